"""Best-fit packing of token sequences by large-item matching.

Documents are cut only where they exceed the capacity.  A piece longer than a
third of the capacity is large: at most two fit into a sequence, so large
pieces are matched greedily, the longest with the longest that still fits.
The smaller pieces then go, longest first, each into the smallest gap that
holds it.

How it scales: the plan depends only on how many pieces there are of each
length, a histogram of at most ``capacity`` numbers.  It is made from that
histogram for whole runs of equal pieces at once ("the next 812 pieces of
length 700 go to sequences 5000..5811 at offset 1300"), and the pieces find
their places by their rank among those of their length.  Ranks are taken in
many small groups (length, spread) whose sizes are summed up, so neither a
frequent length nor the whole table meets in one task.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_names, lean, materialize, shuffle_partitions, table, worker_state

CAPACITY = 2048
#: Letter runs and marks whose ids a worker keeps, before it starts anew.
CACHE_PIECES = 800_000
#: How the tokenizer parts text before it merges: letters, single digits, other marks.
ASCII_PIECES = re.compile(r"[a-z]+|[0-9]|[^a-z0-9\s]+")
LETTER_PIECES = re.compile(r"[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+")
#: The same for texts whose characters beyond ASCII are all letters, by ranges.
PLAIN_PIECES = re.compile(r"[a-zA-Z\x80-\U0010ffff]+|[0-9]|[^a-zA-Z0-9\x80-\U0010ffff\s]+")
#: Characters that are not lower-cased one by one in the same way everywhere.
WIDE = re.compile("[^\x00-\u017f]")


class PieceIds(dict):
    """The ids, as little-endian bytes, of each piece of text that was seen."""

    def __init__(self, path: str, limit: int = CACHE_PIECES):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.by_pieces = parts_by_class(self.tokenizer)
        self.merge = self.tokenizer.model.tokenize
        self.by_merges = self.by_pieces and merges_bytes(self)

    def encode(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join([x.to_bytes(4, "little") for x in ids])

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        out = self.merged(piece) if self.by_merges and simple(piece) else self.encode(piece)
        if len(piece) <= 64:
            self[piece] = out
        return out

    def merged(self, piece: str) -> bytes:
        """The ids of one simple piece by the model alone: the tokenizer would only
        lower-case it and write its bytes as characters."""
        low = piece.lower()
        if not low.isascii():
            low = low.encode().decode("latin-1").translate(BYTE_CHARS)
        return b"".join([x.id.to_bytes(4, "little") for x in self.merge(low)])

    def text(self, text: str) -> bytes:
        """As the tokenizer encodes the whole text.

        It drops white space, lower-cases, and never merges across the pieces
        above, so a text's ids are its pieces' ids in order.  Apostrophes (which
        may part contractions), "<|" (special tokens) and non-ASCII characters
        other than letters send the words that have them to the tokenizer as
        they are; characters that only Python counts as white space, the text.
        """
        if not self.by_pieces or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self.encode(text)
        if plain(text):
            return self.pieces(text)
        return b"".join([self.pieces(w) if plain(w) else self[w] for w in text.split()])

    def pieces(self, text: str) -> bytes:
        if text.isascii():
            found = ASCII_PIECES.findall(text.lower())
        else:
            found = PLAIN_PIECES.findall(text if WIDE.search(text) else text.lower())
        return b"".join(map(self.__getitem__, found))


#: Words on which a tokenizer must agree with its pieces before it is trusted to.
PROBE = "Ab c9d10 e.f--g  H\n\tñandú ÉTÉ x_y 12,5 (z) #a1b2 straße ... A1B2"


def parts_by_class(tokenizer) -> bool:
    """Whether a tokenizer lower-cases, drops white space and never merges letters,
    single digits and marks: else whole texts go to it."""
    same = lambda a, b: tokenizer.encode(a, add_special_tokens=False).ids == [
        i for x in b for i in tokenizer.encode(x, add_special_tokens=False).ids]
    low = PROBE.lower()
    return same(PROBE, [low]) and same(PROBE, LETTER_PIECES.findall(low)) and all(same(w, LETTER_PIECES.findall(w.lower())) for w in PROBE.split())


def byte_chars() -> dict[int, int]:
    """The character that stands for each byte in byte-level vocabularies."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: b for b in kept} | {b: 0x100 + n for n, b in enumerate(b for b in range(0x100) if b not in kept)}


BYTE_CHARS = byte_chars()


def only_letters(c: str) -> bool:
    """A letter, and still letters once it is lower-cased and composed."""
    return c.isalpha() and unicodedata.normalize("NFC", c.lower()).isalpha()


#: Printable ASCII and composed Latin letters, which all versions of Unicode class and
#: lower-case alike; what needs more goes to the tokenizer.
SIMPLE_PIECE = re.compile(r"[!-&(-~]+|[A-Za-z%s]+" % "".join(c for c in map(chr, range(0x80, 0x180)) if only_letters(c)))


def simple(piece: str) -> bool:
    return SIMPLE_PIECE.fullmatch(piece) is not None and "<|" not in piece


def merges_bytes(ids: PieceIds) -> bool:
    """Whether the model alone gives the tokenizer's ids for every simple character,
    alone and between its like, and for the probe's pieces."""
    chars = [c for c in map(chr, range(0x21, 0x180)) if simple(c)]
    pieces = [w for c in chars for w in (c, f"x{c}y" if c.isalpha() else f"%{c}-") if simple(w) and LETTER_PIECES.fullmatch(w)]
    try:
        return all(ids.merged(w) == ids.encode(w) for w in pieces + [w for w in LETTER_PIECES.findall(PROBE) if simple(w)])
    except Exception:  # a model that can't be asked for single pieces
        return False


def plain(text: str) -> bool:
    if "'" in text or "<|" in text:
        return False
    return text.isascii() or all(c < "\x80" or only_letters(c) for c in set(text))


def token_pieces(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text",
                 capacity: int = CAPACITY, end_id: int = 0, cache_pieces: int = CACHE_PIECES) -> DataFrame:
    """Rows (key, piece, start, length, ids_crc32): each text's ids and ``end_id``,
    cut into pieces of ``capacity``.  A null text has just ``end_id``."""
    kind = df.schema[key].dataType.simpleString()
    state = f"pieces {tokenizer_path} {cache_pieces}"

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = worker_state(state, lambda: PieceIds(tokenizer_path, cache_pieces))
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            keys, piece, start, length, crc = [], [], [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = ids.text(t.as_py() or "") + end
                view = memoryview(data)
                for n, i in enumerate(range(0, len(data), 4 * capacity)):
                    part = view[i: i + 4 * capacity]
                    keys.append(k)
                    piece.append(n)
                    start.append(i // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, batch.schema.field(0).type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=[key, "piece", "start", "length", "ids_crc32"])

    return df.select(key, text).mapInArrow(
        lean(cut, state), f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, from_rank, to_rank, bin, offset): equal pieces with ranks
    a..b go to bins bin..bin+b-a at one offset.

    Works on runs of equal bins, split only where a run of pieces ends, so its
    size follows the number of lengths and not of pieces.
    """
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError("a piece must have 1 to capacity tokens")
    runs: list[tuple[int, int, int, int, int]] = []
    left = {n: c for n, c in counts.items() if c}
    rank = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first bin, bins)
    order: list[int] = []  # the gaps in use, sorted
    bins = 0

    def place(n: int, m: int, first: int, offset: int) -> None:
        runs.append((n, rank[n], rank[n] + m, first, offset))
        rank[n] += m
        left[n] -= m

    def add_gap(gap: int, first: int, m: int) -> None:
        if gap:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((first, m))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    ascending = large[::-1]
    for n in large:
        while left[n]:
            i = bisect.bisect_right(ascending, min(n, capacity - n)) - 1
            while i >= 0 and not left[ascending[i]]:
                ascending.pop(i)
                i -= 1
            other = ascending[i] if i >= 0 else None
            if other is None or (other == n and left[n] == 1):
                j = i - 1 if other is not None else -1
                while j >= 0 and not left[ascending[j]]:
                    j -= 1
                other = ascending[j] if j >= 0 else None
            if other is None:
                m = left[n]
                place(n, m, bins, 0)
                add_gap(capacity - n, bins, m)
            else:
                m = left[n] // 2 if other == n else min(left[n], left[other])
                place(n, m, bins, 0)
                place(other, m, bins, n)
                add_gap(capacity - n - other, bins, m)
            bins += m
    for n in sorted((n for n in left if left[n] and 3 * n <= capacity), reverse=True):
        while left[n]:
            i = bisect.bisect_left(order, n)
            if i == len(order):
                m = -(-left[n] // (capacity // n))
                add_gap(capacity, bins, m)
                bins += m
                continue
            gap = order[i]
            first, m = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(i)
            take = min(m, left[n])
            if take < m:
                add_gap(gap, first + take, m - take)
            place(n, take, first, capacity - gap)
            add_gap(gap - n, first, take)
    return runs


def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY, spread: list[str] | None = None) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a token count.

    ``pieces`` should be a stored table: it is read twice.  ``spread`` names the
    columns that tell rows apart (default: all).  Repeated rows each get a place,
    equal lengths are taken in the order of ``spread``, no rows give no rows.
    Columns named like the outputs are replaced, others stay as they are.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop(*[c for c in ("sequence_id", "offset") if c != length])
    spread = spread or pieces.columns
    _s, _rank, _n, _base, _runs, _run = free_names(pieces, "_s", "_rank", "_n", "_base", "_runs", "_run")
    n_spread = 8 * shuffle_partitions(spark)
    dealt = pieces.withColumn(_s, F.pmod(F.xxhash64(*spread), F.lit(n_spread)))
    sizes = materialize(dealt.groupBy(F.col(length).alias(_n), _s).agg(F.count("*").alias(_base)))
    counts = {r[0]: r[1] for r in sizes.groupBy(_n).agg(F.sum(_base)).collect()}  # at most capacity rows
    runs = plan_bins(counts, capacity)
    bases = sizes.select(_n, _s, (F.sum(_base).over(W.partitionBy(_n).orderBy(_s)) - F.col(_base)).alias(_base))
    ranked = dealt.withColumn(_rank, F.row_number().over(W.partitionBy(length, _s).orderBy(*spread)) - 1)
    placed = ranked.join(bases.withColumnRenamed(_n, length), [length, _s]).withColumn(_rank, F.col(_rank) + F.col(_base))
    by_length: dict[int, list] = {}
    for n, a, b, first, offset in runs:
        by_length.setdefault(n, []).append((a, b, first, offset))
    plan = spark.createDataFrame(
        [(n, sorted(x)) for n, x in by_length.items()], f"`{length}` long, `{_runs}` array<struct<a:bigint,b:bigint,first:bigint,offset:bigint>>")
    run = F.filter(_runs, lambda r: (r["a"] <= F.col(_rank)) & (F.col(_rank) < r["b"]))[0]
    return (
        placed.join(F.broadcast(plan), length)  # a row a length: at most capacity
        .withColumn(_run, run)
        .select(*pieces.columns, (F.col(_run)["first"] + F.col(_rank) - F.col(_run)["a"]).alias("sequence_id"), F.col(_run)["offset"].alias("offset"))
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
                   cache_pieces: int = CACHE_PIECES) -> DataFrame:
    """Tokenizes and packs; see :func:`token_pieces` and :func:`pack`.  Null keys
    and repeated rows keep their own pieces; very long texts are cut, null and
    empty ones are the end token alone; other columns are not looked at; no rows
    give no rows."""
    pieces = materialize(token_pieces(docs, tokenizer_path, key, text, capacity, cache_pieces=cache_pieces))
    return pack(pieces, "length", capacity, [key, "piece", "ids_crc32"])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_largeitem(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), default_tokenizer())
