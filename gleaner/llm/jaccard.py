"""Exact n-gram Jaccard self-join by universe partition and pigeonhole.

A document is the set of its distinct 5-word shingles.  Sets of like size (a
band of sizes) share a layout: shingles are hashed into segments, and two sets
that differ in H shingles in all agree on some segment of any H + 1, or agree
up to one shingle on a segment that allows one deletion (which then counts
twice).  How many segments a band has, how many of them are published, and
which allow a deletion is chosen by estimated cost.  Segments' contents are
hashed, and sets that publish the same hash are candidates.

Crowded hashes: counts over all documents give each hash its crowd.  A set asks
only for its least crowded segments, as many as the pigeonhole needs; those that
no other set has come first and cost nothing.  The order is the same for all
sets, so the first segment on which two similar sets agree is asked for by both.

Groups: equal sets are one class from the start.  The classes of a hash are
tied to one hub, the smallest, and verified against it; verified links give
components.  Classes under hashes that still join different components are
decided on their remainder, by the finest partition, a shingle a segment: a
class asks for its n - ceil(0.75 n) + 1 least crowded shingles, and two classes
whose first common one is t share exactly what stands behind t in both.  So
classes with the same rest behind t are settled by sizes alone (the smallest of
them decides), and of classes with different ones only those are compared whose
rests are long enough for the threshold: two sets of which less than 6/7 stands
behind t never are.  A passage that many documents share is thus one rest, not
a square of pairs.

Components are found by star contraction in Spark.  Sets whose segments are too
unevenly filled for the guarantee (one in ten million) are compared with all
others in blocks.  Nothing is capped.

Shingles are compared by 64-bit hashes; a set of a million has a chance of
about 3e-8 of holding a colliding pair.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, lean, materialize, shuffle_partitions, table

SHINGLE = 5
#: The threshold, as a fraction of whole numbers: intersection * DEN >= union * NUM.
NUM, DEN = 75, 100
#: Layouts tried: no segment allows a deletion, every one, or one in so many.
DELETION_STEPS = (0, 1, 2, 8)
#: Chance that a set's segments are too unevenly filled, and the same in standard deviations.
UNEVEN, SLACK = 1e-7, 5.2
#: Sizes up to which that chance is computed exactly.
EXACT_SIZES = 127
#: Share of what a set asks for that it should be able to give up.
RESERVE = 0.25
#: What a segment of one shingle, or a hash that can't be given up, costs in hashes beside itself.
DEAR = 4.0
#: Hashes that a worker holds before it sends them on, and hashes a bucket.
HELD, BUCKET = 500_000, 1_000_000
#: Shingles of unevenly filled sets that are compared with all documents in one pass.
BLOCK_SHINGLES = 2_000_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ np.uint64(salt)) * _M1
        h = (h ^ (h >> np.uint64(31))) * _M2
        return h ^ (h >> np.uint64(29))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_STEPS = mix(np.arange(1, 65, dtype=np.uint64), 9) | np.uint64(1)
#: Bytes of text that are hashed at once.
CHUNK = 2_000_000


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of a buffer, eight bytes of each at a time."""
    low = _LOWER[np.frombuffer(data + b" " * 16, np.uint8)]
    white = _WHITE[low]
    edge = np.flatnonzero(np.concatenate([[True], white[:-1]]) != white)
    if not white[0]:
        starts, ends = edge[0::2], edge[1::2]
    else:
        edge = edge[1:] if len(edge) and edge[0] == 0 and white[0] else edge
        starts, ends = edge[0::2], edge[1::2]
    n = ends - starts
    eight = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))
    h = n.astype(np.uint64)
    at, k = np.arange(len(n)), 0
    while len(at):
        left = np.minimum(n[at] - k, 8).astype(np.uint64)
        block = eight[starts[at] + k] & (np.uint64(2**64 - 1) >> (np.uint64(64) - np.uint64(8) * left))
        h[at] = mix(h[at] ^ block, k + 1)
        k += 8
        at = at[n[at] > k]
    return starts, h


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> Iterator[list[np.ndarray]]:
    """For chunks of texts, each one's sorted hashes of distinct shingles.  Words are
    split at ASCII white space, A-Z lower-cased; a text with fewer words is one
    shingle, a text without words has none."""
    chunk, held = [], 0
    for t in texts:
        chunk.append((t or "").encode("utf-8", "surrogatepass"))
        held += len(chunk[-1])
        if held >= CHUNK:
            yield _chunk_sets(chunk, size)
            chunk, held = [], 0
    if chunk:
        yield _chunk_sets(chunk, size)


def _chunk_sets(chunk: list[bytes], size: int) -> list[np.ndarray]:
    starts, h = word_hashes(b" ".join(chunk))
    ends = np.cumsum([len(c) + 1 for c in chunk])
    last = np.searchsorted(starts, ends)
    first = np.concatenate([[0], last[:-1]])
    whole = np.zeros(max(0, len(h) - size + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            whole += h[i: i + len(whole)] * _STEPS[i]
    whole = mix(whole, size)
    out = []
    for a, b in zip(first.tolist(), last.tolist()):
        if b - a >= size:
            x = np.sort(whole[a: b - size + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif b > a:
            with np.errstate(over="ignore"):
                out.append(mix((h[a:b] * _STEPS[: b - a]).sum(keepdims=True), b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


# -- layouts ------------------------------------------------------------------


def apart(a, b):
    """Most shingles in which similar sets of a and b shingles differ."""
    return (a + b) * (DEN - NUM) // (DEN + NUM)


class Layout:
    """How sets of a band of sizes are cut: ``segments``, and whether all, some (one
    in ``every``) or none allow a deletion.

    The larger of two similar sets vouches for their meeting: it has more weight
    in its segments than the two can differ in.  Beyond that a set should have
    ``RESERVE`` more than it asks for, so that it can give up crowded segments."""

    def __init__(self, band: int):
        self.band = band
        self.low, self.high = 1 << band, (1 << (band + 1)) - 1
        self.top = max(self.high, self.high * DEN // NUM)  # with the sets of the next band that may match
        options = [o for every in DELETION_STEPS for o in self._options(every)]
        self.cost, self.every, self.segments = min(options, key=lambda o: o[0])

    def vouched(self, x):
        """The weight that a set of x needs to meet any similar set that is not larger."""
        return apart(x, np.minimum(x, self.high)) + 1

    @staticmethod
    def asked(x):
        """The weight of the segments that a set of x asks for, whichever of a pair is larger."""
        return np.maximum(apart(x, x), x * (DEN - NUM) // NUM) + 1

    @staticmethod
    def _weight(lam, every):
        filled = 1 - np.exp(-lam)
        twice = (filled - lam * np.exp(-lam)) / every if every else 0 * lam
        return filled, twice

    def _enough(self, m: int, every: int) -> bool:
        """Whether m segments suffice for (nearly) every set."""
        if self.high <= EXACT_SIZES and not every:
            x = np.arange(max(self.low, DEN // (DEN - NUM) - 1), self.top + 1)
            return _chance_of_few(x, self.vouched(x) - 1, m) <= UNEVEN
        x = np.unique(np.linspace(self.low, self.top, 24).astype(np.int64))
        lam = x / m
        filled, twice = self._weight(lam, every)
        var = m * np.exp(-lam) * (filled - lam * np.exp(-lam))
        var = var + m * (2 * twice * (1 - filled) + twice * (1 - twice))  # deletions taken as independent: more than it is
        return bool((m * (filled + twice) - SLACK * np.sqrt(var) >= self.vouched(x)).all())

    def _options(self, every: int):
        if every and self.low < 64:  # small sets' segments are too few to tell their spread
            return
        x = np.arange(self.low, self.top + 1)
        own = x <= self.high
        for fullness in (0.01, 0.02, 0.2, 0.35, 0.5, 0.75, 1.0, 1.25, 1.5, 1.75, 2.0, 2.25, 2.5, 3.0, 3.5, 4.0):
            m = max(2, int(self.high / fullness))
            lam = x / m
            filled, twice = self._weight(lam, every)
            reserve = (m * (filled + twice) / self.asked(x))[own].min() >= 1 + RESERVE
            if (fullness > 0.02 and not reserve) or not self._enough(m, every):
                continue
            loose = m * (filled + lam) / every if every else 0 * lam
            hashes = m * filled + (m * lam / every if every else 0)
            single = m * lam * np.exp(-lam)
            # a lone shingle is shared far sooner than several, and what allows a deletion is never given up
            yield (float(((hashes + DEAR * (single + loose)) / x).mean()), every, m)


def _chance_of_few(x: np.ndarray, most: np.ndarray, m: int) -> float:
    """The largest chance, over sizes x, that x shingles fill at most ``most`` of m segments."""
    wanted = dict(zip(x.tolist(), most.tolist()))
    p = np.zeros(int(most.max()) + 2)
    p[0], worst = 1.0, 0.0
    go = np.maximum(m - np.arange(len(p)), 0) / m
    for n in range(1, int(x.max()) + 1):
        moved = p * go
        p -= moved
        p[1:] += moved[:-1]
        if n in wanted:
            worst = max(worst, float(p[: wanted[n] + 1].sum()))
    return worst


@lru_cache(maxsize=64)
def layout(band: int) -> Layout:
    return Layout(band)


def layouts_up_to(size: int) -> dict[int, Layout]:
    """The layouts of all bands of sets of at most ``size`` shingles."""
    return {b: layout(b) for b in range(1, max(2, int(size).bit_length()))}


def _segment_hashes(sets: list[np.ndarray], bands: np.ndarray, layouts: dict[int, Layout]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, which set each is of, whether of a segment with deletions, weight by
    set) under the layouts of ``bands``.

    A segment's content is the sum of its mixed shingles; sums are taken in four
    16-bit parts, which are exact, so nothing is sorted."""
    made = [layouts[int(b)] for b in bands]
    sizes = np.array([len(s) for s in sets])
    m = np.array([x.segments for x in made], np.uint64)
    every = np.array([x.every for x in made], np.int64)
    base = np.concatenate([[0], np.cumsum(m)]).astype(np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat = np.concatenate(sets)
    salt = mix(bands.astype(np.uint64), 77)
    with np.errstate(over="ignore"):
        seg = ((mix(flat ^ salt[owner]) >> np.uint64(32)) * m[owner] >> np.uint64(32)).astype(np.int64)
        tok = mix(flat, 5)
        slot = base[owner] + seg
        count = np.bincount(slot, minlength=base[-1])
        total = np.zeros(base[-1], np.uint64)
        for shift in (0, 16, 32, 48):
            part = (tok >> np.uint64(shift)) & np.uint64(0xFFFF)
            total += np.bincount(slot, part, minlength=base[-1]).astype(np.uint64) << np.uint64(shift)
        full = np.flatnonzero(count)
        of = np.searchsorted(base, full, "right") - 1
        name = mix((full - base[of]).astype(np.uint64) ^ salt[of], 3)
        sig, who = [mix(total[full] ^ name)], [of]
        weight = np.bincount(of, minlength=len(sets))
        step = np.maximum(every, 1)
        loose = (every[of] > 0) & ((full - base[of]) % step[of] == 0)
        fixed = [loose]
        if every.any():
            twice = loose & (count[full] >= 2)
            weight = weight + np.bincount(of[twice], minlength=len(sets))
            rare = (every[owner] > 0) & (seg % step[owner] == 0) & (count[slot] >= 2)
            sig.append(mix((total[slot[rare]] - tok[rare]) ^ mix(seg[rare].astype(np.uint64) ^ salt[owner[rare]], 3)))
            who.append(owner[rare])
            fixed.append(np.ones(int(rare.sum()), bool))
    return np.concatenate(sig), np.concatenate(who), np.concatenate(fixed), weight


#: Bits of a published hash that say something: of the set's own band; of a segment that is never given up.
OWN, FIXED = np.uint64(1), np.uint64(2)
#: A class under one layout: its size, and the weight that it may give up (negative: too little of it).
ENTRY = np.dtype([("c", "<i8"), ("n", "<i4"), ("spare", "<i4"), ("own", "u1"), ("short", "u1")])


def published(sets: list[np.ndarray], layouts: dict[int, Layout]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes with their bits, which set each is of, entries, which set each is of).
    Sets too small to match anything but themselves publish nothing."""
    sizes = np.array([len(s) for s in sets], np.int64)
    ids = np.flatnonzero(sizes >= DEN // (DEN - NUM) - 1)
    out, owner, entries, entry_of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, ENTRY)], [np.zeros(0, np.int64)]
    bands = np.array([int(n).bit_length() - 1 for n in sizes[ids]], np.int64)
    low = (bands > 1) & (-(-sizes[ids] * NUM // DEN) < (1 << bands))
    for own, at, band in ((1, ids, bands), (0, ids[low], bands[low] - 1)):
        if not len(at):
            continue
        sig, who, fixed, weight = _segment_hashes([sets[i] for i in at], band, layouts)
        out.append((sig & ~(OWN | FIXED)) | np.uint64(own) | (FIXED * fixed.astype(np.uint64)))
        owner.append(at[who])
        e = np.zeros(len(at), ENTRY)
        e["n"], e["own"] = sizes[at], own
        e["spare"] = weight - Layout.asked(sizes[at])
        e["short"] = weight < [layouts[int(b)].vouched(n) for b, n in zip(band, sizes[at])]
        entries.append(e)
        entry_of.append(at)
    return np.concatenate(out), np.concatenate(owner), np.concatenate(entries), np.concatenate(entry_of)


def class_of(s: np.ndarray, seed: int) -> tuple[int, int]:
    h = xxhash.xxh128_intdigest(s.tobytes(), seed)
    return (h & (2**64 - 1)) - 2**63, (h >> 64) - 2**63


# -- passes over the documents -------------------------------------------------


def _classes(docs: DataFrame, key: str, text: str, seed: int) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, c, check = [], [], []
            for sets in shingle_sets(batch.column(1).to_pylist()):
                for s in sets:
                    a, b = class_of(s, seed)
                    n.append(len(s))
                    c.append(a)
                    check.append(b)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(check, pa.int64())], names=[key, "n", "c", "chk"])

    return docs.select(key, text).mapInArrow(lean(run), f"`{key}` {kind}, n long, c long, chk long")


#: A hash (40 bits beside its bucket; what they confuse, verification parts) and a class.
PAIR = np.dtype([("hi", "u1"), ("lo", "<u4"), ("c", "<i8")])
#: A whole shingle and a class.
WIDE = np.dtype([("sig", "<u8"), ("c", "<i8")])
#: A hash that more than one class has, with the number of them and their hub, one of the hash's own band.
HIT = np.dtype([("c", "<i8"), ("sig", "<u8"), ("k", "<u4"), ("hub", "<i8")])


def _deal(rows: np.ndarray, bucket: np.ndarray, entries: bool) -> pa.RecordBatch:
    """Packed rows, one binary value a bucket."""
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    ends = np.concatenate([cut[1:], [len(bucket)]])
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[cut].astype(np.int32)), pa.array([rows[i:j].tobytes() for i, j in zip(cut, ends)], pa.binary()), pa.array(np.full(len(cut), entries))],
        names=["bucket", "data", "entries"])


def _class_bucket(c: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(c.view(np.uint64), 13) % np.uint64(buckets)).astype(np.int32)


PACKED = "bucket int, data binary, entries boolean"


def _publications(docs: DataFrame, text: str, seed: int, buckets: int, layouts: dict[int, Layout]) -> DataFrame:
    """Rows (bucket, data, entries): packed (hash, class) pairs dealt by hash, and
    packed entries dealt by class.  A class is sent once of those held at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], []]
        seen: set[int] = set()

        def flush():
            sig, c, entries = [np.concatenate(x) for x in held]
            for x in held:
                x.clear()
            seen.clear()
            pairs = np.empty(len(sig), PAIR)
            pairs["hi"], pairs["lo"], pairs["c"] = (sig >> np.uint64(32)) & np.uint64(0xFF), sig & np.uint64(0xFFFFFFFF), c
            yield _deal(pairs, ((sig >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32), False)
            yield _deal(entries, _class_bucket(np.ascontiguousarray(entries["c"]), buckets), True)

        for batch in batches:
            for sets in shingle_sets(batch.column(0).to_pylist()):
                c = np.array([class_of(s, seed)[0] for s in sets], np.int64)
                new = []
                for i, x in enumerate(c.tolist()):
                    if x not in seen:
                        seen.add(x)
                        new.append(i)
                if not new:
                    continue
                c = c[new]
                sig, who, entries, of = published([sets[i] for i in new], layouts)
                entries["c"] = c[of]
                held[0].append(sig)
                held[1].append(c[who])
                held[2].append(entries)
                if sum(map(len, held[0])) > HELD:
                    yield from flush()
        if held[0]:
            yield from flush()

    return docs.select(text).mapInArrow(lean(run), PACKED)


def _shingle_publications(sets: DataFrame, buckets: int) -> DataFrame:
    """The same under the finest partition: every shingle of the classes (c, s)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(1)]
            if not rows:
                continue
            c, n = batch.column(0).to_numpy().astype(np.int64), np.array([len(x) for x in rows], np.int64)
            entries = np.zeros(len(rows), ENTRY)
            entries["c"], entries["n"], entries["own"] = c, n, 1
            entries["spare"] = -(-n * NUM // DEN) - 1  # all but n - ceil(0.75 n) + 1
            yield _deal(entries, _class_bucket(c, buckets), True)
            ends = np.cumsum(n)
            at = 0
            while at < len(rows):  # as many sets at a time as hold HELD shingles
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HELD, "right")))
                pairs = np.empty(int(n[at:to].sum()), WIDE)
                pairs["sig"], pairs["c"] = np.concatenate(rows[at:to]), np.repeat(c[at:to], n[at:to])
                yield _deal(pairs, (mix(np.ascontiguousarray(pairs["sig"]), 21) % np.uint64(buckets)).astype(np.int32), False)
                at = to

    return sets.select("c", "s").mapInArrow(lean(run), PACKED)


def _by_bucket(packed: DataFrame, buckets: int) -> DataFrame:
    """Buckets whole and one after the other in their tasks, which so hold one at a time."""
    return packed.repartition(min(buckets, 4 * shuffle_partitions(packed.sparkSession)), "bucket").sortWithinPartitions("bucket")


def _buckets_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list, list]]:
    """(bucket, its binary values, its values with entries) of rows sorted by bucket."""
    now, plain, entries = None, [], []
    for batch in batches:
        for b, d, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if b != now:
                if now is not None:
                    yield now, plain, entries
                now, plain, entries = b, [], []
            (entries if e else plain).append(d)
    if now is not None:
        yield now, plain, entries


def _shared(pubs: DataFrame, buckets: int, wide: bool) -> DataFrame:
    """Packed hits, dealt by class: the hashes that more than one class published (one
    of them under its own band), and how many.  Entries pass through."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        passed: list[np.ndarray] = []

        def flush():
            for x, entries in ((held, False), (passed, True)):
                if x:
                    rows = np.concatenate(x)
                    x.clear()
                    yield _deal(rows, _class_bucket(np.ascontiguousarray(rows["c"]), buckets), entries)

        for b, plain, entries in _buckets_of(batches):
            passed += [np.frombuffer(d, ENTRY) for d in entries]
            if plain:
                pairs = np.frombuffer(b"".join(plain), WIDE if wide else PAIR)
                plain.clear()
                held.append(_crowds(pairs, b, buckets, wide))
            if sum(map(len, held)) + sum(map(len, passed)) > HELD:
                yield from flush()
        yield from flush()

    return _by_bucket(pubs, buckets).mapInArrow(lean(run), PACKED)


def _crowds(pairs: np.ndarray, b: int, buckets: int, wide: bool) -> np.ndarray:
    """The hits of one bucket's pairs."""
    c = pairs["c"].astype(np.int64)
    if wide:
        sig = name = pairs["sig"].astype(np.uint64)
        bits = np.full(len(sig), OWN)
    else:
        code = (pairs["hi"].astype(np.uint64) << np.uint64(32)) | pairs["lo"].astype(np.uint64)
        bits = code & (OWN | FIXED)
        name = code >> np.uint64(2)
        sig = ((name * np.uint64(buckets) + np.uint64(b)) << np.uint64(2)) | bits
    order = np.argsort(name, kind="stable")
    same = name[order]
    near = np.concatenate([same[1:] == same[:-1], [False]])
    order = order[near | np.concatenate([[False], near[:-1]])]  # only hashes that occur again
    order = order[np.lexsort((c[order], ~bits[order] & OWN, name[order]))]
    name, sig, bits, c = name[order], sig[order], bits[order], c[order]
    if not len(name):
        return np.zeros(0, HIT)
    first = np.concatenate([[True], (name[1:] != name[:-1]) | (c[1:] != c[:-1])])
    name, sig, bits, c = name[first], sig[first], bits[first], c[first]
    head = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
    k = np.diff(np.concatenate([head, [len(name)]]))
    owned = (bits[head] & OWN) > 0  # those of the own band come first
    many = np.repeat((k > 1) & owned, k)
    hits = np.empty(int(many.sum()), HIT)
    hits["c"], hits["sig"], hits["hub"] = c[many], sig[many], np.repeat(c[head], k)[many]
    hits["k"] = np.minimum(np.repeat(k, k)[many], 2**32 - 1)
    return hits


def _asked(hits: DataFrame, buckets: int, wide: bool) -> DataFrame:
    """What classes ask for: all their shared hashes but as many of the most crowded as
    they can spare.

    Of segments: rows (c, hub, times), the hubs that a class meets.  Entries
    that are short of weight give a row without hub.  Of single shingles: rows
    (c, n, t, rest, h), where ``rest`` names the shared ones from t on, in the
    order of asking, and h is their number."""

    def rows(**columns):
        n = len(next(iter(columns.values())))
        for i in range(0, n, 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i: i + 100_000]) for x in columns.values()], names=list(columns))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, plain, entries in _buckets_of(batches):
            e = np.frombuffer(b"".join(entries), ENTRY)
            e = e[np.lexsort((e["own"], e["c"]))]
            e = e[np.concatenate([[True], (e["c"][1:] != e["c"][:-1]) | (e["own"][1:] != e["own"][:-1])])] if len(e) else e
            short = np.unique(e["c"][e["short"] > 0].astype(np.int64))
            if len(short):
                none = pa.nulls(len(short), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(short), none, none], names=["c", "hub", "times"])
            if not plain:
                continue
            x = np.frombuffer(b"".join(plain), HIT)
            plain.clear()
            c, sig, k = x["c"].astype(np.int64), x["sig"].astype(np.uint64), x["k"].astype(np.int64)
            own, fixed = np.ones(len(c), bool), np.zeros(len(c), bool)
            if not wide:
                own, fixed, sig = (sig & OWN) > 0, (sig & FIXED) > 0, sig >> np.uint64(2)
            order = np.lexsort((sig, k, ~fixed, own, c))
            c, sig, own, fixed, hub = c[order], sig[order], own[order], fixed[order], x["hub"][order].astype(np.int64)
            at = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (own[1:] != own[:-1])]))
            size = np.diff(np.concatenate([at, [len(c)]]))
            place = np.arange(len(c)) - np.repeat(at, size)
            i = np.searchsorted(e["c"].astype(np.int64), c[at])  # the entry of each group
            i = i + (own[at] & (e["own"][i] == 0))
            spare, n = e["spare"][i].astype(np.int64), e["n"][i].astype(np.int64)
            ask = fixed | (place < np.repeat(size - np.maximum(spare, 0), size))
            if wide:
                with np.errstate(over="ignore"):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sig, 31))])
                    rest = (np.repeat(total[at + size], size) - total[:-1]).view(np.int64)
                yield from rows(c=c[ask], n=np.repeat(n, size)[ask], t=sig.view(np.int64)[ask], rest=rest[ask], h=(np.repeat(size, size) - place)[ask])
                continue
            c, hub = c[ask], hub[ask]
            order = np.lexsort((hub, c))
            c, hub = c[order], hub[order]
            at = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (hub[1:] != hub[:-1])])) if len(c) else np.zeros(0, np.int64)
            yield from rows(c=c[at], hub=hub[at], times=np.diff(np.concatenate([at, [len(c)]])))

    return _by_bucket(hits, buckets).mapInArrow(lean(run), "c long, n long, t long, rest long, h long" if wide else "c long, hub long, times long")


#: Ids (or pairs of them) up to which they are sent to every executor.
BROADCAST_ROWS = 200_000


def _sets(docs: DataFrame, key: str, text: str, seed: int, wanted: DataFrame) -> DataFrame:
    """Rows (c, s): the packed shingles of the classes' representatives."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sets in shingle_sets(batch.column(0).to_pylist()):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([class_of(s, seed)[0] for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["c", "s"])

    ids = materialize(wanted.distinct())
    # rows that repeat a representative's key give its class again; what is made of them is made distinct
    return docs.select(key, text).join(_small(ids), key, "left_semi").select(text).mapInArrow(lean(run), "c long, s binary")


def _small(stored: DataFrame) -> DataFrame:
    """A stored table of ids, to be sent to every executor if it is small."""
    return F.broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b):
        return False
    if min(len(a), len(b)) * DEN < max(len(a), len(b)) * NUM:
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both * DEN >= (len(a) + len(b) - both) * NUM


def _verified(pairs: DataFrame, sets: DataFrame, stored: list) -> DataFrame:
    """Those of the pairs (a, b) that are similar.  ``a`` may be in many pairs: its
    shingles come last, so that they are not moved with each."""
    pairs = materialize(pairs)
    hubs = materialize(pairs.select(F.col("a").alias("c")).distinct())
    stored += [pairs, hubs]
    full = (
        sets.select(F.col("c").alias("b"), F.col("s").alias("sb")).join(_small(pairs), "b")
        .join(sets.join(_small(hubs), "c", "left_semi").select(F.col("c").alias("a"), F.col("s").alias("sa")), "a")
        .select("a", "b", "sa", "sb")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return full.mapInArrow(lean(run), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """Rows (c, root): for every end of a link the least class that it reaches.

    Alternating large-star and small-star contraction; each round is stored, and
    the rounds end when the links no longer change.
    """
    now = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        new = materialize(small.filter("u <> v").distinct())
        seen = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        now = new
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    roots = now.select(F.col("u").alias("c"), F.col("v").alias("root"))
    out = materialize(roots.unionByName(now.select(F.col("v").alias("c"), F.col("v").alias("root")).distinct()))
    discard(now)
    return out


def _uneven_links(docs: DataFrame, text: str, seed: int, tokens: np.ndarray, owner: np.ndarray, sizes: dict[int, int]) -> DataFrame:
    """Links of a block of sets, given as sorted shingles with their classes, to all documents."""
    shared = docs.sparkSession.sparkContext.broadcast((tokens, owner, sizes))  # at most BLOCK_SHINGLES, and a set

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, who, n = shared.value
        for batch in batches:
            a, b = [], []
            for sets in shingle_sets(batch.column(0).to_pylist()):
                for s in sets:
                    lo, hi = np.searchsorted(tokens, s), np.searchsorted(tokens, s, "right")
                    hit = np.flatnonzero(hi > lo)
                    if not len(hit):
                        continue
                    found, times = np.unique(np.concatenate([who[lo[i]: hi[i]] for i in hit]), return_counts=True)
                    mine = class_of(s, seed)[0]
                    for f, k in zip(found.tolist(), times.tolist()):
                        if f != mine and k * DEN >= (n[f] + len(s) - k) * NUM:
                            a.append(f)
                            b.append(mine)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return docs.select(text).mapInArrow(lean(run), "a long, b long").distinct()


def _alike(n, m):
    """Whether sets of n and m shingles can be similar at all."""
    return (n * DEN >= m * NUM) & (m * DEN >= n * NUM)


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_shingles, component_id), one for each row of ``docs``.

    component_id is the least key that links lead to; documents without words
    are linked with nothing.  Null texts count as empty, null keys never name a
    component that has another key; repeated rows stay; very long texts are taken
    whole; other columns are not looked at.  An empty table gives an empty one.
    """
    spark = docs.sparkSession
    for seed in range(8):
        members = materialize(_classes(docs, key, text, seed))
        classes = materialize(members.groupBy("c").agg(F.min(key).alias("rep"), F.max("n").alias("n"), (F.min("chk") != F.max("chk")).alias("clash")))
        if not classes.filter("clash").limit(1).count():
            break
        discard(members, classes)  # two sets of one class number: number them anew
    else:
        raise RuntimeError("different sets have one class number under every seed")
    most, total = classes.agg(F.max("n"), F.sum("n")).first()
    layouts = layouts_up_to(most or 1)
    buckets = max(shuffle_partitions(spark), (total or 0) // BUCKET)
    pubs = _publications(docs, text, seed, buckets, layouts)
    told = materialize(_asked(_shared(pubs, buckets, False), buckets, False))
    short = told.filter("hub is null").select("c")
    ways = told.filter("hub is not null")
    stored = [members, classes, told]
    reps = classes.select("c", F.col("rep").alias(key))
    alone = ways.groupBy("hub").agg(F.count("*").alias("k"), F.min("c").alias("c")).filter("k = 1 and c = hub").select("hub")
    ways = materialize(ways.join(alone, "hub", "left_anti"))  # a hub that no other class asks for is met by none
    seen = ways.select("c").unionByName(ways.select(F.col("hub").alias("c"))).distinct()
    sets = materialize(_sets(docs, key, text, seed, seen.join(reps, "c").select(key)))
    # each class and the hub with which it shares most
    tried = ways.filter("c <> hub").groupBy("c").agg(F.max(F.struct("times", "hub")).alias("x")).select(F.col("x.hub").alias("a"), F.col("c").alias("b"))
    links = materialize(_verified(tried, sets, stored))
    stored += [ways, sets, links]
    extra = _block_links(docs, key, text, seed, short.join(classes, "c"))
    if extra is not None:
        links = links.unionByName(extra)
    roots = components(links)
    stored.append(roots)
    # the classes that meet where different components meet
    r = roots.select(F.col("c").alias("hub"), F.col("root").alias("hub_root"))
    split = ways.join(roots, "c", "left").join(r, "hub", "left").filter(F.coalesce("root", "c") != F.coalesce("hub_root", "hub")).select("hub").distinct()
    rest = materialize(ways.join(split, "hub", "left_semi").select("c").distinct())
    stored.append(rest)
    if rest.limit(1).count():
        roots = _settled(sets.join(_small(rest), "c", "left_semi"), links, roots, sets, stored)
    labels = classes.join(roots, "c", "left").select("c", "n", "rep", F.coalesce("root", "c").alias("root"))
    best = labels.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = materialize(labels.join(best, "root").select("c", "component_id"))
    empty = F.col("n") == 0
    out = materialize(members.join(named, "c", "left").select(
        key, F.col("n").alias("n_shingles"), F.when(empty, F.col(key)).otherwise(F.col("component_id")).alias("component_id")))
    discard(*stored, named, *([extra] if extra is not None else []))
    return out


def _settled(rest: DataFrame, links: DataFrame, roots: DataFrame, sets: DataFrame, stored: list) -> DataFrame:
    """The components with the links among the classes ``rest`` (c, s) that their hubs
    have left open, by the finest partition."""
    buckets = shuffle_partitions(rest.sparkSession)
    asked = materialize(_asked(_shared(_shingle_publications(rest, buckets), buckets, True), buckets, True))
    stored.append(asked)
    both = F.lit(NUM + DEN)

    def rooted(roots):
        return asked.join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))

    here = materialize(rooted(roots))
    stored.append(here)
    # classes that share all behind t, and the smallest of them: their sizes decide
    least = here.groupBy("t", "rest").agg(F.min(F.struct("n", "c", "root")).alias("x"), F.count("*").alias("k")).filter("k > 1")
    sure = here.join(least, ["t", "rest"]).filter(
        (F.col("root") != F.col("x.root")) & ((F.col("n") + F.col("x.n")) * NUM <= both * F.col("h"))
    ).select(F.col("x.c").alias("a"), F.col("c").alias("b")).distinct()
    # and the class of which the largest part stands behind t
    part = F.struct((F.col("h") / F.col("n")).alias("part"), "c", "n", "h", "root")
    hub = here.groupBy("t").agg(F.max(part).alias("x"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("t", "x")
    likely = here.join(hub, "t").filter(
        (F.col("root") != F.col("x.root")) & ((F.col("n") + F.col("x.n")) * NUM <= both * F.least("h", "x.h"))
    ).select(F.col("x.c").alias("a"), F.col("c").alias("b")).distinct()
    more = materialize(_verified(likely, sets, stored).unionByName(sure))
    stored.append(more)
    links = links.select("a", "b").unionByName(more)
    if more.limit(1).count():
        roots = components(links)
        stored.append(roots)
        here = materialize(rooted(roots))
        stored.append(here)
    # of each component the smallest class with each rest; ``most``: the largest partner that the rest allows
    ends = here.groupBy("t", "rest", "root").agg(F.min(F.struct("n", "c")).alias("x"), F.max("h").alias("h")).select(
        "t", "root", F.col("x.c").alias("c"), F.col("x.n").alias("n"), (F.floor(F.col("h") * both / NUM) - F.col("x.n")).alias("most"))
    split = ends.groupBy("t").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("t")
    ends = materialize(ends.join(split, "t", "left_semi"))
    stored.append(ends)
    x = ends.filter("most >= n").select("t", *[F.col(c).alias(f"{c}_x") for c in ("root", "c", "n", "most")])
    pairs = x.join(ends, "t").filter(
        (F.col("root") != F.col("root_x")) & (F.col("n") <= F.col("most_x")) & (F.col("n_x") <= F.col("most")) & _alike(F.col("n"), F.col("n_x"))
    ).select(F.least("c", "c_x").alias("a"), F.greatest("c", "c_x").alias("b")).distinct()
    last = materialize(_verified(pairs, sets, stored))
    stored.append(last)
    if last.limit(1).count():
        roots = components(links.unionByName(last))
        stored.append(roots)
    return roots


def _block_links(docs: DataFrame, key: str, text: str, seed: int, uneven: DataFrame) -> DataFrame | None:
    """Links of unevenly filled sets, in blocks of bounded size against all documents."""
    todo = uneven.select("rep", "n").toLocalIterator()
    out, block, held = None, [], 0

    def run(block: list) -> DataFrame:
        wanted = docs.sparkSession.createDataFrame([(x,) for x in block], f"`{key}` {docs.schema[key].dataType.simpleString()}")
        rows = _sets(docs, key, text, seed, wanted).collect()  # at most BLOCK_SHINGLES, and a set
        tokens = [np.frombuffer(r.s, np.uint64) for r in rows]
        flat = np.concatenate(tokens)
        who = np.repeat(np.array([r.c for r in rows], np.int64), [len(t) for t in tokens])
        by = np.argsort(flat, kind="stable")
        return materialize(_uneven_links(docs, text, seed, flat[by], who[by], {r.c: len(t) for r, t in zip(rows, tokens)}))

    for r in todo:
        block.append(r.rep)
        held += r.n
        if held >= BLOCK_SHINGLES:
            part = run(block)
            out = part if out is None else out.unionByName(part)
            block, held = [], 0
    if block:
        part = run(block)
        out = part if out is None else out.unionByName(part)
    return out


def op8_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
