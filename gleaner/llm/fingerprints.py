"""Document fingerprints: a canonical exact digest.

A text is brought to Unicode form NFKC, its case is folded, and its runs of
white space become one space; the canonical text is hashed twice by xxhash64
under different seeds.  Documents are grouped by these 128 bits, and the bytes
of the canonical texts inside each bucket are compared, so a collision cannot
join two texts: where bytes differ, the digest is told apart by a hash of them.
Two texts that differ only in such ways are alike (1.0), any others are not.

All of it is DataFrame expressions; normalisation calls the ICU library that
Spark ships, through the SQL function ``reflect``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, free_names, is_ascii, materialize, shuffle_partitions, table


#: Keys of repeated documents up to which they are sent to every executor.
BROADCAST_KEYS = 1_000_000


def canonical(text: Column) -> Column:
    """NFKC with full case folding (``ß`` is ``ss``), white space folded and trimmed;
    null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), text, F.lit(True))
    nfkc = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), folded, F.lit(True))
    low = F.lower(F.when(is_ascii(text), text).otherwise(nfkc))  # composing may bring back a capital
    return F.trim(F.regexp_replace(low, r"[\s\u0085\u1680\u2028\u2029]+", " "))


def wide_hash(canon: Column) -> Column:
    """Two differently seeded 64-bit hashes as 32 hex digits."""
    half = [F.lpad(F.hex(F.xxhash64(F.lit(seed), canon)), 16, "0") for seed in (1, 2)]
    return F.lower(F.concat(*half))


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of a text column; a column named like ``out`` is replaced.
    Null and empty texts have that of the empty text, very long ones are read
    whole, repeated rows stay, an empty table gives an empty one."""
    return df.withColumn(out, wide_hash(canonical(F.col(text))))


def exact_groups(prints: DataFrame, df: DataFrame, key: str = "doc_id", text: str = "text", group: str = "fingerprint") -> DataFrame:
    """``prints`` (stored rows with the key and the fingerprint of each row of ``df``)
    with ``group_id``, the least key of the documents with the same canonical
    bytes, and ``n_copies``, their number.

    Only documents whose fingerprint occurs more than once are compared (their keys
    are sent to every executor up to ``BROADCAST_KEYS`` of them; beyond, texts are
    moved once to meet them); each
    bucket's least and greatest bytes are compared, pre-aggregated before the
    shuffle, so a bucket of any size costs a row a task.  Buckets with different
    bytes (none, nearly always) are parted by a hash of the bytes.  Null keys
    take part and name a group only if it has no other; repeated rows are copies;
    columns named like the outputs are replaced; an empty table gives an empty one.
    """
    prints = prints.drop(*[c for c in ("group_id", "n_copies") if c not in (key, group)])
    _t, _b, _n, _lo, _hi, _sha = free_names(prints, "_t", "_b", "_n", "_lo", "_hi", "_sha")
    sums = [F.min(key).alias("group_id"), F.count("*").alias("n_copies")]
    groups = prints.groupBy(group).agg(*sums).filter("n_copies > 1")
    repeated = materialize(prints.join(groups, group, "left_semi").select(F.col(key).alias(_n)).distinct())
    texts = df.select(F.col(key).alias(_n), F.col(text).alias(_t))
    few = F.broadcast(repeated) if repeated.count() <= BROADCAST_KEYS else repeated
    bytes_ = (
        texts.join(few, texts[_n].eqNullSafe(repeated[_n]), "left_semi").select(_n, canonical(F.col(_t)).alias(_b))
        .withColumn(group, wide_hash(F.col(_b)))
    )
    bounds = materialize(bytes_.groupBy(group).agg(F.min(_b).alias(_lo), F.max(_b).alias(_hi)).select(group, (F.col(_lo) != F.col(_hi)).alias(_hi)).filter(_hi))
    if bounds.limit(1).count():
        parted = bytes_.join(bounds.select(group), group, "left_semi").select(_n, group, F.sha2(F.col(_b).cast("binary"), 256).alias(_sha)).distinct()
        prints = prints.join(parted, prints[key].eqNullSafe(parted[_n]) & (prints[group] == parted[group]), "left").drop(parted[group]).drop(_n)
        prints = materialize(prints.withColumn(group, F.concat(group, F.coalesce(_sha, F.lit("")))).drop(_sha))
        groups = prints.groupBy(group).agg(*sums).filter("n_copies > 1")
    discard(repeated, bounds)
    return prints.join(groups, group, "left").select(
        *[F.col(c) for c in prints.columns], F.coalesce("group_id", key).alias("group_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def likeness(a: Column, b: Column, canon_a: Column, canon_b: Column) -> Column:
    """1.0 if the fingerprints are equal, and then the bytes too; else 0.0.  Bytes are
    made only where the fingerprints are equal."""
    return F.when(a == b, (canon_a == canon_b).cast("double")).otherwise(F.lit(0.0))


def _order_buckets(df: DataFrame, key: str) -> tuple[Column, int]:
    """An order-preserving bucket number of an integer key: equi-depth knots, and
    linear steps between two knots.  About 16 buckets a shuffle partition."""
    spark = df.sparkSession
    knots = df.agg(F.percentile_approx(key, [i / 128 for i in range(129)], 2000)).first()[0] or []
    knots = sorted(set(knots))
    if not knots:
        return F.lit(0), 1
    sub = max(1, -(-16 * shuffle_partitions(spark) // 128))
    k = F.col(key)
    bounds = F.split(F.lit(",".join(map(str, knots))), ",").cast("array<bigint>")
    i = F.size(F.filter(bounds, lambda b: b <= k))  # 0: below the first knot
    lo = F.get(bounds, i - 1).cast("double")
    width = F.coalesce(F.get(bounds, i).cast("double"), lo) - lo
    step = F.when((i == 0) | (width <= 0), F.lit(0)).otherwise(
        F.floor((k.cast("double") - lo) * sub / width).cast("int"))
    return i * sub + F.least(step, F.lit(sub - 1)), (len(knots) + 1) * sub


def with_next(df: DataFrame, key: str = "doc_id", columns: dict[str, str] | None = None, order: str = "text") -> DataFrame:
    """Adds columns of the next row in descending order of a key (by default
    ``text`` as ``next_text``); after the last comes the first.

    The rows are dealt into ordered buckets and the first row of each bucket is
    lent to the one before it, so one window a bucket suffices: one shuffle.
    Keys that are no whole numbers are null; equal keys follow the column
    ``order``; null keys come last.  Columns named like the outputs are
    replaced, others stay; an empty table gives an empty one.
    """
    columns = columns or {"text": "next_text"}
    df = df.drop(*[c for c in columns.values() if c not in columns and c != key])
    _k, _b, _to, _lent = free_names(df.withColumns({c: F.lit(0) for c in columns.values()}), "_k", "_b", "_to", "_lent")
    rows = df.withColumn(_k, F.coalesce(F.col(key).try_cast("bigint"), F.lit(-(2**63))))
    bucket, _ = _order_buckets(rows, _k)
    rows = rows.withColumn(_b, bucket)
    heads = materialize(rows.groupBy(_b).agg(F.max(_k).alias(_k)))  # at most a row a bucket
    if not heads.limit(1).count():
        discard(heads)
        return df.withColumns({out: F.col(c) for c, out in columns.items()})
    w = W.orderBy(F.desc(_b))
    lent = heads.select(F.coalesce(F.lag(_b).over(w), F.min(_b).over(W.partitionBy())).alias(_to), _k, _b)
    first = (
        rows.join(F.broadcast(lent), [_k, _b])  # as many rows as buckets: 16 a shuffle partition
        .select(F.col(_to).alias(_b), _k, *columns, F.lit(1).alias(_lent))
    )
    both = rows.withColumn(_lent, F.lit(0)).unionByName(first, allowMissingColumns=True)
    over = W.partitionBy(_b).orderBy(_lent, F.desc(_k), order)
    return both.withColumns({out: F.lead(c).over(over) for c, out in columns.items()}).filter(F.col(_lent) == 0).drop(_k, _b, _lent)


def op9_canonical(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # a fingerprint is made where the text is scanned, and moves with it to the row before
    rows = with_next(fingerprint(docs), columns={"text": "next_text", "fingerprint": "next_fingerprint"})
    rows = rows.withColumn("n_chars", F.char_length("text")).withColumn("third", F.floor(F.col("n_chars") / 3).cast("int"))
    rows = rows.withColumn("edited", F.expr("concat(substring(text, 1, n_chars - third), substring(next_text, 1, third))"))
    rows = rows.withColumn("edited_fingerprint", wide_hash(canonical(F.col("edited"))))
    canon = {c: canonical(F.col(c)) for c in ("text", "edited", "next_text")}
    prints = materialize(rows.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), canon["text"], canon["edited"]).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint"), canon["text"], canon["next_text"]).alias("near_next"),
    ))
    return exact_groups(prints, docs)
