"""Hash rings, MinHash, LSH, similarity graphs and spanning trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hash_shard(key: Column, shards: int) -> Column:
    """By the first 32 bits of md5: the same in every process."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int")


def ring(spark: SparkSession, shards: int, vnodes: int = 150) -> DataFrame:
    """Rows (node, shard): virtual nodes at fixed-width md5 hex."""
    return spark.range(shards).select(F.col("id").cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))).alias("v")).select(
        F.md5(F.concat(F.lit("shard-"), F.col("shard").cast("string"), F.lit("-"), F.col("v").cast("string")).cast("binary")).alias("node"), "shard")


def ring_shard(df: DataFrame, key: str, shards: int, vnodes: int = 150) -> DataFrame:
    """Adds ``shard``: that of the first node at or after md5(key), or of the first
    of all.  The ring, ``shards * vnodes`` nodes, is a constant of the plan."""
    nodes = sorted((r.node, r.shard) for r in ring(df.sparkSession, shards, vnodes).collect())
    names = F.split(F.lit(",".join(n for n, _ in nodes)), ",")
    owners = F.split(F.lit(",".join(str(s) for _, s in nodes)), ",")
    h = F.md5(F.col(key).cast("string").cast("binary"))

    def halve(s, _):
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        less, go = F.get(names, mid) < h, s["lo"] < s["hi"]
        return F.struct(F.when(go & less, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(go & ~less, mid).otherwise(s["hi"]).alias("hi"))

    at = F.aggregate(F.sequence(F.lit(0), F.lit(len(nodes).bit_length())), F.struct(F.lit(0).alias("lo"), F.lit(len(nodes)).alias("hi")), halve, lambda s: F.pmod(s["lo"], F.lit(len(nodes))))
    return df.withColumn("shard", F.get(owners, at).cast("int"))


def rebalanced(df: DataFrame, key: str, shards: int, new_shards: int) -> DataFrame:
    """Rows (key, shard, new_shard) that move when the ring's number of shards changes."""
    was = ring_shard(df.select(key), key, shards).withColumnRenamed("shard", "_was")
    return ring_shard(was, key, new_shards).filter("_was <> shard").select(key, F.col("_was").alias("shard"), F.col("shard").alias("new_shard"))


def neighbours(edges: DataFrame, least: float = 0.0) -> DataFrame:
    """Rows (node, neighbour, similarity, rank): each node's neighbours, most alike first."""
    near = edges.filter(F.col("similarity") > least)
    both = near.select(F.col("a").alias("node"), F.col("b").alias("neighbour"), "similarity").unionByName(
        near.select(F.col("b").alias("node"), F.col("a").alias("neighbour"), "similarity"))
    return both.withColumn("rank", F.row_number().over(W.partitionBy("node").orderBy(F.desc("similarity"), "neighbour")))


def seeded_hash(value: Column, seed: Column) -> Column:
    """The first four bytes, little-endian, of SHA-256 of ``seed:value``: read big-endian, then swapped as a number."""
    x = F.conv(F.substring(F.sha2(F.concat_ws(":", seed.cast("string"), value).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return (F.shiftleft(x.bitwiseAND(0xFF), 24) + F.shiftleft(x.bitwiseAND(0xFF00), 8)
            + F.shiftright(x, 8).bitwiseAND(0xFF00) + F.shiftright(x, 24))


def minhash(shingles: DataFrame, key: str, seeds: int = 128) -> DataFrame:
    """Rows (key, signature) from rows (key, shingle): each shingle of a key is hashed
    once a seed, with partial minima before the last shuffles.

    Minima don't mind repeated rows, so Spark would drop a plain ``distinct`` below them
    and hash every occurrence; the filter, which all rows pass, keeps it.  Seeds are rows
    until the minima are known, so the hash is compiled once and not once a seed."""
    once = shingles.groupBy(key, "shingle").agg(F.count("*").alias("_n")).filter("_n > 0")
    seeded = once.select(key, F.posexplode(F.array(*[F.lit(str(i)) for i in range(seeds)])).alias("_i", "_seed"), "shingle")
    least = seeded.groupBy(key, "_i").agg(F.min(seeded_hash(F.col("shingle"), F.col("_seed"))).alias("_h"))
    slots = ", ".join(f"coalesce(min(if(_i = {i}, _h, null)), {0xFFFFFFFF})" for i in range(seeds))
    return least.groupBy(key).agg(F.expr(f"array({slots})").alias("signature"))


def estimate(a: Column, b: Column) -> Column:
    """Share of equal slots; signatures of different length are an error."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("signatures differ in length"))).otherwise(same)


def signature_classes(signatures: DataFrame, key: str) -> DataFrame:
    """Rows (key, rep): rep is the least key with the same signature."""
    return signatures.join(signatures.groupBy("signature").agg(F.min(key).alias("rep")), "signature").select(key, "rep")


def lsh_candidates(signatures: DataFrame, key: str, bands: int = 16) -> DataFrame:
    """Rows (a, b), a < b, that share a band.  Equal signatures are one group first,
    so copies do not multiply; ``a`` and ``b`` are groups' least keys, and
    ``signature_classes`` has the members.  A pair is given by the first band that it
    shares, so pairs need no shuffle to be distinct."""
    groups = signatures.groupBy("signature").agg(F.min(key).alias(key))

    def part(signature: Column, i: Column) -> Column:
        rows = (F.size(signature) / bands).cast("int")
        return F.slice(signature, i * rows + 1, rows)

    numbers = F.sequence(F.lit(0), F.lit(bands - 1))
    exploded = groups.select(key, "signature", F.explode(F.transform(numbers, lambda i: F.struct(i.alias("band"), part(F.col("signature"), i).alias("part")))).alias("x")).select(
        key, "signature", "x.band", "x.part")
    a, b = exploded.alias("a"), exploded.alias("b")
    earlier = F.exists(numbers, lambda i: (i < F.col("a.band")) & (part(F.col("a.signature"), i) == part(F.col("b.signature"), i)))
    return a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.part") == F.col("b.part")) & (F.col(f"a.{key}") < F.col(f"b.{key}")) & ~earlier).select(
        F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"))


def similarity_edges(signatures: DataFrame, key: str, threshold: float = 0.5, copies: bool = True) -> DataFrame:
    """Rows (a, b, similarity), a < b: all pairs whose estimated similarity is above 0
    and reaches the threshold; without ``copies`` only those of different signatures.

    Of n slots such a pair has m = ceil(threshold * n) equal, so one at least among
    any n - m + 1: pairs that share one of the first n - m + 1 slots are compared, and
    no other can qualify.  Equal signatures are one group until pairs are known, and
    members are found by their signature, so the plan has few branches to be made."""
    groups = signatures.groupBy("signature").agg(F.min(key).alias("g"))
    n = F.size("signature")
    least = F.greatest(F.ceil(F.lit(float(threshold)) * n - 1e-9), F.lit(1)).cast("int")
    slots = groups.select("g", F.posexplode(F.slice("signature", 1, F.greatest(n - least + 1, F.lit(0)))).alias("i", "h"))
    x, y = slots.alias("x"), slots.alias("y")
    met = x.join(y, (F.col("x.i") == F.col("y.i")) & (F.col("x.h") == F.col("y.h")) & (F.col("x.g") < F.col("y.g"))).select(
        F.col("x.g").alias("ga"), F.col("y.g").alias("gb")).distinct()
    far = met.join(groups.toDF("sa", "ga"), "ga").join(groups.toDF("sb", "gb"), "gb").select("sa", "sb", estimate(F.col("sa"), F.col("sb")).alias("similarity")).filter(
        F.col("similarity") >= threshold - 1e-9)
    a, b = signatures.select(F.col(key).alias("ka"), F.col("signature").alias("sa")), signatures.select(F.col(key).alias("kb"), F.col("signature").alias("sb"))
    across = far.join(a, "sa").join(b, "sb").select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "similarity")
    if not copies or threshold > 1:
        return across
    within = a.join(b, (F.col("sa") == F.col("sb")) & (F.col("ka") < F.col("kb")))
    return across.unionByName(within.select(F.col("ka").alias("a"), F.col("kb").alias("b"), F.lit(1.0).alias("similarity")))


def _member_pairs(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Rows (a, b, similarity), a < b, of members (k, g) of classes from pairs of
    classes (ga, gb, similarity); members of one class are alike by 1."""
    a, b = classes.toDF("ka", "ga"), classes.toDF("kb", "gb")
    across = pairs.join(a, "ga").join(b, "gb").select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "similarity")
    within = a.join(b, (F.col("ga") == F.col("gb")) & (F.col("ka") < F.col("kb"))).select(F.col("ka").alias("a"), F.col("kb").alias("b"), F.lit(1.0).alias("similarity"))
    return across.unionByName(within.filter(F.lit(threshold <= 1)))


def _set_classes(shingles: DataFrame, key: str) -> DataFrame:
    """Rows (k, g, s): each key, the least key with an equal set, and the set."""
    sets = shingles.filter(F.col("shingle").isNotNull()).distinct().groupBy(F.col(key).alias("k")).agg(F.array_sort(F.collect_list("shingle")).alias("s"))
    return sets.join(sets.groupBy("s").agg(F.min("k").alias("g")), "s").select("k", "g", "s")


def _class_edges(classes: DataFrame, threshold: float) -> DataFrame:
    items = classes.filter("k = g").select("k", F.size("s").alias("n"), F.explode("s").alias("x"))
    a, b = items.alias("a"), items.alias("b")
    both = a.join(b, (F.col("a.x") == F.col("b.x")) & (F.col("a.k") < F.col("b.k"))).groupBy(
        F.col("a.k").alias("ga"), F.col("b.k").alias("gb"), F.col("a.n").alias("na"), F.col("b.n").alias("nb")).count()
    return both.withColumn("similarity", F.round(F.col("count") / (F.col("na") + F.col("nb") - F.col("count")), 6)).filter(F.col("similarity") >= threshold).select("ga", "gb", "similarity")


def jaccard_edges(shingles: DataFrame, key: str, threshold: float = 0.5) -> DataFrame:
    """Exact similarity of all pairs of sets (key, shingle) that share a shingle.

    For sets of repositories, which are few; equal sets are one group until pairs are known."""
    classes = _set_classes(shingles, key)
    return _member_pairs(_class_edges(classes, threshold), classes.select("k", "g"), threshold)


def tree_edges(shingles: DataFrame, key: str, threshold: float = 0.5) -> DataFrame:
    """``jaccard_edges`` as far as a spanning tree needs them: pairs of classes' least
    keys, and each copy with the least key of its class."""
    classes = _set_classes(shingles, key)
    copies = classes.filter("k <> g").select(F.col("g").alias("a"), F.col("k").alias("b"), F.lit(1.0).alias("similarity"))
    return _class_edges(classes, threshold).toDF("a", "b", "similarity").unionByName(copies)


def spanning_tree(edges: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Rows (node, parent, level) of a maximum-similarity forest: Borůvka rounds in
    Spark, then levels from each tree's busiest node (ties: the least).

    Of ``keys``, a column of all nodes, those without an edge go under the hub, the
    busiest node of all; if no node has an edge, the least one is the hub."""
    spark = edges.sparkSession
    e = edges.select("a", "b", "similarity")
    nodes = e.select(F.col("a").alias("v")).union(e.select(F.col("b").alias("v"))).distinct()
    comp = nodes.withColumn("c", F.col("v"))
    tree = None
    for _ in range(40):
        lab = e.join(comp.select(F.col("v").alias("a"), F.col("c").alias("ca")), "a").join(comp.select(F.col("v").alias("b"), F.col("c").alias("cb")), "b").filter("ca <> cb")
        side = lab.select("ca", "a", "b", "similarity").union(lab.select("cb", "a", "b", "similarity"))
        best = side.groupBy("ca").agg(F.min(F.struct((-F.col("similarity")).alias("w"), "a", "b")).alias("x")).select("x.a", "x.b", (-F.col("x.w")).alias("similarity")).distinct()
        best = best.checkpoint() if spark.sparkContext.getCheckpointDir() else best.cache()
        if best.isEmpty():
            break
        tree = best if tree is None else tree.union(best)
        comp = _labels(nodes, tree)
    if tree is None:
        none = nodes.select(F.col("v").alias("node"), F.lit(None).cast(nodes.dtypes[0][1]).alias("parent"), F.lit(0).alias("level")).filter("false")
        return none if keys is None else _under_hub(none, keys, keys.agg(F.min(keys.columns[0]).alias("hub")))
    both = tree.select("a", "b").union(tree.select(F.col("b"), F.col("a"))).toDF("u", "v").distinct()
    degree = both.groupBy("u").count()
    roots = degree.join(comp.withColumnRenamed("v", "u"), "u").groupBy("c").agg(F.min(F.struct((-F.col("count")).alias("d"), "u")).alias("x")).select(F.col("x.u").alias("node"))
    level = roots.select("node", F.lit(None).cast(dict(both.dtypes)["u"]).alias("parent"), F.lit(0).alias("level"))
    out = level
    for i in range(1, 10_000):
        level = level.select(F.col("node").alias("u"), F.col("parent").alias("p")).join(both, "u").filter("p is null or v <> p").select(
            F.col("v").alias("node"), F.col("u").alias("parent"), F.lit(i).alias("level"))
        level = level.checkpoint() if spark.sparkContext.getCheckpointDir() else level.cache()
        if level.isEmpty():
            break
        out = out.union(level)
    if keys is None:
        return out
    return _under_hub(out, keys, degree.agg(F.min(F.struct((-F.col("count")).alias("d"), "u")).alias("x")).select(F.col("x.u").alias("hub")))


def _under_hub(tree: DataFrame, keys: DataFrame, hub: DataFrame) -> DataFrame:
    """Adds the keys that are not in the tree, under the hub; the hub itself, if it is new, as a root."""
    lone = keys.toDF("node").filter("node is not null").distinct().join(tree.select("node"), "node", "left_anti").crossJoin(F.broadcast(hub))
    return tree.unionByName(lone.select("node", F.when(F.col("node") != F.col("hub"), F.col("hub")).alias("parent"), F.when(F.col("node") != F.col("hub"), 1).otherwise(0).alias("level")))


def _labels(nodes: DataFrame, tree: DataFrame) -> DataFrame:
    """Least node reachable, by rounds of neighbours' minima with pointer jumping."""
    both = tree.select("a", "b").union(tree.select(F.col("b"), F.col("a"))).toDF("u", "v")
    lab = nodes.withColumn("c", F.col("v"))
    while True:
        near = both.join(lab, "v").groupBy("u").agg(F.min("c").alias("m"))
        new = lab.join(near.withColumnRenamed("u", "v"), "v", "left").select("v", F.least("c", F.coalesce("m", "c")).alias("c"))
        jump = new.select(F.col("v").alias("c"), F.col("c").alias("c2"))
        new = new.join(jump, "c").select("v", F.col("c2").alias("c"))
        new = new.checkpoint() if nodes.sparkSession.sparkContext.getCheckpointDir() else new.cache()
        if new.join(lab.withColumnRenamed("c", "old"), "v").filter("c <> old").isEmpty():
            return new
        lab = new


def ingest_order(tree: DataFrame) -> DataFrame:
    return tree.orderBy("level", "node")
