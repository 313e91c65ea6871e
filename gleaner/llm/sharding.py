"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many points on a ring of 64-bit hashes.  A row belongs to the
first point at or after its own hash; a row whose shard is full goes on
clockwise to the next point of a shard with room.  Rows are taken in ring
order, so the outcome depends on nothing but the identifiers and the shards.

How it runs: one aggregation counts the rows of each arc (a bounded table: the
arcs are virtual nodes, not rows).  From those counts the overflow is walked
once around the ring, giving each arc its runs "ranks a..b go to shard s from
slot t".  One window per arc then ranks the rows.  No step holds more than an
arc, and the arcs outnumber the shuffle partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_names, shuffle_partitions

LAW = "rows"


def ring_points(n_shards: int, vnodes: int, spark) -> list[tuple[int, int]]:
    """Sorted (hash, shard) of all virtual nodes; equal hashes keep the smaller shard."""
    rows = (
        spark.range(n_shards)
        .select(F.col("id").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))).alias("v"))
        .select(F.xxhash64(F.lit("vnode"), "shard", "v").alias("h"), "shard")
        .groupBy("h").agg(F.min("shard").alias("shard"))
        .collect()
    )
    return sorted((r.h, r.shard) for r in rows)


def arc_of(h: Column, hashes: list[int]) -> Column:
    """Index of the first ring point at or after ``h``; past the last one, 0.

    A binary search written as a fold over a constant sorted array.
    """
    n = len(hashes)
    ring = F.split(F.lit(",".join(map(str, hashes))), ",").cast("array<bigint>")  # folded to a constant
    steps = F.sequence(F.lit(1), F.lit(max(1, n.bit_length() + 1)))

    def halve(s, _):
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        less = F.get(ring, mid) < h
        go = s["lo"] < s["hi"]
        return F.struct(
            F.when(go & less, mid + 1).otherwise(s["lo"]).alias("lo"),
            F.when(go & ~less, mid).otherwise(s["hi"]).alias("hi"),
        )

    start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))
    return F.aggregate(steps, start, halve, lambda s: F.pmod(s["lo"], F.lit(n)))


def overflow_plan(counts: dict[int, int], points: list[tuple[int, int]], capacity: dict[int, int]):
    """Runs (arc, from_rank, to_rank, shard, slot): where each arc's rows go.

    The full shards are skipped by path-halving links, so the walk costs little
    more than one step per arc.
    """
    n = len(points)
    left = dict(capacity)
    slot = {s: 0 for s in capacity}
    jump = list(range(n))
    runs = []

    def open_from(i: int) -> int:
        seen = 0
        while left[points[i][1]] == 0 and seen <= n:
            nxt = (i + 1) % n if jump[i] == i else jump[i]
            jump[i] = nxt if jump[nxt] == nxt else jump[nxt]
            i = nxt
            seen += 1
        return i

    for arc in range(n):
        rank, todo, at = 0, counts.get(arc, 0), arc
        while todo:
            at = open_from(at)
            shard = points[at][1]
            take = min(todo, left[shard])
            if not take:
                raise ValueError("the shards' capacities are less than the rows")
            runs.append((arc, rank, rank + take, shard, slot[shard]))
            left[shard] -= take
            slot[shard] += take
            rank += take
            todo -= take
    return runs


def bounded_ring_shards(df: DataFrame, key: str = "doc_id", n_shards: int = 24, slack: float | None = None,
                        vnodes: int | None = None) -> DataFrame:
    """Adds ``shard``, ``slot`` (gapless from 0 in a shard) and ``home_shard``.

    ``slack`` None fills shards to within one row of each other; otherwise a
    shard takes at most ceil((1 + slack) * rows / shards).  Null keys and
    repeated keys hash like any other value (repeated rows are ranked by the
    remaining columns, and are alike where those tie too).  An empty table
    gives an empty one.  Columns named like the outputs are replaced, others stay.
    """
    spark = df.sparkSession
    out_names = ("shard", "slot", "home_shard")
    df = df.drop(*[c for c in out_names if c != key])
    parts = shuffle_partitions(spark)
    vnodes = vnodes or max(128, -(-16 * parts // n_shards))
    points = ring_points(n_shards, vnodes, spark)
    _h, _arc, _rank, _runs, _run = free_names(df.withColumns({c: F.lit(0) for c in out_names}), "_h", "_arc", "_rank", "_runs", "_run")
    hashed = df.withColumn(_h, F.xxhash64(F.lit("row"), F.col(key))).withColumn(_arc, arc_of(F.col(_h), [p[0] for p in points]))
    counts = {r[0]: r[1] for r in hashed.groupBy(_arc).count().collect()}  # at most one row a virtual node
    total = sum(counts.values())
    if slack is None:
        capacity = {s: total // n_shards + (s < total % n_shards) for s in range(n_shards)}
    else:
        most = math.ceil(round(total * (1 + slack) / n_shards, 6))
        capacity = {s: most for s in range(n_shards)}
    runs = overflow_plan(counts, points, capacity)
    by_arc: dict[int, list] = {}
    for arc, a, b, shard, slot in runs:
        by_arc.setdefault(arc, []).append((a, b, shard, slot))
    plan = spark.createDataFrame(
        [(arc, points[arc][1], x) for arc, x in by_arc.items()],
        f"`{_arc}` int, home_shard int, `{_runs}` array<struct<a:bigint,b:bigint,shard:int,slot:bigint>>",
    )
    rest = [F.col(c) for c in df.columns if c != key and dict(df.dtypes)[c] in ("bigint", "int", "string", "double")]
    ranked = hashed.withColumn(_rank, F.row_number().over(W.partitionBy(_arc).orderBy(_h, key, *rest)) - 1)
    run = F.filter(F.col(_runs), lambda r: (r["a"] <= F.col(_rank)) & (F.col(_rank) < r["b"]))[0]
    return (
        ranked.join(F.broadcast(plan), _arc)  # a row a virtual node: its size is that of the ring
        .withColumn(_run, run)
        .select(*df.columns, F.col(_run)["shard"].alias("shard"),
                (F.col(_run)["slot"] + F.col(_rank) - F.col(_run)["a"]).alias("slot"), "home_shard")
    )


def op10_ring(spark, sf_dir: str, n_shards: int = 24) -> DataFrame:
    from .common import table

    text = F.col("text")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return bounded_ring_shards(rows, "doc_id", n_shards).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
