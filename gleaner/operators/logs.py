"""Partitioned logs of events as tables: producing, reading, offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.operators.similarity import hash_shard


def repo_events(repos: DataFrame, action: str) -> DataFrame:
    """Rows (key, event_type, payload) for repositories (repo_id, ...)."""
    return repos.select(F.col("repo_id").cast("string").alias("key"), F.lit(f"repo_{action}").alias("event_type"), F.to_json(F.struct("*")).alias("payload"))


def document_events(docs: DataFrame, deleted: bool = False) -> DataFrame:
    """Rows (key, event_type, payload) for documents; a deletion carries the id alone."""
    body = F.struct("doc_id") if deleted else F.struct("*")
    return docs.select(F.col("doc_id").cast("string").alias("key"), F.lit("document_deleted" if deleted else "document_indexed").alias("event_type"), F.to_json(body).alias("payload"))


def numbered(events: DataFrame, order: list[str | Column], partitions: int = 8, ends: DataFrame | None = None, partition: Column | None = None) -> DataFrame:
    """Events with ``partition`` (by their key, if none is given) and ``offset``, going on
    from the ``ends`` (partition, end_offset) of the log.  A partition is a sequence, so
    one task numbers it: there must be as many as the load asks for."""
    placed = events.withColumn("partition", hash_shard(F.col("key"), partitions) if partition is None else partition)
    placed = placed.withColumn("offset", F.row_number().over(W.partitionBy("partition").orderBy(*order)).cast("long") - 1)
    if ends is None:
        return placed
    out = placed.join(F.broadcast(ends.select("partition", "end_offset")), "partition", "left")  # a row a partition
    return out.withColumn("offset", F.col("offset") + F.coalesce("end_offset", F.lit(0))).select(*placed.columns)


def log_ends(log: DataFrame) -> DataFrame:
    """Rows (partition, messages, end_offset): the next free offset of each partition."""
    return log.groupBy("partition").agg(F.count("*").alias("messages"), (F.max("offset") + 1).alias("end_offset"))


def read_range(log: DataFrame, partition: int, start: int, most: int = 100) -> DataFrame:
    """At most ``most`` events of a partition from an offset on; the filter reaches the scan."""
    return log.filter((F.col("partition") == partition) & (F.col("offset") >= start) & (F.col("offset") < start + most))


def poll(log: DataFrame, committed: DataFrame, most: int = 100) -> DataFrame:
    """The next events of a consumer group's every partition behind its committed offsets
    (partition, offset)."""
    c = F.broadcast(committed.select("partition", F.col("offset").alias("_from")))
    at = F.coalesce("_from", F.lit(0))
    return log.join(c, "partition", "left").filter((F.col("offset") >= at) & (F.col("offset") < at + most)).drop("_from")


def assigned(partitions: DataFrame, members: list[str]) -> DataFrame:
    """Rows (partition, member): the partitions dealt to a group's members in turn."""
    names = F.array(*[F.lit(m) for m in sorted(members)])
    return partitions.select("partition").distinct().select("partition", F.get(names, F.col("partition") % len(members)).alias("member"))
