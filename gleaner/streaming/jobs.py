"""Structured Streaming forms of the event consumers and monitors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.operators.monitors import DEFAULT_RULES, apply_events

DOCUMENT_EVENT = T.StructType([
    T.StructField("doc_id", T.StringType()), T.StructField("action", T.StringType()), T.StructField("content", T.StringType()),
    T.StructField("offset", T.LongType())])


def read_topic(spark: SparkSession, path: str, schema: T.StructType, files_a_trigger: int = 100) -> DataFrame:
    """A topic as a folder of JSON files; a Kafka source has the same columns after ``parse``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).json(path)


def parse(stream: DataFrame, schema: T.StructType) -> DataFrame:
    """JSON in ``value``; rows that don't parse have a null ``event`` (dead letters)."""
    return stream.select(F.from_json(F.col("value").cast("string"), schema).alias("event"), "value")


def new_matches(files: DataFrame, rules=DEFAULT_RULES, time_column: str | None = None, delay: str = "1 day") -> DataFrame:
    """A stream of (file_path, content) scanned by the rules: every match of a rule,
    each different one of a file once."""

    def of(rule):
        fits = F.lit(True)
        if rule.language:
            fits = fits & (F.col("language") == rule.language)
        if rule.file_pattern:
            fits = fits & F.rlike("file_path", F.lit(f"^(?:{rule.file_pattern})"))
        texts = F.when(fits, F.regexp_extract_all("content", F.lit("(?i)" + rule.pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
        return F.transform(F.array_distinct(texts), lambda t: F.struct(F.lit(rule.id).alias("rule_id"), F.lit(rule.severity).alias("severity"), t.alias("text")))

    found = F.concat(*[of(rule) for rule in rules if rule.enabled])
    if time_column:
        files = files.withWatermark(time_column, delay)
    hits = files.select("file_path", *([time_column] if time_column else []), F.explode(found).alias("m")).select("file_path", *([time_column] if time_column else []), "m.*")
    keyed = hits.withColumn("match_hash", F.md5(F.concat_ws(":", "file_path", "rule_id", "text").cast("binary")))
    return keyed.dropDuplicatesWithinWatermark(["rule_id", "match_hash"]) if time_column else keyed.dropDuplicates(["rule_id", "match_hash"])


def click_counters(events: DataFrame, time_column: str = "ts", window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time_column, delay).groupBy(F.window(time_column, window), "query", "doc_id").agg(
        F.count_if(~F.col("clicked")).alias("impressions"), F.count_if("clicked").alias("clicks"))


def upsert_sink(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch: applies events to a parquet table, a new version a batch.  A batch
    starts from the last whole version before it that the folder holds, so a batch
    run twice gives the same version, and a restarted query goes on where it was."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        columns = [c for c in batch.columns if c not in ("action", "offset")]
        last = last_version(spark, path, batch_id)
        now = spark.read.parquet(last) if last else batch.select(*columns).filter("false")
        apply_events(now, batch).select(*columns).write.mode("overwrite").parquet(f"{path}/v{batch_id:08d}")

    return apply


def last_version(spark: SparkSession, path: str, before: int | None = None) -> str | None:
    """The last version in the folder that was written whole, below batch ``before``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    whole = []
    for f in fs.listStatus(folder):
        name = f.getPath().getName()
        if name.startswith("v") and name[1:].isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")):
            whole.append(int(name[1:]))
    whole = [v for v in whole if before is None or v < before]
    return f"{path}/v{max(whole):08d}" if whole else None


def alert_sink(*handlers: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """foreachBatch: gives each batch of alerts to every handler, a table writer or a
    notifier; one that fails doesn't keep the others from their turn, but fails the batch."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        failed = []
        for handle in handlers:
            try:
                handle(batch)
            except Exception as e:  # noqa: BLE001
                failed.append(e)
        if failed:
            raise ExceptionGroup(f"handlers failed in batch {batch_id}", failed)

    return apply


def lag(ends: DataFrame, committed: DataFrame) -> DataFrame:
    """Rows (partition, lag) from the ends of a log and the offsets that were read."""
    return ends.join(committed, "partition", "left").select("partition", (F.col("end_offset") - F.coalesce("offset", F.lit(0))).alias("lag"))
