"""URL filters by a sort-merge range join.

A rule is a host and the start of a path.  Writing hosts backwards, label by
label (``org.example``), makes "this host and what lies below it, on paths that
start so" the interval of all keys with a given prefix, per depth of host.  A
url is looked up under each depth that some rule has, so it meets a rule as
one point in one interval.

The sweep: rule events and url keys of one host go to one group (a host with
many urls to several, each with the rules of that host), and are sorted.  Rules
of a host are nested or apart, so the rules active at any point are a stack; a
fold over the sorted rule events pushes at a start and pops at an end, and
notes the top after each event.  A url takes the top that was noted last.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialize, shuffle_partitions, table

#: The contract's rules, (host, path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
DEFAULT_VERDICT = "allow"
#: Sorts behind every character that a path may hold.
LAST = "\U0010ffff"


def rules_frame(spark: SparkSession, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def sweep_rules(rules: DataFrame) -> DataFrame:
    """Rows (rhost, points): for each rule host the sorted turning points
    (key, rule, verdict) of its path intervals, by a sweep with a stack.

    Of equal rules that disagree, block wins.  A host's rules are one row: a
    list of rules, not of urls.
    """
    ruled = (
        rules.filter("host is not null and path is not null and verdict is not null")
        .withColumn("host", F.translate("host", UPPER, LOWER))
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
        .withColumn("rhost", F.array_join(_labels(F.col("host")), "."))
        .withColumn("rule", F.concat("host", "path"))
    )
    top = F.struct("path", "rule", "verdict")
    # at equal places an end comes before a start, and a longer rule ends first
    start = F.struct(F.col("path").alias("at"), F.lit(1).alias("start"), F.length("path").alias("n"), top.alias("r"))
    end = F.struct(F.concat("path", F.lit(LAST)).alias("at"), F.lit(0).alias("start"), (-F.length("path")).alias("n"), top.alias("r"))
    events = (
        ruled.select("rhost", F.explode(F.array(start, end)).alias("e"))
        .groupBy("rhost").agg(F.sort_array(F.collect_list("e")).alias("events"))
    )
    frame = "struct<path:string,rule:string,verdict:string>"
    zero = F.struct(
        F.array().cast(f"array<{frame}>").alias("stack"),
        F.array().cast(f"array<struct<at:string,top:{frame}>>").alias("points"),
    )

    def step(s, e):
        stack = F.when(e["start"] == 1, F.array_append(s["stack"], e["r"])).otherwise(
            F.slice(s["stack"], F.lit(1), F.greatest(F.size(s["stack"]) - 1, F.lit(0))))
        return F.struct(
            stack.alias("stack"),
            F.array_append(s["points"], F.struct(e["at"].alias("at"), F.get(stack, F.size(stack) - 1).alias("top"))).alias("points"),
        )

    return events.select("rhost", F.aggregate("events", zero, step, lambda s: s["points"]).alias("points"))


def judge_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """Adds host, path, rule and verdict to every row.

    The longest fitting rule (as text, host then path) wins; of equally long
    ones the deeper host.  Null urls, or urls without ``://``, have empty host
    and path and get the default verdict.  Columns named like the outputs are
    replaced; repeated urls are judged once.
    """
    spark = df.sparkSession
    df = df.drop(*[c for c in ("host", "path", "rule", "verdict") if c != url])
    base = df.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    points = materialize(sweep_rules(rules))
    depths = sorted({r[0] for r in points.select(F.size(F.split("rhost", r"\.")).alias("d")).distinct().collect()})
    distinct = base.select("host", "path").filter("host <> ''").distinct()
    labels = _labels(F.col("host"))
    suffixes = F.array(*[
        F.when(F.size(labels) >= d, F.array_join(F.slice(labels, 1, d), ".")) for d in depths
    ]) if depths else F.array().cast("array<string>")
    # a rule's host is met by few or by very many urls: the latter are dealt to several groups
    looked = distinct.select("host", "path", F.explode(suffixes).alias("rhost")).filter("rhost is not null")
    per_host = looked.groupBy("rhost").count().join(points, "rhost")
    total = looked.count()
    share = max(1, -(-total // (2 * shuffle_partitions(spark))))
    spread = materialize(per_host.select("rhost", "points", F.ceil(F.col("count") / share).cast("int").alias("n")))
    keyed = looked.join(spread.select("rhost", "n"), "rhost").select(
        "rhost", F.pmod(F.xxhash64("host", "path"), F.col("n")).cast("int").alias("part"),
        F.col("path").alias("at"), F.lit(1).alias("is_url"), "host", "path",
        F.lit(None).cast("struct<path:string,rule:string,verdict:string>").alias("top"))
    marks = (
        spread.select("rhost", "points", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"))
        .select("rhost", "part", F.posexplode("points").alias("i", "p"))
    )
    marks = marks.select(
        "rhost", "part", F.col("p.at").alias("at"), F.lit(0).alias("is_url"),
        F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"),
        F.coalesce("p.top", F.struct(F.lit("").alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))).alias("top"), "i")
    both = keyed.withColumn("i", F.lit(0)).unionByName(marks)
    sweep = W.partitionBy("rhost", "part").orderBy("at", "is_url", "i")
    met = (
        both.withColumn("top", F.last("top", ignorenulls=True).over(sweep))
        .filter("is_url = 1 and top.rule is not null")
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("top.rule").alias("n"), F.length("rhost").alias("d"), F.col("top.verdict").alias("verdict"), F.col("top.rule").alias("rule"))).alias("w"))
        .select("host", "path", "w.rule", "w.verdict")
    )
    return base.join(met, ["host", "path"], "left").select(
        *[F.col(c) for c in df.columns], "host", "path", "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op2_rangejoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rules_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = r"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r(h, s, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                      ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (
  SELECT page_id, host, path, h || s AS rule, v,
         row_number() OVER (PARTITION BY page_id ORDER BY length(h || s) DESC NULLS LAST) AS n
  FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE n = 1
"""
