"""Benchmark decontamination with a distributed positional inverted index.

A benchmark item gives windows of ``width`` consecutive words (the whole item,
if it is shorter).  The words of the windows are counted over all documents,
and each window is looked up by its rarest word, its anchor.  The index stores
the postings of anchors: document, position, and the words around it, which are
the postings of the other words adjusted to the anchor's offset.  A window
occurs where its own list and the stored one intersect at every offset; where
most of its words stand near the anchor, but not in place, it is a proximity
match.

Nothing but windows, postings of rare words and hits is shuffled; texts are
read twice and never leave their tasks.  All steps are DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, table

WIDTH = 10
#: Rows of the benchmark's side up to which a join sends it to every executor.
BROADCAST_ROWS = 200_000
#: Anchors looked for in one pass over the documents; more anchors take more passes.
ANCHORS_A_PASS = 20_000
#: Share of a window's different words that a proximity match has near its anchor.
NEAR = 0.8


def words_of(text: Column) -> Column:
    """Words of ASCII letters, digits and any non-ASCII characters; A-Z lower-cased."""
    low = ascii_lower(F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def windows_of(bench: DataFrame, item: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Rows (win, items): every different window and the sorted items that have it."""
    w = F.col("_w")
    cut = F.when(F.size(w) == 0, F.array().cast("array<array<string>>")).when(
        F.size(w) <= width, F.array(w)
    ).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - width + 1, F.lit(1))), lambda i: F.slice(w, i, width)))
    return (
        bench.select(F.col(item).cast("string").alias("_item"), words_of(F.col(text)).alias("_w"))
        .select("_item", F.explode(cut).alias("win"))
        .groupBy("win").agg(F.sort_array(F.collect_set("_item")).alias("items"))
    )


def word_counts(docs: DataFrame, vocabulary: DataFrame, text: str = "text") -> DataFrame:
    """How often each word of ``vocabulary`` (term) stands in all documents."""
    n = vocabulary.count()
    terms = docs.select(F.explode(words_of(F.col(text))).alias("term"))
    if n <= BROADCAST_ROWS:
        return terms.join(F.broadcast(vocabulary), "term", "left_semi").groupBy("term").count()
    return terms.groupBy("term").count().join(vocabulary, "term", "left_semi")


def anchored_windows(docs: DataFrame, bench: DataFrame, item: str, bench_text: str, text: str, width: int):
    """(windows, item sets): windows (anchor, o, win, gid) that may occur at all, with
    the place ``o`` of the rarest word; item sets (gid, items)."""
    wins = materialize(windows_of(bench, item, bench_text, width))
    sets = materialize(wins.select("items").distinct().withColumn("gid", F.monotonically_increasing_id()))
    counts = word_counts(docs, wins.select(F.explode("win").alias("term")).distinct(), text)
    placed = wins.select("win", F.posexplode("win").alias("o", "term"))
    best = (
        placed.join(counts, "term", "left")
        .groupBy("win").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "term", "o")).alias("a"))
        .filter("a.n > 0")
    )
    anchored = best.join(wins, "win").join(sets, "items").select(
        F.col("a.term").alias("anchor"), F.col("a.o").alias("o"), "win", "gid")
    return materialize(anchored), sets


def index_anchors(docs: DataFrame, anchors: list[str], text: str, width: int, keep: list[str]) -> DataFrame:
    """One pass over the documents: the columns ``keep``, n_words, and the postings
    (position, anchor, place of the first stored word, the words around it)."""
    w = F.col("_w")
    hit = F.filter(
        F.transform(w, lambda x, i: F.when(x.isin(anchors), i) if anchors else F.lit(None).cast("int")), lambda i: i.isNotNull())
    post = F.transform(hit, lambda i: F.struct(
        i.alias("pos"), F.get(w, i).alias("anchor"), F.greatest(i - (width - 1), F.lit(0)).alias("first"),
        F.slice(w, F.greatest(i - (width - 1), F.lit(0)) + 1, F.lit(2 * width - 1)).alias("around")))
    return docs.withColumn("_w", words_of(F.col(text))).select(*keep, F.size("_w").cast("long").alias("n_words"), post.alias("posts"))


def decontaminate(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                  bench_text: str = "text", width: int = WIDTH) -> DataFrame:
    """Rows (key, n_words, n_hit, n_items, items, n_near), one for each row of ``docs``.

    n_hit: words inside occurrences of windows; items: the sorted items with
    occurring windows; n_near: proximity matches that are no occurrence.  Null
    texts have no words; items without a word have no window; repeated rows and
    keys are judged row by row; very long texts are read whole; other columns are
    not looked at; empty tables of documents or items give no rows or no hits.
    """
    windows, sets = anchored_windows(docs, bench, item, bench_text, text, width)
    anchors = sorted(r[0] for r in windows.select("anchor").distinct().collect())  # words of the benchmark
    rows = docs.select(F.monotonically_increasing_id().alias("_rid"), key, text)
    if len(anchors) > ANCHORS_A_PASS:  # several passes must see one numbering of the rows
        rows = materialize(rows)
    passes = [anchors[i: i + ANCHORS_A_PASS] for i in range(0, len(anchors), ANCHORS_A_PASS)] or [[]]
    stored = [materialize(index_anchors(rows, part, text, width, ["_rid", key])) for part in passes]
    posts = None
    for s in stored:
        one = s.filter(F.size("posts") > 0).select("_rid", F.explode("posts").alias("p"))
        posts = one if posts is None else posts.unionByName(one)
    by_anchor = windows.groupBy("anchor").agg(F.collect_list(F.struct("o", "win", "gid")).alias("ws"))
    p = F.col("p")

    def meets(x):
        at = p["pos"] - x["o"] - p["first"]
        return (at >= 0) & (F.slice(p["around"], F.greatest(at, F.lit(0)) + 1, F.size(x["win"])) == x["win"])

    def close(x):
        words = F.array_distinct(x["win"])
        return ~meets(x) & (F.size(F.array_intersect(words, p["around"])) >= F.ceil(F.size(words) * NEAR))

    met = posts.select("_rid", "p", p["anchor"].alias("anchor")).join(_bounded(by_anchor, windows.count()), "anchor").select(
        "_rid",
        F.transform(F.filter("ws", meets), lambda x: F.struct(
            (p["pos"] - x["o"]).alias("start"), (p["pos"] - x["o"] + F.size(x["win"])).alias("end"), x["gid"].alias("gid"))).alias("hits"),
        F.size(F.filter("ws", close)).alias("near"),
    )
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def cover(s, h):
        return F.struct(
            (s["n"] + F.greatest(h["end"] - F.greatest(h["start"], s["end"]), F.lit(0))).alias("n"),
            F.greatest(s["end"], h["end"]).alias("end"))

    # a document's hits are at most a few a word of it
    per_doc = materialize(
        met.filter((F.size("hits") > 0) | (F.col("near") > 0))
        .groupBy("_rid").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"), F.sum("near").alias("n_near"))
        .select("_rid", "n_near", F.aggregate("hits", zero, cover, lambda s: s["n"]).cast("long").alias("n_hit"),
                F.array_distinct(F.transform("hits", lambda h: h["gid"])).alias("gids"))
    )
    items = (
        per_doc.select("_rid", F.explode("gids").alias("gid")).join(_bounded(sets, sets.count()), "gid")
        .groupBy("_rid").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    )
    none = F.array().cast("array<string>")
    return (
        stored[0].select("_rid", key, "n_words")
        .join(per_doc.select("_rid", "n_hit", "n_near"), "_rid", "left").join(items, "_rid", "left")
        .select(key, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                F.size(F.coalesce("items", none)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"),
                F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))
    )


def op7_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "n_near")
