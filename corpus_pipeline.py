"""The corpus pipeline: quality, near duplicates, benchmark passages, personal
data, packing.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` over all that its
predecessor kept; :func:`run` writes each stage's rows to the shared folder and
reads them back for the next.  All but the last return the columns of
``documents``.

What holds for every stage: null and empty texts count as empty and stay, unless
the stage's own rule drops them; very long texts are read whole; repeated rows
are judged alike; rows with a null ``doc_id`` stay unless their text is rejected
or a near copy can't be told by it; columns beside those of ``documents`` are
dropped, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import discard, materialize, table
from gleaner.llm.decontaminate import decontaminate
from gleaner.llm.jaccard import jaccard_components
from gleaner.llm.packing import default_tokenizer, pack_documents
from gleaner.llm.pii import redact
from gleaner.llm.quality import CUT, labelled_documents, score_quality, train_ranker

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Pieces of text whose ids a worker keeps: fewer than on its own, as workers live through all stages.
CACHE_PIECES = 250_000
#: Share of a document's words inside benchmark windows from which all of it goes.
CONTAMINATED = 0.0


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents scored below ``CUT`` by the ranking learnt from the labels; without
    any label all stay.  Ties are impossible: equal texts score alike."""
    model = train_ranker(labelled_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    return score_quality(docs.select(*COLUMNS), model, score="_score").filter(F.col("_score") >= CUT).drop("_score")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near duplicates.

    Only identifiers are joined back; documents without words stay, as do rows that
    repeat the identifier that is kept."""
    found = jaccard_components(docs, "doc_id", "text")
    copies = materialize(found.filter("doc_id <> component_id").select("doc_id").distinct())
    return docs.select(*COLUMNS).join(copies, "doc_id", "left_anti")


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with any window of a benchmark item; without items all stay."""
    judged = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    hit = materialize(judged.filter(F.col("n_hit") > CONTAMINATED * F.col("n_words")).select("doc_id").distinct())
    return docs.select(*COLUMNS).join(hit, "doc_id", "left_anti")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets; n_chars follows the text."""
    return redact(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048: see ``gleaner.llm.packing``."""
    return pack_documents(docs, default_tokenizer(), cache_pieces=CACHE_PIECES)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_benchmark_passages),
    ("PII", redact_personal_data),
    ("best-fit packing", pack_sequences),
]
#: Trees, rankings and packing can't be said in SQL; tests/llm/test_pipeline.py has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = materialize(stage(spark, docs, sf_dir))
        if i:
            discard(docs)
        docs = out
    return docs
