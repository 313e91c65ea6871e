"""Documents from files, trees and tables; snapshots, deltas and statistics."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions import text as T

#: Folders that are never indexed.
EXCLUDED_DIRS = ["node_modules", "venv", ".venv", "__pycache__", ".git", ".svn", ".hg", ".idea", ".vscode", "vendor", "dist", "build", "target"]
MAX_FILE_BYTES = 10 * 1024 * 1024


def keep_file(path: F.Column) -> F.Column:
    """Indexed extension, and no excluded folder on the way."""
    parts = F.split(path, "/")
    return T.extension(path).isin(T.INDEXED_EXTENSIONS) & ~F.arrays_overlap(parts, F.array(*[F.lit(d) for d in EXCLUDED_DIRS]))


def read_directory(spark: SparkSession, root: str, repo: str | None = None, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Documents of a folder: the binary reader skips large files before reading them;
    bytes that aren't UTF-8 are read as Latin-1.  Folders are excluded below the
    root only, wherever the root itself stands."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    top = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    below = F.element_at(F.split("path", re.escape(top) + "/", 2), -1)
    small = files.filter((F.col("length") <= max_bytes) & keep_file(below))
    utf8 = F.expr("try_validate_utf8(cast(content as string))")
    return documents(small.select(
        F.lit(repo or root).alias("repo"), F.col("path"), F.coalesce(utf8, F.decode("content", "ISO-8859-1")).alias("content"),
        F.col("modificationTime").alias("modified_at")))


def documents(files: DataFrame) -> DataFrame:
    """From (repo, path, content): ids, hashes, language and sizes."""
    c = F.col("content")
    out = files.withColumns({
        "repo_id": T.repo_id(F.col("repo")), "blob_hash": T.blob_hash(c), "language": T.language_of(F.col("path")),
        "size_bytes": F.octet_length(c).cast("long"), "line_count": T.line_count(c)})
    return out.withColumn("doc_id", T.document_id(F.col("repo_id"), F.col("path"), F.col("blob_hash")))


def unique_blobs(docs: DataFrame) -> DataFrame:
    """One document for each blob: the first path."""
    w = W.partitionBy("blob_hash").orderBy("repo_id", "path", "doc_id")
    return docs.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def delta(docs: DataFrame, parent: DataFrame) -> DataFrame:
    """Documents whose blob the parent repository doesn't have."""
    return docs.join(parent.select("blob_hash").distinct(), "blob_hash", "left_anti")


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], version: str = "blob_hash") -> DataFrame:
    """Rows (keys, change): added, modified or deleted."""
    a = old.select(*keys, F.col(version).alias("_old"), F.lit(True).alias("_was"))
    b = new.select(*keys, F.col(version).alias("_new"), F.lit(True).alias("_is"))
    change = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "deleted").when(~F.col("_old").eqNullSafe(F.col("_new")), "modified")
    return a.join(b, keys, "full").withColumn("change", change).filter("change is not null").select(*keys, "change")


def crawl_stats(docs: DataFrame) -> DataFrame:
    return docs.agg(
        F.count("*").alias("files"), F.countDistinct("blob_hash").alias("blobs"), F.sum("size_bytes").alias("bytes"),
        F.sum("line_count").cast("long").alias("lines"), F.countDistinct("language").alias("languages"))


def read_git(spark: SparkSession, repos: DataFrame, partitions: int | None = None) -> DataFrame:
    """HEAD trees of local git repositories, a row (repo, path, blob_hash, content)
    a file.  ``repos`` has a column ``repo``; each is read where its row is."""

    def walk(batches):
        import subprocess

        import pandas as pd

        for pdf in batches:
            for repo in pdf["repo"]:
                git = lambda *a, r=repo: subprocess.run(["git", "-C", r, *a], capture_output=True).stdout
                for line in git("ls-tree", "-r", "-z", "HEAD").split(b"\0"):
                    if not line:
                        continue
                    meta, path = line.split(b"\t", 1)
                    sha = meta.split()[2].decode()
                    data = git("cat-file", "blob", sha)
                    try:
                        content = data.decode()
                    except UnicodeDecodeError:
                        content = data.decode("latin-1")
                    yield pd.DataFrame({"repo": [repo], "path": [path.decode(errors="replace")], "blob_hash": [sha], "content": [content]})

    spread = repos.repartition(partitions) if partitions else repos
    return spread.select("repo").mapInPandas(walk, "repo string, path string, blob_hash string, content string")


def to_json(docs: DataFrame) -> DataFrame:
    return docs.select(F.to_json(F.struct("*")).alias("value"))


def from_json(lines: DataFrame, schema) -> DataFrame:
    return lines.select(F.from_json("value", schema).alias("d")).select("d.*")


def filter_symbols(symbols: F.Column, *types: str) -> F.Column:
    return F.filter(symbols, lambda s: s["type"].isin(*types))
