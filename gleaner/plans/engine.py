"""The engine's face: index, search, analyse and maintain a corpus of code."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import analysis, dependencies, index, intel, monitors, ranking
from gleaner.operators.monitors import LruCache
from gleaner.sources import corpus


@dataclass(frozen=True)
class Config:
    ngram: int = 3
    shards: int = 8
    compaction_threshold: int = 10
    segment_limit_bytes: int = index.SEGMENT_LIMIT_BYTES
    fusion_k: int = 60
    lexical_weight: float = 0.6
    semantic_weight: float = 0.4
    embedding_dim: int = 64
    cache_size: int = 1000
    cache_seconds: float = 300.0


@dataclass
class Engine:
    """Tables under ``path``: documents, and one folder of postings a segment.

    A manifest names the segments with their generations and the tombstones; a
    new one is written beside the old and appears by a rename, so a store opened
    anew is always whole.  A tombstone holds for segments up to the generation at
    which it was written: a document that is indexed again lives in a younger
    segment.  Results are DataFrames.
    """

    spark: SparkSession
    path: str
    config: Config = field(default_factory=Config)

    def __post_init__(self):
        self.cache = LruCache(self.config.cache_size, self.config.cache_seconds)
        self.generations: dict[str, int] = {}  # segment folder -> generation
        self.graves: list[str] = []  # folders of (doc_id, generation)
        self.version = 0
        self.bulk = False
        self._path = self.spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        self._open()

    @property
    def segments(self) -> list[str]:
        return list(self.generations)

    # -- the manifest --------------------------------------------------------------

    def _manifests(self) -> list[int]:
        folder = self._path(f"{self.path}/manifests")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _open(self) -> None:
        found = self._manifests()
        if found:
            text = self.spark.read.option("wholetext", True).text(f"{self.path}/manifests/{found[-1]:08d}").first()[0]
            state = json.loads(text)
            self.generations, self.graves, self.version = state["generations"], state["graves"], found[-1]

    def _commit(self, generations: dict[str, int], graves: list[str]) -> None:
        """Makes the new state the current one; what it no longer names is removed."""
        old = {*self.generations, *self.graves} - {*generations, *graves}
        version = self.version + 1
        draft = self._path(f"{self.path}/manifests/{version:08d}.draft")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps({"generations": generations, "graves": graves}).encode()))
        out.close()
        if not self._fs.rename(draft, self._path(f"{self.path}/manifests/{version:08d}")):
            raise RuntimeError("another writer has changed the store")
        self.generations, self.graves, self.version = generations, graves, version
        self.cache.clear()
        for name in old:
            self._fs.delete(self._path(name), True)
        for v in self._manifests()[:-2]:
            self._fs.delete(self._path(f"{self.path}/manifests/{v:08d}"), False)

    def _next(self) -> int:
        return max(self.generations.values(), default=0) + 1

    # -- writing -------------------------------------------------------------------

    def index(self, files: DataFrame) -> DataFrame:
        """Adds documents of (repo, path, content); the last version of a path wins."""
        docs = corpus.documents(files)
        graves = []
        if self.segments:
            old = self.documents().join(docs.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_semi").select("doc_id")
            graves = [self._grave(old.join(docs.select("doc_id"), "doc_id", "left_anti"))]
            docs = docs.join(self.documents().select("doc_id"), "doc_id", "left_anti")
        name = f"{self.path}/seg_{int(time.time() * 1000)}_{self.version}"
        docs.write.parquet(f"{name}/documents")
        docs = self.spark.read.parquet(f"{name}/documents")
        if docs.isEmpty():
            self._commit(self.generations, self.graves + graves)
            return docs
        names = intel.extract_symbols(docs.select(F.col("doc_id").alias("file_path"), "language", "content")).select(F.col("file_path").alias("doc_id"), "name")
        index.write_index(index.build_postings(docs, names, n=self.config.ngram), f"{name}/postings", self.config.shards)
        self._commit(self.generations | {name: self._next()}, self.graves + graves)
        if not self.bulk and len(self.segments) >= self.config.compaction_threshold:
            self.compact()
        return docs

    def index_directory(self, root: str, repo: str | None = None) -> DataFrame:
        return self.index(corpus.read_directory(self.spark, root, repo).select("repo", "path", "content"))

    def delete(self, docs: DataFrame) -> None:
        self._commit(self.generations, [*self.graves, self._grave(docs.select("doc_id"))])

    def delete_repo(self, repo_id: str) -> None:
        self.delete(self.documents().filter(F.col("repo_id") == repo_id))

    def _grave(self, ids: DataFrame) -> str:
        out = f"{self.path}/dead_{int(time.time() * 1000)}_{self.version}"
        ids.distinct().withColumn("generation", F.lit(self._next() - 1)).write.parquet(out)
        return out

    def compact(self) -> None:
        """All segments become one of a new generation, without the dead."""
        if len(self.segments) < 2 and not self.graves:
            return
        name = f"{self.path}/seg_{int(time.time() * 1000)}_c{self.version}"
        self.documents().write.parquet(f"{name}/documents")
        index.write_index(self.postings(), f"{name}/postings", self.config.shards)
        self._commit({name: self._next()}, [])

    def compaction_stats(self) -> dict[str, int]:
        """Segments, tombstones, the current generation, and how many segments are missing to a compaction."""
        dead = self._dead().count() if self.graves else 0
        return {"segments": len(self.segments), "tombstones": dead, "generation": self._next() - 1,
                "to_compaction": max(0, self.config.compaction_threshold - len(self.segments))}

    # -- reading --------------------------------------------------------------------

    def _all(self, what: str) -> DataFrame:
        if not self.segments:
            raise ValueError("nothing is indexed yet")
        out = reduce(DataFrame.unionByName, [
            self.spark.read.parquet(f"{s}/{what}").withColumn("_generation", F.lit(g)) for s, g in self.generations.items()])
        if self.graves:
            dead = self._dead()
            out = out.join(dead, (out["doc_id"] == dead["doc_id"]) & (out["_generation"] <= dead["generation"]), "left_anti")
        return out.drop("_generation")

    def _dead(self) -> DataFrame:
        rows = reduce(DataFrame.unionByName, [self.spark.read.parquet(g) for g in self.graves])
        return rows.groupBy("doc_id").agg(F.max("generation").alias("generation"))

    def documents(self) -> DataFrame:
        return self._all("documents")

    def postings(self) -> DataFrame:
        return self._all("postings").select("ngram", "doc_id", "score", "is_symbol", "n_hits")

    def search(self, query: str, limit: int = 20, min_score: float = 0.0, language: str | None = None, repo_id: str | None = None,
               mode: str = "ngram", verify: bool = False) -> DataFrame:
        """``mode``: ngram, code (tokenizes the query as content is), semantic or hybrid.
        Filters written in the query (``lang:``, ``repo:``) apply as well."""
        words = []
        for w in query.split():
            if w.startswith("lang:"):
                language = language or w[5:]
            elif w.startswith("repo:"):
                repo_id = repo_id or w[5:]
            else:
                words.append(w)
        text = " ".join(words)
        meta = self.documents().select("doc_id", "language", "repo_id", "path")
        if mode in ("ngram", "code"):
            return index.search(self.postings(), text, limit, min_score, meta, language, repo_id, "raw" if mode == "ngram" else "code",
                                self.documents().select("doc_id", "content") if verify else None)
        keep = meta
        if language:
            keep = keep.filter(F.lower("language") == language.lower())
        if repo_id:
            keep = keep.filter(F.col("repo_id") == repo_id)
        lexical = index.match(self.postings(), text, mode="code").join(keep.select("doc_id"), "doc_id", "left_semi")
        semantic = self.semantic(text).join(keep.select("doc_id"), "doc_id", "left_semi")
        if mode == "semantic":
            found = semantic.filter(F.col("score") >= min_score).orderBy(F.desc("score"), "doc_id").limit(limit)
        else:
            c = self.config
            found = ranking.fuse(lexical, semantic, limit, c.fusion_k, c.lexical_weight, c.semantic_weight, min_score)
        return found.join(meta, "doc_id", "left")

    def semantic(self, text: str) -> DataFrame:
        dim = self.config.embedding_dim
        q = self.spark.range(1).select(ranking.hashed_embedding(F.lit(text), dim)).first()[0]
        v = ranking.hashed_embedding(F.col("content"), dim)
        return self.documents().select("doc_id", F.round(ranking.dot(v, F.array(*[F.lit(x) for x in q])), 6).alias("score"))

    def cached(self, query: str, **how) -> list:
        """Rows of a search, remembered until the index changes or they expire."""
        return self.cache.get_or_compute((query, tuple(sorted(how.items())), self.version), lambda: self.search(query, **how).collect())

    def snippets(self, found: DataFrame, query: str) -> DataFrame:
        body = self.documents().select("doc_id", F.substring("content", 1, 200).alias("snippet"), T.highlights(F.col("content"), query).alias("highlights"))
        return found.join(body, "doc_id", "left")

    def files(self) -> DataFrame:
        return self.documents().select(F.col("path").alias("file_path"), "language", "content")

    def symbols(self) -> DataFrame:
        return intel.extract_symbols(self.files())

    def quality(self) -> DataFrame:
        return analysis.quality_scores(self.files())

    def alerts(self, history: DataFrame | None = None) -> DataFrame:
        return monitors.scan(self.files(), history=history)

    def imports(self) -> DataFrame:
        return dependencies.resolve(dependencies.python_imports(self.files().filter("language = 'python'")), self.files())

    def stats(self) -> DataFrame:
        return index.index_stats(self.postings())
