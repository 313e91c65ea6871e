"""Vectors, rank fusion, click statistics and learning to rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WEIGHTS = {"ngram_score": 0.4, "semantic_score": 0.3, "bm25_score": 0.2, "exact_match": 0.3, "symbol_match": 0.2, "prefix_match": 0.1, "ctr": 0.1}
LOG_FEATURES = ("file_length", "repo_stars", "import_count")
FEATURES = [
    "ngram_score", "semantic_score", "bm25_score", "exact_match", "prefix_match", "symbol_match", "file_length", "symbol_count",
    "import_count", "repo_stars", "days_since_modified", "is_test_file", "query_length", "language_match", "ctr"]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """Scaled to length 1; a zero vector stays."""
    n = norm(v)
    return F.when(n == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def nearest(vectors: DataFrame, query: list[float], k: int = 10, min_score: float = 0.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(key, F.round(cosine(F.col(vector), q), 6).alias("score")).filter(F.col("score") >= min_score)
    return scored.withColumn("distance", F.round(1 - F.col("score"), 6)).orderBy(F.desc("score"), key).limit(k)


def nearest_to_each(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding",
                    block: int = 256) -> DataFrame:
    """Exact neighbours of a stated set of queries, searched in blocks: every row
    keeps its k best in each partition before anything is shuffled."""
    import numpy as np
    import pandas as pd

    rows = queries.select(key, vector).orderBy(key).collect()
    if not rows:
        return vectors.select(F.col(key).alias("query_id"), key).filter("false").withColumn("score", F.lit(0.0))
    ids = np.array([r[0] for r in rows])
    q = np.array([r[1] for r in rows], float)
    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

    def best(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            v = np.array(pdf[vector].tolist(), float)
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
            mine = pdf[key].to_numpy()
            for i in range(0, len(q), block):
                s = np.round(q[i: i + block] @ v.T, 6)
                order = np.lexsort((np.broadcast_to(mine, s.shape), -s), axis=1)[:, : k + 1]
                yield pd.DataFrame({"query_id": np.repeat(ids[i: i + block], order.shape[1]), key: mine[order].ravel(), "score": np.take_along_axis(s, order, 1).ravel()})

    kind = dict(vectors.dtypes)[key]
    near = vectors.select(key, vector).mapInPandas(best, f"query_id {kind}, `{key}` {kind}, score double").filter(f"query_id <> `{key}`")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), key)
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def put_vectors(store: DataFrame, new: DataFrame, key: str = "vec_id") -> DataFrame:
    """The store with vectors added, or replaced where their key is known."""
    return store.join(new.select(key), key, "left_anti").unionByName(new.select(*store.columns))


def remove_vectors(store: DataFrame, gone: DataFrame, key: str = "vec_id") -> DataFrame:
    return store.join(gone.select(key).distinct(), key, "left_anti")


def save_vectors(store: DataFrame, path: str) -> None:
    store.write.mode("overwrite").parquet(path)


def load_vectors(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def cell_index(vectors: DataFrame, cells: int = 100, key: str = "vec_id", vector: str = "embedding", sample: int = 20_000, seed: int = 42):
    """An index by cells: (centres, rows (key, vector, cell)).  Centres are fitted on about
    ``sample`` vectors; every vector is in the cell of its nearest centre."""
    import numpy as np

    n = vectors.count()
    x = np.array([r[0] for r in vectors.select(F.transform(unit(F.col(vector)), lambda v: v).alias("v")).sample(min(1.0, 1.2 * sample / max(n, 1)), seed).limit(sample).collect()], float)
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)] if len(x) else np.zeros((0, 0))
    for _ in range(10 if len(x) else 0):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-300), centres)
    return centres, vectors.select(key, vector, nearest_cells(F.col(vector), centres, 1)[0].alias("cell"))


def nearest_cells(vector: Column, centres, n: int) -> Column:
    """The ``n`` cells whose centres are nearest; one cell, 0, where there are no centres."""
    if not len(centres):
        return F.array(F.lit(0))
    table = F.from_json(F.lit(str(centres.tolist())), "array<array<double>>")
    near = F.transform(table, lambda c, i: F.struct((-dot(c, vector)).alias("far"), i.alias("cell")))
    return F.transform(F.slice(F.array_sort(near), 1, n), lambda x: x["cell"])


def search_cells(centres, index: DataFrame, query: list[float], k: int = 10, probes: int = 8, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Nearest vectors among those of the ``probes`` cells nearest to the query: approximate."""
    q = F.array(*[F.lit(float(x)) for x in query])
    cells = index.sparkSession.range(1).select(nearest_cells(q, centres, probes)).first()[0]
    return nearest(index.filter(F.col("cell").isin(cells)), query, k, key=key, vector=vector)


def embed_missing(docs: DataFrame, known: DataFrame, embed=None, now: Column | None = None, hours: int = 24) -> DataFrame:
    """Rows (text_key, embedding, made_at) for all texts of ``docs``: those that are known
    and no older than ``hours``, and the others embedded anew, each text once."""
    now = F.current_timestamp() if now is None else now
    texts = docs.select(F.substring(F.sha2(F.col("content").cast("binary"), 256), 1, 16).alias("text_key"), "content")
    fresh = known.filter(F.col("made_at") >= now - F.expr(f"interval {hours} hours")).join(texts.select("text_key"), "text_key", "left_semi")
    todo = texts.join(fresh.select("text_key"), "text_key", "left_anti").groupBy("text_key").agg(F.min("content").alias("content"))
    return fresh.select("text_key", "embedding", "made_at").unionByName(todo.select("text_key", (embed or hashed_embedding)(F.col("content")).alias("embedding"), now.alias("made_at")))


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """Unit vector of hashed trigram counts: an embedder that needs no model."""
    from gleaner.functions.text import ngrams

    slots = F.transform(ngrams(F.lower(text)), lambda g: F.pmod(F.xxhash64(g), F.lit(dim)).cast("int"))
    return unit(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double")))


def fuse(lexical: DataFrame, semantic: DataFrame, limit: int = 20, k: int = 60, lexical_weight: float = 0.6, semantic_weight: float = 0.4,
         rrf_min_score: float = 0.0) -> DataFrame:
    """Reciprocal rank fusion of two lists (doc_id, score), each at most 2 x limit."""

    def ranked(df: DataFrame, name: str) -> DataFrame:
        top = df.orderBy(F.desc("score"), "doc_id").limit(2 * limit)
        return top.select("doc_id", F.col("score").alias(f"{name}_score"), F.row_number().over(W.orderBy(F.desc("score"), "doc_id")).alias(f"{name}_rank"))

    part = lambda name, w: F.coalesce(F.lit(w) / (k + F.col(f"{name}_rank")), F.lit(0.0))
    both = ranked(lexical, "lexical").join(ranked(semantic, "semantic"), "doc_id", "full")
    return both.withColumn("combined_score", F.round(part("lexical", lexical_weight) + part("semantic", semantic_weight), 9)).filter(
        F.col("combined_score") >= rrf_min_score).orderBy(F.desc("combined_score"), "doc_id").limit(limit)


def explain(found: DataFrame, lexical_weight: float = 0.6, semantic_weight: float = 0.4) -> DataFrame:
    """Fused rows with ``explanation``: their scores, ranks and weights."""
    scores = F.struct(F.col("lexical_score").alias("ngram"), F.col("semantic_score").alias("semantic"), F.col("combined_score").alias("combined"))
    ranks = F.struct(F.col("lexical_rank").alias("ngram"), F.col("semantic_rank").alias("semantic"))
    weights = F.struct(F.lit(lexical_weight).alias("ngram"), F.lit(semantic_weight).alias("semantic"))
    signals = [F.col(c) for c in ("matched_ngrams", "has_symbol_match") if c in found.columns]
    return found.withColumn("explanation", F.struct(scores.alias("scores"), ranks.alias("ranks"), weights.alias("weights"), *signals))


# -- clicks -------------------------------------------------------------------------


def click_stats(log: DataFrame) -> DataFrame:
    """From (query, doc_id, position, clicked): impressions, clicks, ctr, and ctr
    relative to what is expected at the mean position.  A click that was never
    shown counts as one impression."""
    shown = F.count_if(~F.col("clicked"))
    clicks = F.count_if(F.col("clicked"))
    agg = log.groupBy("query", "doc_id").agg(
        F.greatest(shown, F.lit(1)).alias("impressions"), clicks.alias("clicks"),
        F.sum(F.when(~F.col("clicked"), F.col("position")).otherwise(0)).alias("total_position"))
    ctr = F.col("clicks") / F.col("impressions")
    mean = F.col("total_position") / F.col("impressions")
    return agg.withColumn("ctr", F.round(ctr, 6)).withColumn("adjusted_ctr", F.round(ctr * (1 + 0.1 * mean), 6))


def preference_boost(history: DataFrame) -> DataFrame:
    """Rows (user_id, kind, value, boost): a tenth of each language's and repository's share."""
    both = history.select("user_id", F.explode(F.array(
        F.struct(F.lit("language").alias("kind"), F.col("language").alias("value")),
        F.struct(F.lit("repo").alias("kind"), F.col("repo").alias("value")))).alias("x")).select("user_id", "x.kind", "x.value")
    n = both.groupBy("user_id", "kind", "value").count()
    share = F.col("count") / F.sum("count").over(W.partitionBy("user_id", "kind"))
    return n.select("user_id", "kind", "value", F.round(0.1 * share, 6).alias("boost"))


# -- learning to rank ------------------------------------------------------------------


def linear_score(df: DataFrame) -> Column:
    terms = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in WEIGHTS.items() if c in df.columns]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def feature_columns(df: DataFrame) -> list[Column]:
    def one(name: str) -> Column:
        c = F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in df.columns else F.lit(0.0)
        if name in LOG_FEATURES:
            c = F.log1p(c)
        if name == "days_since_modified":
            c = F.log1p(c + 1)
        return c.alias(name)

    return [one(n) for n in FEATURES]


def train_ranker(df: DataFrame, label: str = "relevance", trees: int = 100, depth: int = 5, rate: float = 0.1):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    data = df.select(*feature_columns(df), (F.col(label) > 0).cast("double").alias("label"))
    return Pipeline(stages=[
        VectorAssembler(inputCols=FEATURES, outputCol="raw"), StandardScaler(withMean=True, inputCol="raw", outputCol="features"),
        GBTClassifier(maxIter=trees, stepSize=rate, maxDepth=depth, seed=42)]).fit(data)


def rank(df: DataFrame, model=None, key: str = "doc_id") -> DataFrame:
    """By the model's probability, or by the linear score while there is no model."""
    if model is None:
        return df.withColumn("rank_score", F.round(linear_score(df), 6)).orderBy(F.desc("rank_score"), key)
    from pyspark.ml.functions import vector_to_array

    feats = df.select("*", F.struct(*feature_columns(df)).alias("_f")).select(key, "_f.*")
    return model.transform(feats).select(key, vector_to_array("probability")[1].alias("rank_score")).orderBy(F.desc("rank_score"), key)


def feature_importance(model) -> dict[str, float]:
    return dict(zip(FEATURES, model.stages[-1].featureImportances.toArray().tolist()))


def save_ranker(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_ranker(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)
