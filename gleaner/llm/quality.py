"""Document quality by Bradley-Terry pairwise ranking.

Training texts of label 1 are each set against texts of label 0; the chance
that the better one is preferred is the logistic function of the difference of
their scores, and a score is linear in what can be read off a text's form.
The weights minimise the logistic loss on the feature differences of the
pairs.  A text is kept if its score passes a quantile of the training scores;
the final map to 0..1 puts that quantile at ``CUT``.

Features are measured on the whole text: shares of letters, capitals, digits,
marks and white space, word lengths, how often words repeat, and how uneven
lines are.  Each is also cut at training quantiles, so that the score can rise
and fall along it.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import decimal_id, fit_logistic, labelled_sample, lean, table, worker_state

#: The bounds of the fit: labelled texts of each label, and preference pairs.
TEXTS_PER_LABEL = 4000
MAX_PAIRS = 40_000
#: The score at or above which a document counts as good.
CUT = 0.3
BINS = 6
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CLASS = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 white, 5 not ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[9, 10, 11, 12, 13, 32]], _CLASS[128:] = 1, 2, 3, 4, 5
FEATURES = ["chars", "words", "word_len", "lower", "upper", "digit", "white", "foreign", "types", "again", "top", "ends", "long",
            "bare", "line_len", "line_again"] + [f"mark{m}" for m in MARKS]


def features(text: str | None) -> np.ndarray:
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    seen = np.bincount(data, minlength=256)
    kinds = np.bincount(_CLASS, seen, minlength=6) / max(1, len(data))
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    lines = text.split("\n")
    marks = seen[[ord(m) for m in MARKS]] / max(1, len(data))
    out = [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(text) / n), kinds[1], kinds[2], kinds[3], kinds[4], kinds[5],
        len(counts) / n, sum(map(eq, words, words[1:])) / n, max(counts.values(), default=0) / n,
        (seen[46] + seen[33] + seen[63]) / n, sum(c for w, c in counts.items() if len(w) > 20) / n,
        sum(c for w, c in counts.items() if not w[-1].isalnum()) / n,
        np.log1p(len(text) / len(lines)), 1 - len(set(lines)) / len(lines),
    ]
    return np.concatenate([out, np.log1p(200 * marks)])


def feature_rows(texts: Iterable[str | None]) -> np.ndarray:
    rows = [features(t) for t in texts]
    return np.array(rows) if rows else np.zeros((0, len(FEATURES)))


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    cuts: list[np.ndarray] = field(default_factory=list)
    weights: np.ndarray | None = None
    cut: float = 0.0
    slope: float = 1.0

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        bins = [(x[:, [j]] > c[None, :]).astype(float) for j, c in enumerate(self.cuts)]
        return np.concatenate([z, *bins], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.raw(x) - self.cut) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    @classmethod
    def blank(cls) -> Ranker:
        """Knows nothing: every text scores ``CUT``."""
        n = len(FEATURES)
        return cls(np.zeros(n), np.ones(n), [np.zeros(0)] * n, np.zeros(n))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, max_pairs: int = MAX_PAIRS, seed: int = 7) -> Ranker:
        """Preference pairs by a seeded draw; every text is in about equally many."""
        scale = x.std(axis=0)
        cuts = [np.unique(np.quantile(col, np.arange(1, BINS) / BINS)) for col in x.T]
        model = cls(x.mean(axis=0), np.where(scale > 1e-9, scale, 1.0), cuts)
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        n_features = model.expand(x[:1]).shape[1]
        model.weights = np.zeros(n_features)
        if not len(good) or not len(bad):
            model.cut = 0.0 if len(good) else np.inf
            return model
        rng = np.random.default_rng(seed)
        n = min(max_pairs, 10 * max(len(good), len(bad)))
        a = np.resize(rng.permutation(good), n)
        b = np.resize(rng.permutation(bad), n)
        rng.shuffle(b)
        z = model.expand(x)
        diff = z[a] - z[b]
        flip = np.where(rng.random(n) < 0.5, 1.0, -1.0)  # the order of a pair says nothing
        model.weights = fit_logistic(diff * flip[:, None], (flip > 0).astype(float), ridge=3.0)
        s = model.raw(x)
        # the quantile of the training scores that parts the labels with the fewest (balanced) errors
        levels = np.quantile(s, np.linspace(0.0, 1.0, 401))
        tpr = np.array([(s[good] >= t).mean() for t in levels])
        fpr = np.array([(s[bad] >= t).mean() for t in levels])
        worth = 1.5 * tpr - fpr  # a good document lost counts more than a bad one kept
        best = np.flatnonzero(worth >= worth.max() - 1e-12)
        model.cut = float(levels[best].mean())
        slope = fit_logistic(np.stack([s - model.cut], axis=1), y.astype(float), ridge=1.0)[0]
        model.slope = float(max(slope, 1e-3))
        return model


def train_ranker(df: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text",
                 texts_per_label: int = TEXTS_PER_LABEL) -> Ranker:
    """Fits on at most about ``texts_per_label`` whole texts of each label; rows with
    a null label or key are left out, null texts are empty, repeated rows count as
    often as they occur.  Only the texts' features come to the driver.  Without
    any labelled row every text scores ``CUT``: nothing tells it from a good one."""
    rows = labelled_sample(df.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).select(key, label, text), label, key, texts_per_label, "quality")

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = feature_rows(x.as_py() for x in batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])

    got = rows.select(label, text).mapInArrow(lean(measure), "label int, x array<double>").toArrow()
    if not got.num_rows:
        return Ranker.blank()
    x = np.array(got.column("x").to_pylist())
    y = np.array(got.column("label").to_pylist())
    order = np.lexsort((*x.T, y))  # the outcome doesn't depend on the order of rows
    return Ranker.fit(x[order], y[order])


def score_quality(df: DataFrame, model: Ranker, text: str = "text", score: str = "score") -> DataFrame:
    """Adds ``score`` (0 to 1; empty and null texts too).  A column of that name is
    replaced, all others stay; equal texts score alike, very long ones are read
    whole, no rows give no rows."""
    df = df.drop(*[c for c in (score,) if c != text])
    shared = df.sparkSession.sparkContext.broadcast(vars(model))  # a few hundred numbers
    name = uuid.uuid4().hex
    at = df.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = worker_state(name, lambda: Ranker(**shared.value))
        for batch in batches:
            s = ranker.score(feature_rows(x.as_py() for x in batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*batch.schema.names, score])

    schema = T.StructType([*df.schema.fields, T.StructField(score, T.DoubleType())])
    return df.mapInArrow(lean(run, name), schema)


def labelled_documents(docs: DataFrame, labels: DataFrame, texts_per_label: int = TEXTS_PER_LABEL) -> DataFrame:
    """Documents that may be learnt from, with their labels: those whose crc32 isn't
    divisible by 5.  The labels are sampled first, so that they (and no text) are
    what is sent around."""
    may = labels.select("doc_id", "quality").filter(F.pmod(decimal_id(F.col("doc_id")), F.lit(5)) != 0).filter("quality is not null")
    few = labelled_sample(may, "quality", "doc_id", texts_per_label, "quality")
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")  # about texts_per_label rows a label


def op5_bradleyterry(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_ranker(labelled_documents(docs, table(spark, sf_dir, "labels")))
    return score_quality(docs, model).select(
        "doc_id", (F.pmod(decimal_id(F.col("doc_id")), F.lit(5)) == 0).alias("held_out"), "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"))
