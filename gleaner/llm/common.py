"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, through Spark's reader whatever the file system."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: ``spark.checkpoint.dir``.

    Only where a single-machine session has none (tests) a temporary folder is
    set, and removed when the interpreter ends; a cluster must name one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = getattr(spark, "_gleaner_shared", None)
        if not path:
            path = tempfile.mkdtemp(prefix="gleaner-")
            atexit.register(shutil.rmtree, path, True)
            spark._gleaner_shared = path
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost
    executors, and gives the optimizer true sizes for its choice of joins."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/gleaner-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gleaner_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables that :func:`materialize` wrote and nothing needs any more."""
    for df in frames:
        path = getattr(df, "_gleaner_path", None)
        if path:
            spark = df.sparkSession
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; the per-character way is left to non-ASCII texts."""
    return F.when(is_ascii(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def decimal_id(doc_id: Column) -> Column:
    """crc32 of the identifier written as decimal text."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def worker_state(key: str, make):
    """What a Python worker keeps from task to task (caches; never results)."""
    import pyspark

    store = pyspark.__dict__.setdefault("_gleaner_worker", {})
    if key not in store:
        store[key] = make()
    return store[key]


def lean(run, *keys: str):
    """``run`` for mapInArrow on a worker that lives through many jobs: state of other
    operators goes before it starts, and freed memory goes back when it ends."""

    def tidy(batches):
        import ctypes
        import gc

        import pyarrow as pa
        import pyspark

        store = pyspark.__dict__.setdefault("_gleaner_worker", {})
        for key in [k for k in store if k not in keys]:
            del store[key]
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return tidy


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like those wanted that the table doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def labelled_sample(df: DataFrame, label: str, key: str, per_label: int, seed: str) -> DataFrame:
    """About ``per_label`` rows of each label (all, where there are fewer), chosen by
    a hash of the key, so that neither the order nor the layout of rows matters."""
    counts = df.groupBy(label).count()  # one row a label
    share = counts.select(label, (F.lit(per_label * 1.0) / F.col("count")).alias("_share"))
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    return df.join(F.broadcast(share), label).filter(place < F.col("_share")).drop("_share")


def fit_logistic(x, y, ridge: float = 1.0, steps: int = 40):
    """Weights of a logistic regression by damped Newton steps (numpy arrays)."""
    import numpy as np

    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - (y * z).sum() + 0.5 * ridge * (w @ w)

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        size = 1.0
        while size > 1e-4 and loss(w + size * step) > now:
            size /= 2
        new = loss(w + size * step)
        if size <= 1e-4 or now - new < 1e-9 * max(1.0, now):
            break
        w, now = w + size * step, new
    return w
