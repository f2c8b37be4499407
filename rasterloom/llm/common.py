"""Helpers that the corpus operators share: tables, scratch space, hashing and ordered placement."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sort key of a null id: before every other id.
NULL_ID = -(2**63)

#: Rows of an Arrow batch while a table is stored; the JVM and the Python worker hold a batch of whole texts each.
BATCH_ROWS = 1000

#: Rows that a task decodes at once where whole texts are read and nothing else is done with them in the JVM.
READ_ROWS = 256

_scope: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path, with its scheme, in the folder that driver and executors share (``spark.checkpoint.dir``).

    Where that setting is absent a temporary folder stands in if everything runs in one
    process, as in tests; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.gettempdir() + "/rasterloom-scratch"
    path = qualified(spark, f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}")
    if (scope := _scope.get()) is not None:
        scope.append(path)
    return path


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme; without one it is in Spark's default file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


@contextlib.contextmanager
def scratch_scope(paths: list[str]) -> Iterator[list[str]]:
    """Collect the scratch paths made inside, so that a caller can delete them later."""
    token = _scope.set(paths)
    try:
        yield paths
    finally:
        _scope.reset(token)


def delete_paths(spark: SparkSession, paths: list[str]) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    paths.clear()


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to shared scratch and read it again: cuts lineage, survives lost executors.

    Shuffle files of the write go as soon as it ends, not when the driver next collects its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with small_batches(spark), short_lived_shuffles(spark):
        df.write.parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again.scratch = path
    return again


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Meanwhile tasks get at most BATCH_ROWS rows at once from Spark; a smaller setting stays, and the caller's is set again at the end."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextlib.contextmanager
def small_reads(spark: SparkSession) -> Iterator[None]:
    """Meanwhile tasks read at most READ_ROWS rows of a Parquet file at once; a smaller setting stays, and the caller's is set again at the end."""
    name = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(name)
    if int(before) > READ_ROWS:
        spark.conf.set(name, READ_ROWS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextlib.contextmanager
def short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """Meanwhile Spark deletes the shuffle files of a query at its end; the caller's setting is restored."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, True)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def discard(df: DataFrame) -> None:
    """Delete what ``stored`` wrote, once nothing will read it again."""
    delete_paths(df.sparkSession, [df.scratch])


def trim() -> None:
    """Give what a Python worker has freed back to the system; workers live on after a task, beside the next one."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def parts(spark: SparkSession) -> int:
    """Number of partitions for placements that this package makes itself."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash64(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text)


class WordHashes(dict):
    """word -> 64-bit hash; forgets everything when it holds ``limit`` words."""

    def __init__(self, limit: int = 150_000):
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def odd_constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers, the same for every run."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def word_shingles(words: Sequence[str], size: int, hashes: WordHashes) -> np.ndarray:
    """64-bit hashes of the windows of ``size`` words, repeats included.

    Fewer words make one window of them all; no words make none.
    """
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter((hashes[w] for w in words), np.uint64, len(words))
    take = min(size, len(codes))
    n = len(codes) - take + 1
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(take):
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += codes[k : k + n]
        return mix64(out + np.uint64(take))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def range_bounds(df: DataFrame, key: str, n: int) -> list[int]:
    """At most n - 1 increasing splits of a long column into ranges of about equal size."""
    if n < 2:
        return []
    got = df.select(F.coalesce(F.col(key), F.lit(NULL_ID)).cast("double").alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 1 / (4 * n))
    return sorted({int(x) for x in got})


def range_of(key: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below the key, found in two steps of about sqrt(n) comparisons each."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    heads = F.array(*[F.lit(b).cast("long") for b in bounds[::step]])
    whole = F.array(*[F.lit(b).cast("long") for b in bounds])
    block = F.size(F.filter(heads, lambda b: b <= key))
    inner = F.size(F.filter(F.slice(whole, (block - 1) * step + 1, F.lit(step)), lambda b: b <= key))
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * step + inner).cast("int")
