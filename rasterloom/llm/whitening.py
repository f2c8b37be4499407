"""Whitening of embeddings by a compensated covariance.

Entries become whole numbers x = floor(64 c) + 1,000,000. Three passes over the vectors: exact sums per dimension;
the covariance; the covariance of what comes out. Outer products of centred vectors are accumulated in
double-double numbers: each product and sum keeps its rounding error (error-free transformations), high and low
parts are merged across tasks, row by row of the matrix, in two steps. The matrix of the dimension's size is
then solved on the driver by LAPACK's ``syevd``: reduction to a tridiagonal matrix, divide and conquer.

Nulls: a vector that is null, empty or holds a null or non-finite entry (or one whose x is no 64-bit number) is left
out; a null id is kept. Vectors of another length than the most frequent one (the longer of equals) are left
out too. Repeated rows: each is a vector. Ties: equal eigenvalues have any orthonormal basis. Components without variance
(below ``FLAT`` of the largest) have no whitened values and are left out. Empty tables: no rows. A deviation that is no
64-bit number is null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors whose products are formed at once, and groups in which tasks' matrices are first merged.
ROWS, GROUPS = 32, 64
#: A component whose eigenvalue is below this share of the largest is rounding.
FLAT = 1e-13
OFFSET, STEPS = 1_000_000, 64


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b and its rounding error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def halves(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers of 26 bits whose sum is a."""
    c = a * 134217729.0
    high = c - (c - a)
    return high, a - high


def dd_add(ah: np.ndarray, al: np.ndarray, bh: np.ndarray, bl: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, e = two_sum(ah, bh)
    return _renormal(s, e + (al + bl))


def _renormal(h: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = h + low
    return s, low - (s - h)


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v) of the vectors that count, v of doubles."""
    got = df.select(F.col(key), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0))
    whole = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**56))
    got = got.where(F.coalesce(whole, F.lit(False)))
    most = got.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return got.where(F.size("v") == (most[0]["d"] if most else -1))


def _whole(batch: pa.RecordBatch, at: int) -> np.ndarray:
    """Rows of x."""
    column = batch.column(at)
    c = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return np.floor(STEPS * c).astype(np.int64) + OFFSET


def _exact_sum(x: np.ndarray) -> list[int]:
    if len(x) and float(np.abs(x.astype(float)).max()) * len(x) < 2.0**62:
        return [int(s) for s in x.sum(0)]
    return [sum(col) for col in zip(*x.tolist(), strict=True)]


def sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """How many vectors there are, and the exact sum of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for b in batches:
            if b.num_rows:
                s = _exact_sum(_whole(b, 0))
                n, total = n + b.num_rows, s if total is None else [p + q for p, q in zip(total, s, strict=True)]
        if total is not None:
            wide = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_pydict({"dim": pa.array(range(len(total)), pa.int32()), "n": pa.array([n] * len(total), pa.int64()), "s": pa.array([Decimal(t) for t in total], wide)})

    got = vectors.select("v").mapInArrow(add, "dim int, n long, s decimal(38,0)").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("dim").collect()  # one row a dimension
    return (got[0]["n"], [int(r["s"]) for r in got]) if got else (0, [])


def mean_parts(n: int, s: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Means as high and low parts."""
    high = [float(Fraction(t, n)) for t in s]
    return np.array(high), np.array([float(Fraction(t, n) - Fraction(h)) for t, h in zip(s, high, strict=True)])


def centred(x: np.ndarray, mean: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """x minus the means, as high and low parts."""
    high = x.astype(float)
    s, e = two_sum(high, -mean[0])
    return _renormal(s, e + ((x - high.astype(np.int64)).astype(float) - mean[1]))


class Products:
    """The upper triangle of a sum of outer products, in double-double."""

    def __init__(self, d: int):
        self.i, self.j = np.triu_indices(d)
        self.high, self.low = np.zeros(len(self.i)), np.zeros(len(self.i))

    def add(self, high: np.ndarray, low: np.ndarray) -> None:
        a, b = halves(high)
        for k in range(0, len(high), ROWS):
            at = slice(k, k + ROWS)
            h, w, u, v = high[at], low[at], a[at], b[at]
            p = h[:, self.i] * h[:, self.j]
            # The error of the product, and what the low parts give.
            e = ((u[:, self.i] * u[:, self.j] - p) + u[:, self.i] * v[:, self.j] + v[:, self.i] * u[:, self.j]) + v[:, self.i] * v[:, self.j]
            e += h[:, self.i] * w[:, self.j] + w[:, self.i] * h[:, self.j]
            while len(p) > 1:
                m = len(p) // 2
                s, t = dd_add(p[:m], e[:m], p[m : 2 * m], e[m : 2 * m])
                p, e = (s, t) if len(p) == 2 * m else (np.concatenate([s, p[-1:]]), np.concatenate([t, e[-1:]]))
            self.high, self.low = dd_add(self.high, self.low, p[0], e[0])


def covariance(vectors: DataFrame, n: int, s: list[int]) -> np.ndarray:
    """The covariance with divisor n, rounded from double-double."""
    d, mean = len(s), mean_parts(n, s)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Products(d)
        for b in batches:
            total.add(*centred(_whole(b, 0), mean))
        cuts = np.searchsorted(total.i, np.arange(d + 1))
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(d), pa.int32()), **{k: pa.array([v[cuts[i] : cuts[i + 1]] for i in range(d)], pa.list_(pa.float64())) for k, v in (("high", total.high), ("low", total.low))}})

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        high, low = np.stack(g["high"].to_numpy()), np.stack(g["low"].to_numpy())
        h, w = high[0], low[0]
        for k in range(1, len(high)):
            h, w = dd_add(h, w, high[k], low[k])
        return pd.DataFrame({"i": [g["i"].iloc[0]], "high": [h], "low": [w]})

    parts = vectors.select("v").mapInArrow(multiply, "i int, high array<double>, low array<double>").withColumn("part", F.spark_partition_id() % GROUPS)
    shape = "i int, high array<double>, low array<double>"
    rows = parts.groupBy("i", "part").applyInPandas(merge, shape).groupBy("i").applyInPandas(merge, shape).collect()  # one row a dimension
    out = np.zeros((d, d))
    for r in rows:
        row = [float((Fraction(h) + Fraction(w)) / n) for h, w in zip(r["high"], r["low"], strict=True)]
        out[r["i"], r["i"] :] = row
        out[r["i"] :, r["i"]] = row
    return out


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The largest eigenvalues, falling, their unit eigenvectors as columns, and the trace."""
    # Scaling by a power of two changes no bit and keeps huge entries from overflowing.
    scale = 2.0 ** np.floor(np.log2(top)) if len(v) and (top := np.abs(v).max()) > 0 else 1.0
    values, vectors = np.linalg.eigh(v / scale)
    values, vectors = values[::-1][:most] * scale, vectors[:, ::-1][:, :most]
    keep = values > FLAT * max(values[0], 0) if len(values) else np.zeros(0, bool)
    return values[keep], vectors[:, keep], float(np.trace(v))


def whiten(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", most: int = 32) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every usable vector and component.

    deviation: the exact sum of (n x - S)^2; whitened: the centred vector's projection on the component over the root of
    its eigenvalue; explained: the eigenvalue's share of the trace; identity_error: the largest absolute entry of the
    whitened vectors' covariance minus the identity, over all vectors.
    """
    spark = df.sparkSession
    vectors = usable(df, key, vector)
    n, s = sums(vectors)
    shape = f"{key} {vectors.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    values, basis, trace = components(covariance(vectors, n, s), most) if n else (np.zeros(0), np.zeros((0, 0)), 0.0)
    if not len(values):
        return spark.createDataFrame([], shape)
    mean, to = mean_parts(n, s), basis / np.sqrt(values)
    total = np.array(s, object)

    def project(x: np.ndarray) -> np.ndarray:
        high, low = centred(x, mean)
        return high @ to + low @ to

    def square(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        got = np.zeros((k + 1, k))
        for b in batches:
            w = project(_whole(b, 0))
            got[:k] += w.T @ w
            got[k] += w.sum(0)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(k + 1), pa.int32()), "row": pa.array(list(got), pa.list_(pa.float64()))})

    moments = np.zeros((len(values) + 1, len(values)))
    for r in vectors.select("v").mapInArrow(square, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "m")).groupBy("i", "j").agg(F.sum("m").alias("m")).collect():  # components squared
        moments[r["i"], r["j"]] = r["m"] / n
    off = float(np.abs(moments[:-1] - np.outer(moments[-1], moments[-1]) - np.eye(len(values))).max())

    def exact(x: np.ndarray) -> list[int | None]:
        far = np.abs(centred(x, mean)[0]) * float(n)
        if float((far * far).sum(1).max()) < 2.0**62 and float(np.abs(x.astype(float)).max()) * n < 2.0**62:
            y = n * x - np.array(s, np.int64)
            return (y * y).sum(1).tolist()
        out = [int((y * y).sum()) for y in n * x.astype(object) - total]
        return [v if v < 2**63 else None for v in out]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _whole(b, 1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(exact(x), pa.int64()), pa.array(list(project(x)), pa.list_(pa.float64()))], names=["key", "deviation", "whitened"])

    placed = vectors.select(F.col(key).alias("key"), "v").mapInArrow(place, f"key {vectors.schema[key].dataType.simpleString()}, deviation long, whitened array<double>")
    share = F.array(*(F.lit(float(e / trace)) for e in values))
    out = placed.select("key", "deviation", F.posexplode("whitened").alias("c", "whitened"))
    return out.select(
        F.col("key").alias(key), (F.col("c") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.element_at(share, F.col("c") + 1).alias("explained"), F.lit(off).alias("identity_error")
    )
