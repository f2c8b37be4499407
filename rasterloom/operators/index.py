"""Approximate nearest descriptors by inverted lists.

Lists are the cells of centroids that k-means finds in a sample of at most SAMPLE rows; every row is in the lists of its SPILL nearest
centroids. A query meets the rows of its PROBES nearest lists, an equi join on the list, and distances are exact. A long list is cut into
blocks, so no task has more than about matching.BLOCK of its rows at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.operators import matching

#: Rows that centroids are fitted to, at most; rows of a list that are aimed at; lists, at most: SAMPLE / 16.
SAMPLE, PER_LIST = 20_000, 250
#: Lists that a query looks into, and the share of all lists, where that is more.
PROBES, SHARE = 16, 0.3
#: Lists that a row is in.
SPILL = 2
ROUNDS = 12


def fit(target: DataFrame, lists: int | None = None) -> np.ndarray:
    """Centroids (lists, values) of the rows (kp_id, descriptor), from those of least hash of their id; none for no rows."""
    n = target.count()
    if not n:
        return np.zeros((0, 0))
    lists = lists or int(np.clip(round(n / PER_LIST), 1, SAMPLE // 16))
    share = min(1.0, 1.1 * SAMPLE / n)
    some = target.where(F.abs(F.xxhash64("kp_id")) <= int(share * (2**63 - 1))) if share < 1 else target
    x = np.array([r["descriptor"] for r in some.select("descriptor").limit(SAMPLE).collect()], float)  # a bounded sample
    rng = np.random.default_rng(0)
    c = x[rng.permutation(len(x))[: min(lists, len(x))]]
    for _ in range(ROUNDS):
        own = nearest_lists(x, c, 1)[:, 0]
        sums, counts = np.zeros_like(c), np.bincount(own, minlength=len(c))
        np.add.at(sums, own, x)
        c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
    return c


def nearest_lists(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """Numbers of each row's n nearest centroids, nearest first."""
    out = []
    for k in range(0, len(x), 1024):
        d = (centroids * centroids).sum(1)[None] - 2 * x[k : k + 1024] @ centroids.T
        out.append(np.argsort(d, axis=1, kind="stable")[:, :n])
    return np.concatenate(out) if out else np.zeros((0, n), int)


def placed(rows: DataFrame, centroids: np.ndarray, n: int) -> DataFrame:
    """(kp_id, descriptor, list) of each row, once for each of its n nearest lists."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)  # at most SAMPLE / 16 rows

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.array(frame["descriptor"].tolist(), float).reshape(len(frame), -1)
            yield frame.assign(lists=nearest_lists(x, shared.value, n).tolist())

    own = rows.select(F.col("kp_id").cast("long").alias("kp_id"), F.col("descriptor").cast("array<double>").alias("descriptor"))
    return own.mapInPandas(assign, "kp_id long, descriptor array<double>, lists array<int>").select("kp_id", "descriptor", F.explode("lists").alias("list"))


def search(source: DataFrame, target: DataFrame, centroids: np.ndarray | None = None, probes: int | None = None) -> DataFrame:
    """As matching.two_nearest with L2, but among the rows of each query's nearest lists alone."""
    c = fit(target) if centroids is None else centroids
    if not len(c):
        return source.select(F.col("kp_id").cast("long").alias("query_id"), F.lit(0).cast("long").alias("train_id"), F.lit(0.0).alias("distance"), F.lit(0.0).alias("next_distance")).where("false")
    n = probes or min(len(c), max(PROBES, int(np.ceil(SHARE * len(c)))))
    index = placed(target, c, min(SPILL, len(c)))
    sizes = index.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / matching.BLOCK).cast("int").alias("blocks"))
    t = index.join(sizes, "list").withColumn("block", F.pmod(F.xxhash64("kp_id"), F.col("blocks")).cast("int")).groupBy("list", "block")
    many = sizes.select(F.col("list").alias("_list"), F.col("blocks").alias("_many"))
    s = placed(source, c, n).join(many, F.col("list") == F.col("_list")).select("kp_id", "descriptor", "list", F.explode(F.sequence(F.lit(0), F.col("_many") - 1)).alias("block")).groupBy("list", "block")

    def nearest(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return matching.compare_blocks(a, b, "l2")

    found = s.cogroup(t).applyInPandas(nearest, "query_id long, distance double, train_id long")
    near = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_set(F.struct("distance", "train_id"))), 1, 2).alias("n"))
    first = F.get("n", F.lit(0))
    return near.select("query_id", first["train_id"].alias("train_id"), first["distance"].alias("distance"), F.get("n", F.lit(1))["distance"].alias("next_distance"))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of queries whose nearest row, or one as near, was found."""
    both = exact.select("query_id", F.col("distance").alias("best")).join(found.select("query_id", "distance"), "query_id", "left")
    return both.agg(F.avg(F.coalesce(F.col("distance") <= F.col("best") + 1e-9, F.lit(False)).cast("double"))).first()[0]


def keys_of(df: DataFrame, every: int = 50, key: str = "kp_id") -> DataFrame:
    """The stated query set: rows whose id is divisible by ``every``."""
    return df.where(F.col(key) % every == 0)
