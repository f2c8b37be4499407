"""Exact medians and robust fits of groups that no single task has to hold.

Medians come from ranks in a range partitioning by group and value; those of shifts from the different offsets of a group, with their
numbers. Robust fits work on blocks of at most CHUNK matches: hypotheses
are made from a pool of the matches of least hash, ranked on the pool, and the best of them scored on all blocks by a join with partial
counts; the fit of the inliers is solved from summed moments.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.operators import fits, robust

#: Matches of a block; matches that hypotheses are made from; hypotheses that are scored on all matches.
CHUNK, POOL, FINALISTS = 50_000, 512, 64
Keep = Callable[[DataFrame, str], DataFrame]


def group_medians(df: DataFrame, keys: Sequence[str], value: Column, keep: Keep, tie: Column | None = None) -> DataFrame:
    """(keys, median) of each group's values that are not null, exact; a group's values are spread over as many tasks as they fill.

    keep stores a table and reads it again, so that ranks hold. tie: a column that tells rows of equal values apart, so that
    they can be spread too.
    """
    spark, keys = df.sparkSession, list(keys)
    rows = df.select(*keys, value.cast("double").alias("_v"), (F.lit(0) if tie is None else tie).alias("_tie")).where("_v is not null")
    order = [*keys, "_v", "_tie"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = keep(ranged.select(*keys, "_v", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_i")), "ranked")
    # A row for each part of a group; a group lies in parts that follow each other.
    group = W.partitionBy(*keys)
    cut = ranged.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    cut = cut.withColumns({"_before": F.sum("_n").over(group.orderBy("_p")) - F.col("_n"), "_total": F.sum("_n").over(group)})
    places = (F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2))  # of the middle values; within the part, or beyond it
    wanted = cut.select(*keys, "_p", *((w - F.col("_before") + F.col("_first")).alias(c) for w, c in zip(places, ("_low", "_high"), strict=True)))
    picks = ranged.join(wanted, [*keys, "_p"]).where((F.col("_i") == F.col("_low")) | (F.col("_i") == F.col("_high")))
    return picks.groupBy(*keys).agg(F.avg("_v").alias("median"))


def weighted_medians(df: DataFrame, keys: Sequence[str], value: Column, weight: Column, keep: Keep) -> DataFrame:
    """As group_medians of rows that stand for ``weight`` rows each; weights are whole numbers."""
    keys, parts = list(keys), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(*keys, value.cast("double").alias("_v"), weight.cast("long").alias("_w")).where("_v is not null")
    ranged = keep(rows.repartitionByRange(parts, *keys, "_v").withColumn("_p", F.spark_partition_id()), "weighted")
    group = W.partitionBy(*keys)
    cut = ranged.groupBy(*keys, "_p").agg(F.sum("_w").alias("_n"))
    cut = cut.withColumns({"_before": F.sum("_n").over(group.orderBy("_p")) - F.col("_n"), "_total": F.sum("_n").over(group)})
    cut = cut.withColumns({"_low": F.floor((F.col("_total") - 1) / 2) - F.col("_before"), "_high": F.floor(F.col("_total") / 2) - F.col("_before")})
    wanted = cut.where("_low >= 0 and _low < _n or _high >= 0 and _high < _n").select(*keys, "_p", "_low", "_high")  # a part or two of a group
    near = ranged.join(wanted, [*keys, "_p"]).withColumn("_to", F.sum("_w").over(W.partitionBy(*keys, "_p").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)))
    picks = near.where("_low >= _to - _w and _low < _to or _high >= _to - _w and _high < _to")
    return picks.groupBy(*keys).agg(F.avg("_v").alias("median"))


def offsets(df: DataFrame, keys: Sequence[str], keep: Keep) -> DataFrame:
    """(keys, dx, dy, _n): each different offset of a group and the number of matches that have it. Stored.

    What a shift needs depends on the offset alone, so the matches are read and shuffled once, here, and tasks count their own before the shuffle.
    """
    dx, dy = F.col("dst_x") - F.col("src_x"), F.col("dst_y") - F.col("src_y")
    return keep(df.groupBy(*keys, dx.alias("dx"), dy.alias("dy")).agg(F.count(F.lit(1)).alias("_n")), "offsets")


def with_weighted_median(df: DataFrame, keys: Sequence[str], value: Column, name: str, keep: Keep) -> DataFrame:
    """As robust.with_median for groups of any size, of rows that stand for _n rows each."""
    return df.join(keep(weighted_medians(df, keys, value, F.col("_n"), keep).withColumnRenamed("median", name), "medians"), list(keys))


def _with_dist_bounds(counted: DataFrame, keys: Sequence[str], keep: Keep) -> DataFrame:
    """The offsets with dist, dist_median and dist_mad."""
    dist = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    marked = with_weighted_median(counted.withColumn("dist", dist), keys, F.col("dist"), "dist_median", keep)
    return with_weighted_median(marked, keys, F.abs(F.col("dist") - F.col("dist_median")), "dist_mad", keep)


def _within(limit: float) -> Column:
    return F.col("dist") <= F.least(F.col("dist_median") + 3 * F.col("dist_mad"), F.lit(limit))


def remove_gross_outliers(df: DataFrame, keep: Keep, keys: Sequence[str] = ("pair_id",), limit: float = 1000.0) -> DataFrame:
    """As robust.remove_gross_outliers for groups of any size."""
    bounds = _with_dist_bounds(offsets(df, keys, keep), keys, keep).groupBy(*keys).agg(F.max("dist_median").alias("dist_median"), F.max("dist_mad").alias("dist_mad"))
    return df.withColumn("dist", robust.offset_distance()).join(bounds, list(keys)).where(_within(limit)).drop("dist_median", "dist_mad")


def fit_shift(df: DataFrame, keep: Keep, keys: Sequence[str] = ("pair_id",)) -> DataFrame:
    """As robust.fit_shift for groups of any size."""
    return _shift_of_offsets(offsets(df, keys, keep), keep, keys)


def robust_shift(df: DataFrame, keep: Keep, keys: Sequence[str] = ("pair_id",), limit: float = 1000.0) -> DataFrame:
    """fit_shift of what remove_gross_outliers keeps, both from the same offsets."""
    near = _with_dist_bounds(offsets(df, keys, keep), keys, keep).where(_within(limit)).select(*keys, "dx", "dy", "_n")
    return _shift_of_offsets(keep(near, "near"), keep, keys)


def _shift_of_offsets(counted: DataFrame, keep: Keep, keys: Sequence[str]) -> DataFrame:
    keys, n = list(keys), F.col("_n")
    means = (robust.exact_mean(F.col(c), weight=n).alias(f"shift_{c[1]}") for c in ("dx", "dy"))
    shifts = keep(counted.groupBy(*keys).agg(F.sum(n).alias("n"), *means), "shifts")
    ex, ey = F.col("dx") - F.col("shift_x"), F.col("dy") - F.col("shift_y")
    errors = counted.join(shifts, keys).select(*keys, "_n", F.sqrt(ex * ex + ey * ey).alias("err"))
    return shifts.join(error_summary(errors, keys, "err", keep, weighted=True), keys)


def error_summary(df: DataFrame, keys: Sequence[str], err: str, keep: Keep, weighted: bool = False) -> DataFrame:
    """As robust.error_summary for groups of any size. weighted: rows stand for _n rows each."""
    e, w = F.col(err), F.col("_n") if weighted else None
    off = F.abs(e - F.col("e_median"))
    if weighted:
        marked = with_weighted_median(df, keys, e, "e_median", keep)
        mads = weighted_medians(marked, keys, off, w, keep)
    else:
        marked = df.join(group_medians(df, keys, e, keep).withColumnRenamed("median", "e_median"), list(keys))
        mads = group_medians(marked, keys, off, keep)
    stats = marked.groupBy(*keys).agg(F.max("e_median").alias("median_error"), robust.exact_mean(e, weight=w).alias("mean_error"), robust.exact_sd(e, weight=w).alias("std_error"), F.max(e).alias("max_error"))
    return stats.join(mads.withColumnRenamed("median", "mad"), list(keys)).withColumn("robust_rmse", F.col("median_error") + robust.MAD_TO_SD * F.col("mad")).drop("mad")


def largest_share(df: DataFrame, keys: Sequence[str] = ("pair_id",)) -> int:
    """Rows of the largest group, which says whether groups need splitting."""
    return df.groupBy(*keys).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]


# --- robust fits ---


def blocks(df: DataFrame, keep: Keep, chunk: int = CHUNK) -> DataFrame:
    """(pair_id, block, points): at most about ``chunk`` matches each, points being bytes of (hash, src_x, src_y, dst_x, dst_y). Stored."""
    rows = df.select("pair_id", F.xxhash64("match_id").alias("h"), *(F.col(c).cast("double").alias(c) for c in ("src_x", "src_y", "dst_x", "dst_y")))
    sizes = rows.groupBy("pair_id").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("n"))
    dealt = rows.join(sizes, "pair_id").withColumn("block", F.pmod(F.shiftright("h", 20), F.col("n")).cast("int"))

    def pack(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("h", kind="stable")
        points = np.c_[g["h"].to_numpy(np.int64).view(np.float64), g[["src_x", "src_y", "dst_x", "dst_y"]].to_numpy(float)]
        return pd.DataFrame({"pair_id": [key[0]], "block": [key[1]], "n": [int(g["n"].iloc[0])], "points": [points.tobytes()]})

    return keep(dealt.groupBy("pair_id", "block").applyInPandas(pack, "pair_id long, block int, n int, points binary"), "blocks")


def _points(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p = np.frombuffer(data).reshape(-1, 5)
    return p[:, 0].copy().view(np.int64), p[:, 1:3], p[:, 3:5]


def _pools(packed: DataFrame) -> DataFrame:
    """(pair_id, points): a block's matches of least hash, of which all blocks together have about twice POOL."""

    def least(frames):
        for frame in frames:
            yield pd.DataFrame({"pair_id": frame["pair_id"], "points": [p[: 40 * (2 * POOL // n + 8)] for p, n in zip(frame["points"], frame["n"], strict=True)]})

    return packed.select("pair_id", "n", "points").mapInPandas(least, "pair_id long, points binary")


def _errors(m: np.ndarray, s: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Distances of the mapped points, a row for each of the (k, 3, 3) matrices."""
    w = np.where(np.abs(w := m[:, 2, :2] @ s.T + m[:, 2, 2:]) < 1e-6, 1.0, w)
    return np.hypot((m[:, 0, :2] @ s.T + m[:, 0, 2:]) / w - d[:, 0], (m[:, 1, :2] @ s.T + m[:, 1, 2:]) / w - d[:, 1])


def _moments(s: np.ndarray, d: np.ndarray, norm: np.ndarray, kind: str) -> np.ndarray:
    """Sums that determine a fit, of normalised points: (n, sums of products of 1, x, y, u, v), for a homography of its equations."""
    x, u = (s - norm[:2]) / norm[4], (d - norm[2:4]) / norm[5]
    if kind != "homography":
        a = np.c_[np.ones(len(x)), x, u]
        return a.T @ a
    rows = np.zeros((2 * len(x), 9))
    rows[0::2, 0:2], rows[0::2, 2], rows[0::2, 6:8], rows[0::2, 8] = x, 1, -u[:, :1] * x, -u[:, 0]
    rows[1::2, 3:5], rows[1::2, 5], rows[1::2, 6:8], rows[1::2, 8] = x, 1, -u[:, 1:] * x, -u[:, 1]
    return rows.T @ rows


def _solved(kind: str, total: np.ndarray, norm: np.ndarray) -> np.ndarray | None:
    """The least-squares matrix of summed moments, or None where they do not determine it."""
    to = np.array([[1 / norm[4], 0, -norm[0] / norm[4]], [0, 1 / norm[4], -norm[1] / norm[4]], [0, 0, 1]])
    back = np.array([[norm[5], 0, norm[2]], [0, norm[5], norm[3]], [0, 0, 1]])
    if kind == "homography":
        values, vectors = np.linalg.eigh(total)
        if values[1] <= 1e-15 * values[-1]:
            return None
        h = back @ vectors[:, 0].reshape(3, 3) @ to
        return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None
    n = total[0, 0]
    if n < fits.LEAST_POINTS[kind]:
        return None
    mean, c = total[0] / n, total - np.outer(total[0], total[0]) / n
    if kind == "similarity":
        ss = c[1, 1] + c[2, 2]
        if ss < 1e-12 * n:
            return None
        a, b = (c[1, 3] + c[2, 4]) / ss, (c[1, 4] - c[2, 3]) / ss
        lin = np.array([[a, -b], [b, a]])
    else:
        if np.linalg.det(c[1:3, 1:3]) < 1e-12 * n * n:
            return None
        lin = np.linalg.solve(c[1:3, 1:3], c[1:3, 3:5]).T
    m = np.eye(3)
    m[:2, :2], m[:2, 2] = lin, mean[3:5] - lin @ mean[1:3]
    return back @ m @ to


def fit_matrix(df: DataFrame, kind: str, threshold: float, keep: Keep, chunk: int = CHUNK) -> DataFrame:
    """(pair_id, matrix, num_points, inlier_count, inlier_ratio, median_error, robust_rmse, mean_error, std_error, max_error, error) of a
    similarity, affine or homography fit of each pair, however many matches it has; errors are those of inliers."""
    packed = blocks(df, keep, chunk)
    need = fits.LEAST_POINTS[kind]

    def propose(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        h, s, d = (np.concatenate(c) for c in zip(*map(_points, g["points"]), strict=True))
        some = np.argsort(h, kind="stable")[:POOL]
        s, d = s[some], d[some]
        out = {"pair_id": [key[0]], "norm": [[]], "matrices": [b""]}
        if len(s) >= need:
            picks = fits.distinct_picks(np.random.default_rng(0), len(s), need, fits.ITERATIONS)
            m = fits.through(kind, s[picks], d[picks])
            if len(m):
                counts = np.concatenate([(_errors(m[i : i + 400], s, d) <= threshold).sum(1) for i in range(0, len(m), 400)])
                best = m[np.argsort(-counts, kind="stable")[:FINALISTS]]
                ms, md = s.mean(0), d.mean(0)
                size = [float(np.sqrt(((q - c) ** 2).sum(1).mean())) or 1.0 for q, c in ((s, ms), (d, md))]
                out |= {"norm": [[*ms, *md, *size]], "matrices": [best.tobytes()]}
        return pd.DataFrame(out)

    proposed = keep(_pools(packed).groupBy("pair_id").applyInPandas(propose, "pair_id long, norm array<double>, matrices binary"), "hypotheses")

    def score(frames):
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                _, s, d = _points(r.points)
                m = np.frombuffer(r.matrices).reshape(-1, 3, 3)
                rows.append((r.pair_id, len(s), [int((_errors(m[k : k + 1], s, d) <= threshold).sum()) for k in range(len(m))]))
            yield pd.DataFrame(rows, columns=["pair_id", "n", "counts"])

    scored = packed.select("pair_id", "points").join(proposed, "pair_id").mapInPandas(score, "pair_id long, n long, counts array<long>")
    sums = scored.select("pair_id", F.posexplode_outer("counts").alias("k", "c")).groupBy("pair_id", "k").agg(F.sum("c").alias("c")).groupBy("pair_id").agg(F.min(F.struct(-F.col("c"), "k")).alias("b"))
    best = keep(proposed.join(sums.select("pair_id", F.col("b.k").alias("k")), "pair_id"), "best")

    def gather(frames):
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                if len(r.norm):
                    _, s, d = _points(r.points)
                    m = np.frombuffer(r.matrices).reshape(-1, 3, 3)[int(r.k)]
                    inside = _errors(m[None], s, d)[0] <= threshold
                    rows.append((r.pair_id, _moments(s[inside], d[inside], np.array(r.norm), kind).ravel().tolist()))
            yield pd.DataFrame(rows, columns=["pair_id", "sums"])

    size = 81 if kind == "homography" else 25
    parts = packed.select("pair_id", "points").join(best, "pair_id").mapInPandas(gather, "pair_id long, sums array<double>")
    total = parts.groupBy("pair_id").agg(*(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(size))).select("pair_id", F.array(*(f"s{i}" for i in range(size))).alias("sums"))

    def settle(frames):
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                m = None if r.sums is None or not len(r.norm) else _solved(kind, np.array(r.sums, float).reshape(int(size**0.5), -1), np.array(r.norm))
                rows.append((r.pair_id, None if m is None else m.ravel().tolist()))
            yield pd.DataFrame(rows, columns=["pair_id", "matrix"])

    fitted = keep(proposed.join(total, "pair_id", "left").mapInPandas(settle, "pair_id long, matrix array<double>"), "fitted")

    def measure(frames):
        for frame in frames:
            for r in frame.itertuples():
                _, s, d = _points(r.points)
                e = np.minimum(_errors(np.array(r.matrix, float).reshape(1, 3, 3), s, d)[0], 1e6)
                yield pd.DataFrame({"pair_id": r.pair_id, "err": e, "inside": e <= threshold})

    errors = keep(packed.select("pair_id", "points").join(fitted.where("matrix is not null"), "pair_id").mapInPandas(measure, "pair_id long, err double, inside boolean"), "errors")
    counts = errors.groupBy("pair_id").agg(F.count(F.lit(1)).alias("num_points"), F.count_if("inside").alias("inlier_count"))
    used = errors.join(counts.select("pair_id", F.col("inlier_count").alias("_k")), "pair_id").where(F.col("inside") | (F.col("_k") == 0))
    summary = error_summary(used, ["pair_id"], "err", keep)
    out = fitted.join(counts, "pair_id", "left").join(summary, "pair_id", "left")
    sizes = df.groupBy("pair_id").agg(F.count(F.lit(1)).alias("_n"))
    why = F.when(F.col("matrix").isNull(), F.when(F.col("_n") < need, "insufficient_points").otherwise("degenerate_points"))
    return out.join(sizes, "pair_id").select(
        "pair_id", "matrix", F.col("_n").alias("num_points"), F.coalesce("inlier_count", F.lit(0)).alias("inlier_count"), (F.col("inlier_count") / F.col("num_points")).alias("inlier_ratio"),
        "median_error", "robust_rmse", "mean_error", "std_error", "max_error", why.alias("error"),
    )
