"""Robust statistics over correspondence tables: (pair_id, match_id, src_x, src_y, dst_x, dst_y, ...).

Filter, fit and error summary of a group use windows over the same keys, so a
chain of them reads its input once and shuffles it once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAD_TO_SD = 1.4826


def offset_distance() -> Column:
    dx, dy = F.col("dst_x") - F.col("src_x"), F.col("dst_y") - F.col("src_y")
    return F.sqrt(dx * dx + dy * dy)


def exact_mean(x: Column, digits: int = 6, over=None, weight: Column | None = None) -> Column:
    """A mean that does not depend on the order of summation: integers are summed, then divided once. over: a window. weight: rows that a row stands for."""
    unit = 10.0**digits
    y = F.round(x * unit).cast("long")
    total, n = (F.sum(y), F.count(x)) if weight is None else (F.sum(y * weight), F.sum(F.when(x.isNotNull(), weight)))
    return (total.over(over) if over is not None else total) / ((n.over(over) if over is not None else n) * F.lit(unit))


def exact_sd(x: Column, digits: int = 6, weight: Column | None = None) -> Column:
    """Population standard deviation from sums of scaled integers. weight: rows that a row stands for."""
    unit = 10.0**digits
    n, y = (F.count(x) if weight is None else F.sum(F.when(x.isNotNull(), weight))).cast("double"), F.round(x * unit).cast("decimal(38,0)")
    w = F.lit(1) if weight is None else weight
    mean, square = F.sum(y * w).cast("double") / n, F.sum(y * y * w).cast("double") / n
    return F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)) / unit


def with_median_and_mad(df: DataFrame, keys: Sequence[str], value: Column, prefix: str = "d") -> DataFrame:
    """Add {prefix}, {prefix}_median and {prefix}_mad per group; nulls have no part in them."""
    df = with_median(df.withColumn(prefix, value), keys, F.col(prefix), f"{prefix}_median")
    return with_median(df, keys, F.abs(F.col(prefix) - F.col(f"{prefix}_median")), f"{prefix}_mad")


def with_median(df: DataFrame, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    """Add the group's exact median; a task holds the distinct values of a group."""
    return df.withColumn("_value", value).withColumn(name, F.median("_value").over(W.partitionBy(*keys))).drop("_value")


def remove_gross_outliers(df: DataFrame, keys: Sequence[str] = ("pair_id",), limit: float = 1000.0) -> DataFrame:
    """Keep offsets of length at most min(median + 3 MAD, limit) of their group."""
    marked = with_median_and_mad(df, keys, offset_distance(), "dist")
    return marked.where(F.col("dist") <= F.least(F.col("dist_median") + 3 * F.col("dist_mad"), F.lit(limit))).drop("dist_median", "dist_mad")


def fit_shift(df: DataFrame, keys: Sequence[str] = ("pair_id",)) -> DataFrame:
    """Mean shift per group with residual statistics: n, shift_x, shift_y, median_error, robust_rmse, mean_error, std_error, max_error."""
    keys, group = list(keys), W.partitionBy(*keys)
    dx, dy = F.col("dst_x") - F.col("src_x"), F.col("dst_y") - F.col("src_y")
    res = df.withColumns({"n": F.count(F.lit(1)).over(group), "shift_x": exact_mean(dx, over=group), "shift_y": exact_mean(dy, over=group)})
    ex, ey = dx - F.col("shift_x"), dy - F.col("shift_y")
    return error_summary(res.withColumn("err", F.sqrt(ex * ex + ey * ey)), [*keys, "n", "shift_x", "shift_y"], "err")


def error_summary(df: DataFrame, keys: Sequence[str], err: str) -> DataFrame:
    marked = with_median_and_mad(df, keys, F.col(err), "e")
    stats = marked.groupBy(*keys).agg(
        F.max("e_median").alias("median_error"), F.max("e_mad").alias("mad_error"), exact_mean(F.col("e")).alias("mean_error"), exact_sd(F.col("e")).alias("std_error"), F.max("e").alias("max_error")
    )
    return stats.withColumn("robust_rmse", F.col("median_error") + MAD_TO_SD * F.col("mad_error")).drop("mad_error")


def distance_summary(df: DataFrame, keys: Sequence[str], pixel_m: float) -> DataFrame:
    """Mean, median, sd, min, max and percentiles of match distances in pixels and metres; zeros for no matches."""
    d, m = F.col("dist"), F.col("dist") * pixel_m
    aggs = [F.count(F.lit(1)).alias("n")]
    for name, x in (("px", d), ("m", m)):
        aggs += [
            F.coalesce(exact_mean(x), F.lit(0.0)).alias(f"mean_{name}"), F.coalesce(F.median(x), F.lit(0.0)).alias(f"median_{name}"), F.coalesce(exact_sd(x), F.lit(0.0)).alias(f"stddev_{name}"),
            F.coalesce(F.min(x), F.lit(0.0)).alias(f"min_{name}"), F.coalesce(F.max(x), F.lit(0.0)).alias(f"max_{name}"),
        ]
    aggs += [F.percentile("dist", F.lit(0.9)).alias("p90_px"), F.percentile("dist", F.lit(0.95)).alias("p95_px"), F.percentile("dist", F.lit(0.99)).alias("p99_px")]
    return df.withColumn("dist", offset_distance()).groupBy(*keys).agg(*aggs)


def histogram(df: DataFrame, value: str, bins: int, low: Column, high: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Counts of equal-width bins; the last bin holds its right edge. Bounds are columns of df. Values beyond are left out."""
    inside = df.where((F.col(value) >= low) & (F.col(value) <= high))
    at = F.when(high == low, F.lit(0)).otherwise(F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1)))
    edge = low + at * ((high - low) / bins)
    return inside.withColumn("bin", at.cast("int")).withColumn("left_edge", edge).groupBy(*keys, "bin").agg(F.min("left_edge").alias("left_edge"), F.count(F.lit(1)).alias("n"))


def inlier_errors(df: DataFrame, kind: str = "type", err: str = "err", inlier: str = "inlier") -> DataFrame:
    """Rows whose error belongs in a histogram: a spline goes through its control points, so its inliers are those with an error; of other types the marked ones."""
    return df.where(F.when(F.col(kind) == "spline", F.col(err) > 1e-6).otherwise(F.col(inlier)))


def colour_band(metres: Column, edges: tuple[float, float, float] = (5.0, 10.0, 20.0)) -> Column:
    a, b, c = edges
    return F.when(metres < a, "green").when(metres < b, "yellow").when(metres < c, "orange").otherwise("red")


def even_sample_by_y(df: DataFrame, keys: Sequence[str] = ("pair_id",), n: int = 200) -> DataFrame:
    """At most n matches per group, evenly spread along source y."""
    w = W.partitionBy(*keys).orderBy("src_y", "match_id")
    ranked = df.withColumn("rn", F.row_number().over(w)).withColumn("total", F.count(F.lit(1)).over(W.partitionBy(*keys)))
    step = F.greatest(F.lit(1), F.floor(F.col("total") / n))
    return ranked.where(((F.col("rn") - 1) % step == 0) & ((F.col("rn") - 1) / step < n)).drop("rn", "total")


def leaderboard(df: DataFrame, method: str = "method") -> DataFrame:
    """Matches per method and whether it is the best: most matches, the first by name of equals."""
    counts = df.groupBy(method).agg(F.count(F.lit(1)).alias("n"))
    best = counts.agg(F.min(F.struct(-F.col("n"), F.col(method))).alias("b")).select(F.col(f"b.{method}").alias("best"))
    return counts.join(F.broadcast(best)).select(method, "n", (F.col(method) == F.col("best")).alias("is_best"))  # one row


def collinearity(df: DataFrame, keys: Sequence[str] = ("pair_id",), first: int = 100) -> DataFrame:
    """Least area of triangles of consecutive source points among the first ones; below 1e-6 they are collinear."""
    w = W.partitionBy(*keys).orderBy("match_id")
    x1, y1, x2, y2 = (F.lead(c, k).over(w) for k in (1, 2) for c in ("src_x", "src_y"))
    t = df.select(*keys, "src_x", "src_y", F.row_number().over(w).alias("rn"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")).where((F.col("rn") <= first) & F.col("x2").isNotNull())
    area = F.abs((F.col("x1") - F.col("src_x")) * (F.col("y2") - F.col("src_y")) - (F.col("x2") - F.col("src_x")) * (F.col("y1") - F.col("src_y"))) / 2
    return t.groupBy(*keys).agg(F.min(area).alias("least_area"), F.count(F.lit(1)).alias("triples")).withColumn("collinear", F.col("least_area") < 1e-6)
