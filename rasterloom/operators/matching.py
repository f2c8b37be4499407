"""Descriptor matching, tile grids and patch correlation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Strongest keypoints of an image that take part, as matchers have it.
MAX_FEATURES = 5000
#: Descriptors of each side that a task compares at a time, about.
BLOCK = 2000
#: Candidates whose exact distance is taken; rounding of the product moves a distance by far less than their spread.
CLOSE = 16


def strongest(keypoints: DataFrame, image: Sequence[str] = (), n: int = MAX_FEATURES) -> DataFrame:
    w = W.partitionBy(*(image or [F.lit(0)])).orderBy(F.desc("response"), "kp_id")
    return keypoints.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def compare_blocks(s: pd.DataFrame, t: pd.DataFrame, metric: str) -> pd.DataFrame:
    """(query_id, distance, train_id): the two nearest rows of t (kp_id, descriptor) to each of s, ties to the smaller id."""
    kind = np.float64 if metric == "l2" else np.int64
    names = ["query_id", "distance", "train_id"]
    if not len(s) or not len(t):
        return pd.DataFrame({c: [] for c in names})
    t = t.sort_values("kp_id", kind="stable")
    ids, theirs, own = t["kp_id"].to_numpy(np.int64), np.array(t["descriptor"].tolist(), kind), np.array(s["descriptor"].tolist(), kind)
    out, squares = [], (theirs * theirs).sum(1)[None] if metric == "l2" else None
    for i in range(0, len(own), 64):
        if metric == "l2":
            part = own[i : i + 64]
            near = (part * part).sum(1)[:, None] - 2 * part @ theirs.T + squares
            # The product picks a few candidates; their distances are taken from the differences.
            some = np.argpartition(near, min(CLOSE, len(ids)) - 1, axis=1)[:, :CLOSE]
            limit = np.sort(np.take_along_axis(near, some, 1), axis=1)[:, : min(2, len(ids))][:, -1]
            if len(ids) > CLOSE and ((near <= limit[:, None] + 1e-9 * (1 + np.abs(near).max())).sum(1) > CLOSE).any():
                some = np.tile(np.arange(len(ids)), (len(part), 1))  # more are as near as the second than were picked
            some.sort(axis=1)
            exact = np.sqrt(((part[:, None, :] - theirs[some]) ** 2).sum(-1))
            best = np.argsort(exact, axis=1, kind="stable")[:, :2]
            out.append(pd.DataFrame({"query_id": np.repeat(s["kp_id"].to_numpy(np.int64)[i : i + 64], best.shape[1]), "distance": np.take_along_axis(exact, best, 1).ravel(), "train_id": ids[np.take_along_axis(some, best, 1)].ravel()}, columns=names))
            continue
        d = np.bitwise_count((own[i : i + 64, None, :] ^ theirs[None]).view(np.uint64)).sum(-1).astype(np.float64)
        order = np.argsort(d, axis=1, kind="stable")[:, :2]
        out.append(pd.DataFrame({"query_id": np.repeat(s["kp_id"].to_numpy(np.int64)[i : i + 64], order.shape[1]), "distance": np.take_along_axis(d, order, 1).ravel(), "train_id": ids[order].ravel()}, columns=names))
    return pd.concat(out)


def two_nearest(source: DataFrame, target: DataFrame, metric: str = "l2", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, query_id, train_id, distance, next_distance): the nearest and second nearest target of each source descriptor.

    keys: columns that name an image pair; descriptors of different pairs do not meet, and a pair with no target has no rows. Both sides of a
    pair are cut into blocks of about BLOCK rows by hash of their id, and each two blocks meet in a task, so neither many pairs nor a large one
    is a burden. Ties go to the smaller id; one target alone has no second.
    metric: l2 over float vectors, hamming over arrays of 64-bit words.
    """
    return _nearest(source, target, metric, keys, False).drop("back")


def _nearest(source: DataFrame, target: DataFrame, metric: str, keys: Sequence[str], both: bool) -> DataFrame:
    """Rows of two_nearest with back false; both: those of each target among the sources too, with back true, from the same blocks."""
    own_keys = list(keys) or ["_all"]
    names = [F.col(k).alias(k) for k in keys] or [F.lit(0).alias("_all")]
    sides = [df.select(*names, F.col("kp_id").cast("long").alias("kp_id"), F.col("descriptor").alias("descriptor")) for df in (source, target)]
    cuts = [df.groupBy(*own_keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(n)) for df, n in zip(sides, ("_s", "_t"), strict=True)]
    sizes = cuts[0].join(cuts[1], own_keys)

    def blocks(df: DataFrame, own: str, n: str, other: str, m: str):
        rows = df.join(sizes, own_keys).withColumn(own, F.pmod(F.xxhash64("kp_id"), F.col(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(m) - 1)))
        return rows.drop("_s", "_t").groupBy(*own_keys, "sb", "tb")

    def nearest(key: tuple, s: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        found = compare_blocks(s, t, metric).assign(back=False)
        if both:
            found = pd.concat([found, compare_blocks(t, s, metric).assign(back=True)])
        for k, v in zip(own_keys, key, strict=False):
            found[k] = v
        return found[[*own_keys, "back", "query_id", "distance", "train_id"]]

    schema = StructType([sides[0].schema[k] for k in own_keys]).add("back", "boolean").add("query_id", "long").add("distance", "double").add("train_id", "long")
    found = blocks(sides[0], "sb", "_s", "tb", "_t").cogroup(blocks(sides[1], "tb", "_t", "sb", "_s")).applyInPandas(nearest, schema)
    near = found.groupBy(*own_keys, "back", "query_id").agg(F.sort_array(F.collect_list(F.struct("distance", "train_id"))).alias("n"))  # two of each target block
    first = F.get("n", F.lit(0))
    return near.select(*keys, "back", "query_id", first["train_id"].alias("train_id"), first["distance"].alias("distance"), F.get("n", F.lit(1))["distance"].alias("next_distance"))


def ratio_matches(source: DataFrame, target: DataFrame, ratio: float, metric: str = "l2", keys: Sequence[str] = ()) -> DataFrame:
    """Lowe's test: the nearest is kept if it is nearer than ratio times the second."""
    return two_nearest(source, target, metric, keys).where(F.col("distance") < ratio * F.col("next_distance"))


def mutual_matches(source: DataFrame, target: DataFrame, metric: str = "l2", keys: Sequence[str] = ()) -> DataFrame:
    """Pairs that are each other's nearest; two blocks meet once for both ways."""
    near = _nearest(source, target, metric, keys, True)
    ends = [F.when(F.col("back"), F.col(x)).otherwise(F.col(y)).alias(y) for x, y in (("train_id", "query_id"), ("query_id", "train_id"))]
    pairs = near.select(*keys, *ends, "distance", "back").groupBy(*keys, "query_id", "train_id")
    return pairs.agg(F.max(F.when(~F.col("back"), F.col("distance"))).alias("distance"), F.count_distinct("back").alias("_ways")).where("_ways = 2").drop("_ways")


def with_keypoints(matches: DataFrame, source: DataFrame, target: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Coordinates of both ends by match index."""
    s = source.select(*keys, F.col("kp_id").alias("query_id"), F.col("x").alias("src_x"), F.col("y").alias("src_y"))
    t = target.select(*keys, F.col("kp_id").alias("train_id"), F.col("x").alias("dst_x"), F.col("y").alias("dst_y"))
    return matches.where("query_id >= 0 and train_id >= 0").join(s, [*keys, "query_id"]).join(t, [*keys, "train_id"])


def confidence_to_distance(confidence: Column) -> Column:
    return F.coalesce(1.0 - confidence, F.lit(0.5))


def tile_grid(rasters: DataFrame, tile: int = 2048, overlap: int = 256, least: int = 64) -> DataFrame:
    """Tiles (ty, tx, y0, y1, x0, x1) of each raster, those with a side below ``least`` left out."""

    def starts(size: str) -> Column:
        n = F.greatest(F.lit(1), F.floor((F.col(size) + tile - overlap - 1) / (tile - overlap))).cast("int")
        return F.sequence(F.lit(0), n - 1)

    step = tile - overlap
    t = rasters.select("*", F.explode(starts("height")).alias("ty")).select("*", F.explode(starts("width")).alias("tx"))
    t = t.withColumn("y0", F.col("ty") * step).withColumn("x0", F.col("tx") * step)
    t = t.withColumn("y1", F.least(F.col("y0") + tile, "height")).withColumn("x1", F.least(F.col("x0") + tile, "width"))
    return t.where((F.col("y1") - F.col("y0") >= least) & (F.col("x1") - F.col("x0") >= least))


def needs_tiles(width: Column, height: Column, tile: int = 2048) -> Column:
    return (width > 2 * tile) | (height > 2 * tile)


def patch_grid(rasters: DataFrame, patch: int, spacing: int) -> DataFrame:
    """Patch centres (py, px), the upper bound excluded."""

    def centres(size: str) -> Column:
        last = F.col(size) - patch // 2 - 1
        return F.when(last >= patch // 2, F.sequence(F.lit(patch // 2), last.cast("int"), F.lit(spacing))).otherwise(F.array().cast("array<int>"))

    return rasters.select("*", F.explode(centres("height")).alias("py")).select("*", F.explode(centres("width")).alias("px"))


def first_patches(centres: DataFrame, n: int) -> DataFrame:
    """The first n patches of each raster in the order of its grid."""
    w = W.partitionBy("raster_id").orderBy("py", "px")
    return centres.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


#: A match needs a valid source pixel this near, and a search region so many valid ones of the patch's area or so large a share.
NEAR, PATCH_SHARE, REGION_SHARE = 5, 0.2, 0.1


def patch_ncc(source: DataFrame, target: DataFrame, centres: DataFrame, patch: int, margin: int, valid: int | None = None) -> DataFrame:
    """Best offset of each target patch in the source: (raster_id, py, px, dy, dx, ncc).

    Pixel tables (raster_id, row, col, value) have whole values. A task has a square of centres and the pixels that
    they reach, so a pixel goes to about four tasks whatever the margin. Correlation is Pearson's over
    the patch, from exact sums: a transform for the products, running sums for the rest. Flat patches and offsets that leave the raster
    have none. Ties go to the first offset in row-major order.

    valid: pixels above it are valid. Then a patch whose centre is not is left out, as are one whose search region has too
    few valid source pixels and a match with none within NEAR of it.
    """
    half, reach = patch // 2, margin + patch + NEAR
    side = max(64, 2 * reach)

    def squares(value: str, around: int) -> Column:
        return F.explode(F.sequence(F.floor((F.col(value) - around) / side).cast("int"), F.floor((F.col(value) + around) / side).cast("int")))

    def dealt(df: DataFrame, kind: int, y: str, x: str, value: Column, around: int) -> DataFrame:
        rows = df.select("raster_id", F.lit(kind).alias("kind"), F.col(y).cast("int").alias("row"), F.col(x).cast("int").alias("col"), value.cast("long").alias("value"))
        return rows.withColumn("by", squares("row", around)).withColumn("bx", squares("col", around))

    rows = dealt(centres, 0, "py", "px", F.lit(0), 0).unionByName(dealt(source, 1, "row", "col", F.col("value"), reach)).unionByName(dealt(target, 2, "row", "col", F.col("value"), half + 1))
    used = centres.select("raster_id", F.floor(F.col("py") / side).cast("int").alias("by"), F.floor(F.col("px") / side).cast("int").alias("bx")).distinct()
    rows = rows.join(used, ["raster_id", "by", "bx"], "left_semi")

    def match(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        top, left = key[1] * side - reach, key[2] * side - reach
        n = side + 2 * reach
        value, there = np.zeros((2, n, n)), np.zeros((2, n, n), bool)
        for k in (1, 2):
            p = g[g["kind"] == k]
            y, x = p["row"].to_numpy() - top, p["col"].to_numpy() - left
            value[k - 1, y, x], there[k - 1, y, x] = p["value"], True
        ok = there[0] & (value[0] > valid) if valid is not None else there[0]
        sums = [np.pad(np.cumsum(np.cumsum(a, 0), 1), ((1, 0), (1, 0))) for a in (value[0], value[0] ** 2, there[0].astype(float), ok.astype(float))]

        def box(a: np.ndarray, y0, y1, x0, x1):
            return a[y1, x1] - a[y0, x1] - a[y1, x0] + a[y0, x0]

        out, offsets = [], np.arange(2 * margin + 1)
        for y, x in sorted(zip(g["row"][g["kind"] == 0].tolist(), g["col"][g["kind"] == 0].tolist(), strict=True)):
            cy, cx = y - top, x - left
            t, full = value[1, cy - half : cy + half, cx - half : cx + half], there[1, cy - half : cy + half, cx - half : cx + half].all()
            m = float(t.size)
            spread = m * (t * t).sum() - t.sum() ** 2
            if not full or spread <= 0 or valid is not None and not (there[1, cy, cx] and value[1, cy, cx] > valid):
                continue
            if valid is not None:
                a, b, c, d = cy - margin, cy + margin + patch, cx - margin, cx + margin + patch
                area, good = box(sums[2], a, b, c, d), box(sums[3], a, b, c, d)
                if good < PATCH_SHARE * patch * patch and good < REGION_SHARE * area:
                    continue
            a, c = cy - half - margin, cx - half - margin
            region = value[0, a : a + 2 * (half + margin), c : c + 2 * (half + margin)]
            shape = region.shape
            cross = np.rint(np.fft.irfft2(np.fft.rfft2(region) * np.conj(np.fft.rfft2(t, shape)), shape))[: 2 * margin + 1, : 2 * margin + 1]
            yy, xx = (a + offsets)[:, None], (c + offsets)[None]
            s1, s2, have = (box(q, yy, yy + 2 * half, xx, xx + 2 * half) for q in sums[:3])
            own = m * s2 - s1 * s1
            with np.errstate(divide="ignore", invalid="ignore"):
                ncc = np.where((have == m) & (own > 0), (m * cross - s1 * t.sum()) / np.sqrt(own * spread), -np.inf)
            k = int(np.argmax(np.round(ncc, 9)))
            dy, dx = divmod(k, 2 * margin + 1)
            if not np.isfinite(ncc[dy, dx]):
                continue
            sy, sx = cy + dy - margin, cx + dx - margin
            if valid is not None and not box(sums[3], sy - NEAR, sy + NEAR + 1, sx - NEAR, sx + NEAR + 1):
                continue
            out.append((key[0], y, x, dy - margin, dx - margin, float(ncc[dy, dx])))
        return pd.DataFrame(out, columns=["raster_id", "py", "px", "dy", "dx", "ncc"])

    return rows.groupBy("raster_id", "by", "bx").applyInPandas(match, "raster_id long, py int, px int, dy int, dx int, ncc double")
