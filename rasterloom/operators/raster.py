"""Rasters as pixel tables (raster_id, band, row, col, value) and as tiles of bytes.

Everything that SQL can say works on pixels. Warps work on tiles: source and
output tiles meet by number, an equi join, and each pair is resampled in numpy.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GRAY = (0.299, 0.587, 0.114)


def valid_mask(value: Column, threshold: int = 10) -> Column:
    return value > threshold


def apply_mask(value: Column, mask: Column) -> Column:
    return F.when(mask, value).otherwise(0)


def normalise(pixels: DataFrame, keys: tuple[str, ...] = ("raster_id",)) -> DataFrame:
    """To 0..255 by the least and largest value of the group, towards zero; flat groups become 0."""
    ends = pixels.groupBy(*keys).agg(F.min("value").alias("_low"), F.max("value").alias("_high"))
    scaled = F.when(F.col("_high") > F.col("_low"), ((F.col("value") - F.col("_low")) * 255 / (F.col("_high") - F.col("_low"))).cast("int")).otherwise(0)
    return pixels.join(ends, list(keys)).withColumn("value", scaled).drop("_low", "_high")


def gray(r: Column, g: Column, b: Column) -> Column:
    return (r * 299 + g * 587 + b * 114) / 1000


def three_bands(pixels: DataFrame) -> DataFrame:
    """One band becomes three equal ones, of two the second is doubled, of more the first three stay."""
    bands = pixels.groupBy("raster_id").agg(F.max("band").alias("_n"))
    p = pixels.join(bands, "raster_id").where("band <= 3")
    copies = F.when(F.col("_n") == 1, F.array(F.lit(1), F.lit(2), F.lit(3))).when((F.col("_n") == 2) & (F.col("band") == 2), F.array(F.lit(2), F.lit(3))).otherwise(F.array("band"))
    return p.withColumn("band", F.explode(copies)).drop("_n")


def window(pixels: DataFrame, row0: int, row1: int, col0: int, col1: int, rebase: bool = False) -> DataFrame:
    """The block [row0, row1) x [col0, col1); a filter that reaches the scan."""
    out = pixels.where((F.col("row") >= row0) & (F.col("row") < row1) & (F.col("col") >= col0) & (F.col("col") < col1))
    return out.withColumn("row", F.col("row") - row0).withColumn("col", F.col("col") - col0) if rebase else out


def downsample_box(pixels: DataFrame, factor: int) -> DataFrame:
    """Mean of blocks of factor x factor pixels, from integer sums."""
    r, c = F.floor(F.col("row") / factor).cast("int"), F.floor(F.col("col") / factor).cast("int")
    return pixels.groupBy("raster_id", r.alias("row"), c.alias("col")).agg((F.sum(F.col("value").cast("long")) / F.count(F.lit(1))).alias("value"))


def upsample_nearest(pixels: DataFrame, factor: int) -> DataFrame:
    spread = F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))
    p = pixels.withColumn("_r", spread).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
    return p.select("raster_id", (F.col("row") * factor + F.col("_r")).alias("row"), (F.col("col") * factor + F.col("_c")).alias("col"), "value")


def shift_nearest(pixels: DataFrame, dx: int, dy: int, width: int, height: int) -> DataFrame:
    """Moved by whole pixels; what leaves the raster is cut, what is not reached is 0 (that is, absent)."""
    p = pixels.withColumn("row", F.col("row") + dy).withColumn("col", F.col("col") + dx)
    return p.where((F.col("row") >= 0) & (F.col("row") < height) & (F.col("col") >= 0) & (F.col("col") < width))


def sobel(pixels: DataFrame) -> DataFrame:
    """Squared magnitude of the 3 x 3 gradient of inner pixels; each pixel adds to its eight neighbours, so there is no join."""
    steps = F.array(*(F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr in (-1, 0, 1) for dc in (-1, 0, 1)))
    p = pixels.withColumn("_s", F.explode(steps))
    # The pixel is at (-dr, -dc) from the one that it adds to.
    gx, gy = -F.col("_s.dc") * (2 - F.abs("_s.dr")), -F.col("_s.dr") * (2 - F.abs("_s.dc"))
    sums = p.groupBy("raster_id", (F.col("row") + F.col("_s.dr")).alias("row"), (F.col("col") + F.col("_s.dc")).alias("col")).agg(
        F.sum(F.col("value").cast("long") * gx).alias("gx"), F.sum(F.col("value").cast("long") * gy).alias("gy"), F.count(F.lit(1)).alias("n")
    )
    return sums.where("n = 9").select("raster_id", "row", "col", "gx", "gy", (F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("mag2"))


def tile_validity(pixels: DataFrame, tile: int, least: float = 0.1) -> DataFrame:
    """Share of valid pixels of each tile, tiles below ``least`` left out."""
    t = pixels.groupBy("raster_id", F.floor(F.col("row") / tile).cast("int").alias("ty"), F.floor(F.col("col") / tile).cast("int").alias("tx"))
    return t.agg(F.sum(valid_mask(F.col("value")).cast("int")).cast("long").alias("valid"), F.count(F.lit(1)).alias("total")).where(F.col("valid") >= least * F.col("total"))


def y_coverage(pixels: DataFrame, height: int) -> DataFrame:
    """Valid pixels in the top quarter, the middle half and the bottom quarter."""
    ok, q1, q3 = valid_mask(F.col("value")), height // 4, 3 * height // 4
    return pixels.groupBy("raster_id").agg(
        F.count_if(ok & (F.col("row") < q1)).alias("top"), F.count_if(ok & (F.col("row") >= q1) & (F.col("row") < q3)).alias("middle"), F.count_if(ok & (F.col("row") >= q3)).alias("bottom")
    )


def to_tiles(pixels: DataFrame, tile: int) -> DataFrame:
    """(raster_id, ty, tx, data): float32 bytes of tile x tile values, 0 where there is no pixel."""

    def fill(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((tile, tile), np.float32)
        out[g["row"] - key[1] * tile, g["col"] - key[2] * tile] = g["value"]
        return pd.DataFrame({"raster_id": [key[0]], "ty": [key[1]], "tx": [key[2]], "data": [out.tobytes()]})

    p = pixels.select("raster_id", "row", "col", "value", F.floor(F.col("row") / tile).cast("int").alias("ty"), F.floor(F.col("col") / tile).cast("int").alias("tx"))
    return p.groupBy("raster_id", "ty", "tx").applyInPandas(fill, "raster_id long, ty int, tx int, data binary")


def gray_tiles(tiles: DataFrame) -> DataFrame:
    """Tiles (path, ty, tx, data) in gray of (path, band, ty, tx, data) with the bands red, green and blue or a single one."""

    def mix(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        bands = {r.band: np.frombuffer(r.data, np.float32) for r in g.itertuples()}
        out = sum(w * bands[k] for k, w in enumerate(GRAY, 1)) if len(bands) >= 3 else bands[min(bands)]
        return pd.DataFrame({"path": [key[0]], "ty": [key[1]], "tx": [key[2]], "data": [np.asarray(out, np.float32).tobytes()]})

    return tiles.groupBy("path", "ty", "tx").applyInPandas(mix, "path string, ty int, tx int, data binary")


def reduce_tiles(tiles: DataFrame, tile: int, factor: int) -> DataFrame:
    """Tiles of the raster at 1 / factor of its size, by means of factor x factor values; ``factor`` divides ``tile``. A task holds the tiles of one output tile, one after another."""
    if factor == 1:
        return tiles
    if tile % factor:
        raise ValueError(f"{factor} does not divide {tile}")
    side = tile // factor

    def shrink(frames):
        for frame in frames:
            data = [np.frombuffer(d, np.float32).reshape(side, factor, side, factor).mean(axis=(1, 3)).tobytes() for d in frame["data"]]
            yield frame.assign(data=data)

    def join(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((tile, tile), np.float32)
        for r in g.itertuples():
            y, x = (r.ty - key[1] * factor) * side, (r.tx - key[2] * factor) * side
            out[y : y + side, x : x + side] = np.frombuffer(r.data, np.float32).reshape(side, side)
        return pd.DataFrame({"raster_id": [key[0]], "ty": [key[1]], "tx": [key[2]], "data": [out.tobytes()]})

    small = tiles.select("raster_id", "ty", "tx", "data").mapInPandas(shrink, "raster_id long, ty int, tx int, data binary")  # before the shuffle
    keyed = small.withColumn("oy", F.floor(F.col("ty") / factor).cast("int")).withColumn("ox", F.floor(F.col("tx") / factor).cast("int"))
    return keyed.groupBy("raster_id", "oy", "ox").applyInPandas(join, "raster_id long, ty int, tx int, data binary")


def _looked_up(inverse: Callable[[np.ndarray], np.ndarray], ty: int, tx: int, tile: int) -> np.ndarray:
    """Source x, y of every pixel of an output tile; far outside where the map has no finite value."""
    gy, gx = np.meshgrid(np.arange(tile) + ty * tile, np.arange(tile) + tx * tile, indexing="ij")
    s = np.asarray(inverse(np.c_[gx.ravel(), gy.ravel()].astype(float)), float)
    return np.clip(np.where(np.isfinite(s), s, -1e9), -1e9, 1e9)


def _corners(s: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, weight) of the four pixels that bilinear interpolation at each place mixes."""
    fx, fy = np.floor(s[:, 0]), np.floor(s[:, 1])
    out = []
    for dx in (0, 1):
        for dy in (0, 1):
            x, y = (fx + dx).astype(np.int64), (fy + dy).astype(np.int64)
            out.append((x, y, (1 - np.abs(s[:, 0] - x)) * (1 - np.abs(s[:, 1] - y))))
    return out


def warp_tiles(tiles: DataFrame, inverse: Callable[[np.ndarray], np.ndarray], tile: int, height: int, width: int, source: tuple[int, int] | None = None, ids: tuple[int, ...] | None = None) -> DataFrame:
    """Resample bilinearly; ``inverse`` maps output (n, 2) x, y to source ones and is the same on every task.

    Tasks look up every pixel of an output tile to learn which source tiles it needs, so a map that bends within a tile
    loses nothing, and one that scatters costs as many rows as it has pixels at most. Source and output tiles meet by
    number; each pair gives the pixels, or the shares of pixels, that the source tile has, and an output tile adds them up: a task
    holds one source tile at a time. ``source``: height and width, where a raster ends before its tiles do. ``ids``: the
    raster_ids, where they are known. An output tile of which the source has nothing is all 0.
    """
    spark, down, across = tiles.sparkSession, -(-height // tile), -(-width // tile)
    most = (-(-source[0] // tile), -(-source[1] // tile)) if source else (2**20, 2**20)

    def needed(frames):
        for frame in frames:
            rows = []
            for oy, ox in (divmod(int(k), across) for k in frame["id"]):
                keys = [np.unique((y // tile)[ok] << 32 | (x // tile)[ok]) for x, y, w in _corners(_looked_up(inverse, oy, ox, tile)) if (ok := (w > 0) & (x >= 0) & (y >= 0) & (y // tile < most[0]) & (x // tile < most[1])).any()]
                rows += [(oy, ox, int(k >> 32), int(k & 0xFFFFFFFF)) for k in np.unique(np.concatenate(keys))] if keys else []
            yield pd.DataFrame(rows, columns=["oy", "ox", "ty", "tx"])

    def place(frames):
        looked: dict[tuple[int, int], np.ndarray] = {}
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                if (r.oy, r.ox) not in looked:
                    if len(looked) >= 8:
                        looked.clear()
                    looked[r.oy, r.ox] = _looked_up(inverse, r.oy, r.ox, tile)
                src, out, share = np.frombuffer(r.data, np.float32), np.zeros(tile * tile), np.zeros(tile * tile)
                for x, y, w in _corners(looked[r.oy, r.ox]):
                    at = np.flatnonzero((x // tile == r.tx) & (y // tile == r.ty) & (w > 0))
                    out[at] += w[at] * src[(y[at] - r.ty * tile) * tile + x[at] - r.tx * tile]
                    share[at] += w[at]
                whole, part = np.flatnonzero(share > 1 - 1e-12), np.flatnonzero((share > 0) & (share <= 1 - 1e-12))
                dense = len(whole) == tile * tile
                rows.append((r.raster_id, r.oy, r.ox, b"" if dense else whole.astype("<i4").tobytes(), out[whole].astype(np.float32).tobytes(), part.astype("<i4").tobytes(), out[part].tobytes()))
            yield pd.DataFrame(rows, columns=["raster_id", "oy", "ox", "at", "value", "part_at", "part"])

    def add(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        out, parts = np.zeros(tile * tile, np.float32), np.zeros(tile * tile)
        for r in g.sort_values(["part_at", "part"], na_position="last").itertuples():
            if r.value is not None:
                value = np.frombuffer(r.value, np.float32)
                at = np.frombuffer(r.at, "<i4") if len(r.at) or not len(value) else slice(None)
                out[at] = value
                parts[np.frombuffer(r.part_at, "<i4")] += np.frombuffer(r.part)
        return pd.DataFrame({"raster_id": [key[0]], "ty": [key[1]], "tx": [key[2]], "data": [(out + parts.astype(np.float32)).tobytes()]})

    # Spark takes the plan for as small as the list of output tiles, so it must not be broadcast.
    plan = spark.range(down * across).mapInPandas(needed, "oy int, ox int, ty int, tx int").hint("merge")
    met = tiles.join(plan, ["ty", "tx"]).select("raster_id", "oy", "ox", "ty", "tx", "data")
    found = met.mapInPandas(place, "raster_id long, oy int, ox int, at binary, value binary, part_at binary, part binary")
    which = spark.createDataFrame([(int(i),) for i in ids], "raster_id long") if ids is not None else tiles.select("raster_id").distinct()
    grid = spark.range(down * across).select(F.floor(F.col("id") / across).cast("int").alias("oy"), (F.col("id") % across).cast("int").alias("ox"))
    rows = found.unionByName(which.crossJoin(grid), allowMissingColumns=True)  # a row for each output tile of each raster
    return rows.groupBy("raster_id", "oy", "ox").applyInPandas(add, "raster_id long, ty int, tx int, data binary")


def warp_extent(rasters: DataFrame, matrix: tuple[Column, ...]) -> DataFrame:
    """Least and largest mapped corner of each raster and the size of what holds them."""
    corners = F.array(*(F.struct((F.lit(i).cast("double") * F.col("width")).alias("x"), (F.lit(j).cast("double") * F.col("height")).alias("y")) for i in (0, 1) for j in (0, 1)))
    c = rasters.select("raster_id", "width", "height", F.explode(corners).alias("p"))
    m = matrix
    x, y = m[0] * F.col("p.x") + m[1] * F.col("p.y") + m[2], m[3] * F.col("p.x") + m[4] * F.col("p.y") + m[5]
    e = c.groupBy("raster_id").agg(F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(x).alias("max_x"), F.max(y).alias("max_y"))
    return e.withColumn("out_width", F.ceil(F.col("max_x") - F.col("min_x"))).withColumn("out_height", F.ceil(F.col("max_y") - F.col("min_y")))


def local_contrast(image: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited adaptive histogram equalisation of an 8-bit image."""
    h, w = image.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    padded = np.pad(image, ((0, th * tiles - h), (0, tw * tiles - w)), mode="edge")
    maps = np.empty((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            hist = np.bincount(padded[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256).astype(float)
            limit = max(1.0, clip * th * tw / 256)
            over = np.maximum(hist - limit, 0).sum()
            maps[i, j] = np.cumsum(np.minimum(hist, limit) + over / 256) * 255 / (th * tw)
    y, x = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.clip(np.floor(y).astype(int), 0, tiles - 1), np.clip(np.floor(x).astype(int), 0, tiles - 1)
    y1, x1 = np.clip(y0 + 1, 0, tiles - 1), np.clip(x0 + 1, 0, tiles - 1)
    fy, fx = np.clip(y - y0, 0, 1)[:, None], np.clip(x - x0, 0, 1)[None]
    a, b, c, d = (maps[i[:, None], j[None], image] for i, j in ((y0, x0), (y0, x1), (y1, x0), (y1, x1)))
    return np.clip(np.rint((a * (1 - fx) + b * fx) * (1 - fy) + (c * (1 - fx) + d * fx) * fy), 0, 255).astype(np.uint8)


def edges(image: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Binary edge map: gradient, thinning along it, and hysteresis."""
    p = np.pad(image.astype(float), 1, mode="edge")
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    m = np.abs(gx) + np.abs(gy)
    sector = (np.round(np.arctan2(gy, gx) / (np.pi / 4)).astype(int)) % 4
    q = np.pad(m, 1)
    thin = np.zeros(m.shape, bool)
    for s, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        ahead, behind = q[1 + dy : q.shape[0] - 1 + dy, 1 + dx : q.shape[1] - 1 + dx], q[1 - dy : q.shape[0] - 1 - dy, 1 - dx : q.shape[1] - 1 - dx]
        thin |= (sector == s) & (m > behind) & (m >= ahead)
    weak, strong = thin & (m > low), thin & (m > high)
    while True:
        g = np.pad(strong, 1)
        grown = weak & np.any([g[1 + a : g.shape[0] - 1 + a, 1 + b : g.shape[1] - 1 + b] for a in (-1, 0, 1) for b in (-1, 0, 1)], axis=0)
        if (grown | strong).sum() == strong.sum():
            return strong.astype(np.uint8) * 255
        strong |= grown


def running_mean_steps(steps: DataFrame, order: str = "step", value: str = "mean_error") -> DataFrame:
    """Trend against the step before: N/A, Improving, Degrading or Same. Steps are few."""
    before = F.lag(value).over(W.orderBy(order))
    return steps.withColumn("trend", F.when(before.isNull(), "N/A").when(F.col(value) < before, "Improving").when(F.col(value) > before, "Degrading").otherwise("Same"))
