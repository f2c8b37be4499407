"""Two rasters on one grid: what they share, a lattice for each scale, and resampling to it by any real factor.

The lattice of a scale is the source's own grid with pixels 1 / scale as long: its edge i lies at source pixel
edge i / scale, and at target pixel edge start + i * step. Rasters in one reference system, without rotation, whose
pixels run the same way have such a lattice. Resampling is linear and separable, so each input tile adds its part
to the output tiles that it meets and no tile needs its neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GEOTRANSFORM = ("a", "b", "c", "d", "e", "f", "width", "height", "left", "bottom", "right", "top", "epsg")


def pair_of(source: DataFrame, target: DataFrame, keys: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """Headers of both sides with prefixed names, ready for a join."""
    return tuple(r.select(F.col(k).alias(f"{p}_id"), *(F.col(c).alias(f"{p}_{c}") for c in GEOTRANSFORM)) for r, k, p in ((source, keys[0], "s"), (target, keys[1], "t")))


def common_lattice(pairs: DataFrame, scale: Column | float) -> DataFrame:
    """Rows of source and target headers (s_..., t_...) with the lattice of a scale.

    lattice_width, lattice_height: its size over the whole source; x0, y0, x1, y1: the window of the overlap; start_x, step_x,
    start_y, step_y: target pixel edges of the lattice's; problem: why there is no lattice, null if there is one.
    """
    k = F.lit(scale).cast("double") if isinstance(scale, float | int) else scale
    left, right = F.greatest("s_left", "t_left"), F.least("s_right", "t_right")
    bottom, top = F.greatest("s_bottom", "t_bottom"), F.least("s_top", "t_top")
    problem = (
        F.when(~F.col("s_epsg").eqNullSafe(F.col("t_epsg")), "reference systems differ").when((left >= right) | (bottom >= top), "no overlap")
        .when((F.col("s_b") != 0) | (F.col("s_d") != 0) | (F.col("t_b") != 0) | (F.col("t_d") != 0), "rotated").when((F.col("s_a") * F.col("t_a") <= 0) | (F.col("s_e") * F.col("t_e") <= 0), "pixels run different ways")
    )
    out = pairs.withColumn("problem", problem)
    for axis, size, unit, origin, ends in (("x", "width", "a", "c", (left, right)), ("y", "height", "e", "f", (top, bottom))):
        n = F.ceil(F.col(f"s_{size}") * k).cast("long")
        near, far = ((v - F.col(f"s_{origin}")) / F.col(f"s_{unit}") * k for v in ends)
        low, high = F.least(near, far), F.greatest(near, far)
        step = F.col(f"s_{unit}") / k / F.col(f"t_{unit}")
        out = out.withColumns({
            f"lattice_{size}": n, f"{axis}0": F.greatest(F.lit(0), F.floor(low)).cast("long"), f"{axis}1": F.least(n, F.ceil(high)).cast("long"),
            f"start_{axis}": (F.col(f"s_{origin}") - F.col(f"t_{origin}")) / F.col(f"t_{unit}"), f"step_{axis}": step,
        })
    return out


class Axis(NamedTuple):
    """Output pixel i in [first, last) covers the input from pixel edge start + i * step on, a step long; the input has ``size`` pixels."""

    start: float
    step: float
    size: int
    first: int
    last: int


def covered(axis: Axis, i: np.ndarray) -> np.ndarray:
    """Length of the input under output pixels (1 by cubic weights, which add up to it already)."""
    if axis.step < 1:
        s = axis.start + (i + 0.5) * axis.step
        return np.where((s >= 0) & (s <= axis.size), 1.0, 0.0)
    a = axis.start + i * axis.step
    return np.clip(np.minimum(a + axis.step, axis.size) - np.maximum(a, 0), 0, None)


def weights(axis: Axis, low: int, high: int) -> tuple[int, np.ndarray]:
    """The first output pixel that input pixels [low, high) reach, and a row of their weights for it and each that follows.

    From one input pixel a step on: lengths of overlap, to be divided by ``covered``. Below: Keys' cubic between centres, a = -1/2.
    """
    margin = 2 if axis.step < 1 else 0
    i0 = max(axis.first, int(np.floor((low - margin - axis.start) / axis.step)) - 1)
    i1 = min(axis.last, int(np.ceil((high + margin - axis.start) / axis.step)) + 1)
    i, j = np.arange(i0, max(i0, i1), dtype=float)[:, None], np.arange(low, high, dtype=float)[None]
    if axis.step >= 1:
        a = axis.start + i * axis.step
        return i0, np.clip(np.minimum(a + axis.step, j + 1) - np.maximum(a, j), 0, None) * (j < axis.size)
    s = axis.start + (i + 0.5) * axis.step - 0.5
    out = np.zeros((len(i), high - low))
    inside = (s >= -0.5) & (s <= axis.size - 0.5)
    for tap in (-1, 0, 1, 2):
        at = np.floor(s) + tap
        d = np.abs(s - at)
        w = np.where(d < 1, (1.5 * d - 2.5) * d * d + 1, ((-0.5 * d + 2.5) * d - 4) * d + 2)
        out += np.where(inside & (np.clip(at, 0, axis.size - 1) == j), w, 0)
    return i0, out


def resample_tiles(tiles: DataFrame, tile: int, y: Axis, x: Axis) -> DataFrame:
    """Tiles (raster_id, ty, tx, data) of the resampled raster; output pixels beyond the input are 0, output tiles without input absent.

    Each input tile is reduced before the shuffle; an output tile's parts are added up in one task.
    """

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                i0, wy = weights(y, r.ty * tile, (r.ty + 1) * tile)
                j0, wx = weights(x, r.tx * tile, (r.tx + 1) * tile)
                if not len(wy) or not len(wx):
                    continue
                part = wy @ np.frombuffer(r.data, np.float32).reshape(tile, tile).astype(float) @ wx.T
                rows = []
                for oy in range(i0 // tile, (i0 + len(wy) - 1) // tile + 1):
                    a, b = max(i0, oy * tile), min(i0 + len(wy), (oy + 1) * tile)
                    for ox in range(j0 // tile, (j0 + len(wx) - 1) // tile + 1):
                        c, d = max(j0, ox * tile), min(j0 + len(wx), (ox + 1) * tile)
                        piece = part[a - i0 : b - i0, c - j0 : d - j0]
                        if piece.any():
                            rows.append((r.raster_id, oy, ox, a - oy * tile, c - ox * tile, b - a, d - c, piece.tobytes()))
                yield pd.DataFrame(rows, columns=["raster_id", "oy", "ox", "y", "x", "h", "w", "part"])

    def add(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((tile, tile))
        for r in g.sort_values(["y", "x", "h", "w"]).itertuples():
            out[r.y : r.y + r.h, r.x : r.x + r.w] += np.frombuffer(r.part).reshape(r.h, r.w)
        area = covered(y, key[1] * tile + np.arange(tile))[:, None] * covered(x, key[2] * tile + np.arange(tile))[None]
        out = np.divide(out, area, out=np.zeros_like(out), where=area > 0)
        return pd.DataFrame({"raster_id": [key[0]], "ty": [key[1]], "tx": [key[2]], "data": [out.astype(np.float32).tobytes()]})

    parts = tiles.select("raster_id", "ty", "tx", "data").mapInPandas(spread, "raster_id long, oy int, ox int, y int, x int, h int, w int, part binary")
    return parts.groupBy("raster_id", "oy", "ox").applyInPandas(add, "raster_id long, ty int, tx int, data binary")


def ends(tiles: DataFrame, tile: int, height: int, width: int) -> DataFrame:
    """(raster_id, low, high) of finite values within the raster; tiles' padding does not count."""

    def least_and_most(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                a = np.frombuffer(r.data, np.float32).reshape(tile, tile)[: max(0, height - r.ty * tile), : max(0, width - r.tx * tile)]
                a = a[np.isfinite(a)]
                if a.size:
                    rows.append((r.raster_id, float(a.min()), float(a.max())))
            yield pd.DataFrame(rows, columns=["raster_id", "low", "high"])

    return tiles.select("raster_id", "ty", "tx", "data").mapInPandas(least_and_most, "raster_id long, low double, high double").groupBy("raster_id").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def stretch_tiles(tiles: DataFrame, by: dict[int, tuple[float, float]]) -> DataFrame:
    """Values from low to high of each raster_id become whole numbers from 0 to 255, towards zero; a flat raster becomes 0, what is not finite too."""

    def stretch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                low, high = by.get(r.raster_id, (0.0, 0.0))
                a = np.frombuffer(r.data, np.float32).astype(float)
                a = np.where(np.isfinite(a), a, low)
                out.append((np.floor(np.clip((a - low) * 255.0 / (high - low), 0, 255)) if high > low else np.zeros_like(a)).astype(np.float32).tobytes())
            yield frame.assign(data=out)

    return tiles.mapInPandas(stretch, tiles.schema)
