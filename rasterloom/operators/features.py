"""Keypoints, binary descriptors and tile-wise matching in numpy, one tile of bytes at a time.

Detection is Harris' corner measure, a descriptor compares 256 fixed pairs of
smoothed pixels around the point. Tiles are those of ``raster.to_tiles``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.operators import raster

KEYPOINTS = "raster_id long, ty int, tx int, kp_id long, x double, y double, response double, descriptor array<long>"
BITS, REACH = 256, 12
#: What an image may be turned into before it is matched.
VARIANTS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "raw": lambda a: a,
    "gradient": lambda a: gradient(a),
    "contrast": lambda a: raster.local_contrast(a.astype(np.uint8)).astype(float),
    "edges": lambda a: raster.edges(a.astype(np.uint8)).astype(float),
}


def _pairs() -> np.ndarray:
    return np.clip(np.random.default_rng(17).normal(0, REACH / 2.5, (BITS, 4)).round(), -REACH, REACH).astype(int)


def gradient(image: np.ndarray) -> np.ndarray:
    """Magnitude of the 3 x 3 gradient, stretched to 0..255."""
    gy, gx = np.gradient(image.astype(float))
    m = np.hypot(gx, gy)
    return (m - m.min()) / max(1e-9, m.max() - m.min()) * 255


def smooth(a: np.ndarray, radius: int = 2) -> np.ndarray:
    p = np.pad(a.astype(float), radius, mode="edge")
    for axis in (0, 1):
        c = np.cumsum(p, axis=axis)
        c = np.insert(c, 0, 0, axis=axis)
        n = 2 * radius + 1
        p = (c[n:] - c[:-n]) / n if axis == 0 else (c[:, n:] - c[:, :-n]) / n
    return p


def detect(image: np.ndarray, most: int = 5000, least_valid: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y), response and packed descriptors of the strongest corners on valid pixels, strongest first, ties by place."""
    h, w = image.shape
    if min(h, w) < 2 * REACH + 3:
        return np.empty((0, 2)), np.empty(0), np.empty((0, BITS // 64), np.int64)
    gy, gx = np.gradient(image.astype(float))
    a, b, c = smooth(gx * gx), smooth(gy * gy), smooth(gx * gy)
    r = a * b - c * c - 0.05 * (a + b) ** 2
    inner = np.zeros(r.shape, bool)
    inner[REACH + 1 : -REACH - 1, REACH + 1 : -REACH - 1] = True
    q = np.pad(r, 1, constant_values=-np.inf)
    peak = np.ones(r.shape, bool)
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            if dy or dx:
                near = q[1 + dy : q.shape[0] - 1 + dy, 1 + dx : q.shape[1] - 1 + dx]
                peak &= (r > near) if (dy, dx) < (0, 0) else (r >= near)
    y, x = np.nonzero(peak & inner & (r > 0) & (image > least_valid))
    order = np.argsort(-r[y, x], kind="stable")[:most]
    y, x = y[order], x[order]
    s, p = smooth(image), _pairs()
    bits = s[y[:, None] + p[:, 0], x[:, None] + p[:, 1]] < s[y[:, None] + p[:, 2], x[:, None] + p[:, 3]]
    packed = np.packbits(bits, axis=1).view(np.int64) if len(y) else np.empty((0, BITS // 64), np.int64)
    return np.c_[x, y].astype(float), r[y, x], packed


def keypoints(tiles: DataFrame, tile: int, variant: str = "raw", most: int = 2000) -> DataFrame:
    """Keypoints of every tile in coordinates of the whole raster; ids number them by tile and strength."""
    prepare = VARIANTS[variant]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in KEYPOINTS.split(", ")]
        for frame in frames:
            rows = []
            for t in frame.itertuples():
                xy, response, words = detect(prepare(np.frombuffer(t.data, np.float32).reshape(tile, tile)), most)
                first = (t.ty << 16 | t.tx) << 20
                rows += [(t.raster_id, t.ty, t.tx, first + k, xy[k, 0] + t.tx * tile, xy[k, 1] + t.ty * tile, response[k], words[k]) for k in range(len(xy))]
            yield pd.DataFrame(rows, columns=names)

    return tiles.mapInPandas(run, KEYPOINTS)


def prepared(tiles: DataFrame, tile: int, variant: str) -> DataFrame:
    """Tiles as a variant has them."""
    prepare = VARIANTS[variant]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(data=[np.asarray(prepare(np.frombuffer(d, np.float32).reshape(tile, tile)), np.float32).tobytes() for d in frame["data"]])

    return tiles.select("raster_id", "ty", "tx", "data").mapInPandas(run, "raster_id long, ty int, tx int, data binary")


def renumbered(matches: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matches whose ends are places as keypoints: (pair_id, kp_id, x, y) of each side, a place once, and (pair_id, match_id, query_id, train_id).

    Ids are hashes of the place, so that no task numbers all of them.
    """
    sides = []
    for side, name in (("src", "query_id"), ("dst", "train_id")):
        place = [F.col(f"{side}_x"), F.col(f"{side}_y")]
        matches = matches.withColumn(name, F.xxhash64(*place))
        sides.append(matches.groupBy("pair_id", F.col(name).alias("kp_id")).agg(F.first(place[0]).alias("x"), F.first(place[1]).alias("y")))
    return sides[0], sides[1], matches.select("pair_id", "match_id", "query_id", "train_id")


def match_tiles(source: DataFrame, target: DataFrame, ratio: float = 0.75, tile: int | None = None, overlap: int = 0) -> DataFrame:
    """Nearest descriptors that pass the ratio test, tile by tile; coordinates are those of the whole raster.

    A tile's source keypoints meet the target ones of the same tile and, with ``tile`` given, those up to ``overlap`` pixels
    beyond it, so what has moved across an edge is found too. A tile's keypoints are bounded by ``most``, so one task compares small sets.
    """
    cols = ["raster_id", "ty", "tx", "kp_id", "x", "y", "descriptor"]
    out = "pair_id long, match_id long, src_x double, src_y double, dst_x double, dst_y double, confidence double"
    names = [c.split()[0] for c in out.split(", ")]
    theirs = target.select(*cols)
    if overlap and tile:
        around = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1))))
        near = theirs.withColumn("_n", around).withColumns({"ty": F.col("ty") + F.col("_n.dy"), "tx": F.col("tx") + F.col("_n.dx")})
        inside = [(F.col(v) >= F.col(t) * tile - overlap) & (F.col(v) < (F.col(t) + 1) * tile + overlap) for v, t in (("y", "ty"), ("x", "tx"))]
        theirs = near.where(inside[0] & inside[1]).select(*cols)

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or len(b) < 2:
            return pd.DataFrame(columns=names)
        a, b = a.sort_values("kp_id"), b.sort_values("kp_id")
        da, db = (np.stack(f["descriptor"].to_numpy()).astype(np.int64).view(np.uint64) for f in (a, b))
        found = []
        for i in range(0, len(a), 256):
            d = sum(np.bitwise_count(da[i : i + 256, None, k] ^ db[None, :, k]).astype(np.int32) for k in range(da.shape[1]))
            two = np.argsort(d, axis=1, kind="stable")[:, :2]
            first, second = np.take_along_axis(d, two, 1).T
            keep = np.flatnonzero(first < ratio * second)
            s, t = a.iloc[i + keep], b.iloc[two[keep, 0]]
            found.append(pd.DataFrame({"pair_id": s["raster_id"].to_numpy(), "match_id": s["kp_id"].to_numpy(), "src_x": s["x"].to_numpy(), "src_y": s["y"].to_numpy(), "dst_x": t["x"].to_numpy(), "dst_y": t["y"].to_numpy(), "confidence": 1 - first[keep] / BITS}))
        return pd.concat(found)[names]

    keys = ["raster_id", "ty", "tx"]
    return source.select(*cols).groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInPandas(compare, out)


def distinct_matches(matches: DataFrame, digits: int = 0) -> DataFrame:
    """One of the matches whose rounded ends are equal, as overlapping tiles give them twice: the most confident."""
    ends = [F.round(c, digits).alias(f"_{c}") for c in ("src_x", "src_y", "dst_x", "dst_y")]
    best = F.max_by(F.struct(*matches.columns), F.struct("confidence", -F.col("match_id"))).alias("m")
    return matches.groupBy("pair_id", *ends).agg(best).select("m.*")


def compare_variants(source: DataFrame, target: DataFrame, tile: int, ratio: float = 0.75) -> DataFrame:
    """Matches of every variant, marked with its name in ``method``."""
    found = None
    for name in VARIANTS:
        m = match_tiles(keypoints(source, tile, name), keypoints(target, tile, name), ratio).withColumn("method", F.lit(name))
        found = m if found is None else found.unionByName(m)
    return found
