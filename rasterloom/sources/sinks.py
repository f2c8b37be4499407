"""Writing matches, transforms, evaluations, event logs and images."""

from __future__ import annotations

import json
import struct
import zlib
from datetime import datetime
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.operators.robust import distance_summary, offset_distance
from rasterloom.sources import paths


#: Matches of one JSON text, about.
PART = 10_000


def matches_json(matches: DataFrame, pixel_m: float, keys: tuple[str, ...] = ("pair_id",), part: int = PART, statistics: bool = False) -> DataFrame:
    """JSON texts (keys, part, json) of each group: matches in order of match_id and the group's number of them; order of keys as read back.
    statistics: also the mean, median, deviation, least and largest distance of the group, in pixels and metres.

    A group of more than ``part`` matches is dealt out over several texts of about that size by hash of match_id; readers add them up.
    """
    d = F.round(offset_distance(), 6)
    one = F.struct(
        F.col("match_id").alias("match_id"), F.struct(F.col("src_x").alias("x"), F.col("src_y").alias("y")).alias("source"), F.struct(F.col("dst_x").alias("x"), F.col("dst_y").alias("y")).alias("target_original"),
        F.struct(d.alias("pixels"), F.round(d * pixel_m, 6).alias("meters")).alias("distance"),
    )
    stats = [f"{s}_{u}" for u in ("px", "m") for s in ("mean", "median", "stddev", "min", "max")]
    named = [F.col(k).alias(f"_{k}") for k in keys]
    if statistics:
        counts = distance_summary(matches, keys, pixel_m).select(*named, F.col("n").alias("_total"), F.struct(*stats).alias("_statistics"))
    else:
        counts = matches.groupBy(*named).agg(F.count(F.lit(1)).alias("_total"))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    parts = F.ceil(F.col("_total") / part)
    rows = matches.join(counts, same).withColumn("part", F.pmod(F.xxhash64("match_id"), parts).cast("int"))
    whole = [F.first("_statistics").alias("statistics")] if statistics else []
    body = F.to_json(F.struct(F.first("_total").alias("num_matches"), *whole, F.sort_array(F.collect_list(one)).alias("matches")))
    return rows.groupBy(*keys, "part").agg(body.alias("json"))


def transforms_json(transforms: DataFrame, resolution: str = "pixel_resolution") -> DataFrame:
    """One JSON text per transform with pixel and metre values."""
    px = ["median_error", "robust_rmse"]
    return transforms.select(
        "pair_id",
        F.to_json(
            F.struct(
                F.col("type").alias("transform_type"), F.col(resolution).alias("pixel_resolution_meters"), *(F.col(c).alias(f"{c}_pixels") for c in px),
                *((F.col(c) * F.col(resolution)).alias(f"{c}_meters") for c in px), F.col("matrix"), F.col("coef_x").alias("coefficients_x"), F.col("coef_y").alias("coefficients_y"),
                F.col("ctrl_src").alias("control_points_src"), F.col("ctrl_dst").alias("control_points_dst"),
            )
        ).alias("json"),
    )


def transform_record(row: dict, scale: float, pixel_m: float) -> dict:
    """A step's transform for a file: errors and shifts in pixels of its scale and in metres, ``pixel_m`` being a pixel of scale 1."""
    at = pixel_m / scale
    errors = {f"{c}_{unit}": None if row.get(c) is None else row[c] * k for c in ("median_error", "robust_rmse", "mean_error", "std_error", "max_error") for unit, k in (("pixels", 1.0), ("meters", at))}
    m = row.get("matrix")
    metres = None if not m else [v * at if k in (2, 5) else v / at if k in (6, 7) else v for k, v in enumerate(m)]
    names = {"coef_x": "coefficients_x", "coef_y": "coefficients_y", "ctrl_src": "control_points_src", "ctrl_dst": "control_points_dst"}
    return {
        "scale": scale, "transform_type": row["type"], "type": row["type"], "pixel_resolution_meters": at, "matrix": m, "matrix_meters": metres, **errors, **{n: row.get(k) for k, n in names.items()},
        "degree": row.get("degree"), "num_points": row.get("num_points"), "inlier_count": row.get("inlier_count"), "inlier_ratio": row.get("inlier_ratio"),
    }


def append_events(events: DataFrame, path: str) -> None:
    """NDJSON lines: sessionId, runId, hypothesisId, location, message, data, timestamp."""
    events.write.mode("append").json(path)


def run_directory(base: str, now: datetime) -> dict[str, str]:
    top = f"{base.rstrip('/')}/run_{now:%Y%m%d_%H%M%S}"
    return {"run": top} | {d: f"{top}/{d}" for d in ("visualizations", "intermediate", "logs")}


def save_config(config: dict, path: str) -> None:
    with open(path, "w") as f:
        json.dump(config, f, indent=2, sort_keys=True, default=str)


def write_text(path: str, text: str) -> None:
    paths.write(path, text.encode())


def to_uint8(image: np.ndarray) -> np.ndarray:
    low, high = float(image.min()), float(image.max())
    return ((image - low) / (high - low + 1e-6) * 255).astype(np.uint8)


def geotiff(image: np.ndarray, transform: tuple[float, ...], epsg: int) -> bytes:
    """An uncompressed 8-bit GeoTIFF of (bands, height, width) or (height, width); one band becomes three."""
    if image.ndim == 2:
        image = np.stack([image] * 3)
    if image.dtype != np.uint8:
        image = to_uint8(image)
    bands, h, w = image.shape
    a, _, c, _, e, f = transform
    pixels = image.transpose(1, 2, 0).tobytes()
    geokeys = (1, 1, 0, 3, 1024, 0, 1, 2 if epsg == 4326 else 1, 1025, 0, 1, 1, 2048 if epsg == 4326 else 3072, 0, 1, epsg)
    entries = [(256, "I", (w,)), (257, "I", (h,)), (258, "H", (8,) * bands), (259, "H", (1,)), (262, "H", (2 if bands >= 3 else 1,)), (273, "I", None), (277, "H", (bands,)), (278, "I", (h,)), (279, "I", (len(pixels),)), (33550, "d", (a, -e, 0.0)), (33922, "d", (0.0, 0.0, 0.0, c, f, 0.0)), (34735, "H", geokeys)]
    if bands > 3:
        entries.insert(9, (338, "H", (0,) * (bands - 3)))
    at, extra, directory = 8 + 2 + 12 * len(entries) + 4, b"", b""
    total = at + sum(n for _, code, v in entries if (n := struct.calcsize(f"<{len(v or (0,))}{code}")) > 4)
    for tag, code, values in entries:
        data = struct.pack(f"<{len(values or (0,))}{code}", *(values or (total,)))
        kind = {"H": 3, "I": 4, "d": 12}[code]
        if len(data) > 4:
            directory += struct.pack("<HHII", tag, kind, len(values), at + len(extra))
            extra += data
        else:
            directory += struct.pack("<HHI", tag, kind, len(values or (0,))) + data.ljust(4, b"\0")
    return struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", len(entries)) + directory + struct.pack("<I", 0) + extra + pixels


def png(image: np.ndarray) -> bytes:
    """8-bit gray or RGB."""
    h, w = image.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, -1)], axis=1).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
