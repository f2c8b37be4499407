"""Reading control points, matches, transforms, cells, boxes, configuration and images."""

from __future__ import annotations

import json
import re
import zipfile
from collections.abc import Iterator
from io import BytesIO
from pathlib import PurePosixPath
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators.control import normalise_gcps
from rasterloom.sources import geotiff
from rasterloom.sources.geotiff import read_raster_headers  # noqa: F401

POINT = "struct<x:double,y:double,response:double>"
MATCHES_SCHEMA = f"method string, scale double, num_matches long, scale_factor double, source_image string, target_image string, matches array<struct<source:{POINT},target_upsampled:{POINT},target_original:{POINT},confidence:double>>"
GCP_SCHEMA = "id string, lon double, lat double, z double, accuracy double"


def read_gcps(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: .csv and .tsv, or .kmz; anything else is a ValueError, an absent file a FileNotFoundError."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(path)
    suffix = PurePosixPath(path).suffix.lower()
    if suffix in (".csv", ".tsv"):
        head = spark.read.text(path).head(1)
        return normalise_gcps(spark.read.csv(path, sep="\t" if head and "\t" in head[0][0] else ",", header=True))
    if suffix == ".kmz":
        return spark.read.format("binaryFile").load(path).select("content").mapInPandas(_kmz, GCP_SCHEMA)
    raise ValueError(f"unknown kind of control point file: {path}")


def _kmz(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for content in frame["content"]:
            with zipfile.ZipFile(BytesIO(content)) as z:
                for name in z.namelist():
                    if name.lower().endswith(".kml"):
                        for mark in ElementTree.fromstring(z.read(name)).iter():
                            if mark.tag.rpartition("}")[2] == "Placemark":
                                found = {e.tag.rpartition("}")[2]: (e.text or "").strip() for e in mark.iter()}
                                parts = [float(v) for v in found.get("coordinates", "").split()[0].split(",")] if found.get("coordinates") else []
                                if len(parts) >= 2:
                                    rows.append((found.get("name") or f"GCP_{len(rows) + 1:03d}", parts[0], parts[1], parts[2] if len(parts) > 2 else 0.0, 0.005))
        yield pd.DataFrame(rows, columns=["id", "lon", "lat", "z", "accuracy"])


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """(file, scale, src_x, src_y, dst_x, dst_y, confidence): the upsampled target if there is one, else the original."""
    m = spark.read.schema(MATCHES_SCHEMA).json(path, multiLine=True).select(F.input_file_name().alias("file"), "scale", F.explode("matches").alias("m"))
    x, y = (F.coalesce(F.col(f"m.target_upsampled.{c}"), F.col(f"m.target_original.{c}")) for c in "xy")
    rows = m.select("file", "scale", F.col("m.source.x").alias("src_x"), F.col("m.source.y").alias("src_y"), x.alias("dst_x"), y.alias("dst_y"), F.col("m.confidence").alias("confidence"))
    return rows.dropna(subset=["src_x", "src_y", "dst_x", "dst_y"])


def scale_of(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"scale([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).cast("double")


def level_of(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"level([0-9]+)", 1), F.lit("")).cast("int")


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """H3 cells: the distinct hexadecimal texts of 15 characters of an XML file, or the lines of a text file without comments."""
    text = spark.read.text(path, wholetext=path.lower().endswith(".xml"))
    if path.lower().endswith(".xml"):
        return text.select(F.explode(F.regexp_extract_all("value", F.lit(r">\s*([0-9a-fA-F]{15})\s*<"), F.lit(1))).alias("cell")).distinct()
    return text.select(F.trim("value").alias("cell")).where((F.col("cell") != "") & ~F.col("cell").startswith("#"))


def parse_bbox(text: str) -> tuple[float, float, float, float]:
    """(min_lat, min_lon, max_lat, max_lon) from four numbers between commas or spaces."""
    parts = [float(p) for p in (text.split(",") if "," in text else text.split())]
    if len(parts) != 4:
        raise ValueError(f"a box has four numbers, not {len(parts)}")
    if parts[0] >= parts[2] or parts[1] >= parts[3]:
        raise ValueError("a box's least values come before its largest")
    return tuple(parts)


def load_config(path: str) -> dict:
    with open(path) as f:
        return json.load(f)


def read_steps(spark: SparkSession, path: str) -> list[dict]:
    """A run's transforms in order of scale: a file that lists them, one transform's file, or a folder of transform_scale*.json or *level*.json."""
    rows = [(r.path, json.loads(bytes(r.content))) for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).collect()]  # a file a scale
    lists = [t for _, t in rows if isinstance(t, list)]
    if lists:
        return lists[0]
    named = [(p.rpartition("/")[2], t) for p, t in rows if isinstance(t, dict) and ("matrix" in t or "coefficients_x" in t)]

    def order(item: tuple[str, dict]) -> tuple:
        found = re.search(r"(?:scale|level)([0-9]+(?:\.[0-9]+)?)", item[0])
        return (float(found[1]) if found else float(item[1].get("scale", 1.0)), item[0])

    return [{"scale": order((n, t))[0] if "scale" not in t else t["scale"]} | t for n, t in sorted(named, key=order)]


def read_tiff(data: bytes) -> np.ndarray:
    """(bands, height, width) of a whole TIFF in memory; files are read by window, see geotiff.read_tiles."""
    tiff = geotiff.Tiff(BytesIO(data))
    return tiff.window(0, tiff.height, 0, tiff.width)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, height, width, bands, data) of PNG, JPEG and TIFF files; unreadable ones have null data."""
    i = spark.read.format("image").option("dropInvalid", False).load(path)
    return i.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("bands"), F.when(F.col("image.height") > 0, F.col("image.data")).alias("data"))


def file_info(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def newest_run(names: list[str]) -> str | None:
    return max((n for n in names if re.fullmatch(r"run_\d{8}_\d{6}", n)), default=None)
