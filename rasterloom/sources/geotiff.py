"""GeoTIFF files in and out, by byte ranges and by tiles.

A header costs two or three short reads of a file. Pixels are read by window: a
task opens the file and reads only the strips or tiles that its window meets.
Output is a mosaic of files, one per block of tiles, each written by one task,
and a VRT text that joins them; no task holds more than a block.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.sources import jpeg, paths

#: TIFF tags and the bytes of their types.
TAGS = {
    256: "width", 257: "height", 258: "bits", 259: "compression", 262: "photometric", 273: "strips", 277: "bands", 278: "rows", 279: "counts", 284: "planar", 317: "predictor", 322: "tile_width", 323: "tile_height",
    324: "tiles", 325: "tile_counts", 339: "format", 347: "jpeg_tables", 33550: "pixel_scale", 33922: "tiepoint", 34264: "matrix", 34735: "geokeys",
}
SIZES = {1: ("B", 1), 2: ("c", 1), 3: ("H", 2), 4: ("I", 4), 7: ("B", 1), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}
KINDS = {(8, 1): "u1", (16, 1): "u2", (32, 1): "u4", (8, 2): "i1", (16, 2): "i2", (32, 2): "i4", (32, 3): "f4", (64, 3): "f8"}
RASTER_SCHEMA = "path string, epsg int, width int, height int, bands int, a double, b double, c double, d double, e double, f double, left double, bottom double, right double, top double, kind string, error string"
TILE_SCHEMA = "path string, band int, ty int, tx int, data binary"
#: Least side of a reduced image.
LEAST_SIDE = 100


def open_file(path: str):
    """A seekable stream of a path with or without a scheme."""
    system, at = paths.file_system(path)
    return system.open_input_file(at)


def tags_of(read) -> dict:
    """Known tags of the first directory of a TIFF or BigTIFF; ``read(at, n)`` gives bytes of the file."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    kind = struct.unpack_from(order + "H", head, 2)[0] if order and len(head) >= 8 else 0
    if kind not in (42, 43):
        raise ValueError("not a TIFF")
    big = kind == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), head, 8 if big else 4)[0]
    n = struct.unpack(order + ("Q" if big else "H"), read(at, 8 if big else 2))[0]
    size, first, inline = (20, 8, 8) if big else (12, 2, 4)
    entries = read(at + first, n * size)
    out: dict = {"order": order}
    for k in range(n):
        tag, code = struct.unpack_from(order + "HH", entries, k * size)
        count = struct.unpack_from(order + ("Q" if big else "I"), entries, k * size + 4)[0]
        if tag in TAGS and code in SIZES:
            letter, width = SIZES[code]
            place = k * size + (12 if big else 8)
            if count * width <= inline:
                raw = entries[place : place + count * width]
            else:
                raw = read(struct.unpack_from(order + ("Q" if big else "I"), entries, place)[0], count * width)
            out[TAGS[tag]] = struct.unpack(f"{order}{count}{letter}", raw)
    return out


def reader(stream):
    def read(at: int, n: int) -> bytes:
        stream.seek(at)
        return stream.read(n)

    return read


def geo_row(path: str, t: dict) -> dict:
    """RASTER_SCHEMA of a file's tags."""
    w, h = t["width"][0], t["height"][0]
    if "matrix" in t:
        m = t["matrix"]
        a, b, c, d, e, f = m[0], m[1], m[3], m[4], m[5], m[7]
    else:
        sx, sy = t.get("pixel_scale", (1.0, 1.0))[:2]
        i, j, _, x, y = t.get("tiepoint", (0, 0, 0, 0.0, 0.0, 0))[:5]
        a, b, c, d, e, f = sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy
    keys = t.get("geokeys", ())
    epsg = next((keys[k + 3] for k in range(4, len(keys), 4) if keys[k] in (2048, 3072)), None)
    xs, ys = [a * i + b * j + c for i in (0, w) for j in (0, h)], [d * i + e * j + f for i in (0, w) for j in (0, h)]
    kind = KINDS.get((t.get("bits", (1,))[0], t.get("format", (1,))[0]))
    return {"kind": kind, "path": path, "epsg": epsg, "width": w, "height": h, "bands": t.get("bands", (1,))[0], "a": a, "b": b, "c": c, "d": d, "e": e, "f": f, "left": min(xs), "right": max(xs), "bottom": min(ys), "top": max(ys)}


def sound(head: dict) -> dict:
    """A header whose pixels have no size gets one from its bounds; without bounds either, pixels are units."""
    if abs(head["a"]) > 1e-10 or abs(head["e"]) > 1e-10 or head["b"] or head["d"]:
        return head
    left, bottom, right, top = (head[c] for c in ("left", "bottom", "right", "top"))
    w, h = head["width"], head["height"]
    if right - left <= 0 or top - bottom <= 0:
        left, bottom, right, top = left, top - h, left + w, top
    return head | {"a": (right - left) / w, "b": 0.0, "c": left, "d": 0.0, "e": (bottom - top) / h, "f": top, "left": left, "bottom": bottom, "right": right, "top": top}


def read_raster_headers(spark: SparkSession, path: str) -> DataFrame:
    """A row for each GeoTIFF, from its header; ``error`` says why a file has none."""

    def headers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RASTER_SCHEMA.split(", ")]
        for frame in frames:
            rows = []
            for p in frame["path"]:
                try:
                    with open_file(p) as stream:
                        rows.append(dict.fromkeys(names) | geo_row(p, tags_of(reader(stream))))
                except (ValueError, KeyError, OSError, struct.error) as e:
                    rows.append(dict.fromkeys(names) | {"path": p, "error": str(e) or type(e).__name__})
            yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(path).select("path").mapInPandas(headers, RASTER_SCHEMA)


def unpack_lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes from nine bits on, the most significant bit first."""
    out, table, width, held, have, last = bytearray(), [], 9, 0, 0, b""
    for byte in data:
        held, have = held << 8 | byte, have + 8
        if have < width:
            continue
        code = held >> (have - width) & ((1 << width) - 1)
        have -= width
        held &= (1 << have) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


def unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at] - 256 if data[at] > 127 else data[at]
        if n >= 0:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += data[at + 1 : at + 2] * (1 - n if n != -128 else 0)
            at += 2 if n != -128 else 1
    return bytes(out)


#: The compression and the photometric interpretation of JPEG in luminance and differences.
JPEG, YCC = 7, 6
DECODERS = {1: lambda d: d, 5: unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpack_bits}


class Tiff:
    """Windows of an open TIFF: strips or tiles, whole or separate planes, with and without horizontal differences."""

    def __init__(self, stream):
        self.read = reader(stream)
        t = self.tags = tags_of(self.read)
        self.height, self.width, self.bands = t["height"][0], t["width"][0], t.get("bands", (1,))[0]
        kinds = {(b, f) for b, f in zip(t.get("bits", (1,)), t.get("format", (1,) * len(t.get("bits", (1,)))), strict=False)}
        self.compression, self.predictor = t.get("compression", (1,))[0], t.get("predictor", (1,))[0]
        if len(kinds) != 1 or next(iter(kinds)) not in KINDS:
            raise ValueError(f"samples of {sorted(kinds)} bits and kinds are not read")
        if self.compression not in (*DECODERS, JPEG) or self.predictor not in (1, 2):
            raise ValueError(f"compression {self.compression} with predictor {self.predictor} is not read")
        self.kind = np.dtype(t["order"] + KINDS[next(iter(kinds))])
        self.separate = t.get("planar", (1,))[0] == 2
        self.jpeg = jpeg.Tables()
        if self.compression == JPEG and "jpeg_tables" in t:
            jpeg.read_tables(bytes(t["jpeg_tables"]), self.jpeg)
        self.tiled = "tiles" in t
        self.block = (t["tile_height"][0], t["tile_width"][0]) if self.tiled else (min(t.get("rows", (self.height,))[0], self.height), self.width)
        self.across = -(-self.width // self.block[1])
        self.down = -(-self.height // self.block[0])
        self.offsets, self.counts = (t["tiles"], t["tile_counts"]) if self.tiled else (t["strips"], t["counts"])

    def _block(self, i: int, j: int, plane: int) -> np.ndarray:
        k = (plane * self.down + i) * self.across + j
        samples = 1 if self.separate else self.bands
        h, w = self.block
        if not self.tiled:
            h = min(h, self.height - i * h)
        if not self.counts[k]:
            return np.zeros((h, w, samples), self.kind)
        data = self.read(self.offsets[k], self.counts[k])
        if self.compression == JPEG:
            got = jpeg.decode(data, self.jpeg)[:h, :w]
            return jpeg.from_ycc(got) if self.tags.get("photometric", (1,))[0] == YCC and got.shape[2] == 3 else got
        raw = DECODERS[self.compression](data)
        out = np.frombuffer(raw, self.kind, h * w * samples).reshape(h, w, samples)
        if self.predictor == 2:
            out = np.cumsum(out, axis=1, dtype=self.kind.newbyteorder("="))
        return out

    def window(self, y0: int, y1: int, x0: int, x1: int) -> np.ndarray:
        """(bands, y1 - y0, x1 - x0); 0 beyond the raster."""
        out = np.zeros((self.bands, y1 - y0, x1 - x0), self.kind.newbyteorder("="))
        h, w = self.block
        for i in range(max(0, y0) // h, -(-min(y1, self.height) // h)):
            for j in range(max(0, x0) // w, -(-min(x1, self.width) // w)):
                top, left = i * h, j * w
                a, b = max(y0, top, 0), min(y1, top + h, self.height)
                c, d = max(x0, left, 0), min(x1, left + w, self.width)
                for plane in range(self.bands if self.separate else 1):
                    got = self._block(i, j, plane)[a - top : b - top, c - left : d - left].transpose(2, 0, 1)
                    out[slice(plane, plane + 1) if self.separate else slice(None), a - y0 : b - y0, c - x0 : d - x0] = got
        return out


def read_tiles(spark: SparkSession, path: str, tile: int = 256) -> DataFrame:
    """Every file's pixels as tiles (path, band, ty, tx, data of float32), each read by its window; unreadable files have none."""
    ends = read_raster_headers(spark, path).where("error IS NULL").select("path", *(F.sequence(F.lit(0), F.ceil(F.col(c) / tile).cast("int") - 1).alias(c) for c in ("height", "width")))
    windows = ends.select("path", F.explode("height").alias("ty"), "width").select("path", "ty", F.explode("width").alias("tx"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, own in frame.groupby("path", sort=False):
                with open_file(p) as stream:
                    try:
                        tiff = Tiff(stream)
                    except ValueError:
                        continue
                    for ty, tx in zip(own["ty"], own["tx"], strict=True):
                        got = tiff.window(ty * tile, (ty + 1) * tile, tx * tile, (tx + 1) * tile).astype(np.float32)
                        yield pd.DataFrame({"path": p, "band": np.arange(1, len(got) + 1), "ty": ty, "tx": tx, "data": [b.tobytes() for b in got]})

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return windows.repartition(n, "path", "ty").mapInPandas(read, TILE_SCHEMA)


def reduced_shape(height: int, width: int, scale: float) -> tuple[int, int]:
    return max(int(height * scale), LEAST_SIDE), max(int(width * scale), LEAST_SIDE)


def read_reduced(spark: SparkSession, path: str, scale: float, tile: int = 256) -> DataFrame:
    """As read_tiles, at a scale: sides of at least LEAST_SIDE, bilinear between the centres of pixels; each task reads its window alone."""
    heads = read_raster_headers(spark, path).where("error IS NULL")
    sides = {c: F.greatest(F.floor(F.col(c) * scale), F.lit(LEAST_SIDE)).cast("int") for c in ("height", "width")}
    out = heads.select("path", sides["height"].alias("h"), sides["width"].alias("w"))
    grid = out.withColumn("ty", F.explode(F.sequence(F.lit(0), F.ceil(F.col("h") / tile).cast("int") - 1))).withColumn("tx", F.explode(F.sequence(F.lit(0), F.ceil(F.col("w") / tile).cast("int") - 1)))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                with open_file(r.path) as stream:
                    try:
                        tiff = Tiff(stream)
                    except ValueError:
                        continue
                    ys, xs = np.arange(r.ty * tile, min((r.ty + 1) * tile, r.h)), np.arange(r.tx * tile, min((r.tx + 1) * tile, r.w))
                    y, x = np.clip((ys + 0.5) * tiff.height / r.h - 0.5, 0, tiff.height - 1), np.clip((xs + 0.5) * tiff.width / r.w - 0.5, 0, tiff.width - 1)
                    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
                    got = tiff.window(y0[0], y0[-1] + 2, x0[0], x0[-1] + 2).astype(np.float64)
                    yb, xb = np.minimum(y0 + 1, tiff.height - 1) - y0[0], np.minimum(x0 + 1, tiff.width - 1) - x0[0]
                    fy, fx = (y - y0)[:, None], (x - x0)[None]
                    y0, x0 = y0 - y0[0], x0 - x0[0]
                    mixed = (got[:, y0][:, :, x0] * (1 - fx) + got[:, y0][:, :, xb] * fx) * (1 - fy) + (got[:, yb][:, :, x0] * (1 - fx) + got[:, yb][:, :, xb] * fx) * fy
                    full = np.zeros((len(got), tile, tile), np.float32)
                    full[:, : len(ys), : len(xs)] = mixed
                    yield pd.DataFrame({"path": r.path, "band": np.arange(1, len(got) + 1), "ty": r.ty, "tx": r.tx, "data": [b.tobytes() for b in full]})

    return grid.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "ty").mapInPandas(read, TILE_SCHEMA)


def encode(image: np.ndarray, transform: tuple[float, ...], epsg: int, tile: int = 256, quality: int | None = None) -> bytes:
    """A tiled 8-bit GeoTIFF of (bands, height, width), deflated or, with a quality, in JPEG."""
    bands, h, w = image.shape
    a, _, c, _, e, f = transform
    down, across = -(-h // tile), -(-w // tile)
    padded = np.zeros((down * tile, across * tile, bands), np.uint8)
    padded[:h, :w] = image.transpose(1, 2, 0)
    cut = [padded[i * tile : (i + 1) * tile, j * tile : (j + 1) * tile] for i in range(down) for j in range(across)]
    shared, blocks = (None, [zlib.compress(c.tobytes(), 6) for c in cut]) if quality is None else jpeg.encode(cut, quality)
    degrees = epsg == 4326
    geokeys = (1, 1, 0, 3, 1024, 0, 1, 2 if degrees else 1, 1025, 0, 1, 1, 2048 if degrees else 3072, 0, 1, epsg)
    n = len(blocks)
    fields = [
        (256, "I", (w,)), (257, "I", (h,)), (258, "H", (8,) * bands), (259, "H", (8 if quality is None else JPEG,)), (262, "H", (2 if bands >= 3 else 1,)), (277, "H", (bands,)), (284, "H", (1,)), (322, "I", (tile,)), (323, "I", (tile,)),
        (324, "I", (0,) * n), (325, "I", tuple(map(len, blocks))), *([(338, "H", (0,) * (bands - 3))] if bands > 3 else []), *([(347, "B", tuple(shared))] if shared else []), (33550, "d", (a, -e, 0.0)), (33922, "d", (0.0, 0.0, 0.0, c, f, 0.0)), (34735, "H", geokeys),
    ]
    start = 8 + 2 + 12 * len(fields) + 4
    extra = start + sum(s for _, code, v in fields if (s := struct.calcsize(f"<{len(v)}{code}")) > 4)
    places = tuple((extra + np.concatenate(([0], np.cumsum([len(b) for b in blocks])[:-1]))).astype(int).tolist())
    directory, tail = b"", b""
    for tag, code, values in fields:
        data = struct.pack(f"<{len(values)}{code}", *(places if tag == 324 else values))
        kind = {"B": 7, "H": 3, "I": 4, "d": 12}[code]
        if len(data) > 4:
            directory += struct.pack("<HHII", tag, kind, len(values), start + len(tail))
            tail += data
        else:
            directory += struct.pack("<HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
    return struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", len(fields)) + directory + struct.pack("<I", 0) + tail + b"".join(blocks)


def write_tiles(tiles: DataFrame, out: str, transform: tuple[float, ...], epsg: int, height: int, width: int, tile: int, block: int = 8, low: float = 0.0, high: float = 255.0, quality: int | None = None) -> DataFrame:
    """Write (band, ty, tx, data) of one raster as GeoTIFFs of block x block tiles; returns the manifest (path, y0, x0, height, width, bands).

    Values from low to high become 0 to 255; one band is written as three; files are deflated or, with a quality, in JPEG. A block's file is
    written under a new name, so a repeated attempt leaves a file that no row names. The files are written now: the
    manifest is a table beside them, ``out``/manifest, so reading it writes nothing again.
    """
    out = paths.qualified(tiles.sparkSession, out)
    a, b, c, d, e, f = transform
    rows = tiles if "band" in tiles.columns else tiles.withColumn("band", F.lit(1))

    def write(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = key[0] * block * tile, key[1] * block * tile
        h, w = min(block * tile, height - y0), min(block * tile, width - x0)
        bands = int(g["band"].max())
        image = np.zeros((bands, block * tile, block * tile), np.float32)
        for r in g.itertuples():
            y, x = r.ty * tile - y0, r.tx * tile - x0
            image[r.band - 1, y : y + tile, x : x + tile] = np.frombuffer(r.data, np.float32).reshape(tile, tile)
        eight = np.clip((image[:, :h, :w] - low) * (255.0 / max(high - low, 1e-6)), 0, 255).astype(np.uint8)
        if bands == 1:
            eight = np.repeat(eight, 3, axis=0)
        path = f"{out.rstrip('/')}/block-{key[0]:05d}-{key[1]:05d}-{uuid.uuid4().hex}.tif"
        paths.write(path, encode(eight, (a, b, c + a * x0 + b * y0, d, e, f + d * x0 + e * y0), epsg, quality=quality))
        return pd.DataFrame({"path": [path], "y0": [y0], "x0": [x0], "height": [h], "width": [w], "bands": [len(eight)]})

    cut = rows.where((F.col("ty") >= 0) & (F.col("tx") >= 0) & (F.col("ty") * tile < height) & (F.col("tx") * tile < width))
    groups = cut.select("band", "ty", "tx", "data", F.floor(F.col("ty") / block).cast("int").alias("by"), F.floor(F.col("tx") / block).cast("int").alias("bx")).groupBy("by", "bx")
    shape = "path string, y0 int, x0 int, height int, width int, bands int"
    groups.applyInPandas(write, shape).write.mode("overwrite").parquet(f"{out.rstrip('/')}/manifest")
    return tiles.sparkSession.read.schema(shape).parquet(f"{out.rstrip('/')}/manifest")


def vrt(manifest: list[dict], transform: tuple[float, ...], epsg: int, height: int, width: int) -> str:
    """The text of a virtual raster that joins the files of a manifest: a line per file."""
    a, b, c, d, e, f = transform
    bands = max((m["bands"] for m in manifest), default=1)
    out = [f'<VRTDataset rasterXSize="{width}" rasterYSize="{height}">', f"<SRS>EPSG:{epsg}</SRS>", f"<GeoTransform>{c}, {a}, {b}, {f}, {d}, {e}</GeoTransform>"]
    for band in range(1, bands + 1):
        out.append(f'<VRTRasterBand dataType="Byte" band="{band}">')
        out += [
            f'<SimpleSource><SourceFilename relativeToVRT="1">{m["path"].rpartition("/")[2]}</SourceFilename><SourceBand>{band}</SourceBand><SrcRect xOff="0" yOff="0" xSize="{m["width"]}" ySize="{m["height"]}"/>'
            f'<DstRect xOff="{m["x0"]}" yOff="{m["y0"]}" xSize="{m["width"]}" ySize="{m["height"]}"/></SimpleSource>'
            for m in sorted(manifest, key=lambda m: (m["y0"], m["x0"]))
        ]
        out.append("</VRTRasterBand>")
    return "\n".join([*out, "</VRTDataset>"])
