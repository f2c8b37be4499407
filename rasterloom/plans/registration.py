"""Coarse-to-fine registration, basemap tiles, diagnostics and reprojection as plans over DataFrames.

A plan is an ordered list of (scale, transform type). At each scale both rasters come
to one lattice, the source as the steps so far map it; they are matched, and the fit is
composed with those before. In the end the
composed transform is applied once to the full-resolution colour tiles. Polynomials and
splines have no inverse in closed form, so they are fitted from the target to the
mosaic, which is the way that pixels are looked up.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rasterloom.functions import geo, projection
from rasterloom.operators import control, features, fits, grids, matching, raster, robust, scalespace, split
from rasterloom.sources import geotiff, paths, sinks

log = logging.getLogger("rasterloom")
#: The plan that is used where none is given.
DEFAULT_PLAN = ((1.0, "affine"),)
#: Instead of a transform type: try all, and take the one after which the next scale matches best.
AUTO = "auto"
Matcher = Callable[[DataFrame, DataFrame, float], DataFrame]


@dataclass
class Step:
    scale: float
    kind: str
    row: dict
    matrix: np.ndarray | None  # at full resolution, all steps so far composed; None once one of them is no matrix
    back: Callable[[np.ndarray], np.ndarray]  # this step's map of (n, 2) x, y at full resolution to those before it


@dataclass
class Registration:
    steps: list[Step] = field(default_factory=list)

    @property
    def matrix(self) -> np.ndarray | None:
        return self.steps[-1].matrix if self.steps else np.eye(3)

    def back(self, p: np.ndarray) -> np.ndarray:
        """x, y of the registered mosaic to those of the source, through all steps from the last to the first."""
        if self.matrix is not None:
            return fits._project(np.linalg.inv(self.matrix), p)
        for step in reversed(self.steps):
            p = step.back(p)
        return p


def lattice_place(scale: float) -> np.ndarray:
    """Centres of a scale's pixels in pixels of scale 1: both count centres from 0, so edges and not centres coincide."""
    k = 1 / scale
    return np.array([[k, 0, (k - 1) / 2], [0, k, (k - 1) / 2], [0, 0, 1.0]])


def at_full_resolution(m: np.ndarray, scale: float) -> np.ndarray:
    """A matrix in pixels of a scale, in those of scale 1."""
    to = lattice_place(scale)
    return to @ m @ np.linalg.inv(to)


def look_up(row: dict, scale: float) -> Callable[[np.ndarray], np.ndarray]:
    """The map of a polynomial or spline, fitted in pixels of a scale, in those of scale 1."""
    k, shift = 1 / scale, (1 / scale - 1) / 2
    if row.get("coef_x"):
        coef = np.array([row["coef_x"], row["coef_y"]]).T

        def bent(q: np.ndarray) -> np.ndarray:
            return fits.basis(q[:, 0], q[:, 1], row["degree"]) @ coef
    else:
        bent = fits.LocalSplines(np.array(row["ctrl_src"]), np.array(row["ctrl_dst"]))

    return lambda p: bent((p - shift) / k) * k + shift


def default_plan(scales: Sequence[float]) -> list[tuple[float, str]]:
    """The first two scales shift, the others use a homography."""
    return [(s, "shift" if i < 2 else "homography") for i, s in enumerate(sorted(scales))]


def checked_plan(scales: Sequence[float], kinds: Sequence[str]) -> list[tuple[float, str]]:
    if len(scales) != len(kinds):
        raise ValueError("as many algorithms as scales")
    if bad := set(kinds) - {*fits.LEAST_POINTS, AUTO}:
        raise ValueError(f"unknown transform {sorted(bad)[0]!r}")
    return sorted(zip(scales, kinds, strict=True))


def ncc_matcher(patch: int = 8, spacing: int = 8, margin: int = 4, threshold: float = 0.5, gsd: float | None = None, valid: int | None = None) -> Matcher:
    """Patch correlation on a grid; both images are pixel tables of one scale.

    gsd: metres per pixel of the source at scale 1; patch, spacing and margin then follow the scale as ``geo.adaptive_ncc`` has it. valid: see
    ``matching.patch_ncc``.
    """

    def sizes(scale: float) -> tuple[int, int, int]:
        if gsd is None:
            return patch, spacing, margin
        return max(patch, int(patch / scale)), max(spacing, int(spacing / scale)), max(150, 3 * int(3.0 / (gsd / scale)))

    def match(source: DataFrame, target: DataFrame, scale: float) -> DataFrame:
        p, grid, around = sizes(scale)
        size = target.groupBy("raster_id").agg((F.max("row") + 1).cast("int").alias("height"), (F.max("col") + 1).cast("int").alias("width"))
        best = matching.patch_ncc(source, target, matching.patch_grid(size, p, grid), p, around, valid).where(F.col("ncc") > threshold)
        key = (F.col("py") * 100_000 + F.col("px")).cast("long")
        x, y = F.col("px").cast("double"), F.col("py").cast("double")
        return best.select(F.col("raster_id").alias("pair_id"), key.alias("match_id"), (x + F.col("dx")).alias("src_x"), (y + F.col("dy")).alias("src_y"), x.alias("dst_x"), y.alias("dst_y"))

    return match


def corner_matcher(tile: int = 64, ratio: float = 0.75, overlap: int = 16) -> Matcher:
    """Corners and binary descriptors, tile by tile, with an overlap."""

    def match(source: DataFrame, target: DataFrame, scale: float) -> DataFrame:
        a, b = (features.keypoints(raster.to_tiles(p, tile), tile) for p in (source, target))
        return features.distinct_matches(features.match_tiles(a, b, ratio, tile, overlap)).drop("confidence")

    return match


def keypoint_matcher(kind: str, metric: str, ratio: float) -> Callable[..., Matcher]:
    """Keypoints with scale and direction, the strongest of each raster, nearest descriptors that pass the ratio test."""

    def make(most: int = matching.MAX_FEATURES, tile: int = 512) -> Matcher:
        def match(source: DataFrame, target: DataFrame, scale: float) -> DataFrame:
            sides = []
            for p in (source, target):
                # Keypoints are found once and read twice, so they are stored by whoever keeps the matches; a window begins at its own first pixel.
                y0, x0, y1, x1 = p.agg(F.min("row"), F.min("col"), F.max("row"), F.max("col")).first()
                if y0 is None:
                    y0 = x0 = y1 = x1 = 0
                t = raster.to_tiles(p.withColumns({"row": F.col("row") - y0, "col": F.col("col") - x0}), tile)
                found = scalespace.valid_only(scalespace.keypoints(t, tile, y1 - y0 + 1, x1 - x0 + 1, kind), t, tile)
                sides.append(matching.strongest(found.withColumns({"x": F.col("x") + x0, "y": F.col("y") + y0}), ["raster_id"], most))
            a, b = sides
            pairs = matching.with_keypoints(matching.ratio_matches(a, b, ratio, metric), a, b)
            return pairs.select(F.lit(1).cast("long").alias("pair_id"), F.col("query_id").alias("match_id"), "src_x", "src_y", "dst_x", "dst_y")

        return match

    return make


MATCHERS: dict[str, Callable[..., Matcher]] = {"patch_ncc": ncc_matcher, "corners": corner_matcher, "sift": keypoint_matcher("sift", "l2", 0.75), "orb": keypoint_matcher("orb", "hamming", 0.75)}


def matcher(name: str, **options) -> Matcher:
    """A learned matcher may be added to MATCHERS; unknown names are an error."""
    if name not in MATCHERS:
        raise ValueError(f"unknown matcher {name!r}")
    return MATCHERS[name](**options)


@dataclass
class Raster:
    """An opened raster: its header and its tiles (raster_id is the band, ty, tx, data)."""

    head: Mapping
    tiles: DataFrame


def open_raster(spark: SparkSession, path: str, tile: int) -> Raster:
    """The one raster of a path, at most three bands of it; a path of several files or of none that can be read is an error."""
    heads = geotiff.read_raster_headers(spark, path).limit(2).collect()
    if len(heads) != 1:
        raise ValueError(f"{path}: one raster is asked for, there are {'none' if not heads else 'several'}")
    if heads[0].error:
        raise ValueError(f"{heads[0].path}: {heads[0].error}")
    tiles = geotiff.read_tiles(spark, path, tile).where("band <= 3").select(F.col("band").cast("long").alias("raster_id"), "ty", "tx", "data")
    return Raster(geotiff.sound(heads[0].asDict()), tiles)


def eight_bit(r: Raster, tile: int, joint: bool) -> DataFrame:
    """Values of 0 to 255: those of bytes as they are, others stretched, all bands together or each by itself."""
    if r.head.get("kind") == "u1":
        return r.tiles
    by = {e.raster_id: (e.low, e.high) for e in grids.ends(r.tiles, tile, r.head["height"], r.head["width"]).collect()}  # a row a band
    if joint and by:
        by = dict.fromkeys(by, (min(low for low, _ in by.values()), max(high for _, high in by.values())))
    return grids.stretch_tiles(r.tiles, by)


def in_gray(r: Raster, tile: int) -> DataFrame:
    named = eight_bit(r, tile, joint=True).select(F.lit("").alias("path"), F.col("raster_id").alias("band"), "ty", "tx", "data")
    return raster.gray_tiles(named).select(F.lit(1).cast("long").alias("raster_id"), "ty", "tx", "data")


def window_pixels(tiles: DataFrame, tile: int, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """Pixel rows, of whole values, of a window; tiles beyond it are not read."""
    met = tiles.where((F.col("ty") * tile < y1) & ((F.col("ty") + 1) * tile > y0) & (F.col("tx") * tile < x1) & ((F.col("tx") + 1) * tile > x0))
    return pixels_of(met, tile).where(F.col("row").between(y0, y1 - 1) & F.col("col").between(x0, x1 - 1)).withColumn("value", F.round("value").cast("int"))


Keep = Callable[[DataFrame, str], DataFrame]


def kept_in(folder: str) -> Keep:
    """Write tables under a shared folder and read them again: the pyramid of a run, which steps read instead of the files."""

    def keep(df: DataFrame, name: str) -> DataFrame:
        path = f"{folder.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    return keep


#: Matchers that need what is not there, and who stands in.
STAND_INS = {"lightglue": "sift"}


def matcher_for(name: str, *, patch: int, spacing: int, margin: int, threshold: float, features: int, tile: int) -> Matcher:
    """A matcher by name with the options of a run; one that is not there is replaced, with a warning."""
    if name in STAND_INS and name not in MATCHERS:
        log.warning("%s is not there, %s stands in", name, STAND_INS[name])
        name = STAND_INS[name]
    options = {"patch_ncc": {"patch": patch, "spacing": spacing, "margin": margin, "threshold": threshold}, "sift": {"most": features, "tile": tile}, "orb": {"most": features, "tile": tile}}
    return matcher(name, **options.get(name, {}))


def _step(rows: list, scale: float, kind: str, done: Registration) -> Step | None:
    """A fitted row as the next step."""
    if not rows:
        return None
    row = rows[0].asDict()
    if not row["matrix"]:
        return Step(scale, kind, row, None, look_up(row, scale))
    m = at_full_resolution(np.array(row["matrix"]).reshape(3, 3), scale)
    return Step(scale, kind, row, None if done.matrix is None else m @ done.matrix, lambda p, back=np.linalg.inv(m): fits._project(back, p))


#: Matches of a pair beyond which its fit is split over tasks.
SPLIT = 200_000


def fit_step(matches: DataFrame, kind: str, scale: float) -> list:
    """The fitted row of one type, none where there is no transform."""
    if kind in ("similarity", "affine", "homography") and split.largest_share(matches) > SPLIT:
        found = split.fit_matrix(split.remove_gross_outliers(matches, paths.keep), kind, fits.ransac_threshold(scale), paths.keep)
        return found.where("error IS NULL").withColumns({"type": F.lit(kind), **{c: F.lit(None) for c in ("coef_x", "coef_y", "ctrl_src", "ctrl_dst", "degree")}}).collect()  # one row
    found = robust.remove_gross_outliers(matches)
    if kind in ("polynomial_2", "polynomial_3", "spline"):
        ends = ("src_x", "src_y", "dst_x", "dst_y")
        found = found.select("pair_id", "match_id", *(F.col(a).alias(b) for a, b in zip(ends, ends[2:] + ends[:2], strict=True)))
    return fits.fit_all(found, [kind], threshold=fits.ransac_threshold(scale)).where("error IS NULL").collect()  # one row


#: Types whose fit goes from the target to the source.
BACKWARD = ("polynomial_2", "polynomial_3", "spline")


def candidates(matches: DataFrame, scale: float, next_scale: float | None) -> list:
    """The fitted rows, valid ones alone, of every type that is tried at a scale, simplest first; each judged on matches it was not fitted to."""
    found, kinds = robust.remove_gross_outliers(matches), fits.candidate_kinds(next_scale)
    ends = ("src_x", "src_y", "dst_x", "dst_y")
    swapped = found.select("pair_id", "match_id", *(F.col(a).alias(b) for a, b in zip(ends, ends[2:] + ends[:2], strict=True)))
    rows = []
    for df, own in ((found, [k for k in kinds if k not in BACKWARD]), (swapped, [k for k in kinds if k in BACKWARD])):
        rows += fits.fit_all(df, own, fits.ransac_threshold(scale), judge=True).where("error IS NULL").collect()  # a row a type
    return sorted(rows, key=lambda r: list(fits.LEAST_POINTS).index(r["type"]))


def simplest_of_best(rows: list, error: dict[str, float]) -> object | None:
    """Of rows in order, the first whose error is within a twentieth, and a hundredth of a pixel, of the least."""
    known = [r for r in rows if error.get(r["type"]) is not None]
    least = min((error[r["type"]] for r in known), default=0.0)
    return next((r for r in known if error[r["type"]] <= 1.05 * least + 0.01), None)


def process_scale_level(matches: DataFrame, scale: float, next_scale: float | None, done: Registration, rematch: Callable[[Step], DataFrame] | None) -> tuple[Step | None, DataFrame | None]:
    """Try every type at a scale: the step that is best, and a histogram of offsets at the next scale for each type (type, bin, left_edge, n).

    ``rematch`` gives the matches of the next scale after a step. A type is judged by the robust RMSE of their offsets, if it leaves at
    least half as many matches as any; where there is no next scale, by its error on matches that it was not fitted to.
    """
    rows = candidates(matches, scale, next_scale)
    if next_scale is None or rematch is None:
        # Types of one direction are compared by chance, those of the two by a quarter of the error.
        held = {r["type"]: r["held_error"] if r["held_error"] is not None else r["robust_rmse"] for r in rows}
        least = min(held.values(), default=0.0)
        best = next((r for r in rows if r["as_good"] is not False and held[r["type"]] <= 1.25 * least + 0.01), None)
        return _step([best], scale, best["type"], done) if best else None, None
    offsets = None
    for r in rows:
        own = rematch(_step([r], scale, r["type"], done)).select(F.lit(r["type"]).alias("type"), robust.offset_distance().alias("err"))
        offsets = own if offsets is None else offsets.unionByName(own)
    if offsets is None:
        return None, None
    stats = {r["type"]: r for r in robust.error_summary(offsets, ["type"], "err").join(offsets.groupBy("type").count(), "type").collect()}  # a row a type
    most = max((r["count"] for r in stats.values()), default=0)
    best = simplest_of_best(rows, {k: r["robust_rmse"] for k, r in stats.items() if 2 * r["count"] >= most})
    ends = offsets.groupBy("type").agg(F.min("err").alias("_low"), F.max("err").alias("_high"))
    report = robust.histogram(offsets.join(ends, "type"), "err", 50, F.col("_low"), F.col("_high"), ["type"])
    return _step([best], scale, best["type"], done) if best else None, report


def lattices(source: Raster, target: Raster, scales: Sequence[float]) -> dict[float, Mapping]:
    """The lattice of each scale; rasters that have none are an error."""
    spark = source.tiles.sparkSession
    sides = [spark.createDataFrame([tuple(r.head.get(c) for c in grids.GEOTRANSFORM) + (1,)], ", ".join(f"{c} {'long' if c in ('width', 'height') else 'int' if c == 'epsg' else 'double'}" for c in grids.GEOTRANSFORM) + ", n long") for r in (source, target)]
    s, t = grids.pair_of(*sides, ("n", "n"))
    each = spark.createDataFrame([(float(k),) for k in scales], "scale double")
    rows = grids.common_lattice(s.join(t, F.col("s_id") == F.col("t_id")).crossJoin(each), F.col("scale")).collect()  # a row a scale
    if rows and rows[0].problem:
        raise ValueError(rows[0].problem)
    return {r.scale: r.asDict() for r in rows}


def register_rasters(source: Raster, target: Raster, tile: int, plan: Sequence[tuple[float, str]], match: Matcher | None, keep: Keep) -> tuple[Registration, DataFrame, dict[float, DataFrame]]:
    """Register one raster to another of any size, origin and pixel: the steps, the warped colour tiles and each scale's matches.

    At each scale the source is reduced once, the target is brought to the same lattice within the overlap, and both
    are kept; a step warps the reduced source alone. Each step needs the one before, so the scales are a loop on the
    driver, which holds the steps' transforms; the pixels stay distributed. A step that finds no transform leaves the mosaic as it is.
    """
    match, done, matches = match or ncc_matcher(), Registration(), {}
    shared = lattices(source, target, [s for s, _ in plan])
    gray = keep(in_gray(source, tile), "source"), keep(in_gray(target, tile), "target")
    small: dict[float, DataFrame] = {}

    def aim(scale: float) -> DataFrame:
        g = shared[scale]
        y, x = (grids.Axis(g[f"start_{a}"], g[f"step_{a}"], target.head[size], g[f"{a}0"], g[f"{a}1"]) for a, size in (("y", "height"), ("x", "width")))
        return grids.resample_tiles(gray[1], tile, y, x)

    def matched(scale: float, steps: list[Step], name: str) -> DataFrame:
        """Matches of a scale as the steps map the source."""
        g = shared[scale]
        h, w, window = g["lattice_height"], g["lattice_width"], (g["x0"], g["y0"], g["x1"], g["y1"])
        if scale not in small:
            axes = (grids.Axis(0.0, 1 / scale, source.head[size], 0, n) for size, n in (("height", h), ("width", w)))
            small[scale] = keep(grids.resample_tiles(gray[0], tile, *axes), f"source_scale{scale:.3f}")
            aims[scale] = keep(aim(scale), f"target_overlap_scale{scale:.3f}")
        moved = small[scale]
        if steps:
            to, so_far = lattice_place(scale), Registration(list(steps))
            back = lambda p: fits._project(np.linalg.inv(to), so_far.back(fits._project(to, p)))
            moved = keep(raster.warp_tiles(moved, back, tile, h, w, (h, w), (1,)), f"source_scale{scale:.3f}_{name}")
        return keep(match(window_pixels(moved, tile, *window), window_pixels(aims[scale], tile, *window), scale), f"matches_scale{scale:.3f}_{name}")

    aims: dict[float, DataFrame] = {}
    for k, (scale, kind) in enumerate(plan):
        matches[scale] = matched(scale, done.steps, "moved")
        if kind == AUTO:
            after = plan[k + 1][0] if k + 1 < len(plan) else None
            step, report = process_scale_level(matches[scale], scale, after, done, lambda s, after=after: matched(after, [*done.steps, s], f"after_{s.kind}"))
            if report is not None:
                keep(report, f"histograms_scale{scale:.3f}")
        else:
            step = _step(fit_step(matches[scale], kind, scale), scale, kind, done)
        if step:
            done.steps.append(step)
    size = source.head["height"], source.head["width"]
    color = eight_bit(source, tile, joint=False)
    bands = tuple(range(1, min(3, source.head["bands"]) + 1))
    return done, raster.warp_tiles(color, done.back, tile, *size, size, bands) if done.steps else color, matches


def register(source: DataFrame, target: DataFrame, plan: Sequence[tuple[float, str]] = DEFAULT_PLAN, match: Matcher | None = None, height: int = 0, width: int = 0, tile: int = 64) -> tuple[Registration, DataFrame]:
    """As register_tiles, from pixel tables."""
    if not (height and width):
        height, width = source.agg(F.max("row") + 1, F.max("col") + 1).first()
    return register_tiles(raster.to_tiles(source, tile), raster.to_tiles(target, tile), tile, height, width, plan, match)


def register_tiles(tiles: DataFrame, target: DataFrame, tile: int, height: int, width: int, plan: Sequence[tuple[float, str]] = DEFAULT_PLAN, match: Matcher | None = None, keep: Keep | None = None) -> tuple[Registration, DataFrame]:
    """Register one raster's gray tiles (values 0..255) to another's on the same grid; returns the steps and the warped tiles."""
    head = {"height": height, "width": width, "bands": 1, "kind": "u1", "epsg": 4326, "a": 1.0, "b": 0.0, "c": 0.0, "d": 0.0, "e": -1.0, "f": float(height), "left": 0.0, "right": float(width), "bottom": 0.0, "top": float(height)}
    sides = (Raster(head, t.select(F.lit(1).cast("long").alias("raster_id"), "ty", "tx", "data")) for t in (tiles, target))
    return register_rasters(*sides, tile, plan, match, keep or (lambda df, name: df))[:2]


def apply_transform(tiles: DataFrame, row: dict, scale: float, tile: int, height: int, width: int) -> DataFrame:
    """A fitted row of ``fits.TRANSFORM_SCHEMA``, in pixels of a scale, applied to full-resolution tiles: a matrix by its inverse, a
    polynomial or spline as the map by which pixels are looked up."""
    if row.get("matrix"):
        back = np.linalg.inv(at_full_resolution(np.array(row["matrix"]).reshape(3, 3), scale))
        return raster.warp_tiles(tiles, lambda p: fits._project(back, p), tile, height, width)
    return raster.warp_tiles(tiles, look_up(row, scale), tile, height, width)


def matrix_at(record: Mapping, pixel_m: float) -> list[float] | None:
    """A transform file's matrix for pixels of ``pixel_m`` metres, of whatever scale and raster: from its metres, or else from its own pixels."""
    m = record.get("matrix_meters")
    if not m and record.get("matrix"):
        own = record["pixel_resolution_meters"]
        m = [v * own if k in (2, 5) else v / own if k in (6, 7) else v for k, v in enumerate(record["matrix"])]
    return None if not m else [v / pixel_m if k in (2, 5) else v * pixel_m if k in (6, 7) else v for k, v in enumerate(m)]


def run_methods(source: DataFrame, target: DataFrame, scale: float, methods: Mapping[str, Matcher]) -> DataFrame:
    """Matches of two pixel tables by each matcher, marked with its name in ``method``; see robust.leaderboard."""
    found = None
    for name, match in methods.items():
        own = match(source, target, scale).withColumn("method", F.lit(name))
        found = own if found is None else found.unionByName(own)
    return found


def compare_patch_variants(source: DataFrame, target: DataFrame, tile: int, match: Matcher | None = None, scale: float = 1.0) -> DataFrame:
    """Patch matches of two rasters' tiles as they are and as gradients, equalised and as edges, marked in ``method``."""
    sides = ((name, *(pixels_of(features.prepared(t, tile, name), tile).withColumn("value", F.round("value").cast("int")) for t in (source, target))) for name in features.VARIANTS)
    found = None
    for name, a, b in sides:
        own = (match or ncc_matcher())(a, b, scale).withColumn("method", F.lit(name))
        found = own if found is None else found.unionByName(own)
    return found


def pixels_of(tiles: DataFrame, tile: int) -> DataFrame:
    """Pixel rows of tiles."""
    import pandas as pd

    def spread(frames):
        at = np.arange(tile * tile)
        for frame in frames:
            for r in frame.itertuples():
                yield pd.DataFrame({"raster_id": r.raster_id, "row": r.ty * tile + at // tile, "col": r.tx * tile + at % tile, "value": np.frombuffer(r.data, np.float32).astype(float)})

    return tiles.mapInPandas(spread, "raster_id long, row int, col int, value double")


def tiles_of_box(spark: SparkSession, box: tuple[float, float, float, float], zoom: int, source: str = "osm") -> DataFrame:
    """(x, y, zoom, url) of the map tiles that cover (min_lat, min_lon, max_lat, max_lon)."""
    lat0, lon0, lat1, lon1 = box
    z = F.lit(zoom)
    ends = spark.range(1).select(geo.tile_x(F.lit(lon0), z).alias("x0"), geo.tile_x(F.lit(lon1), z).alias("x1"), geo.tile_y(F.lit(lat1), z).alias("y0"), geo.tile_y(F.lit(lat0), z).alias("y1"))
    t = ends.select(F.explode(F.sequence("x0", "x1")).alias("x"), "y0", "y1").select("x", F.explode(F.sequence("y0", "y1")).alias("y"))
    return t.select("x", "y", z.alias("zoom"), geo.tile_url(F.lit(source), F.col("x"), F.col("y"), z).alias("url"))


def zoom_of_box(box: tuple[float, float, float, float], most: int = 64) -> int:
    """By area, then smaller until at most ``most`` tiles cover the box."""
    lat0, lon0, lat1, lon1 = box
    area = (lat1 - lat0) * (lon1 - lon0)
    zoom = next((z for limit, z in ((0.0001, 16), (0.001, 15), (0.01, 13), (0.1, 11)) if area < limit), 9)

    def span(z: int) -> int:
        y = [math.floor((1 - math.asinh(math.tan(math.radians(a))) / math.pi) / 2 * 2**z) for a in (lat0, lat1)]
        x = [math.floor((o + 180) / 360 * 2**z) for o in (lon0, lon1)]
        return (abs(x[1] - x[0]) + 1) * (abs(y[1] - y[0]) + 1)

    while zoom > 1 and span(zoom) > most:
        zoom -= 1
    return zoom


def fetch_tiles(tiles: DataFrame, fetch: Callable[[str], bytes | None], retries: int = 2) -> DataFrame:
    """Add ``data``: what ``fetch`` gives for the address, tried again after a growing pause, null if it never does."""
    import time

    import pandas as pd

    def run(frames):
        for frame in frames:
            out = []
            for url in frame["url"]:
                data = None
                for n in range(retries + 1):
                    try:
                        data = fetch(url)
                    except OSError:
                        data = None
                    if data is not None:
                        break
                    time.sleep(0.1 * (n + 1))
                out.append(data)
            yield frame.assign(data=pd.Series(out, dtype=object))

    return tiles.mapInPandas(run, StructType([*tiles.schema.fields]).add("data", "binary"))


def stitch(fetched: DataFrame, folder: str, box: tuple[float, float, float, float], zoom: int, tile: int = geo.TILE_PX) -> tuple[DataFrame, int, int]:
    """Fetched map tiles (x, y, data) as one image of a box: tiles (raster_id is the band, ty, tx, data), height and width.

    The images are written to ``folder``, which all executors share, and decoded by Spark's image source; a tile that
    was not fetched, or is no image, is gray 128.
    """
    import uuid

    spark, top = fetched.sparkSession, f"{paths.qualified(fetched.sparkSession, folder).rstrip('/')}/tiles-{uuid.uuid4().hex}"
    x0, y0, x1, y1 = fetched.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    left, upper, right, lower = mosaic_crop(x0, y0, x1, y1, zoom, box)

    def save(frames):
        import pandas as pd

        for frame in frames:
            names = [f"{top}/{r.x}_{r.y}.img" for r in frame.itertuples()]
            for name, data in zip(names, frame["data"], strict=True):
                paths.write(name, data or b"none")
            yield pd.DataFrame({"path": names})

    fetched.mapInPandas(save, "path string").count()
    images = spark.read.format("image").option("dropInvalid", False).load(top).select("image.*")

    def place(frames):
        import pandas as pd

        for frame in frames:
            for r in frame.itertuples():
                x, y = (int(v) for v in r.origin.rpartition("/")[2].removesuffix(".img").split("_"))
                pixels = np.full((3, tile, tile), 128, np.float32)
                if r.height == tile and r.width == tile and r.nChannels in (1, 3, 4):
                    got = np.frombuffer(r.data, np.uint8).reshape(tile, tile, r.nChannels)
                    pixels[:] = (got[:, :, [2, 1, 0]] if r.nChannels >= 3 else got[:, :, [0, 0, 0]]).transpose(2, 0, 1)  # blue comes first
                yield pd.DataFrame({"raster_id": [1, 2, 3], "ty": y - y0, "tx": x - x0, "data": [b.tobytes() for b in pixels]})

    whole = images.mapInPandas(place, "raster_id long, ty int, tx int, data binary")
    height, width = lower - upper, right - left
    return raster.warp_tiles(whole, lambda p: p + [left, upper], tile, height, width), height, width


def download_basemap(spark: SparkSession, box: tuple[float, float, float, float], source: str, fetch: Callable[[str], bytes | None], folder: str, zoom: int | None = None) -> DataFrame:
    """Tiles of a box, stitched, cropped and written as GeoTIFFs in degrees under ``folder``; returns the manifest."""
    zoom = zoom or zoom_of_box(box)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tiles, height, width = stitch(fetch_tiles(tiles_of_box(spark, box, zoom, source).repartition(n), fetch), folder, box, zoom)
    lat0, lon0, lat1, lon1 = box
    transform = ((lon1 - lon0) / width, 0.0, lon0, 0.0, (lat0 - lat1) / height, lat1)
    return geotiff.write_tiles(tiles.withColumnRenamed("raster_id", "band"), f"{folder.rstrip('/')}/basemap", transform, 4326, height, width, geo.TILE_PX)


def mosaic_crop(x0: int, y0: int, x1: int, y1: int, zoom: int, box: tuple[float, float, float, float]) -> tuple[int, int, int, int]:
    """(left, upper, right, lower) pixels of a box in the mosaic of tiles x0..x1, y0..y1; at least one pixel each way."""
    lat0, lon0, lat1, lon1 = box
    lon = lambda x: x / 2**zoom * 360 - 180
    lat = lambda y: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * y / 2**zoom))))
    w, h = (x1 - x0 + 1) * geo.TILE_PX, (y1 - y0 + 1) * geo.TILE_PX
    px = w / (lon(x1 + 1) - lon(x0))
    py = h / (lat(y0) - lat(y1 + 1))
    left, right = int((lon0 - lon(x0)) * px), int((lon1 - lon(x0)) * px)
    upper, lower = int((lat(y0) - lat1) * py), int((lat(y0) - lat0) * py)
    return left, upper, max(left + 1, right), max(upper + 1, lower)


def reproject_tiles(tiles: DataFrame, tile: int, head: Mapping, transform: tuple[float, ...], epsg: int, height: int, width: int, ids: tuple[int, ...] | None = None) -> DataFrame:
    """Tiles of a raster (its header: a to f, height, width, epsg) resampled to the grid of a geotransform in another system."""
    a, b, c, d, e, f = (head[k] for k in "abcdef")
    back = np.linalg.inv(np.array([[a, b, c], [d, e, f], [0, 0, 1.0]]))
    a2, b2, c2, d2, e2, f2 = transform

    def inverse(p: np.ndarray) -> np.ndarray:
        u, v = p[:, 0] + 0.5, p[:, 1] + 0.5
        x, y = projection.between(epsg, head["epsg"], a2 * u + b2 * v + c2, d2 * u + e2 * v + f2)
        return (np.c_[x, y, np.ones(len(p))] @ back.T)[:, :2] - 0.5

    return raster.warp_tiles(tiles, inverse, tile, height, width, (head["height"], head["width"]), ids)


def best_zone(head: Mapping) -> int:
    """EPSG code of the UTM zone that holds a raster's centre."""
    lon, lat = projection.inverse(np.array((head["left"] + head["right"]) / 2), np.array((head["bottom"] + head["top"]) / 2), head["epsg"])
    spark = SparkSession.getActiveSession()
    return spark.range(1).select(geo.utm_epsg(F.lit(float(lon)), F.lit(float(lat)))).first()[0]


def reproject_file(spark: SparkSession, path: str, out: str, epsg: int | None = None, tile: int = 256) -> str:
    """A raster resampled to another system of ``projection`` and written under ``out``; returns its files' path.

    epsg: by default the UTM zone of the raster's centre. Pixels keep about their size on the ground: the width of one
    at the raster's centre.
    """
    r = open_raster(spark, path, tile)
    h = r.head
    epsg = epsg or best_zone(h)
    if bad := [k for k in (h["epsg"], epsg) if k is None or not projection.known(k)]:
        raise ValueError(f"EPSG:{bad[0]} is not known")
    u = np.linspace(0, 1, 65)
    # Edges of a box bend in the projection, so points along them give its extent.
    px = np.concatenate([u * h["width"], u * h["width"], 0 * u, 0 * u + h["width"]])
    py = np.concatenate([0 * u, 0 * u + h["height"], u * h["height"], u * h["height"]])
    x, y = projection.between(h["epsg"], epsg, h["a"] * px + h["b"] * py + h["c"], h["d"] * px + h["e"] * py + h["f"])
    mx, my = h["width"] / 2 + np.array([0.0, 1.0, 0.0]), h["height"] / 2 + np.array([0.0, 0.0, 1.0])
    cx, cy = projection.between(h["epsg"], epsg, h["a"] * mx + h["b"] * my + h["c"], h["d"] * mx + h["e"] * my + h["f"])
    size = float(np.hypot(cx[1] - cx[0], cy[1] - cy[0]))
    left, top = float(x.min()), float(y.max())
    width, height = max(1, math.ceil((x.max() - left) / size)), max(1, math.ceil((top - y.min()) / size))
    transform = (size, 0.0, left, 0.0, -size, top)
    bands = tuple(range(1, min(3, h["bands"]) + 1))
    warped = reproject_tiles(eight_bit(r, tile, joint=False), tile, h, transform, epsg, height, width, bands)
    geotiff.write_tiles(warped.withColumnRenamed("raster_id", "band"), out, transform, epsg, height, width, tile)
    return f"{out}/*.tif"


def write_patches(placed: DataFrame, folder: str) -> int:
    """Write each point's patch (path, gcp_id, x0, y0, x1, y1) as a PNG of its first three bands, or of one; returns how many."""
    import pandas as pd

    out = paths.qualified(placed.sparkSession, folder)

    def cut(frames):
        for frame in frames:
            names = []
            for path, own in frame.groupby("path", sort=False):
                with geotiff.open_file(path) as stream:
                    tiff = geotiff.Tiff(stream)
                    for r in own.itertuples():
                        image = tiff.window(r.y0, r.y1, r.x0, r.x1)[:3]
                        image = image if image.dtype == np.uint8 else sinks.to_uint8(image)
                        names.append(f"{out.rstrip('/')}/{r.name}.png")
                        paths.write(names[-1], sinks.png(np.ascontiguousarray(image.transpose(1, 2, 0)) if len(image) == 3 else image[0]))
            yield pd.DataFrame({"name": names})

    named = placed.select("path", "x0", "y0", "x1", "y1", geo.safe_name(F.col("gcp_id").cast("string")).alias("name"))
    return named.mapInPandas(cut, "name string").count()


def analyse_gcps(gcps: DataFrame, rasters: DataFrame, size: int = 300) -> tuple[DataFrame, DataFrame]:
    """Patch bounds of the points that a raster holds, and the number of points with and without."""
    placed = control.patch_bounds(control.points_in_rasters(gcps, rasters), size)
    status = gcps.join(placed.select("gcp_id").distinct().withColumn("_hit", F.lit(True)), "gcp_id", "left")
    return placed, status.groupBy(F.when(F.col("_hit"), "success").otherwise("failed").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def diagnose(pair: DataFrame) -> DataFrame:
    """Issues of (source, target) rasters in one row each: other CRS, no or little overlap, very different resolution."""
    s, t = (lambda c: F.col(f"source.{c}")), (lambda c: F.col(f"target.{c}"))
    w, h = F.least(s("right"), t("right")) - F.greatest(s("left"), t("left")), F.least(s("top"), t("top")) - F.greatest(s("bottom"), t("bottom"))
    share = F.when((w > 0) & (h > 0), w * h / ((s("right") - s("left")) * (s("top") - s("bottom")))).otherwise(0.0)
    ratio = t("a") / s("a")
    gap = F.sqrt(F.pow((s("left") + s("right") - t("left") - t("right")) / 2, 2) + F.pow((s("top") + s("bottom") - t("top") - t("bottom")) / 2, 2))
    issues = F.array(F.when(s("epsg") != t("epsg"), "CRS differ"), F.when(share == 0, "no overlap").when(share < 0.1, "small overlap"), F.when((ratio > 10) | (ratio < 0.1), "resolutions differ"))
    return pair.select("*", share.alias("overlap"), ratio.alias("resolution_ratio"), F.when(share == 0, gap).alias("centre_distance"), F.filter(issues, lambda x: x.isNotNull()).alias("issues"))
