"""Command line: python -m rasterloom register | basemap | gcp-analysis | gcp-evaluation | reproject | evaluate | headers; see --help."""

from __future__ import annotations

import argparse
import json
import logging
import sys
import urllib.request
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import geo
from rasterloom.operators import control, raster
from rasterloom.plans import registration
from rasterloom.sources import files, geotiff, paths, sinks

log = logging.getLogger("rasterloom")
#: Names of a configuration file, and the options that they stand for.
CONFIG = {
    "source_path": "source", "target_path": "target", "output_dir": "out", "hierarchical_scales": "scales", "scales": "scales", "algorithms": "algorithms", "method": "matcher", "matcher": "matcher", "patch_size": "patch",
    "patch_grid_spacing": "spacing", "search_margin": "margin", "ncc_threshold": "threshold", "max_features": "features", "debug_level": "debug_level",
}
DEFAULTS = {"out": "outputs", "scales": [s for s, _ in registration.DEFAULT_PLAN], "matcher": "lightglue", "patch": 64, "spacing": 32, "margin": 150, "threshold": 0.5, "features": 5000, "debug_level": "none"}


def set_up_logging(debug: bool) -> None:
    """Lines with time and level on standard error; details only with ``debug``."""
    handler = logging.StreamHandler(sys.stderr)
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
    log.handlers[:] = [handler]
    log.setLevel(logging.DEBUG if debug else logging.INFO)


def fetch(url: str) -> bytes | None:
    """The bytes at an address; errors of the network are OSError."""
    request = urllib.request.Request(url, headers={"User-Agent": "rasterloom/1"})
    with urllib.request.urlopen(request, timeout=10) as answer:
        return answer.read() if answer.status == 200 else None


def settled(a: argparse.Namespace) -> dict:
    """Options of a run: the command line before the configuration file before the defaults; unknown names of the file are logged."""
    config = files.load_config(a.config) if a.config else {}
    given = {CONFIG[k]: v for k, v in config.items() if k in CONFIG}
    if other := [k for k in config if k not in (*CONFIG, "output_format") and not k.startswith("_")]:
        log.info("not used of %s: %s", a.config, ", ".join(other))
    out = DEFAULTS | {"algorithms": None, "source": None, "target": None} | given | {k: v for k, v in vars(a).items() if k in {*CONFIG.values()} and v is not None}
    form = config.get("output_format") or {}
    out["quality"] = a.jpeg_quality or (int(form.get("jpeg_quality", 90)) if str(form.get("compression", "")).upper() == "JPEG" else None)
    if out["algorithms"] is None and out["scales"] == DEFAULTS["scales"]:
        out["algorithms"] = [k for _, k in registration.DEFAULT_PLAN]
    return out


def register(spark: SparkSession, a: argparse.Namespace) -> None:
    o = settled(a)
    out = paths.qualified(spark, o["out"])
    box = None
    if a.get_basemap:
        if not a.basemap_area:
            raise SystemExit("--get-basemap needs --basemap-area")
        if o["target"]:
            log.warning("the basemap stands instead of the target %s", o["target"])
        box = area(spark, a.basemap_area)
        o["target"] = download(spark, box, a.get_basemap, f"{out}/basemap_{a.get_basemap}", a.basemap_zoom, a.basemap_resolution, a.tile)
    for side in ("source", "target"):
        if not o[side]:
            raise SystemExit(f"{side}_path is missing: name it, or give a configuration file")
    try:
        plan = registration.checked_plan(o["scales"], o["algorithms"]) if o["algorithms"] else registration.default_plan(o["scales"])
        source, target = (registration.open_raster(spark, o[side], a.tile) for side in ("source", "target"))
        match = registration.matcher_for(o["matcher"], patch=o["patch"], spacing=o["spacing"], margin=o["margin"], threshold=o["threshold"], features=o["features"], tile=a.tile)
        run = sinks.run_directory(out, datetime.now(UTC))
        log.info("register %s to %s: %s", o["source"], o["target"], plan)
        done, tiles, matches = registration.register_rasters(source, target, a.tile, plan, match, registration.kept_in(run["intermediate"]))
    except ValueError as e:
        raise SystemExit(str(e)) from e
    for s in done.steps:
        log.info("scale %s: %s with %s inliers of %s, robust RMSE %s", s.scale, s.row["type"], s.row["inlier_count"], s.row["num_points"], s.row["robust_rmse"])
    head = source.head
    transform, epsg = tuple(head[c] for c in "abcdef"), head["epsg"] or 32610
    pixel_m = spark.range(1).select(geo.pixel_metres(F.lit(epsg), *(F.lit(head[c]) for c in ("a", "top", "bottom")))).first()[0]
    manifest = [r.asDict() for r in geotiff.write_tiles(tiles.withColumnRenamed("raster_id", "band"), f"{run['run']}/registered", transform, epsg, head["height"], head["width"], a.tile, quality=o["quality"]).collect()]  # a row per file
    for scale, found in matches.items():
        sinks.matches_json(found.withColumn("scale", F.lit(scale)), pixel_m / scale, ("pair_id", "scale"), statistics=True).select("json").write.mode("overwrite").text(f"{run['run']}/matches_scale{scale:.3f}")
    steps = [sinks.transform_record(s.row, s.scale, pixel_m) for s in done.steps]
    texts = {f"transform_scale{s['scale']:.3f}.json": json.dumps(s, indent=2) for s in steps} | {
        "steps.json": json.dumps(steps, indent=2), "registered/registered.vrt": geotiff.vrt(manifest, transform, epsg, head["height"], head["width"]),
        "run_config.json": json.dumps({k: o[v] for k, v in CONFIG.items() if k != "scales" and v != "features"} | {"transform_types": {str(s): k for s, k in plan}, "basemap": box}, indent=2),
    }
    for name, text in texts.items():
        sinks.write_text(f"{run['run']}/{name}", text)
    if a.gcp_analysis:
        analyse(spark, f"{run['run']}/registered/*.tif", a.gcp_analysis, f"{run['run']}/gcp_analysis", 300)
    if a.gcp_evaluation:
        evaluate_points(spark, o["source"], a.gcp_evaluation, steps, f"{run['run']}/gcp_evaluation")
    print(run["run"])


def area(spark: SparkSession, text: str) -> tuple[float, float, float, float]:
    """A box from its four numbers, or from a text file that holds them."""
    for read in (lambda: text, lambda: " ".join(r.value for r in spark.read.text(text).limit(2).collect())):
        try:
            return files.parse_bbox(read())
        except ValueError:
            continue
        except Exception as e:  # no such file
            raise SystemExit(f"{text}: neither a box nor a file: {e}") from e
    raise SystemExit(f"{text}: no box of four numbers")


def download(spark: SparkSession, box: tuple[float, float, float, float], source: str, folder: str, zoom: int | None, resolution: float | None, tile: int) -> str:
    """Fetch a basemap into a folder; returns the path of its files, which are one where the box is small."""
    if zoom is None and resolution is not None:
        zoom = spark.range(1).select(geo.zoom_for_resolution(F.lit((box[0] + box[2]) / 2), F.lit(resolution))).first()[0]
    registration.download_basemap(spark, box, source, fetch, folder, zoom)
    return f"{folder}/basemap/*.tif"


def basemap(spark: SparkSession, a: argparse.Namespace) -> None:
    print(download(spark, area(spark, a.area), a.provider, paths.qualified(spark, a.out), a.zoom, a.resolution, 256))


def analyse(spark: SparkSession, raster_path: str, points: str, out: str, size: int) -> None:
    """A patch around each control point as PNG, and a line that says how many points had one."""
    rasters = geotiff.read_raster_headers(spark, raster_path).where("error IS NULL").withColumn("raster_id", F.xxhash64("path"))
    gcps = files.read_gcps(spark, points).withColumnRenamed("id", "gcp_id")
    placed, status = registration.analyse_gcps(gcps, rasters, size)
    registration.write_patches(placed, out)
    print(json.dumps({r.status: r.n for r in status.collect()}))


def gcp_analysis(spark: SparkSession, a: argparse.Namespace) -> None:
    analyse(spark, a.raster, a.points, paths.qualified(spark, a.out), a.size)


def evaluate_points(spark: SparkSession, source: str, points: str, steps: list[dict], out: str) -> None:
    rasters = geotiff.read_raster_headers(spark, source).withColumn("raster_id", F.lit(1).cast("long"))
    placed = control.points_in_rasters(files.read_gcps(spark, points).withColumnRenamed("id", "gcp_id"), rasters)
    rows = spark.createDataFrame([(k + 1, float(s["scale"]), s["matrix"][:6]) for k, s in enumerate(steps) if s.get("matrix")], "step int, scale double, matrix array<double>")
    errors = control.step_errors(placed, control.cumulative_matrices(rows), F.col("a"))
    summary = control.step_summary(errors)
    control.evaluation_json(summary, errors).select("json").write.mode("overwrite").text(out)
    for r in raster.running_mean_steps(summary).orderBy("step").collect():  # a row per step
        print(json.dumps(r.asDict()))


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    """How far each step moves the control points that the source holds; steps are a file or a folder of transform files."""
    evaluate_points(spark, a.source, a.points, files.read_steps(spark, a.steps), a.out)


def reproject(spark: SparkSession, a: argparse.Namespace) -> None:
    """Rasters in degrees to metres, each to the zone of its own centre where no system is named."""
    for head in geotiff.read_raster_headers(spark, a.source).toLocalIterator():
        if head.error:
            log.warning("%s: %s", head.path, head.error)
            continue
        name = head.path.rpartition("/")[2].rpartition(".")[0]
        try:
            print(registration.reproject_file(spark, head.path, f"{paths.qualified(spark, a.out)}/{name}", a.epsg, a.tile))
        except ValueError as e:
            log.warning("%s: %s", head.path, e)


def headers(spark: SparkSession, a: argparse.Namespace) -> None:
    for r in geotiff.read_raster_headers(spark, a.path).toLocalIterator():
        print(json.dumps(r.asDict()))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser("rasterloom")
    parser.add_argument("--debug", action="store_true")
    commands = parser.add_subparsers(required=True)
    providers = sorted(geo.TILE_PROVIDERS)
    r = commands.add_parser("register", help="register a source GeoTIFF to a target")
    for name in ("source", "target", "out"):
        r.add_argument(name, nargs="?")
    r.add_argument("--scales", type=float, nargs="+")
    r.add_argument("--algorithms", nargs="+")
    r.add_argument("--matcher", choices=sorted({*registration.MATCHERS, *registration.STAND_INS}))
    for name in ("config", "basemap-area", "gcp-analysis", "gcp-evaluation"):
        r.add_argument(f"--{name}")
    r.add_argument("--get-basemap", choices=providers)
    r.add_argument("--basemap-zoom", type=int)
    r.add_argument("--basemap-resolution", type=float)
    r.add_argument("--tile", type=int, default=512)
    for name in ("patch", "spacing", "margin", "features"):
        r.add_argument(f"--{name}", type=int)
    r.add_argument("--threshold", type=float)
    r.add_argument("--jpeg-quality", type=int)
    r.set_defaults(run=register)
    b = commands.add_parser("basemap", help="download the map of an area")
    b.add_argument("area", help="min_lat,min_lon,max_lat,max_lon or a file that holds them")
    b.add_argument("out")
    b.add_argument("--provider", choices=providers, default="openstreetmap")
    b.add_argument("--zoom", type=int)
    b.add_argument("--resolution", type=float)
    b.set_defaults(run=basemap)
    g = commands.add_parser("gcp-analysis", help="cut a patch around each control point")
    for name in ("raster", "points", "out"):
        g.add_argument(name)
    g.add_argument("--size", type=int, default=300)
    g.set_defaults(run=gcp_analysis)
    for name in ("evaluate", "gcp-evaluation"):
        e = commands.add_parser(name, help="displacement of control points by each step")
        for argument in ("source", "points", "steps", "out"):
            e.add_argument(argument)
        e.set_defaults(run=evaluate)
    p = commands.add_parser("reproject", help="rasters in degrees to metres")
    p.add_argument("source")
    p.add_argument("out")
    p.add_argument("--epsg", type=int)
    p.add_argument("--tile", type=int, default=256)
    p.set_defaults(run=reproject)
    h = commands.add_parser("headers", help="headers of GeoTIFFs")
    h.add_argument("path")
    h.set_defaults(run=headers)
    a = parser.parse_args(argv)
    set_up_logging(a.debug)
    a.run(SparkSession.builder.getOrCreate(), a)


if __name__ == "__main__":
    main()
