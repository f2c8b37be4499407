"""Operators on closed-form cases, files on round trips."""

import json
import math
import time
import zipfile
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import geo
from rasterloom.operators import control, fits, grids, index, matching, raster, robust, split
from rasterloom.sources import files, sinks

SCHEMA = "pair_id long, match_id long, src_x double, src_y double, dst_x double, dst_y double"


def pairs(spark, src, dst):
    return spark.createDataFrame([(1, i, *map(float, s), *map(float, d)) for i, (s, d) in enumerate(zip(src, dst, strict=True))], SCHEMA)


GRID = [(x * 10, y * 7) for x in range(6) for y in range(5)]


def test_pure_shift(spark):
    r = robust.fit_shift(pairs(spark, GRID, [(x + 3, y - 2) for x, y in GRID])).first()
    assert (r.shift_x, r.shift_y, r.robust_rmse, r.max_error) == (3, -2, 0, 0)


def test_gross_outliers_go(spark):
    dst = [(x + 3, y - 2) for x, y in GRID[:28]] + [(x + 500, y) for x, y in GRID[28:]]
    assert robust.remove_gross_outliers(pairs(spark, GRID, dst)).count() == 28


def test_median_of_even_number(spark):
    df = spark.createDataFrame([(1, v) for v in (1.0, 2.0, 4.0, 8.0)], "g int, v double")
    assert robust.with_median_and_mad(df, ["g"], F.col("v")).first().d_median == 3.0


def test_histogram_edge_and_flat(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (5.0,)], "v double")
    assert {r.bin: r.n for r in robust.histogram(df, "v", 10, F.lit(0.0), F.lit(10.0)).collect()} == {0: 1, 5: 1, 9: 1}
    assert robust.histogram(df.where("v = 5"), "v", 10, F.lit(5.0), F.lit(5.0)).first().bin == 0


def test_affine_and_similarity_least_squares(spark):
    r = fits.fit_affine_lsq(pairs(spark, GRID, [(2 * x + 0.5 * y + 1, -x + 3 * y - 4) for x, y in GRID])).first()
    assert [r.a, r.b, r.tx, r.c, r.d, r.ty] == pytest.approx([2, 0.5, 1, -1, 3, -4])
    r = fits.fit_similarity_lsq(pairs(spark, GRID, [(2 * x - y + 1, x + 2 * y - 4) for x, y in GRID])).first()
    assert [r.a, r.b, r.tx, r.ty] == pytest.approx([2, 1, 1, -4])
    assert fits.fit_affine_lsq(pairs(spark, [(i, i) for i in range(5)], [(i, i) for i in range(5)])).first().a is None


@pytest.mark.parametrize("kind,f", [
    ("shift", lambda x, y: (x + 3, y - 2)), ("similarity", lambda x, y: (2 * x - y + 1, x + 2 * y)), ("affine", lambda x, y: (2 * x + y, y - x / 2 + 9)),
    ("homography", lambda x, y: ((2 * x + y) / (1 + 0.01 * x), (y + 3) / (1 + 0.01 * x))), ("polynomial_2", lambda x, y: (x + 0.01 * x * y, y - 0.02 * x * x)), ("spline", lambda x, y: (x + math.sin(x / 9), y)),
])
def test_fits_recover(kind, f):
    s = np.array(GRID, float)
    d = np.array([f(x, y) for x, y in GRID], float)
    if kind not in ("shift", "polynomial_2", "spline"):
        d[:3] += 300  # outliers
    r = fits.fit_one(kind, s, d, 5.0 if kind != "polynomial_2" else 50.0)
    assert r.get("error") is None and r["median_error"] < (1e-2 if kind == "spline" else 1e-6)  # points of a grid are collinear, which smooths
    if kind not in ("shift", "polynomial_2", "spline"):
        assert r["inlier_count"] == len(GRID) - 3


def test_too_few_and_degenerate_points():
    for kind, n in fits.LEAST_POINTS.items():
        p = np.array(GRID[: n - 1], float).reshape(-1, 2)
        assert fits.fit_one(kind, p, p)["error"] == "insufficient_points"
    line = np.array([(i, i) for i in range(12)], float)
    assert fits.fit_one("affine", line, line)["error"] == "degenerate_points"


def test_best_transform(spark):
    df = pairs(spark, GRID, [(2 * x + y, y - x / 2 + 9) for x, y in GRID])
    all_ = fits.fit_all(df)
    assert all_.count() == len(fits.LEAST_POINTS) and fits.choose_best(all_).first()["type"] in ("affine", "homography", "polynomial_2", "polynomial_3", "spline")


def test_matrices_compose_in_order(spark):
    a, b = [list(map(float, m)) for m in ([1, 0, 5, 0, 1, 0, 0, 0, 1], [2, 0, 0, 0, 2, 0, 0, 0, 1])]
    df = spark.createDataFrame([(1, 2, b), (1, 1, a)], "g int, step int, matrix array<double>")
    assert fits.compose_matrices(df, ["g"], "step").first().matrix == (np.array(b).reshape(3, 3) @ np.array(a).reshape(3, 3)).ravel().tolist()


def test_nearest_and_ratio(spark):
    s = spark.createDataFrame([(1, [0.0, 0.0]), (2, [5.0, 5.0])], "kp_id long, descriptor array<double>")
    t = spark.createDataFrame([(7, [0.0, 1.0]), (8, [0.0, -1.0]), (9, [5.0, 5.5])], "kp_id long, descriptor array<double>")
    assert {(r.query_id, r.train_id) for r in matching.two_nearest(s, t).collect()} == {(1, 7), (2, 9)}
    assert [r.query_id for r in matching.ratio_matches(s, t, 0.7).collect()] == [2]
    assert matching.two_nearest(s, t.limit(0)).count() == 0 and matching.ratio_matches(s, t.limit(1), 0.7).count() == 0
    w = spark.createDataFrame([(1, [-1, 0])], "kp_id long, descriptor array<long>")
    v = spark.createDataFrame([(5, [-2, 1]), (6, [0, 0])], "kp_id long, descriptor array<long>")
    assert matching.two_nearest(w, v, "hamming").first().distance == 2.0


def test_tiles_and_utm(spark):
    one = spark.range(1)
    for lat, lon in ((49.0, -123.0), (-30.0, 20.0), (0.1, 179.9)):
        z = F.lit(12)
        r = one.select(geo.tile_x(F.lit(lon), z).alias("x"), geo.tile_y(F.lit(lat), z).alias("y")).first()
        b = one.select(geo.tile_lon(F.lit(float(r.x)), z), geo.tile_lon(F.lit(r.x + 1.0), z), geo.tile_lat(F.lit(r.y + 1.0), z), geo.tile_lat(F.lit(float(r.y)), z)).first()
        assert b[0] <= lon < b[1] and b[2] <= lat <= b[3]
    for lat, lon, epsg in ((60, 5, 32632), (78, 15, 32633), (-30, 20, 32734), (49, -123, 32610)):
        assert one.select(geo.utm_epsg(F.lit(float(lon)), F.lit(float(lat)))).first()[0] == epsg
    with pytest.raises(Exception, match="unknown tile source"):
        one.select(geo.tile_url(F.lit("x"), F.lit(1), F.lit(1), F.lit(1))).collect()
    assert one.select(geo.tile_url(F.lit("esri"), F.lit(1), F.lit(2), F.lit(3))).first()[0].endswith("/3/2/1")


def test_raster_operators(spark):
    p = spark.createDataFrame([(1, 1, r, c, (r * 5 + c) % 7 * 30) for r in range(8) for c in range(8)], "raster_id long, band int, row int, col int, value int")
    assert raster.three_bands(p).count() == 3 * 64
    flat = p.withColumn("value", F.lit(9))
    assert {r.value for r in raster.normalise(flat).collect()} == {0}
    up = raster.upsample_nearest(p, 2)
    assert up.count() == 256 and raster.downsample_box(up, 2).join(p.withColumnRenamed("value", "v"), ["raster_id", "row", "col"]).where("value <> v").count() == 0
    tiles = raster.to_tiles(p, 4)
    same = {(r.ty, r.tx): r.data for r in raster.warp_tiles(tiles, lambda q: q, 4, 8, 8).collect()}
    assert same == {(r.ty, r.tx): bytes(r.data) for r in tiles.collect()}
    moved = {(r.ty, r.tx): np.frombuffer(r.data, np.float32).reshape(4, 4) for r in raster.warp_tiles(tiles, lambda q: q - [1, 2], 4, 8, 8).collect()}
    whole = np.block([[moved[y, x] for x in (0, 1)] for y in (0, 1)])
    image = np.array([[(r * 5 + c) % 7 * 30 for c in range(8)] for r in range(8)])
    assert (whole[2:, 1:] == image[:-2, :-1]).all() and (whole[:2] == 0).all()


def test_image_kernels():
    image = np.zeros((40, 40), np.uint8)
    image[:, 20:] = 200
    e = raster.edges(image)
    assert e[:, :17].max() == 0 and e[5:-5, 18:22].max() == 255
    assert raster.local_contrast(image).shape == image.shape


def test_ncc_finds_a_shift(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 255, (24, 24))
    schema = "raster_id long, row int, col int, value int"
    t = spark.createDataFrame([(1, r, c, int(a[r, c])) for r in range(24) for c in range(24)], schema)
    s = spark.createDataFrame([(1, r + 1, c + 2, int(a[r, c])) for r in range(23) for c in range(22)], schema)
    g = matching.patch_grid(spark.createDataFrame([(1, 24, 24)], "raster_id long, height int, width int"), 8, 4)
    got = matching.patch_ncc(s, t, g, 8, 2).where("py between 6 and 14 and px between 6 and 14").collect()
    assert got and {(r.dy, r.dx, round(r.ncc, 9)) for r in got} == {(1, 2, 1.0)}
    assert matching.patch_ncc(s.withColumn("value", F.lit(3)), t, g, 8, 1).count() == 0


GCPS = "Label,X,Y,Z,Accuracy,Enabled\nA,-123.1,49.2,5,0.01,1\n,-123.2,49.3,,,1\nC,-123.3,49.4,1,0.01,0\n"


def test_control_point_files(spark, tmp_path):
    (tmp_path / "g.csv").write_text(GCPS)
    (tmp_path / "g.tsv").write_text("label\tx\ty\tz\nP\t1\t2\t3\n")
    got = files.read_gcps(spark, str(tmp_path / "g.csv")).collect()
    assert [(r.id, r.lon, r.z, r.accuracy) for r in got] == [("A", -123.1, 5.0, 0.01), ("GCP_002", -123.2, 0.0, 0.005)]
    assert files.read_gcps(spark, str(tmp_path / "g.tsv")).first().id == "P"
    with zipfile.ZipFile(tmp_path / "g.kmz", "w") as z:
        z.writestr("doc.kml", '<kml xmlns="http://www.opengis.net/kml/2.2"><Placemark><name>K</name><Point><coordinates>1.5,2.5,9</coordinates></Point></Placemark></kml>')
    assert tuple(files.read_gcps(spark, str(tmp_path / "g.kmz")).first())[:4] == ("K", 1.5, 2.5, 9.0)
    with pytest.raises(FileNotFoundError):
        files.read_gcps(spark, str(tmp_path / "none.csv"))
    (tmp_path / "g.txt").write_text("x")
    with pytest.raises(ValueError):
        files.read_gcps(spark, str(tmp_path / "g.txt"))


def test_matches_and_cells(spark, tmp_path):
    m = {"scale": 0.5, "matches": [{"source": {"x": 1, "y": 2}, "target_original": {"x": 3, "y": 4}}, {"source": {"x": 1, "y": 2}, "target_original": {"x": 3, "y": 4}, "target_upsampled": {"x": 9, "y": 8}}, {"source": {"x": 1}}]}
    (tmp_path / "matches_scale0.500.json").write_text(json.dumps(m))
    got = files.read_matches(spark, str(tmp_path / "matches_scale0.500.json")).withColumn("s", files.scale_of("file")).collect()
    assert sorted((r.dst_x, r.dst_y, r.s) for r in got) == [(3, 4, 0.5), (9, 8, 0.5)]
    (tmp_path / "c.xml").write_text("<a><c>8828d1a2b5fffff</c><c>8828d1a2b5fffff</c><c>no</c></a>")
    (tmp_path / "c.txt").write_text("# comment\n8828d1a2b5fffff\n\n8828d1a2b5fffff\n")
    assert files.read_cells(spark, str(tmp_path / "c.xml")).count() == 1 and files.read_cells(spark, str(tmp_path / "c.txt")).count() == 2
    assert files.parse_bbox("1,2,3,4") == (1, 2, 3, 4) == files.parse_bbox("1 2 3 4")
    for bad in ("1,2,3", "3,2,1,4"):
        with pytest.raises(ValueError):
            files.parse_bbox(bad)


def test_geotiff_round_trip(spark, tmp_path):
    image = np.arange(3 * 20 * 30, dtype=np.uint8).reshape(3, 20, 30)
    (tmp_path / "r.tif").write_bytes(sinks.geotiff(image, (0.5, 0, -123.5, 0, -0.25, 49.1), 4326))
    (tmp_path / "bad.tif").write_bytes(b"nothing")
    assert (files.read_tiff((tmp_path / "r.tif").read_bytes()) == image).all()
    rows = {r.path.rpartition("/")[2]: r for r in files.read_raster_headers(spark, str(tmp_path)).collect()}
    r = rows["r.tif"]
    assert (r.width, r.height, r.bands, r.epsg, r.left, r.top, r.right, r.bottom) == (30, 20, 3, 4326, -123.5, 49.1, -108.5, 49.1 - 5)
    assert rows["bad.tif"].error
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "p.png").write_bytes(sinks.png(image[0]))
    got = files.read_images(spark, str(tmp_path / "img")).first()
    assert (got.height, got.width) == (20, 30) and bytes(got.data) == image[0].tobytes()
    assert files.file_info(spark, str(tmp_path / "img")).first().length > 0


def test_sinks(spark, tmp_path):
    df = pairs(spark, GRID, [(x + 3, y - 4) for x, y in GRID])
    j = json.loads(sinks.matches_json(df, 0.5).first().json)
    assert j["num_matches"] == 30 and j["matches"][0]["distance"] == {"pixels": 5.0, "meters": 2.5}
    t = json.loads(sinks.transforms_json(fits.fit_all(df, ["shift"]).withColumn("pixel_resolution", F.lit(0.5))).first().json)
    assert t["matrix"][2] == 3.0 and t["median_error_meters"] == 0.0
    sinks.append_events(spark.createDataFrame([(1, "x")], "timestamp long, message string"), str(tmp_path / "e"))
    sinks.append_events(spark.createDataFrame([(2, "y")], "timestamp long, message string"), str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).count() == 2
    assert sinks.run_directory("o", datetime(2020, 1, 2, 3, 4, 5))["run"] == "o/run_20200102_030405" and files.newest_run(["run_20200102_030405", "run_20210102_030405", "x"]) == "run_20210102_030405"
    sinks.save_config({"a": 1}, str(tmp_path / "c.json"))
    assert files.load_config(str(tmp_path / "c.json")) == {"a": 1}


def test_points_patches_and_disjoint_boxes(spark):
    r = spark.createDataFrame([(1, 400, 200, 0.001, 0.0, 10.0, 0.0, -0.001, 50.0, 10.0, 49.8, 10.4, 50.0)], "raster_id long, width long, height long, a double, b double, c double, d double, e double, f double, left double, bottom double, right double, top double")
    g = spark.createDataFrame([(1, 10.0005, 49.9995), (2, 10.39, 49.81), (3, 9.99, 49.9), (4, None, 1.0)], "gcp_id long, lon double, lat double")
    got = {p.gcp_id: p for p in control.patch_bounds(control.points_in_rasters(g, r)).collect()}
    assert set(got) == {1, 2} and (got[1].x0, got[1].x1, got[1].y0, got[1].y1) == (0, 300, 0, 200) and (got[2].x0, got[2].x1) == (100, 400)
    boxes = r.select(F.col("raster_id").alias("id"), "left", "bottom", "right", "top")
    far = boxes.withColumn("left", F.col("left") + 5).withColumn("right", F.col("right") + 5)
    assert control.overlaps(boxes, far).count() == 0 and control.overlaps(boxes, boxes).first().share_a == 1.0


def rasters_of(spark, rows):
    """(raster_id, left) as rasters of 400 x 200 pixels."""
    cols = "raster_id long, width long, height long, a double, b double, c double, d double, e double, f double, left double, bottom double, right double, top double"
    return spark.createDataFrame([(k, 400, 200, 0.001, 0.0, x, 0.0, -0.001, 50.0, x, 49.8, x + 0.4, 50.0) for k, x in rows], cols)


def test_rasters_of_one_shape_are_looked_up_once(spark):
    r = rasters_of(spark, [(k, 10.0) for k in range(2500)] + [(7, 10.0), (None, 10.0), (9000, 10.1), (9001, 30.0)])
    g = spark.createDataFrame([(1, 10.0505, 49.9995), (2, 10.15, 49.9)], "gcp_id long, lon double, lat double")
    seen = []
    got = control.points_in_rasters(g, r, lambda p: seen.append(p.count()) or p.withColumn("twice", F.col("gcp_id") * 2)).collect()
    assert seen == [3]
    assert Counter((p.gcp_id, p.raster_id) for p in got) == Counter([(k, x) for k in (1, 2) for x in (*range(2500), 7, None)] + [(2, 9000)])
    assert all(p.twice == 2 * p.gcp_id for p in got) and {round(p.px, 6) for p in got if p.raster_id == 9000} == {50.0}


def test_evaluation_of_rows_that_stand_for_several(spark, tmp_path):
    keep = lambda df, label: (df.write.parquet(str(tmp_path / label)), spark.read.parquet(str(tmp_path / label)))[1]
    rows = [(k % 3, k, float(k), 1.0, float(k), 2.0, (k * 37 % 101) / 8, 1 + k % 5) for k in range(200)] + [(5, 1, 0.0, 0.0, 0.0, 0.0, 0.5, 1), (5, 2, 0.0, 0.0, 0.0, 0.0, 1.5, 1)]
    e = spark.createDataFrame(rows, "step int, gcp_id long, px double, py double, new_x double, new_y double, error_m double, rasters long")
    whole = e.select("step", "error_m", F.explode(F.sequence(F.lit(1).cast("long"), "rasters")))
    want = {r.step: r for r in control.step_summary(whole).collect()}
    summary = control.weighted_step_summary(e, "rasters", keep)
    got = {r.step: r for r in summary.collect()}
    assert set(got) == set(want) == {0, 1, 2, 5} and got[5].median_error == 1.0
    assert all(got[k][c] == pytest.approx(want[k][c], rel=1e-12) for k in want for c in want[k].asDict())
    texts = [json.loads(r.json) for r in control.evaluation_json(summary, e).collect()]
    assert all(sum(p["rasters"] for p in t["points"]) == t["n"] for t in texts) and sum(len(t["points"]) for t in texts) == len(rows)


def test_boxes_of_one_shape_meet_once(spark):
    a = rasters_of(spark, [(k, 10.0) for k in range(1500)] + [(7, 10.0), (None, 10.0), (9000, 30.0)]).withColumnRenamed("raster_id", "id")
    b = rasters_of(spark, [(k, 10.2) for k in range(1200)] + [(9001, 10.3)]).withColumnRenamed("raster_id", "id")
    seen = []
    got = control.overlaps(a, b, control.SHAPE, lambda met: seen.append(met.count()) or control.overlap_pixels(met)).select("a_id", "b_id", "x0", "x1")
    assert seen == [2] and got.count() == 1502 * 1201 and got.where("a_id = 7").count() == 2 * 1201 and got.where("a_id is null").distinct().count() == 1201
    assert {(r.x0, r.x1) for r in got.where("b_id = 9001").collect()} == {(300, 400)}


@pytest.fixture
def unbroadcast(spark):
    """As with tables that are too large to be broadcast."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield spark
    spark.conf.set(key, old)


def test_points_of_one_shape_are_dealt_to_several_tasks(unbroadcast):
    g = unbroadcast.createDataFrame([(k, 10.001 + k / 2000, 49.9) for k in range(400)], "gcp_id long, lon double, lat double")
    for ids in ([1], [1, 2, 2]):
        got = control.points_in_rasters(g, rasters_of(unbroadcast, [(k, 10.0) for k in ids])).select("gcp_id", "raster_id", F.spark_partition_id().alias("task")).collect()
        assert Counter((p.gcp_id, p.raster_id) for p in got) == Counter((k, x) for k in range(400) for x in ids)
        tasks = Counter(p.task for p in got)
        assert len(tasks) >= 4 and max(tasks.values()) < len(got) / 2


def test_boxes_of_one_shape_are_dealt_to_several_tasks_and_listed_on_one_side_at_a_time(unbroadcast):
    a, b = (rasters_of(unbroadcast, [(k, x) for k in range(60)]).withColumnRenamed("raster_id", "id") for x in (10.0, 10.2))
    met = control.overlaps(a, b, control.SHAPE, control.overlap_pixels).select("a_id", "b_id", "x0")
    got = met.withColumn("task", F.spark_partition_id()).collect()
    assert Counter((p.a_id, p.b_id) for p in got) == Counter((k, x) for k in range(60) for x in range(60)) and len({p.x0 for p in got}) == 1
    tasks = Counter(p.task for p in got)
    assert len(tasks) >= 4 and max(tasks.values()) < len(got) / 2
    _, between, *_ = met._jdf.queryExecution().optimizedPlan().toString().split("Generate inline")
    assert "Join" in between


@pytest.mark.parametrize("name", ["gcp_patch_bounds", "gcp_in_bounds", "gcp_in_bounds_of_the_world", "gcp_step_errors"])
def test_only_the_columns_asked_for_are_listed(spark, name):
    from rasterloom.plans import queries

    assert "epsg" not in queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["gcp_patch_bounds", "gcp_in_bounds_of_the_world", "gcp_step_errors", "raster_overlap", "overlap_pixel_windows"])
def test_values_of_a_shape_are_computed_before_its_rasters_are_listed(spark, name):
    from rasterloom.plans import queries

    above, listed, _ = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().partition("Generate inline")
    assert listed and not any(f in above for f in ("round(", "replace(", "least(", "median(", "Join"))


def test_best_transform_fits_every_match(spark, monkeypatch):
    from rasterloom.plans import queries

    grid = [(x * 7 % 101, y * 3) for x in range(20) for y in range(21)]
    df = pairs(spark, grid, [(x + 3, y - 2) for x, y in grid])
    monkeypatch.setattr(queries, "view", lambda *_: df)
    best = queries.best_transform_per_pair(spark, "").first()
    assert best.num_points == best.inlier_count == len(grid) and best.type == "shift"


def test_nearest_among_more_than_one_image(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 40, (2100, 3)).astype(float), rng.integers(0, 40, (5100, 3)).astype(float)
    s, t = (spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "kp_id long, descriptor array<double>") for m in (a, b))
    got = {r.query_id: r[1:] for r in matching.two_nearest(s, t).collect()}
    for i, v in enumerate(a):
        d = np.sqrt(((v - b) ** 2).sum(-1))
        first, second = np.argsort(d, kind="stable")[:2]
        assert got[i] == (first, d[first], d[second])
    assert len(got) == len(a)


def test_mutual_neighbours_compare_blocks_once(spark):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 9, (60, 2)).astype(float), rng.integers(0, 9, (50, 2)).astype(float)
    s, t = (spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "kp_id long, descriptor array<double>") for m in (a, b))
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    there, back = d.argmin(1), d.argmin(0)
    found = matching.mutual_matches(s, t)
    assert {tuple(r) for r in found.collect()} == {(i, j, d[i, j]) for i, j in enumerate(there) if back[j] == i}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroupsIn") == 1


def test_match_json_of_a_large_pair_comes_in_parts(spark):
    grid = [(x, y) for x in range(50) for y in range(20)]
    df = pairs(spark, grid, [(x + 3, y + 4) for x, y in grid])
    df = df.union(df.limit(1).withColumn("pair_id", F.lit(None).cast("long")))
    rows = sinks.matches_json(df, 0.5, part=100).collect()
    texts = [json.loads(r.json) for r in rows if r.pair_id == 1]
    assert len({r.part for r in rows if r.pair_id == 1}) == len(texts) == 10 and {t["num_matches"] for t in texts} == {1000}
    assert max(len(t["matches"]) for t in texts) < 150 and sorted(m["match_id"] for t in texts for m in t["matches"]) == list(range(1000))
    assert [json.loads(r.json)["num_matches"] for r in rows if r.pair_id is None] == [1]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_robust_chain_reads_and_shuffles_once(spark):
    """Filter, fit and error summary of a pair: one scan, one exchange; the choice among a pair's few fits is another small one."""
    from rasterloom.plans import queries

    for name, exchanges in (("robust_shift_per_pair", 1), ("gross_outlier_filter", 1), ("best_transform_per_pair", 2)):
        text = plan_of(queries.QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert text.count("FileScan") == 1 and text.count("Exchange") == exchanges, name


def test_neighbours_within_image_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(pair, side, k, rng.normal(size=8).tolist()) for pair in (1, 2) for side in (0, 1) for k in range(30)]
    df = spark.createDataFrame([*rows, (3, 0, 1, [0.0] * 8), (4, 1, 1, [0.0] * 8)], "pair_id long, side int, kp_id long, descriptor array<double>")
    got = {(r.pair_id, r.query_id): r for r in matching.two_nearest(df.where("side = 0"), df.where("side = 1"), keys=["pair_id"]).collect()}
    assert len(got) == 60
    for pair, side, k, v in rows:
        if side == 0:
            d = sorted((float(np.linalg.norm(np.array(v) - w)), j) for p, s, j, w in rows if p == pair and s == 1)
            assert got[pair, k].train_id == d[0][1] and abs(got[pair, k].distance - d[0][0]) < 1e-9 and abs(got[pair, k].next_distance - d[1][0]) < 1e-9


def test_many_targets(spark):
    """Ten blocks of targets; equal descriptors go to the smallest id."""
    ids = spark.range(20_000)
    target = ids.select(F.col("id").alias("kp_id"), F.array(*((F.col("id") % m).cast("double") for m in (997, 89, 7))).alias("descriptor"))
    source = spark.createDataFrame([(1, [5.0, 5.0, 5.0]), (2, [996.0, 88.0, 6.0])], "kp_id long, descriptor array<double>")
    got = {r.query_id: r for r in matching.two_nearest(source, target).collect()}
    every = np.array([[i % 997, i % 89, i % 7] for i in range(20_000)], float)
    for r, v in ((got[1], [5, 5, 5]), (got[2], [996, 88, 6])):
        d = np.linalg.norm(every - v, axis=1)
        assert r.train_id == int(np.argmin(d)) and r.distance == d.min() and r.next_distance == np.sort(d)[1]


def test_area_and_cubic_resampling_equal_plain_sums(spark):
    rng = np.random.default_rng(6)
    image = rng.integers(0, 255, (45, 37)).astype(np.float32)
    p = spark.createDataFrame([(1, r, c, float(image[r, c])) for r in range(45) for c in range(37)], "raster_id long, row int, col int, value double")
    for step, start in ((2.6, -1.3), (1.0, 0.25), (7.5, 0.0), (0.4, -2.0)):
        y, x = grids.Axis(start, step, 45, 0, 20), grids.Axis(start / 2, step, 37, 0, 17)
        got = np.zeros((24, 24), np.float32)
        for r in grids.resample_tiles(raster.to_tiles(p, 8), 8, y, x).collect():
            got[r.ty * 8 : r.ty * 8 + 8, r.tx * 8 : r.tx * 8 + 8] = np.frombuffer(r.data, np.float32).reshape(8, 8)

        def row(axis, i):
            if axis.step >= 1:
                a, b = max(0, axis.start + i * axis.step), min(axis.size, axis.start + (i + 1) * axis.step)
                return [max(0, min(b, j + 1) - max(a, j)) / (b - a) if b > a else 0 for j in range(axis.size)]
            s = axis.start + (i + 0.5) * axis.step - 0.5
            out = [0.0] * axis.size
            for at in range(int(np.floor(s)) - 1, int(np.floor(s)) + 3) if -0.5 <= s <= axis.size - 0.5 else ():
                d = abs(s - at)
                out[min(max(at, 0), axis.size - 1)] += 1.5 * d**3 - 2.5 * d**2 + 1 if d < 1 else -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2
            return out

        want = np.array([row(y, i) for i in range(20)]) @ image @ np.array([row(x, i) for i in range(17)]).T
        assert np.allclose(got[:20, :17], want, atol=1e-3) and not got[20:].any() and not got[:, 17:].any()


def test_stretch_leaves_out_padding_and_what_is_not_finite(spark):
    p = [(1, r, c, 1000.0 + 10 * r + c) for r in range(5) for c in range(5)] + [(2, r, c, 7.0) for r in range(5) for c in range(5)]
    p[3] = (1, 0, 3, float("nan"))
    tiles = raster.to_tiles(spark.createDataFrame(p, "raster_id long, row int, col int, value double"), 4)
    by = {r.raster_id: (r.low, r.high) for r in grids.ends(tiles, 4, 5, 5).collect()}
    assert by == {1: (1000.0, 1044.0), 2: (7.0, 7.0)}
    got = {(r.raster_id, r.ty, r.tx): np.frombuffer(r.data, np.float32).reshape(4, 4) for r in grids.stretch_tiles(tiles, by).collect()}
    assert got[1, 0, 0][0, 1] == 5 and got[1, 0, 0][0, 3] == 0 and got[1, 1, 1][0, 0] == 255 and not got[2, 0, 0].any()


def test_a_local_bump_loses_no_pixel(spark):
    """A few pixels far away in the middle of a tile; the same picture as looking each pixel up."""
    image = np.arange(64 * 64, dtype=np.float32).reshape(64, 64)
    tiles = raster.to_tiles(spark.createDataFrame([(1, r, c, float(image[r, c])) for r in range(64) for c in range(64)], "raster_id long, row int, col int, value double"), 16)

    def bump(q):
        hit = (np.abs(q - [21, 38]) <= 1).all(1)
        return q + np.where(hit[:, None], [30.0, -30.5], 0)

    def scatter(q):
        return (q * 3000.0 + q**3) % 64 // 1

    for inverse in (bump, scatter, lambda q: q * np.nan, lambda q: q * 1e30):
        got = np.zeros((64, 64), np.float32)
        for r in raster.warp_tiles(tiles, inverse, 16, 64, 64, (64, 64), (1,)).collect():
            got[r.ty * 16 : r.ty * 16 + 16, r.tx * 16 : r.tx * 16 + 16] = np.frombuffer(r.data, np.float32).reshape(16, 16)
        y, x = np.mgrid[0:64, 0:64]
        s = inverse(np.c_[x.ravel(), y.ravel()].astype(float))
        want = np.zeros(64 * 64)
        for k, (sx, sy) in enumerate(s):
            if np.isfinite([sx, sy]).all() and 0 <= sx <= 63 and 0 <= sy <= 63:
                i, j = int(sy), int(sx)
                a, b = min(i + 1, 63), min(j + 1, 63)
                want[k] = (image[i, j] * (1 - sx % 1) + image[i, b] * (sx % 1)) * (1 - sy % 1) + (image[a, j] * (1 - sx % 1) + image[a, b] * (sx % 1)) * (sy % 1)
        edge = np.isfinite(s).all(1) & (((s < 0) & (s > -1)) | ((s > 63) & (s < 64))).any(1)
        assert np.allclose(got.ravel()[~edge], want[~edge], atol=1e-2)


def test_lattice_of_two_rasters(spark):
    cols = "rid long, width long, height long, a double, b double, c double, d double, e double, f double, left double, bottom double, right double, top double, epsg int"
    s = spark.createDataFrame([(1, 1000, 800, 0.02, 0.0, 100.0, 0.0, -0.02, 50.0, 100.0, 34.0, 120.0, 50.0, 32610)], cols)
    t = [(2, 100, 100, 0.19, 0.0, 105.0, 0.0, -0.19, 60.0, 105.0, 41.0, 124.0, 60.0, 32610), (3, 10, 10, 1.0, 0.0, 500.0, 0.0, -1.0, 60.0, 500.0, 50.0, 510.0, 60.0, 32610), (4, 10, 10, 1.0, 0.5, 100.0, 0.0, -1.0, 50.0, 100.0, 40.0, 110.0, 50.0, 32610), (5, 9, 9, 1.0, 0.0, 100.0, 0.0, -1.0, 50.0, 100.0, 41.0, 109.0, 50.0, 4326)]
    a, b = grids.pair_of(s, spark.createDataFrame(t, cols), ("rid", "rid"))
    got = {r.t_id: r for r in grids.common_lattice(a.crossJoin(b), 0.15).collect()}
    assert {k: r.problem for k, r in got.items()} == {2: None, 3: "no overlap", 4: "rotated", 5: "reference systems differ"}
    r = got[2]
    assert (r.lattice_width, r.lattice_height) == (150, 120) and (r.x0, r.x1, r.y0, r.y1) == (37, 150, 0, 68)
    for i in (0, 10, 77):
        assert abs(100 + i / 0.15 * 0.02 - (105 + (r.start_x + i * r.step_x) * 0.19)) < 1e-9 and abs(50 - i / 0.15 * 0.02 - (60 - (r.start_y + i * r.step_y) * 0.19)) < 1e-9


def keeper(folder):
    from rasterloom.plans.registration import kept_in

    count = iter(range(10_000))
    return lambda df, name: kept_in(str(folder))(df, f"{name}-{next(count)}")


def test_medians_of_split_groups(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(k, i, float(v)) for k, n in ((1, 3000), (2, 7), (3, 2), (4, 1), (5, 1200)) for i, v in enumerate(rng.normal(size=n).round(2) if k != 5 else [4.0] * n)] + [(6, 0, None), (None, 1, 2.0), (None, 2, 5.0)]
    df = spark.createDataFrame(rows, "pair_id long, match_id long, v double").repartition(7)
    got = {r.pair_id: r["median"] for r in split.group_medians(df, ["pair_id"], F.col("v"), keeper(tmp_path), F.col("match_id")).where("pair_id is not null").collect()}
    assert got == {k: float(np.median([v for p, _, v in rows if p == k])) for k in (1, 2, 3, 4, 5)}
    # The largest group is in several tasks.
    assert spark.read.parquet(f"{tmp_path}/ranked-0").where("pair_id = 1").select("_p").distinct().count() > 1


def test_split_shift_equals_the_window_form(spark, tmp_path):
    rng = np.random.default_rng(3)
    s = rng.uniform(0, 500, (900, 2))
    d = s + [3, -2] + rng.normal(0, 0.3, s.shape)
    d[::29] += 200
    df = pairs(spark, s.tolist(), d.tolist())
    keep = keeper(tmp_path)
    one = robust.fit_shift(robust.remove_gross_outliers(df)).first().asDict()
    two = split.fit_shift(split.remove_gross_outliers(df, keep), keep).first().asDict()
    assert one == pytest.approx(two)


@pytest.mark.parametrize("kind", ["similarity", "affine", "homography"])
def test_split_fits_equal_fits_of_one_task(spark, tmp_path, kind):
    rng = np.random.default_rng(4)
    s = rng.uniform(0, 800, (3000, 2))
    m = {"similarity": [[0.9, -0.2, 5], [0.2, 0.9, -7], [0, 0, 1]], "affine": [[0.9, -0.3, 5], [0.1, 1.1, -7], [0, 0, 1]], "homography": [[0.9, -0.3, 5], [0.1, 1.1, -7], [1e-4, -5e-5, 1]]}[kind]
    d = fits._project(np.array(m, float), s) + rng.normal(0, 0.5, s.shape)
    d[:600] += rng.uniform(-300, 300, (600, 2))
    df = pairs(spark, s.tolist(), d.tolist()).union(pairs(spark, [(1, 1), (2, 2)], [(1, 1), (2, 2)]).withColumn("pair_id", F.lit(2).cast("long")).limit(1))
    got = {r.pair_id: r for r in split.fit_matrix(df, kind, 3.0, keeper(tmp_path), chunk=400).collect()}
    one = fits.fit_one(kind, s, d, 3.0)
    inside = np.linalg.norm(fits._project(np.array(got[1].matrix).reshape(3, 3), s) - d, axis=1)
    assert np.abs(fits._project(np.array(got[1].matrix).reshape(3, 3), s) - fits._project(np.array(m, float), s)).max() < 0.3
    assert abs(got[1].inlier_count - one["inlier_count"]) < 15 and got[1].inlier_count == (inside <= 3).sum() and got[1].num_points == 3000
    kept = inside[inside <= 3]
    assert got[1].median_error == pytest.approx(np.median(kept)) and got[1].max_error == pytest.approx(kept.max()) and got[1].mean_error == pytest.approx(kept.mean(), abs=1e-5)
    assert got[2].error == "insufficient_points" and got[2].matrix is None


@pytest.mark.parametrize("kind", ["shift", "similarity", "affine", "polynomial_2"])
def test_the_chosen_type_is_the_planted_one(spark, kind):
    rng = np.random.default_rng(6)
    s = rng.uniform(0, 400, (300, 2))
    x, y = s.T
    d = {"shift": np.c_[x + 4, y - 9], "similarity": np.c_[0.98 * x - 0.1 * y + 4, 0.1 * x + 0.98 * y], "affine": np.c_[1.05 * x - 0.1 * y + 4, 0.02 * x + 0.9 * y], "polynomial_2": np.c_[x + 2e-4 * x * y, y - 1e-4 * x * x + 3]}[kind]
    d = d + rng.normal(0, 0.4, s.shape)
    df = pairs(spark, s.tolist(), d.tolist())
    assert fits.choose_best(fits.fit_all(df, fits.candidate_kinds(0.3), judge=True)).first()["type"] == kind
    assert "spline" not in fits.candidate_kinds(0.5) and "spline" not in fits.candidate_kinds()


def test_robust_fits_stop_when_they_have_seen_enough():
    rng = np.random.default_rng(8)
    s = rng.uniform(0, 400, (400, 2))
    d = s * 1.1 + 3
    d[:120] += rng.uniform(20, 200, (120, 2))
    m, inside = fits.ransac("affine", s, d, 1.0)
    assert inside.sum() == 280 and np.allclose(m, [[1.1, 0, 3], [0, 1.1, 3], [0, 0, 1]])


def test_inverted_lists_find_the_nearest(spark, monkeypatch):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("kp_id"), F.col("embedding").cast("array<double>").alias("descriptor"))
    monkeypatch.setattr(index, "PER_LIST", 40)  # 50 lists of these few rows
    monkeypatch.setattr(matching, "BLOCK", 30)  # lists in several blocks
    queries, rest = index.keys_of(e), e.where("kp_id % 50 <> 0")
    centroids = index.fit(rest)
    assert len(centroids) == 49
    exact = matching.two_nearest(queries, rest)
    assert index.recall(index.search(queries, rest, centroids), exact) >= 0.9
    whole = {r.query_id: (r.train_id, r.next_distance) for r in index.search(queries, rest, centroids, probes=49).collect()}
    assert whole == {r.query_id: (r.train_id, r.next_distance) for r in exact.collect()} and len(whole) == queries.count()
    assert index.search(queries, rest.limit(0)).count() == 0 and index.search(queries.limit(0), rest, centroids).count() == 0
    # Every row is in its lists.
    assert index.placed(rest, centroids, 2).select("kp_id").distinct().count() == rest.count()


def test_local_splines_are_the_spline_itself_for_few_points():
    rng = np.random.default_rng(1)
    s = rng.uniform(0, 500, (300, 2))
    d = np.c_[s[:, 0] + 8 * np.sin(s[:, 1] / 60), s[:, 1] + 5 * np.cos(s[:, 0] / 80)]
    at = rng.uniform(-20, 520, (500, 2))
    assert np.allclose(fits.LocalSplines(s, d)(at), fits.apply_thin_plate(at, s, *fits.spline_through(s, d)), atol=1e-6)


def test_local_splines_of_many_points_follow_the_map():
    rng = np.random.default_rng(2)
    bend = lambda p: np.c_[p[:, 0] + 8 * np.sin(p[:, 1] / 60), p[:, 1] + 5 * np.cos(p[:, 0] / 80)]
    s = rng.uniform(0, 2000, (9000, 2))
    began = time.process_time()
    spline = fits.LocalSplines(s, bend(s))
    at = rng.uniform(30, 1970, (4000, 2))
    assert np.abs(spline(at) - bend(at)).max() < 0.2 and np.abs(spline(at) - bend(at)).mean() < 0.005 and np.abs(spline(s) - bend(s)).max() < 1e-3
    assert time.process_time() - began < 120 and np.isfinite(spline(rng.uniform(-500, 3000, (500, 2)))).all()
    same = np.repeat([[5.0, 5.0], [9.0, 7.0]], 600, axis=0) + rng.normal(0, 1e-3, (1200, 2))  # two heaps of points
    assert np.isfinite(fits.LocalSplines(same, same + 3)(same)).all()


def test_split_shift_ranks_different_offsets_alone(spark, tmp_path):
    grid = [(float(x), float(y)) for x in range(60) for y in range(50)]
    df = pairs(spark, grid, [(x + 3 + x % 3 / 4, y - 2 + (300 if (x, y) == (0, 0) else 0)) for x, y in grid])
    keep, rows = keeper(tmp_path), []

    def counting(table, name):
        out = keep(table, name)
        rows.append(out.count())
        return out

    one, two = robust.fit_shift(robust.remove_gross_outliers(df)).first().asDict(), split.robust_shift(df, counting).first().asDict()
    assert one == pytest.approx(two) and max(rows) == 4
    three = split.fit_shift(split.remove_gross_outliers(df, counting), counting).first().asDict()
    assert one == pytest.approx(three) and max(rows) == 4


def test_homography_memory_grows_with_matches():
    import tracemalloc

    s = np.random.default_rng(5).uniform(0, 500, (2000, 2))
    tracemalloc.start()
    m = fits.solve("homography", s, s + [3, -2])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.abs(m - [[1, 0, 3], [0, 1, -2], [0, 0, 1]]).max() < 1e-6 and peak < 10e6


@pytest.mark.parametrize("kind", ["similarity", "affine", "homography"])
@pytest.mark.parametrize("wrong", [0, 90, 500])
def test_a_robust_fit_stops_at_a_sample_that_has_all_points(monkeypatch, kind, wrong):
    rng = np.random.default_rng(6)
    s = rng.uniform(0, 500, (600, 2))
    d = s + [3, -2] + rng.normal(0, 0.2, s.shape)
    d[:wrong] += rng.uniform(50, 90, (wrong, 2))
    made, through = [], fits.through
    monkeypatch.setattr(fits, "through", lambda k, a, b: made.append(len(a)) or through(k, a, b))
    m, inside = fits.ransac(kind, s, d, 30.0)
    few = sum(made)
    monkeypatch.setattr(fits, "FIRST", 100)
    whole, same = fits.ransac(kind, s, d, 30.0)
    assert (inside == same).all() and np.allclose(m, whole) and (wrong or few < 100)
