import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom import __main__ as cli
from rasterloom.functions import projection
from rasterloom.operators import features, fits, matching, raster, robust, scalespace
from rasterloom.plans import registration
from rasterloom.sources import files, geotiff, sinks
from rasterloom.streaming import events

def meridian_m(lat, steps=200_000):
    """Length of the meridian from the equator on WGS84, by the midpoint rule."""
    a, f = 6378137.0, 1 / 298.257223563
    e2 = f * (2 - f)
    phi = (np.arange(steps) + 0.5) * np.radians(lat) / steps
    return float((a * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5).sum() * np.radians(lat) / steps)


SCHEMA = "raster_id long, row int, col int, value int"


def test_coarse_to_fine_recovers_a_shift(spark):
    rng = np.random.default_rng(5)
    base = np.kron(rng.integers(20, 250, (18, 18)), np.ones((4, 4), int))
    source = spark.createDataFrame([(1, r, c, int(base[r, c])) for r in range(64) for c in range(64)], SCHEMA)
    target = spark.createDataFrame([(1, r, c, int(base[r + 4, c + 2])) for r in range(64) for c in range(64)], SCHEMA)
    done, tiles = registration.register(source, target, [(0.5, "shift"), (1.0, "shift")])
    assert len(done.steps) == 2 and np.allclose(done.matrix[:2, 2], [-2, -4], atol=0.5)
    assert tiles.count() == 1


def test_plans():
    assert registration.default_plan([0.5, 0.1, 0.3]) == [(0.1, "shift"), (0.3, "shift"), (0.5, "homography")]
    assert registration.checked_plan([0.5, 0.1], ["affine", "shift"]) == [(0.1, "shift"), (0.5, "affine")]
    for bad in (([0.1], []), ([0.1], ["rubber"])):
        with pytest.raises(ValueError):
            registration.checked_plan(*bad)
    with pytest.raises(ValueError):
        registration.matcher("none")


def test_basemap_tiles(spark):
    box = (49.0, -123.5, 49.02, -123.46)
    zoom = registration.zoom_of_box(box)
    tiles = registration.tiles_of_box(spark, box, zoom)
    rows = tiles.collect()
    assert 1 <= len(rows) <= 64
    x, y = [r.x for r in rows], [r.y for r in rows]
    left, upper, right, lower = registration.mosaic_crop(min(x), min(y), max(x), max(y), zoom, box)
    assert 0 <= left < right <= 256 * (max(x) - min(x) + 1) and 0 <= upper < lower <= 256 * (max(y) - min(y) + 1)
    got = registration.fetch_tiles(tiles, lambda url: None if url.endswith("0.png") else b"x", retries=0).collect()
    assert all((r.data is None) == r.url.endswith("0.png") for r in got)


def test_utm(spark):
    e, n = projection.forward(F.lit(-123.0), F.lit(49.0), 32610, projection.columns)
    r = spark.range(1).select(e.alias("e"), n.alias("n")).first()
    assert abs(r.e - 500000) < 1e-3 and abs(r.n - 0.9996 * meridian_m(49.0)) < 1e-3


def test_diagnosis(spark):
    s = "struct<epsg:int,a:double,left:double,bottom:double,right:double,top:double>"
    df = spark.createDataFrame([((4326, 1.0, 0.0, 0.0, 1.0, 1.0), (4326, 1.0, 0.5, 0.0, 1.5, 1.0)), ((4326, 1.0, 0.0, 0.0, 1.0, 1.0), (32610, 50.0, 5.0, 0.0, 6.0, 1.0))], f"source {s}, target {s}")
    a, b = registration.diagnose(df).collect()
    assert a.issues == [] and a.overlap == 0.5 and b.issues == ["CRS differ", "no overlap", "resolutions differ"] and b.centre_distance == 5.0


def test_event_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"runId": "r", "message": "m", "timestamp": 60000}\n{"runId": "r", "message": "m", "timestamp": 61000}\n')
    q = events.windowed_counts(events.read_events(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counts").first().n == 2


@pytest.mark.parametrize("epsg,lon,lat", [(32610, -123.3, 49.2), (32734, 20.5, -30.2), (32632, 5.0, 60.0), (25832, 10.7, 48.1), (26910, -121.0, 37.5), (3857, 151.2, -33.9), (2154, 2.35, 48.85), (2154, -4.5, 42.5), (3034, 24.0, 61.0), (3347, -63.5, 46.2)])
def test_projections_there_and_back(spark, epsg, lon, lat):
    """Columns and arrays agree, and what comes back is within a tenth of a millimetre."""
    x, y = projection.forward(F.lit(lon), F.lit(lat), epsg, projection.columns)
    r = spark.range(1).select(x.alias("x"), y.alias("y")).select("x", "y", *(c.alias(n) for c, n in zip(projection.inverse(F.col("x"), F.col("y"), epsg, projection.columns), ("lon", "lat"), strict=True))).first()
    assert abs(r.lon - lon) < 1e-9 and abs(r.lat - lat) < 1e-9
    ax, ay = projection.forward(np.array([lon]), np.array([lat]), epsg)
    assert abs(ax[0] - r.x) < 1e-6 and abs(ay[0] - r.y) < 1e-6
    # A conformal map stretches alike in all directions.
    d = 1e-5
    here, east, north = (np.array(projection.forward(np.array([lon + i * d / np.cos(np.radians(lat))]), np.array([lat + j * d]), epsg))[:, 0] for i, j in ((0, 0), (1, 0), (0, 1)))
    assert abs(np.dot(east - here, north - here)) < 1e-4 * np.dot(north - here, north - here)


def test_known_places():
    assert np.allclose(projection.forward(3.0, 46.5, 2154), (700000, 6600000), atol=1e-3)  # the origins of the systems
    assert np.allclose(projection.forward(10.0, 52.0, 3034), (4000000, 2800000), atol=1e-3)
    assert np.allclose(projection.forward(180.0, 0.0, 3857), (20037508.342789, 0), atol=1e-5)
    assert not projection.known(4267) and projection.known(32760) and not projection.known(32761)
    with pytest.raises(ValueError, match="not known"):
        projection.forward(0.0, 0.0, 4267)


def test_corners_match_across_a_shift(spark):
    rng = np.random.default_rng(8)
    base = np.kron(rng.integers(20, 250, (24, 24)), np.ones((4, 4), int))
    source = spark.createDataFrame([(1, r, c, int(base[r, c])) for r in range(64) for c in range(64)], SCHEMA)
    target = spark.createDataFrame([(1, r, c, int(base[r + 3, c + 2])) for r in range(64) for c in range(64)], SCHEMA)
    from rasterloom.operators import features, raster

    a, b = raster.to_tiles(source, 64), raster.to_tiles(target, 64)
    found = features.compare_variants(a, b, 64).collect()
    raw = [m for m in found if m.method == "raw"]
    assert len(raw) > 10 and np.mean([(m.dst_x - m.src_x, m.dst_y - m.src_y) == (-2, -3) for m in raw]) > 0.9
    done, _ = registration.register(source, target, [(1.0, "shift")], registration.matcher("corners"))
    assert np.allclose(done.matrix[:2, 2], [-2, -3], atol=0.2)


def test_gcp_analysis(spark):
    r = spark.createDataFrame([(1, 400, 200, 0.001, 0.0, 10.0, 0.0, -0.001, 50.0, 10.0, 49.8, 10.4, 50.0)], "raster_id long, width long, height long, a double, b double, c double, d double, e double, f double, left double, bottom double, right double, top double")
    g = spark.createDataFrame([(1, 10.1, 49.9), (2, 99.0, 1.0)], "gcp_id long, lon double, lat double")
    placed, status = registration.analyse_gcps(g, r)
    assert placed.count() == 1 and {(x.status, x.n) for x in status.collect()} == {("success", 1), ("failed", 1)}


def test_reprojection_keeps_a_flat_image(spark):
    p = spark.createDataFrame([(1, r, c, 100) for r in range(32) for c in range(32)], SCHEMA)
    head = {"a": 0.0001, "b": 0.0, "c": -123.0, "d": 0.0, "e": -0.0001, "f": 49.0, "height": 32, "width": 32, "epsg": 4326}
    x, y = projection.forward(-123.0, 49.0, 32610)
    out = registration.reproject_tiles(raster.to_tiles(p, 16), 16, head, (10.0, 0.0, x + 30, 0.0, -10.0, y - 30), 32610, 16, 16).collect()
    assert len(out) == 1 and np.allclose(np.frombuffer(out[0].data, np.float32), 100, atol=1e-3)


@pytest.mark.parametrize("kind", ["polynomial_2", "polynomial_3", "spline"])
def test_curved_steps_are_applied(spark, kind):
    """A target that is the source moved by (2, 4), found by control points; a shift goes before and an affine step after."""
    rng = np.random.default_rng(5)
    base = np.kron(rng.integers(20, 250, (18, 18)), np.ones((4, 4), int))
    source = spark.createDataFrame([(1, r, c, int(base[r, c])) for r in range(64) for c in range(64)], SCHEMA)
    bend = {0.5: lambda x, y: (x + 1, y), 1.0: lambda x, y: (x + 2 + x * x / 400, y + 4 + x * y / 500), 2.0: lambda x, y: (x, y - 1)}

    def match(a, b, scale):
        at = [(x, y) for x in range(0, 64, 9) for y in range(0, 64, 9)]
        rows = [(1, i, *map(float, bend[scale](x, y)), float(x), float(y)) for i, (x, y) in enumerate(at)]
        return spark.createDataFrame(rows, "pair_id long, match_id long, src_x double, src_y double, dst_x double, dst_y double")

    done, tiles = registration.register(source, source, [(0.5, "shift"), (1.0, kind), (2.0, "affine")], match)
    assert [s.kind for s in done.steps] == ["shift", kind, "affine"] and done.matrix is None
    p = np.array([[18.0, 27.0], [36.0, 9.0]])
    expected = np.array([np.add(bend[1.0](x, y - 0.5), (2, 0)) for x, y in p])
    assert np.allclose(done.back(p), expected, atol=0.3 if kind == "spline" else 1e-6)
    got = np.frombuffer(tiles.first().data, np.float32).reshape(64, 64)
    x, y = done.back(np.array([[20.0, 30.0]]))[0]
    i, j = int(y), int(x)
    fy, fx = y - i, x - j
    assert got[30, 20] == pytest.approx((base[i, j] * (1 - fx) + base[i, j + 1] * fx) * (1 - fy) + (base[i + 1, j] * (1 - fx) + base[i + 1, j + 1] * fx) * fy, abs=0.01)


def test_polynomial_and_spline_are_applied(spark):
    """A quadratic map by its coefficients and by control points, against the image looked up directly."""
    y, x = np.mgrid[0:64, 0:64]
    rows = [(1, int(r), int(c), float(r * 2 + c)) for r, c in zip(y.ravel(), x.ravel(), strict=True)]
    tiles = raster.to_tiles(spark.createDataFrame(rows, "raster_id long, row int, col int, value double"), 16)
    grid = np.c_[x.ravel()[::7], y.ravel()[::7]].astype(float)
    there = np.c_[grid[:, 0] * 0.9 + 2, grid[:, 1] * 0.95 + 1 + 0.001 * grid[:, 0] ** 2]
    for kind in ("polynomial_2", "spline", "affine"):
        row = fits.fit_one(kind, *((grid, there) if kind != "affine" else (there, grid)), 5.0)
        got = {(r.row, r.col): r.value for r in registration.pixels_of(registration.apply_transform(tiles, row, 1.0, 16, 64, 64), 16).collect()}
        assert len(got) == 64 * 64
        for r, c in ((5, 9), (30, 40), (50, 20)):
            sx, sy = c * 0.9 + 2, r * 0.95 + 1 + 0.001 * c * c
            assert abs(got[r, c] - (2 * sy + sx)) < (0.2 if kind != "affine" else 4)


def test_matches_across_an_edge(spark):
    rng = np.random.default_rng(3)
    image = np.kron(rng.integers(20, 250, (40, 40)), np.ones((4, 4)))
    pixel = lambda a: spark.createDataFrame([(1, r, c, float(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])], "raster_id long, row int, col int, value double")
    source, target = features.keypoints(raster.to_tiles(pixel(image[:128, :128]), 64), 64), features.keypoints(raster.to_tiles(pixel(image[:128, 32:160]), 64), 64)
    wide = features.match_tiles(source, target, 0.75, 64, 40)
    assert wide.where("src_x >= 64 and dst_x < 64").count() > 0 == features.match_tiles(source, target, 0.75).where("src_x >= 64 and dst_x < 64").count()
    assert wide.where("abs(src_x - dst_x - 32) < 2 and abs(src_y - dst_y) < 2").count() >= 0.7 * wide.count() > 5


def test_reduced_tiles_equal_box_means(spark):
    p = spark.createDataFrame([(1, r, c, (r * 37 + c * 11) % 200) for r in range(64) for c in range(64)], "raster_id long, row int, col int, value int")
    got = {(r.row, r.col): r.value for r in registration.pixels_of(raster.reduce_tiles(raster.to_tiles(p, 16), 16, 4), 16).collect()}
    for r in raster.downsample_box(p, 4).collect():
        assert abs(got[r.row, r.col] - r.value) < 1e-3


def test_basemap_is_stitched_and_written(spark, tmp_path):
    box, zoom = (49.0, -123.5, 49.4, -122.9), 9
    color = {}

    def fetch(url):
        z, x, y = (int(v) for v in url.removesuffix(".png").split("/")[-3:])
        if (x + y) % 3 == 0:
            return None
        return sinks.png(np.full((256, 256, 3), ((x * 50) % 256, (y * 50) % 256, 7), np.uint8))

    color = {(r.x, r.y): None for r in registration.tiles_of_box(spark, box, zoom).collect()}
    assert len(color) > 1
    manifest = registration.download_basemap(spark, box, "osm", fetch, str(tmp_path), zoom).collect()
    xs, ys = [k[0] for k in color], [k[1] for k in color]
    left, upper, right, lower = registration.mosaic_crop(min(xs), min(ys), max(xs), max(ys), zoom, box)
    assert sum(m.height * m.width for m in manifest) == (lower - upper) * (right - left)
    for m in manifest:
        with geotiff.open_file(m.path) as f:
            tiff = geotiff.Tiff(f)
            part = tiff.window(0, m.height, 0, m.width)
            assert geotiff.geo_row("", tiff.tags)["epsg"] == 4326
        for r, c in ((0, 0), (m.height - 1, m.width - 1), (m.height // 2, m.width // 3)):
            x, y = min(xs) + (left + m.x0 + c) // 256, min(ys) + (upper + m.y0 + r) // 256
            assert part[:, r, c].tolist() == ([128] * 3 if (x + y) % 3 == 0 else [(x * 50) % 256, (y * 50) % 256, 7])


def picture(seed, n, step=6):
    """A smooth random picture of n x n pixels as a function of place."""
    rng = np.random.default_rng(seed)
    grid = rng.integers(0, 255, (n // step + 8, n // step + 8)).astype(float)

    def at(x, y):
        u, v = np.clip(x / step + 2, 0, grid.shape[1] - 2.001), np.clip(y / step + 2, 0, grid.shape[0] - 2.001)
        i, j = np.floor(v).astype(int), np.floor(u).astype(int)
        fv, fu = v - i, u - j
        fv, fu = fv * fv * (3 - 2 * fv), fu * fu * (3 - 2 * fu)
        return (grid[i, j] * (1 - fu) + grid[i, j + 1] * fu) * (1 - fv) + (grid[i + 1, j] * (1 - fu) + grid[i + 1, j + 1] * fu) * fv

    return at


def tiles_of(spark, image, tile):
    h, w = image.shape
    rows = []
    for ty in range(-(-h // tile)):
        for tx in range(-(-w // tile)):
            a = np.zeros((tile, tile), np.float32)
            part = image[ty * tile : (ty + 1) * tile, tx * tile : (tx + 1) * tile]
            a[: part.shape[0], : part.shape[1]] = part
            rows.append((1, ty, tx, a.tobytes()))
    return spark.createDataFrame(rows, "raster_id long, ty int, tx int, data binary")


@pytest.mark.parametrize("kind", ["sift", "orb"])
def test_keypoints_do_not_depend_on_tiles(spark, kind):
    y, x = np.mgrid[0:150, 0:170]
    image = np.rint(picture(4, 170)(x, y))
    found = [{(round(r.x, 6), round(r.y, 6), round(r.angle, 6), tuple(r.descriptor)) for r in scalespace.keypoints(tiles_of(spark, image, tile), tile, 150, 170, kind).collect()} for tile in (256, 64)]
    assert len(found[0]) > 30 and found[0] == found[1]


@pytest.mark.parametrize("kind,metric,turn,size", [("sift", "l2", 30, 1.0), ("sift", "l2", 0, 1.5), ("orb", "hamming", 30, 1.0), ("orb", "hamming", 0, 1.44)])
def test_matches_under_rotation_and_scale(spark, kind, metric, turn, size):
    y, x = np.mgrid[0:220, 0:220].astype(float)
    at, t = picture(9, 220, 9), np.radians(turn)
    m = np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]]) / size
    moved = np.einsum("ij,jyx->iyx", m, np.stack([x - 110, y - 110])) + 110
    a, b = (scalespace.keypoints(tiles_of(spark, np.rint(v), 256), 256, 220, 220, kind) for v in (at(moved[0], moved[1]), at(x, y)))
    rows = matching.with_keypoints(matching.ratio_matches(a, b, 0.8, metric), a, b).collect()
    away = [np.hypot(*(m @ [r.src_x - 110, r.src_y - 110] + 110 - [r.dst_x, r.dst_y])) for r in rows]
    assert len(rows) >= 15 and np.mean(np.array(away) < 3) > 0.8


@pytest.mark.parametrize("name", ["sift", "orb"])
def test_registration_by_keypoints(spark, name):
    y, x = np.mgrid[0:160, 0:160].astype(float)
    at = picture(3, 160, 7)
    pixels = lambda a: spark.createDataFrame([(1, r, c, int(a[r, c])) for r in range(160) for c in range(160)], SCHEMA)
    done, _ = registration.register(pixels(at(x, y)), pixels(at(x + 5, y - 3)), [(1.0, "shift")], registration.matcher(name, tile=160), tile=160)
    assert np.allclose(done.matrix[:2, 2], [-5, 3], atol=0.6)


def test_two_rasters_of_different_grids_register(spark, tmp_path, capsys):
    """A colour source of 0.02 m and a coarser target, elsewhere, of 16 bits; the source is 0.5 m off to the east and 0.3 m to the south."""
    at = [picture(k, 1100, 24) for k in (1, 2, 3)]
    x, y = np.meshgrid((np.arange(900) + 0.5) * 0.02, 50 - (np.arange(700) + 0.5) * 0.02)
    source = np.stack([f((x - 0.5) * 50, (50 - (y + 0.3)) * 50) for f in at])
    u, v = np.meshgrid(2 + (np.arange(180) + 0.5) * 0.07, 49 - (np.arange(150) + 0.5) * 0.07)
    target = np.stack([f(u * 50, (50 - v) * 50) for f in at])
    (tmp_path / "s.tif").write_bytes(geotiff.encode(np.rint(source).astype(np.uint8), (0.02, 0, 0.0, 0, -0.02, 50.0), 32610, 128))
    (tmp_path / "t.tif").write_bytes(sinks.geotiff(np.clip(target, 0, 255).astype(np.uint8), (0.07, 0, 2.0, 0, -0.07, 49.0), 32610))
    config = {"source_path": f"{tmp_path}/s.tif", "target_path": f"{tmp_path}/t.tif", "output_dir": f"{tmp_path}/out", "hierarchical_scales": [0.15, 0.3, 0.5], "algorithms": ["shift", "shift", "shift"], "method": "patch_ncc", "patch_size": 32, "patch_grid_spacing": 24, "search_margin": 8, "verbose": True, "_note": "x"}
    (tmp_path / "c.json").write_text(json.dumps(config))
    (tmp_path / "p.csv").write_text("Label,X,Y,Z,Accuracy,Enabled\na,5,45,1,0.1,1\nb,9,40,,,1\n")
    cli.main(["register", "--config", f"{tmp_path}/c.json", "--tile", "256", "--gcp-analysis", f"{tmp_path}/p.csv", "--gcp-evaluation", f"{tmp_path}/p.csv"])
    run = capsys.readouterr().out.strip().splitlines()[-1].removeprefix("file:")
    steps = json.loads(open(f"{run}/steps.json").read())
    assert [s["scale"] for s in steps] == [0.15, 0.3, 0.5] and steps[0]["matrix_meters"][2] == pytest.approx(steps[0]["matrix"][2] * 0.02 / 0.15)
    moved = np.sum([np.array(s["matrix_meters"])[[2, 5]] for s in steps], axis=0) / 0.02
    assert np.allclose(moved, [-25, -15], atol=1.0)
    manifest = spark.read.parquet(f"{run}/registered/manifest").collect()
    image = np.zeros((3, 700, 900), np.uint8)
    for m in manifest:
        with geotiff.open_file(m.path) as f:
            image[:, m.y0 : m.y0 + m.height, m.x0 : m.x0 + m.width] = geotiff.Tiff(f).window(0, m.height, 0, m.width)
    want = np.stack([f(x * 50, (50 - y) * 50) for f in at])
    error = np.abs(image[:, 100:600, 100:800].astype(float) - want[:, 100:600, 100:800])
    assert error.mean() < 12 and len({image[k].tobytes() for k in range(3)}) == 3
    assert {f"transform_scale{s:.3f}.json" for s in (0.15, 0.3, 0.5)} <= set(os.listdir(run)) and len(os.listdir(f"{run}/gcp_analysis")) == 2
    again = files.read_steps(spark, f"{run}/transform_scale*.json")
    assert [s["scale"] for s in again] == [0.15, 0.3, 0.5] and again[1]["matrix"] == steps[1]["matrix"]


@pytest.mark.parametrize("kind", ["shift", "affine", "polynomial_2"])
def test_the_type_that_makes_the_next_scale_match_is_chosen(spark, tmp_path, kind):
    """A matcher that knows the map: after the right type the next scale's offsets are noise."""
    flat = {(x, y) for x in range(0, 60, 4) for y in range(0, 60, 4)}
    rng = np.random.default_rng(3)
    p = np.array(sorted(flat), float)
    x, y = p.T
    d = {"shift": np.c_[x + 4, y - 3], "affine": np.c_[1.05 * x - 0.08 * y + 2, 0.03 * x + 0.93 * y + 3], "polynomial_2": np.c_[x + 2e-3 * x * y, y - 2e-3 * x * x + 3]}[kind]
    rows = lambda a, b: spark.createDataFrame([(1, i, *map(float, u), *map(float, v)) for i, (u, v) in enumerate(zip(a, b, strict=True))], "pair_id long, match_id long, src_x double, src_y double, dst_x double, dst_y double")
    asked = []

    def rematch(step):
        asked.append(step.kind)
        moved = fits._project(step.matrix, p) if step.matrix is not None else None
        if moved is None:  # the step looks up the source of each target place
            found = step.back(d)
            return rows(d + (p - found) + rng.normal(0, 0.05, p.shape), d)
        return rows(moved + rng.normal(0, 0.05, p.shape), d)

    step, report = registration.process_scale_level(rows(p + rng.normal(0, 0.05, p.shape), d), 1.0, 1.0, registration.Registration(), rematch)
    assert step.kind == kind and "spline" not in asked and len(asked) >= 5
    assert {r.type for r in report.select("type").distinct().collect()} == set(asked) and report.groupBy("type").agg(F.sum("n").alias("n")).where(f"n <> {len(p)}").count() == 0
    alone, none = registration.process_scale_level(rows(p + rng.normal(0, 0.05, p.shape), d), 1.0, None, registration.Registration(), None)
    assert alone.kind[:10] == kind[:10] and none is None  # the inverse of a square is no square


def test_registration_tries_all_types(spark, tmp_path):
    y, x = np.mgrid[0:96, 0:96].astype(float)
    at = picture(12, 110, 7)
    pixels = lambda a: spark.createDataFrame([(1, r, c, int(a[r, c])) for r in range(96) for c in range(96)], SCHEMA)
    tiles = [raster.to_tiles(pixels(a), 96) for a in (at(x, y), at(x + 3, y - 2))]
    done, _ = registration.register_tiles(*tiles, 96, 96, 96, [(0.5, "auto"), (1.0, "auto")], registration.ncc_matcher(16, 12, 6, 0.6), registration.kept_in(str(tmp_path)))
    assert len(done.steps) == 2 and np.allclose(fits._project(done.matrix, np.array([[48.0, 48.0]])), [[45, 50]], atol=0.6)
    assert any(f.startswith("histograms") for f in os.listdir(tmp_path))


def test_other_inputs_are_refused_or_stretched(spark, tmp_path):
    flat = np.full((3, 20, 20), 9, np.uint8)
    for k, (transform, epsg) in enumerate([((1, 0, 0, 0, -1, 20), 32610), ((1, 0, 500, 0, -1, 20), 32610), ((1, 0, 0, 0, -1, 20), 4326)]):
        (tmp_path / f"r{k}.tif").write_bytes(sinks.geotiff(flat, transform, epsg))
    opened = [registration.open_raster(spark, f"{tmp_path}/r{k}.tif", 16) for k in range(3)]
    for other, why in ((1, "no overlap"), (2, "reference systems differ")):
        with pytest.raises(ValueError, match=why):
            registration.lattices(opened[0], opened[other], [0.5])
    with pytest.raises(ValueError, match="several"):
        registration.open_raster(spark, f"{tmp_path}/*.tif", 16)
    wide = registration.Raster({"kind": "u2", "height": 2, "width": 2, "bands": 2}, tiles_of(spark, np.array([[100.0, 300.0], [200.0, 500.0]]), 4))
    assert np.frombuffer(registration.eight_bit(wide, 4, True).first().data, np.float32).reshape(4, 4)[:2, :2].tolist() == [[0, 127], [63, 255]]
    assert geotiff.sound({"a": 0.0, "b": 0.0, "d": 0.0, "e": 0.0, "left": 5.0, "bottom": 1.0, "right": 9.0, "top": 3.0, "width": 4, "height": 4})["a"] == 1.0


def test_reprojected_file_keeps_its_place(spark, tmp_path):
    y, x = np.mgrid[0:60, 0:80]
    image = np.stack([x * 3, y * 4, x + y]).astype(np.uint8)
    (tmp_path / "d.tif").write_bytes(sinks.geotiff(image, (0.0001, 0, -123.0, 0, -0.0001, 49.3), 4326))
    cli.main(["reproject", f"{tmp_path}/d.tif", f"{tmp_path}/utm"])
    r = registration.open_raster(spark, f"{tmp_path}/utm/d/*.tif", 64)
    assert r.head["epsg"] == 32610
    lon, lat = projection.inverse(np.array([r.head["c"] + 30.5 * r.head["a"]]), np.array([r.head["f"] + 25.5 * r.head["e"]]), 32610)
    cli.main(["reproject", f"{tmp_path}/utm/d/*.tif", f"{tmp_path}/web", "--epsg", "3857"])
    assert registration.open_raster(spark, f"{tmp_path}/web/*/*.tif", 64).head["epsg"] == 3857
    tile = {t.raster_id: np.frombuffer(t.data, np.float32).reshape(64, 64) for t in r.tiles.where("ty = 0 and tx = 0").collect()}
    assert abs(tile[1][25, 30] - ((lon[0] + 123) / 0.0001 - 0.5) * 3) < 3 and abs(tile[2][25, 30] - ((49.3 - lat[0]) / 0.0001 - 0.5) * 4) < 4


def test_command_line(spark, tmp_path, capsys):
    rng = np.random.default_rng(9)
    image = np.kron(rng.integers(20, 250, (32, 32)), np.ones((4, 4))).astype(np.uint8)
    moved = np.roll(image, (2, 3), axis=(0, 1))
    transform = (0.001, 0.0, -123.0, 0.0, -0.001, 49.2)
    for name, a in (("s", image), ("t", moved)):
        (tmp_path / f"{name}.tif").write_bytes(geotiff.encode(a[None].repeat(3, 0), transform, 4326, 32))
    cli.main(["register", f"{tmp_path}/s.tif", f"{tmp_path}/t.tif", f"{tmp_path}/out", "--scales", "1", "--algorithms", "shift", "--matcher", "patch_ncc", "--tile", "64", "--patch", "16", "--spacing", "16", "--margin", "6"])
    run = capsys.readouterr().out.strip().splitlines()[-1].removeprefix("file:")
    steps = json.loads(open(f"{run}/steps.json").read())
    assert [round(steps[0]["matrix"][k]) for k in (2, 5)] == [3, 2] and "SimpleSource" in open(f"{run}/registered/registered.vrt").read()
    (tmp_path / "p.csv").write_text("Label,X,Y,Z,Accuracy,Enabled\na,-122.95,49.15,1,0.1,1\nb,-122.9,49.1,,,1\nc,10,10,,,1\n")
    cli.main(["evaluate", f"{tmp_path}/s.tif", f"{tmp_path}/p.csv", f"{run}/steps.json", f"{tmp_path}/eval"])
    lines = [json.loads(x) for x in capsys.readouterr().out.strip().splitlines()]
    assert [(r["step"], r["n"]) for r in lines] == [(0, 2), (1, 2)] and lines[0]["mean_error"] == 0 and abs(lines[1]["mean_error"] - 0.001 * 13**0.5) < 3e-4
    cli.main(["headers", f"{tmp_path}/*.tif"])
    assert len(capsys.readouterr().out.strip().splitlines()) == 2


def test_methods_and_variants_are_compared(spark):
    y, x = np.mgrid[0:96, 0:96].astype(float)
    at = picture(5, 120, 6)
    pixels = lambda a: spark.createDataFrame([(1, r, c, int(a[r, c])) for r in range(96) for c in range(96)], SCHEMA)
    source, target = pixels(at(x, y)), pixels(at(x + 4, y - 2))
    both = registration.run_methods(source, target, 1.0, {"patch_ncc": registration.ncc_matcher(16, 12, 8), "corners": registration.corner_matcher(96)})
    board = {r.method: r for r in robust.leaderboard(both).collect()}
    assert set(board) == {"patch_ncc", "corners"} and sum(r.is_best for r in board.values()) == 1
    found = registration.compare_patch_variants(raster.to_tiles(source, 96), raster.to_tiles(target, 96), 96, registration.ncc_matcher(16, 12, 8)).collect()
    for name in features.VARIANTS:
        own = [m for m in found if m.method == name]
        assert len(own) > 10 and np.mean([abs(m.dst_x - m.src_x + 4) < 1.5 and abs(m.dst_y - m.src_y - 2) < 1.5 for m in own]) > 0.8, name
    a, b, links = features.renumbered(both)
    assert a.count() == both.select("src_x", "src_y").distinct().count() and links.count() == both.count() and set(b.columns) == {"pair_id", "kp_id", "x", "y"}


def test_a_transform_file_serves_pixels_of_any_size():
    record = sinks.transform_record({"type": "homography", "matrix": [1.1, 0.2, 30.0, -0.1, 0.9, 6.0, 1e-4, 2e-4, 1.0], "median_error": 2.0}, 0.5, 0.1)
    assert record["pixel_resolution_meters"] == 0.2 and record["median_error_meters"] == 0.4 and record["matrix_meters"][2] == 6.0
    m = np.array(registration.matrix_at(record, 0.05)).reshape(3, 3)
    p = np.array([[10.0, 20.0]])
    assert np.allclose(fits._project(m, p * 4), fits._project(np.array(record["matrix"]).reshape(3, 3), p) * 4)
    assert np.allclose(registration.matrix_at({k: v for k, v in record.items() if k != "matrix_meters"}, 0.05), m.ravel()) and registration.matrix_at({}, 1.0) is None
