"""Column expressions for map tiles, geotransforms, UTM zones and units."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: WGS84, Web Mercator and degree lengths.
EQUATOR_M = 40075017.0
METRES_PER_DEGREE = 111320.0
TILE_PX = 256
#: Tile providers; Esri's has y before x.
TILE_URLS = {
    "esri": "https://server.arcgisonline.com/ArcGIS/rest/services/World_Imagery/MapServer/tile/%d/%d/%d",
    "google_satellite": "https://mt1.google.com/vt/lyrs=s&x=%d&y=%d&z=%d",
    "osm": "https://tile.openstreetmap.org/%d/%d/%d.png",
    "google_hybrid": "https://mt1.google.com/vt/lyrs=y&x=%d&y=%d&z=%d",
}
#: Names of providers, and whose addresses they are.
TILE_PROVIDERS = {"esri": "esri", "esri_world_imagery": "esri", "google_satellite": "google_satellite", "google_hybrid": "google_hybrid", "osm": "osm", "openstreetmap": "osm"}


def whole(x: Column) -> Column:
    """Towards zero."""
    return x.cast("int")


def tile_x(lon: Column, zoom: Column) -> Column:
    return whole((lon + 180.0) / 360.0 * F.pow(F.lit(2.0), zoom))


def tile_y(lat: Column, zoom: Column) -> Column:
    return whole((1.0 - F.asinh(F.tan(F.radians(lat))) / F.pi()) / 2.0 * F.pow(F.lit(2.0), zoom))


def tile_lon(x: Column, zoom: Column) -> Column:
    """Of the tile's left edge."""
    return x / F.pow(F.lit(2.0), zoom) * 360.0 - 180.0


def tile_lat(y: Column, zoom: Column) -> Column:
    """Of the tile's upper edge."""
    return F.degrees(F.atan(F.sinh(F.pi() * (1.0 - 2.0 * y / F.pow(F.lit(2.0), zoom)))))


def tile_url(source: Column, x: Column, y: Column, zoom: Column) -> Column:
    """Raises for a source that is unknown."""
    order = {"esri": (zoom, y, x), "osm": (zoom, x, y)}
    out = None
    for name, own in TILE_PROVIDERS.items():
        url = F.format_string(TILE_URLS[own], *order.get(own, (x, y, zoom)))
        out = F.when(source == name, url) if out is None else out.when(source == name, url)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown tile source: "), source)))


def ground_resolution(lat: Column, zoom: Column) -> Column:
    """Metres per pixel."""
    return EQUATOR_M / (TILE_PX * F.pow(F.lit(2.0), zoom)) * F.cos(F.radians(lat))


def zoom_for_resolution(lat: Column, metres: Column, low: int = 12, high: int = 19) -> Column:
    """The largest zoom from high down to low whose resolution is as fine as asked; if none is, the nearest."""
    zooms = F.sequence(F.lit(high), F.lit(low), F.lit(-1))
    fine = F.filter(zooms, lambda z: ground_resolution(lat, z) <= metres)
    nearest = F.array_min(F.transform(zooms, lambda z: F.struct(F.abs(ground_resolution(lat, z) - metres).alias("off"), z.alias("z"))))["z"]
    return F.when(F.size(fine) > 0, F.array_max(fine)).otherwise(nearest)


def zoom_for_area(width_deg: Column, height_deg: Column) -> Column:
    """By thresholds on the area in square degrees."""
    area = width_deg * height_deg
    return F.when(area < 0.0001, 16).when(area < 0.001, 15).when(area < 0.01, 13).when(area < 0.1, 11).otherwise(9)


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone, with the exceptions for Norway and Svalbard."""
    zone = whole((lon + 180.0) / 6.0) + 1
    zone = F.when((lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12), 32).otherwise(zone)
    svalbard = (lat >= 72) & (lat < 84)
    for west, east, number in ((0, 9, 31), (9, 21, 33), (21, 33, 35), (33, 42, 37)):
        zone = F.when(svalbard & (lon >= west) & (lon < east), number).otherwise(zone)
    return F.when(lat >= 0, 32600 + zone).otherwise(32700 + zone)


def world_to_pixel(x: Column, y: Column, a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> tuple[Column, Column]:
    """(column, row) by the inverse of the affine geotransform x = a col + b row + c, y = d col + e row + f."""
    det = a * e - b * d
    return (e * (x - c) - b * (y - f)) / det, (a * (y - f) - d * (x - c)) / det


def pixel_to_world(col: Column, row: Column, a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> tuple[Column, Column]:
    return a * col + b * row + c, d * col + e * row + f


def from_bounds(left: Column, bottom: Column, right: Column, top: Column, width: Column, height: Column) -> dict[str, Column]:
    """The geotransform of a raster without rotation that fills a rectangle."""
    return {"a": (right - left) / width, "b": F.lit(0.0), "c": left, "d": F.lit(0.0), "e": (bottom - top) / height, "f": top}


def bounding_box(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """min_lat, min_lon, max_lat, max_lon of the vertices (lon, lat) of each group's cells or polygons."""
    return points.groupBy(*keys).agg(F.min("lat").alias("min_lat"), F.min("lon").alias("min_lon"), F.max("lat").alias("max_lat"), F.max("lon").alias("max_lon"))


#: H3 base cells and those of them that are pentagons.
BASE_CELLS, PENTAGONS = 122, (4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117)


def valid_cell(cell: Column) -> Column:
    """Whether a text is an H3 cell: 15 hexadecimal digits with the mode of a cell, a base cell that exists, digits 0 to 6 up to its resolution and 7 beyond; a
    pentagon's first digit that is not 0 is not 1."""
    h = F.when(cell.rlike("^[0-9a-fA-F]{15}$"), F.conv(cell, 16, 10).cast("long"))
    at = lambda place, bits: F.shiftright(h, place).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    resolution, base = at(52, 4), at(45, 7)
    digits = [at(3 * (15 - i), 3) for i in range(1, 16)]
    fits = [F.when(resolution >= i, d < 7).otherwise(d == 7) for i, d in enumerate(digits, 1)]
    first = F.coalesce(*(F.when((d != 0) & (resolution >= i), d) for i, d in enumerate(digits, 1)), F.lit(0).cast("long"))
    good = (at(59, 5) == 1) & (base < BASE_CELLS) & ~(base.isin(*PENTAGONS) & (first == 1))
    for f in fits:
        good = good & f
    return F.coalesce(good, F.lit(False))


def metres_to_degrees(dx: Column, dy: Column, lat: Column) -> tuple[Column, Column]:
    return dx / (METRES_PER_DEGREE * F.cos(F.radians(lat))), dy / METRES_PER_DEGREE


def pixel_metres(epsg: Column, a: Column, top: Column, bottom: Column) -> Column:
    """Width of a pixel in metres: degrees at the raster's middle latitude, other systems as they are."""
    return F.abs(F.when(epsg == 4326, a * METRES_PER_DEGREE * F.cos(F.radians((top + bottom) / 2))).otherwise(a))


def geodesic_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on the WGS84 ellipsoid by Lambert's formula: to about 1e-5 of short and middle distances."""
    a, f = 6378137.0, 1 / 298.257223563
    b1, b2 = (F.atan((1 - f) * F.tan(F.radians(x))) for x in (lat1, lat2))
    h = F.pow(F.sin((b2 - b1) / 2), 2) + F.cos(b1) * F.cos(b2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    s = 2 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    x = (s - F.sin(s)) * F.pow(F.sin(p) * F.cos(q), 2) / F.greatest(1 - h, F.lit(1e-300))
    y = (s + F.sin(s)) * F.pow(F.cos(p) * F.sin(q), 2) / F.greatest(h, F.lit(1e-300))
    return F.when(h <= 0, 0.0).otherwise(a * (s - f / 2 * (x + y)))


def adaptive_ncc(scale: Column, patch: int = 64, grid: int = 32, gsd: float = 0.02, error_m: float = 3.0) -> dict[str, Column]:
    """Patch size, grid spacing and search margin for a scale."""
    res = gsd / scale
    err = whole(error_m / res)
    return {
        "res": res, "err_px": err, "patch": F.greatest(F.lit(patch), whole(patch / scale)), "spacing": F.greatest(F.lit(grid), whole(grid / scale)),
        "margin": F.greatest(F.lit(150), 3 * err),
    }


def format_bytes(n: Column) -> Column:
    out = F.format_string("%.1f TB", n / 1024.0**4)
    for unit, power in (("GB", 3), ("MB", 2), ("KB", 1), ("B", 0)):
        out = F.when(n < 1024.0 ** (power + 1), F.format_string(f"%.1f {unit}", n / 1024.0**power)).otherwise(out)
    return out


def resolution_class(ratio: Column) -> Column:
    return F.when(ratio > 10, "source much finer").when(ratio < 0.1, "source much coarser").otherwise("OK")


def safe_name(name: Column) -> Column:
    """Letters, digits, underscores and hyphens only, for file names."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "")
