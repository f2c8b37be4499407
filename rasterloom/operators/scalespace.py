"""Keypoints with scale and direction: differences of Gaussians with gradient histograms, and corners with rotated binary tests.

A task has one tile and a margin of its neighbours, wide enough for all that a keypoint of the tile looks at; levels of
smaller scale lie on a lattice of the whole raster. So a keypoint is the same however the raster is cut
into tiles. Beyond the raster its edge pixels repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.operators import grids

#: Fixed values of the detector: steps an octave, first blur, contrast and edge limits, histogram sizes.
STEPS, BLUR, CONTRAST, EDGE, BINS, PEAK, CLIP = 3, 1.6, 0.04, 10.0, 36, 0.8, 0.2
OCTAVES = 3
#: Levels of corners and the ratio of their scales; radius of the disc that gives a corner its direction, bits of its descriptor.
LEVELS, RATIO, DISC, BITS = 8, 1.2, 15, 256
ROW = "raster_id long, ty int, tx int, kp_id long, x double, y double, size double, angle double, response double, descriptor array<{}>"


def with_margin(tiles: DataFrame, tile: int, margin: int) -> DataFrame:
    """(raster_id, ty, tx, data): float32 bytes of tile + 2 margin values a side, 0 where there is no tile. Each tile sends strips to those that its pixels border."""
    reach = -(-margin // tile)

    def strips(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                a = np.frombuffer(r.data, np.float32).reshape(tile, tile)
                for dy in range(-reach, reach + 1):
                    for dx in range(-reach, reach + 1):
                        # The part of this tile in the frame of the tile at (ty + dy, tx + dx).
                        y0, x0 = max(0, dy * tile - margin), max(0, dx * tile - margin)
                        y1, x1 = min(tile, (dy + 1) * tile + margin), min(tile, (dx + 1) * tile + margin)
                        if y0 < y1 and x0 < x1:
                            rows.append((r.raster_id, r.ty + dy, r.tx + dx, y0 - dy * tile + margin, x0 - dx * tile + margin, y1 - y0, x1 - x0, dy == 0 and dx == 0, a[y0:y1, x0:x1].tobytes()))
            yield pd.DataFrame(rows, columns=["raster_id", "ty", "tx", "y", "x", "h", "w", "own", "part"])

    def join(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        if not g["own"].any():
            return pd.DataFrame(columns=["raster_id", "ty", "tx", "data"])
        out = np.zeros((tile + 2 * margin,) * 2, np.float32)
        for r in g.itertuples():
            out[r.y : r.y + r.h, r.x : r.x + r.w] = np.frombuffer(r.part, np.float32).reshape(r.h, r.w)
        return pd.DataFrame({"raster_id": [key[0]], "ty": [key[1]], "tx": [key[2]], "data": [out.tobytes()]})

    parts = tiles.select("raster_id", "ty", "tx", "data").mapInPandas(strips, "raster_id long, ty int, tx int, y int, x int, h int, w int, own boolean, part binary")
    return parts.groupBy("raster_id", "ty", "tx").applyInPandas(join, "raster_id long, ty int, tx int, data binary")


def blurred(a: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur within four sigma; the same sums at every place."""
    r = max(1, int(np.ceil(4 * sigma)))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        p = np.pad(a, [(r, r) if i == axis else (0, 0) for i in (0, 1)], mode="edge")
        n = a.shape[axis]
        a = sum(w * (p[i : i + n] if axis == 0 else p[:, i : i + n]) for i, w in enumerate(k))
    return a


def _framed(data: bytes, side: int, top: int, left: int, height: int, width: int) -> np.ndarray:
    """A tile with its margin, whose first pixel is (top, left) of the raster; beyond the raster its edge pixels repeat."""
    a = np.frombuffer(data, np.float32).reshape(side, side).astype(float)
    y, x = np.clip(np.arange(side), -top, height - 1 - top), np.clip(np.arange(side), -left, width - 1 - left)
    return a[np.clip(y, 0, side - 1)][:, np.clip(x, 0, side - 1)]


# --- differences of Gaussians ---


def sift_margin() -> int:
    """Pixels that the largest descriptor, and the blurs under it, look at beyond a keypoint; a multiple of the coarsest octave's pixel."""
    largest = BLUR * 2 ** (OCTAVES - 1) * 2 ** ((STEPS + 0.5) / STEPS)
    need = 3 * largest * np.sqrt(2) * 2.5 + 4 * BLUR * 2**OCTAVES * 2 + 2**OCTAVES * 4
    return int(np.ceil(need / 2**OCTAVES)) * 2**OCTAVES


def _pyramid(image: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Gaussians and their differences of each octave."""
    base = blurred(image, np.sqrt(BLUR**2 - 0.5**2))
    for _ in range(OCTAVES):
        levels = [base]
        for s in range(1, STEPS + 3):
            before, after = BLUR * 2 ** ((s - 1) / STEPS), BLUR * 2 ** (s / STEPS)
            levels.append(blurred(levels[-1], np.sqrt(after**2 - before**2)))
        g = np.stack(levels)
        yield g, g[1:] - g[:-1]
        base = g[STEPS][::2, ::2]


def _extrema(d: np.ndarray) -> np.ndarray:
    """(level, y, x) of values beyond all 26 around them, the first in order of place among equals."""
    mid = d[1:-1, 1:-1, 1:-1]
    high, low = mid > 0.5 * CONTRAST / STEPS * 255, mid < -0.5 * CONTRAST / STEPS * 255
    for ds in (0, 1, 2):
        for dy in (0, 1, 2):
            for dx in (0, 1, 2):
                if (ds, dy, dx) != (1, 1, 1):
                    near = d[ds : ds + mid.shape[0], dy : dy + mid.shape[1], dx : dx + mid.shape[2]]
                    first = (ds, dy, dx) < (1, 1, 1)
                    high &= (mid > near) if first else (mid >= near)
                    low &= (mid < near) if first else (mid <= near)
    return np.argwhere(high | low) + 1


def _refined(d: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the fitted parabola's peak, its value, and which of them hold: near, of contrast, no edge."""
    s, y, x = at.T
    v = lambda a, b, c: d[s + a, y + b, x + c]
    grad = np.stack([v(1, 0, 0) - v(-1, 0, 0), v(0, 1, 0) - v(0, -1, 0), v(0, 0, 1) - v(0, 0, -1)], 1) / 2
    ss, yy, xx = v(1, 0, 0) + v(-1, 0, 0) - 2 * v(0, 0, 0), v(0, 1, 0) + v(0, -1, 0) - 2 * v(0, 0, 0), v(0, 0, 1) + v(0, 0, -1) - 2 * v(0, 0, 0)
    sy = (v(1, 1, 0) - v(1, -1, 0) - v(-1, 1, 0) + v(-1, -1, 0)) / 4
    sx = (v(1, 0, 1) - v(1, 0, -1) - v(-1, 0, 1) + v(-1, 0, -1)) / 4
    yx = (v(0, 1, 1) - v(0, 1, -1) - v(0, -1, 1) + v(0, -1, -1)) / 4
    hess = np.stack([np.stack([ss, sy, sx], 1), np.stack([sy, yy, yx], 1), np.stack([sx, yx, xx], 1)], 1)
    det = np.abs(np.linalg.det(hess))
    ok = det > 1e-9
    off = np.zeros_like(grad)
    off[ok] = -np.linalg.solve(hess[ok], grad[ok][:, :, None])[:, :, 0]
    value = v(0, 0, 0) + 0.5 * (grad * off).sum(1)
    tr, flat = yy + xx, yy * xx - yx * yx
    ok &= (np.abs(off) < 1.0).all(1) & (np.abs(value) * STEPS >= CONTRAST * 255) & (flat > 0) & (tr * tr * EDGE < (EDGE + 1) ** 2 * flat)
    return at + off, value, ok


def _directions(g: np.ndarray, y: float, x: float, sigma: float) -> list[float]:
    """Directions, in radians, of the peaks of the gradients' histogram around a place."""
    r = int(round(4.5 * sigma))
    iy, ix = int(round(y)), int(round(x))
    a = g[iy - r - 1 : iy + r + 2, ix - r - 1 : ix + r + 2]
    if a.shape != (2 * r + 3, 2 * r + 3):
        return []
    gy, gx = (a[2:, 1:-1] - a[:-2, 1:-1]), (a[1:-1, 2:] - a[1:-1, :-2])
    yy, xx = np.mgrid[-r : r + 1, -r : r + 1]
    w = np.hypot(gy, gx) * np.exp(-(yy**2 + xx**2) / (2 * (1.5 * sigma) ** 2))
    k = np.rint(np.arctan2(gy, gx) / (2 * np.pi) * BINS).astype(int) % BINS
    h = np.bincount(k.ravel(), w.ravel(), BINS)
    h = (6 * h + 4 * (np.roll(h, 1) + np.roll(h, -1)) + np.roll(h, 2) + np.roll(h, -2)) / 16
    left, right = np.roll(h, 1), np.roll(h, -1)
    peaks = np.flatnonzero((h > left) & (h > right) & (h >= PEAK * h.max()))
    return [float((p + 0.5 * (left[p] - right[p]) / (left[p] - 2 * h[p] + right[p])) % BINS * 2 * np.pi / BINS) for p in peaks]


def _gradient_histograms(g: np.ndarray, y: float, x: float, sigma: float, angle: float) -> np.ndarray | None:
    """128 values: gradients in 4 x 4 cells and 8 directions, turned by the angle, each shared between neighbours."""
    cell = 3 * sigma
    r = int(round(cell * np.sqrt(2) * 2.5))
    iy, ix = int(round(y)), int(round(x))
    a = g[iy - r - 1 : iy + r + 2, ix - r - 1 : ix + r + 2]
    if a.shape != (2 * r + 3, 2 * r + 3):
        return None
    gy, gx = (a[2:, 1:-1] - a[:-2, 1:-1]), (a[1:-1, 2:] - a[1:-1, :-2])
    yy, xx = np.mgrid[-r : r + 1, -r : r + 1]
    yy, xx = yy + iy - y, xx + ix - x
    c, s = np.cos(angle) / cell, np.sin(angle) / cell
    u, v = c * xx + s * yy, -s * xx + c * yy
    bu, bv, bo = u + 1.5, v + 1.5, (np.arctan2(gy, gx) - angle) % (2 * np.pi) * 8 / (2 * np.pi)
    w = np.hypot(gy, gx) * np.exp(-(u * u + v * v) / 8)
    ok = (bu > -1) & (bu < 4) & (bv > -1) & (bv < 4)
    bu, bv, bo, w = bu[ok], bv[ok], bo[ok], w[ok]
    fu, fv, fo = np.floor(bu).astype(int), np.floor(bv).astype(int), np.floor(bo).astype(int)
    out = np.zeros(6 * 6 * 8)
    for du in (0, 1):
        for dv in (0, 1):
            for do in (0, 1):
                share = w * np.abs(1 - du - (bu - fu)) * np.abs(1 - dv - (bv - fv)) * np.abs(1 - do - (bo - fo))
                out += np.bincount(((fv + dv + 1) * 6 + fu + du + 1) * 8 + (fo + do) % 8, share, len(out))
    d = out.reshape(6, 6, 8)[1:5, 1:5].ravel()
    n = np.linalg.norm(d)
    if n < 1e-9:
        return None
    d = np.minimum(d / n, CLIP)
    return np.minimum(np.rint(d / np.linalg.norm(d) * 512), 255)


def _sift(image: np.ndarray, margin: int, tile: int, top: int, left: int, height: int, width: int) -> list[tuple]:
    """(x, y, size, angle, response, descriptor) of keypoints whose extremum is in the tile proper."""
    out = []
    for o, (g, d) in enumerate(_pyramid(image)):
        f = 2**o
        at = _extrema(d)
        own = (at[:, 1] * f >= margin) & (at[:, 1] * f < margin + tile) & (at[:, 2] * f >= margin) & (at[:, 2] * f < margin + tile)
        own &= (at[:, 1] * f + top < height) & (at[:, 2] * f + left < width)
        at = at[own]
        if not len(at):
            continue
        places, value, ok = _refined(d, at)
        for (s, y, x), level, v in zip(places[ok], at[ok][:, 0], value[ok], strict=True):
            sigma = BLUR * 2 ** (s / STEPS)
            for angle in _directions(g[level], y, x, sigma):
                h = _gradient_histograms(g[level], y, x, sigma, angle)
                if h is not None:
                    out.append((x * f + left, y * f + top, sigma * f, angle, abs(float(v)), h))
    return out


# --- corners ---


def orb_margin() -> int:
    return int(np.ceil((DISC * 1.5 + 8) * RATIO ** (LEVELS - 1))) + 8


def _tests() -> np.ndarray:
    """Pairs of places within the disc that a descriptor compares, the same for every run."""
    return np.clip(np.random.default_rng(29).normal(0, DISC / 2.5, (BITS, 4)), -DISC * 0.7, DISC * 0.7)


def _on_circle() -> np.ndarray:
    """The 16 places of the circle of radius 3, in order round it."""
    t = np.arange(16) * 2 * np.pi / 16
    return np.rint(np.c_[3 * np.sin(t), 3 * np.cos(t)]).astype(int)


def _corners(a: np.ndarray, threshold: float = 20.0, run: int = 9) -> np.ndarray:
    """Where ``run`` consecutive pixels of the circle are all brighter, or all darker, by the threshold."""
    inner = a[3:-3, 3:-3]
    h, w = inner.shape
    ring = np.stack([a[3 + y : 3 + y + h, 3 + x : 3 + x + w] for y, x in _on_circle()])
    out = np.zeros(inner.shape, bool)
    for far in (ring > inner + threshold, ring < inner - threshold):
        twice = np.concatenate([far, far[: run - 1]])
        for k in range(16):
            out |= twice[k : k + run].all(0)
    return np.pad(out, 3)


def _orb(image: np.ndarray, margin: int, tile: int, top: int, left: int, height: int, width: int) -> list[tuple]:
    tests, out = _tests(), []
    disc = np.array([(y, x) for y in range(-DISC, DISC + 1) for x in range(-DISC, DISC + 1) if y * y + x * x <= DISC * DISC])
    for k in range(LEVELS):
        f = RATIO**k
        # The level's pixel i covers [i f, (i + 1) f) of the raster, so every tile has the same ones.
        axes = []
        for start, size in ((top, image.shape[0]), (left, image.shape[1])):
            first, last = int(np.ceil(start / f)), int(np.floor((start + size) / f))
            axis = grids.Axis(-float(start), f, size, first, last)
            i0, w = grids.weights(axis, 0, size)
            axes.append((first, w[first - i0 : last - i0] / f))
        (y0, wy), (x0, wx) = axes
        a = np.floor(wy @ image @ wx.T + 0.5 + 1e-6) if k else image  # whole values: the order of sums is of no account
        s = blurred(a, 2.0)
        gy, gx = np.gradient(s)
        xx, yy, xy = blurred(gx * gx, 2.0), blurred(gy * gy, 2.0), blurred(gx * gy, 2.0)
        r = np.where(_corners(a), xx * yy - xy * xy - 0.04 * (xx + yy) ** 2, -np.inf)
        q = np.pad(r, 1, constant_values=-np.inf)
        peak = np.isfinite(r)
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    near = q[1 + dy : q.shape[0] - 1 + dy, 1 + dx : q.shape[1] - 1 + dx]
                    peak &= (r > near) if (dy, dx) < (0, 0) else (r >= near)
        y, x = np.nonzero(peak)
        py, px = (y + y0 + 0.5) * f - 0.5, (x + x0 + 0.5) * f - 0.5
        own = (py >= top + margin) & (py < top + margin + tile) & (px >= left + margin) & (px < left + margin + tile) & (py < height) & (px < width)
        pad = int(np.ceil(DISC * 1.5))
        own &= (y >= pad) & (x >= pad) & (y < a.shape[0] - pad) & (x < a.shape[1] - pad)
        y, x, py, px = y[own], x[own], py[own], px[own]
        if not len(y):
            continue
        around = a[y[:, None] + disc[:, 0], x[:, None] + disc[:, 1]]
        angle = np.arctan2((around * disc[:, 0]).sum(1), (around * disc[:, 1]).sum(1))
        turn = np.rint(angle / (np.pi / 15)) * (np.pi / 15)  # in steps of 12 degrees
        c, n = np.cos(turn)[:, None], np.sin(turn)[:, None]

        def at(v: np.ndarray, u: np.ndarray, y=y, x=x, c=c, n=n, s=s) -> np.ndarray:
            return s[y[:, None] + np.rint(n * u + c * v).astype(int), x[:, None] + np.rint(c * u - n * v).astype(int)]

        bits = at(tests[:, 0], tests[:, 1]) < at(tests[:, 2], tests[:, 3])
        words = np.packbits(bits, axis=1).view(np.int64)
        out += [(px[i], py[i], f * (2 * DISC + 1), float(angle[i]), float(r[y[i], x[i]]), words[i]) for i in range(len(y))]
    return out


def keypoints(tiles: DataFrame, tile: int, height: int, width: int, kind: str = "sift") -> DataFrame:
    """Keypoints of a raster's tiles (values 0..255) in coordinates of the whole raster; ids number them by tile and, in it, by scale and place.

    kind: sift (128 values, for L2) or orb (256 bits, for the Hamming distance).
    """
    detect, margin = (_sift, sift_margin()) if kind == "sift" else (_orb, orb_margin())
    schema = ROW.format("double" if kind == "sift" else "long")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for t in frame.itertuples():
                top, left = t.ty * tile - margin, t.tx * tile - margin
                image = _framed(t.data, tile + 2 * margin, top, left, height, width)
                found = detect(image, margin, tile, top, left, height, width)
                first = (t.ty << 16 | t.tx) << 24
                yield pd.DataFrame([(t.raster_id, t.ty, t.tx, first + k, *row) for k, row in enumerate(found)], columns=["raster_id", "ty", "tx", "kp_id", "x", "y", "size", "angle", "response", "descriptor"])

    return with_margin(tiles, tile, margin).mapInPandas(run, schema)


def valid_only(found: DataFrame, tiles: DataFrame, tile: int, least: int = 10) -> DataFrame:
    """Keypoints on pixels above ``least``, as a mask has it."""

    def pick(key: tuple, k: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(k) or not len(t):
            return k.iloc[:0]
        a = np.frombuffer(t["data"].iloc[0], np.float32).reshape(tile, tile)
        y, x = (np.clip(np.floor(k[c] + 0.5).astype(int) - n * tile, 0, tile - 1) for c, n in (("y", key[1]), ("x", key[2])))
        return k[a[y, x] > least]

    keys = ["raster_id", "ty", "tx"]
    return found.groupBy(*keys).cogroup(tiles.select(*keys, "data").groupBy(*keys)).applyInPandas(pick, found.schema)
