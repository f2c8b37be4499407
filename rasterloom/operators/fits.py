"""Geometric transforms per group of correspondences.

Shift, similarity and affine least squares are sums and closed forms. Robust
fits (RANSAC), homography, polynomials and thin-plate splines run as numpy in
one task per group, on all of its matches; a group is one image pair at one scale, and ``split`` has the forms for groups of any size.
``fit_all`` makes one row per type, ``choose_best`` takes the simplest that is as good as any on matches it was not fitted to.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Points that each type needs, in the order that settles ties.
LEAST_POINTS = {"shift": 1, "similarity": 2, "affine": 3, "homography": 4, "polynomial_2": 6, "polynomial_3": 10, "spline": 3}
TRANSFORM_SCHEMA = (
    "pair_id long, type string, matrix array<double>, coef_x array<double>, coef_y array<double>, ctrl_src array<array<double>>, ctrl_dst array<array<double>>, degree int, "
    "num_points long, inlier_count long, inlier_ratio double, median_error double, robust_rmse double, mean_error double, std_error double, max_error double, held_error double, as_good boolean, error string"
)
#: Fixed value: hypotheses of a robust fit, at most.
ITERATIONS = 2000
#: Chance that a robust fit which stops earlier has seen no sample of inliers alone.
MISS = 1e-9
#: Hypotheses that are scored before the others of the first step.
FIRST = 4
#: One of so many parts of the matches judges a type that is fitted to the others; a type whose mean error there exceeds the least by no
#: more than so many standard errors of the difference is as good.
FOLDS, SURE = 5, 2.0
#: A spline is tried where the next scale is below this.
SPLINE_SCALE = 0.5


def ransac_threshold(scale: Column | float) -> Column | float:
    """Pixels of a scale."""
    return 5.0 * (scale / 0.15)


def _centred_sums(df: DataFrame, keys: Sequence[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Counts, means and centred sums of products per group, in one aggregate."""
    cols = ["src_x", "src_y", "dst_x", "dst_y"]
    n = F.count(F.lit(1)).cast("double")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"m_{c}") for c in cols), *((F.covar_pop(p, q) * n).alias(k) for k, (p, q) in pairs.items()))


def fit_affine_lsq(df: DataFrame, keys: Sequence[str] = ("pair_id",)) -> DataFrame:
    """Affine least squares by centred normal equations: n and a, b, tx, c, d, ty (null for collinear points)."""
    x, y, u, v = "src_x", "src_y", "dst_x", "dst_y"
    sums = _centred_sums(df, keys, {"sxx": (x, x), "sxy": (x, y), "syy": (y, y), "sxu": (x, u), "syu": (y, u), "sxv": (x, v), "syv": (y, v)})
    det = F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy")
    solved = sums.withColumn("det", F.when(F.abs(det) > 1e-9, det))
    for name, p, q in (("a", "sxu", "syu"), ("c", "sxv", "syv")):
        solved = solved.withColumn(name, (F.col(p) * F.col("syy") - F.col(q) * F.col("sxy")) / F.col("det"))
    for name, p, q in (("b", "sxu", "syu"), ("d", "sxv", "syv")):
        solved = solved.withColumn(name, (F.col(q) * F.col("sxx") - F.col(p) * F.col("sxy")) / F.col("det"))
    tx = F.col("m_dst_x") - F.col("a") * F.col("m_src_x") - F.col("b") * F.col("m_src_y")
    ty = F.col("m_dst_y") - F.col("c") * F.col("m_src_x") - F.col("d") * F.col("m_src_y")
    return solved.select(*keys, "n", "a", "b", tx.alias("tx"), "c", "d", ty.alias("ty"))


def fit_similarity_lsq(df: DataFrame, keys: Sequence[str] = ("pair_id",)) -> DataFrame:
    """Rotation, scale and shift least squares: u = a x - b y + tx, v = b x + a y + ty."""
    x, y, u, v = "src_x", "src_y", "dst_x", "dst_y"
    s = _centred_sums(df, keys, {"sxx": (x, x), "syy": (y, y), "sxu": (x, u), "syv": (y, v), "sxv": (x, v), "syu": (y, u)})
    ss = F.col("sxx") + F.col("syy")
    s = s.withColumn("ss", F.when(ss > 1e-9, ss)).withColumn("a", (F.col("sxu") + F.col("syv")) / F.col("ss")).withColumn("b", (F.col("sxv") - F.col("syu")) / F.col("ss"))
    tx = F.col("m_dst_x") - F.col("a") * F.col("m_src_x") + F.col("b") * F.col("m_src_y")
    ty = F.col("m_dst_y") - F.col("b") * F.col("m_src_x") - F.col("a") * F.col("m_src_y")
    return s.select(*keys, "n", "a", "b", tx.alias("tx"), ty.alias("ty"))


def apply_matrix(x: Column, y: Column, m: Sequence[Column]) -> tuple[Column, Column]:
    """Six entries: affine; nine: projective, a w near zero counts as 1."""
    u, v = m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5]
    if len(m) == 6:
        return u, v
    w = m[6] * x + m[7] * y + m[8]
    w = F.when(F.abs(w) < 1e-6, F.lit(1.0)).otherwise(w)
    return u / w, v / w


def basis(x: np.ndarray, y: np.ndarray, degree: int) -> np.ndarray:
    cols = [np.ones_like(x), x, y, x * x, x * y, y * y]
    if degree == 3:
        cols += [x**3, x * x * y, x * y * y, y**3]
    return np.stack(cols, 1)


def _project(m: np.ndarray, p: np.ndarray) -> np.ndarray:
    q = np.c_[p, np.ones(len(p))] @ m.T
    w = np.where(np.abs(q[:, 2]) < 1e-6, 1.0, q[:, 2])
    out = q[:, :2] / w[:, None]
    return np.where(np.isfinite(out), out, 1e6)


def solve(kind: str, s: np.ndarray, d: np.ndarray) -> np.ndarray | None:
    """3 x 3 least-squares matrix of a type, or None where the points do not determine it."""
    ms, md = s.mean(0), d.mean(0)
    x, u = s - ms, d - md
    if kind == "shift":
        return np.array([[1, 0, md[0] - ms[0]], [0, 1, md[1] - ms[1]], [0, 0, 1.0]])
    if kind == "similarity":
        ss = (x * x).sum()
        if ss < 1e-9:
            return None
        a, b = (x * u).sum() / ss, (x[:, 0] * u[:, 1] - x[:, 1] * u[:, 0]).sum() / ss
        return np.array([[a, -b, md[0] - a * ms[0] + b * ms[1]], [b, a, md[1] - b * ms[0] - a * ms[1]], [0, 0, 1]])
    if kind == "affine":
        normal = x.T @ x
        if abs(np.linalg.det(normal)) < 1e-9:
            return None
        lin = np.linalg.solve(normal, x.T @ u).T
        return np.vstack([np.c_[lin, md - lin @ ms], [0, 0, 1]])
    scale_s, scale_d = np.sqrt((x * x).sum(1).mean()) or 1, np.sqrt((u * u).sum(1).mean()) or 1
    x, u = x / scale_s, u / scale_d
    rows = np.zeros((2 * len(s), 9))
    rows[0::2, 0:2], rows[0::2, 2], rows[0::2, 6:8], rows[0::2, 8] = x, 1, -u[:, :1] * x, -u[:, 0]
    rows[1::2, 3:5], rows[1::2, 5], rows[1::2, 6:8], rows[1::2, 8] = x, 1, -u[:, 1:] * x, -u[:, 1]
    _, sv, vt = np.linalg.svd(rows, full_matrices=len(rows) < 9)  # else the left factor has a row and a column for each equation
    if len(sv) >= 8 and sv[7] < 1e-9 * sv[0]:
        return None
    h = vt[-1].reshape(3, 3)
    to_s = np.array([[1 / scale_s, 0, -ms[0] / scale_s], [0, 1 / scale_s, -ms[1] / scale_s], [0, 0, 1]])
    from_d = np.array([[scale_d, 0, md[0]], [0, scale_d, md[1]], [0, 0, 1]])
    h = from_d @ h @ to_s
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None


def distinct_picks(rng: np.random.Generator, n: int, need: int, many: int) -> np.ndarray:
    """Rows of ``need`` different numbers below n."""
    if n <= 4 * need:
        return np.argsort(rng.random((many, n)), axis=1)[:, :need]
    picks = rng.integers(0, n, (many, need))
    while True:
        ordered = np.sort(picks, axis=1)
        again = np.flatnonzero((ordered[:, 1:] == ordered[:, :-1]).any(axis=1))
        if not len(again):
            return picks
        picks[again] = rng.integers(0, n, (len(again), need))


def through(kind: str, s: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The 3 x 3 matrices that take the few points s[k] to d[k] exactly; samples that determine none are left out."""
    if kind == "similarity":
        p, q = s[:, 1] - s[:, 0], d[:, 1] - d[:, 0]
        ss = (p * p).sum(1)
        ok = ss > 1e-9
        p, q, ss, s, d = p[ok], q[ok], ss[ok], s[ok], d[ok]
        a, b = (p * q).sum(1) / ss, (p[:, 0] * q[:, 1] - p[:, 1] * q[:, 0]) / ss
        tx, ty = d[:, 0, 0] - a * s[:, 0, 0] + b * s[:, 0, 1], d[:, 0, 1] - b * s[:, 0, 0] - a * s[:, 0, 1]
        o = np.zeros_like(a)
        return np.stack([np.stack([a, -b, tx], 1), np.stack([b, a, ty], 1), np.stack([o, o, o + 1], 1)], 1)

    def areas(i: int, j: int, k: int) -> np.ndarray:
        u, v = s[:, j] - s[:, i], s[:, k] - s[:, i]
        return np.abs(u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])

    corners = [(0, 1, 2)] if kind == "affine" else [(0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)]
    ok = np.min([areas(*c) for c in corners], axis=0) > 1e-6
    s, d = s[ok], d[ok]
    if not len(s):
        return np.empty((0, 3, 3))
    if kind == "affine":
        a = np.concatenate([s, np.ones((len(s), 3, 1))], axis=2)
        top = np.linalg.solve(a, d).transpose(0, 2, 1)
        return np.concatenate([top, np.tile([[[0.0, 0.0, 1.0]]], (len(s), 1, 1))], axis=1)
    # Eight equations with the last entry 1.
    a, b = np.zeros((len(s), 8, 8)), d.reshape(len(s), 8, 1)
    a[:, 0::2, 0:2], a[:, 0::2, 2], a[:, 0::2, 6:8] = s, 1, -d[:, :, :1] * s
    a[:, 1::2, 3:5], a[:, 1::2, 5], a[:, 1::2, 6:8] = s, 1, -d[:, :, 1:] * s
    good = np.abs(np.linalg.det(a)) > 1e-12
    h = np.linalg.solve(a[good], b[good])[:, :, 0]
    return np.concatenate([h, np.ones((len(h), 1))], axis=1).reshape(-1, 3, 3)


@functools.lru_cache(maxsize=128)
def _samples(n: int, need: int, many: int, seed: int) -> np.ndarray:
    """The samples of a robust fit; they depend on the number of points alone, so groups of one size share them."""
    picks = distinct_picks(np.random.default_rng(seed), n, need, many)
    picks.flags.writeable = False
    return picks


def ransac(kind: str, s: np.ndarray, d: np.ndarray, threshold: float, seed: int = 0) -> tuple[np.ndarray | None, np.ndarray]:
    """The matrix with most inliers among seeded hypotheses (the first of equals), refitted on them.

    Hypotheses are made and scored some at a time, so that work and memory per step stay about equal for any number of points.
    """
    need, best = LEAST_POINTS[kind], np.zeros(len(s), bool)
    picks = _samples(len(s), need, ITERATIONS, seed)
    step = int(np.clip(100_000 // len(s), 1, 100))
    # A few come first: where one of them has all points inside, it is the first of the best, whatever follows.
    begins = [0, *range(FIRST, step, step), *range(step, len(picks), step)]
    for i, end in zip(begins, [*begins[1:], len(picks)], strict=True):
        # Enough, if so many samples have missed a better set of inliers with a probability below MISS.
        if i >= step and (1 - best.mean() ** need) ** i < MISS:
            break
        m = through(kind, s[picks[i:end]], d[picks[i:end]])
        if not len(m):
            continue
        w = np.where(np.abs(w := m[:, 2, :2] @ s.T + m[:, 2, 2:]) < 1e-6, 1.0, w)
        dx, dy = (m[:, 0, :2] @ s.T + m[:, 0, 2:]) / w - d[:, 0], (m[:, 1, :2] @ s.T + m[:, 1, 2:]) / w - d[:, 1]
        inside = dx * dx + dy * dy <= threshold * threshold
        counts = inside.sum(axis=1)
        if counts.max() > best.sum():
            best = inside[int(counts.argmax())]
            if best.all():
                break
    if best.sum() < need:
        return None, best
    m = solve(kind, s[best], d[best])
    return m, best if m is None else np.linalg.norm(_project(m, s) - d, axis=1) <= threshold


def thin_plate(s: np.ndarray, d: np.ndarray, smoothing: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and affine part of the spline with kernel r^2 ln r."""
    n = len(s)
    r2 = ((s[:, None] - s[None]) ** 2).sum(-1)
    k = np.where(r2 > 0, 0.5 * r2 * np.log(np.where(r2 > 0, r2, 1)), 0) + smoothing * np.eye(n)
    p = np.c_[np.ones(n), s]
    a = np.block([[k, p], [p.T, np.zeros((3, 3))]])
    out = np.linalg.solve(a, np.vstack([d, np.zeros((3, 2))]))
    return out[:n], out[n:]


def spline_through(s: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The thin-plate spline of least smoothing that has a finite solution; smoothing starts higher where consecutive points are collinear."""
    u, v = s[1:101] - s[:-1][:100], s[2:102] - s[:-2][:100]
    area = np.abs(u[: len(v), 0] * v[:, 1] - u[: len(v), 1] * v[:, 0]) / 2
    for smoothing in (1.0, 10.0, 100.0, 1000.0) if len(area) and area.min() < 1e-6 else (0.0, 0.1, 1.0, 10.0):
        try:
            weights, affine = thin_plate(s, d, smoothing)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(apply_thin_plate(s, s, weights, affine)).all():
            return weights, affine
    raise np.linalg.LinAlgError("no spline through the control points")


def apply_thin_plate(at: np.ndarray, s: np.ndarray, weights: np.ndarray, affine: np.ndarray) -> np.ndarray:
    out = np.c_[np.ones(len(at)), at] @ affine
    for i in range(0, len(at), 1024):
        r2 = ((at[i : i + 1024, None] - s[None]) ** 2).sum(-1)
        out[i : i + 1024] += np.where(r2 > 0, 0.5 * r2 * np.log(np.where(r2 > 0, r2, 1)), 0) @ weights
    return out


#: Control points of a cell, about, beyond which a spline is made of local ones; how far a cell's own spline reaches beyond it, in shares of its sides.
CELL, REACH = 400, 0.5


class LocalSplines:
    """A partition of unity of thin-plate splines: control points are cut into cells of at most CELL by a k-d split, each cell has the spline
    of the points within its box and REACH around it, and splines are blended by weights that fall smoothly to 0 at the edge of their reach.

    With up to CELL points it is the thin-plate spline itself. Fitting and memory grow with the number of points; it goes through the
    control points where their splines do.
    """

    def __init__(self, s: np.ndarray, d: np.ndarray):
        self.s, self.d = s, d
        low, high = s.min(0), s.max(0)
        pad = np.maximum(high - low, 1e-9) * 1e-9
        self.root = self._split(np.arange(len(s)), low - pad, high + pad, None)

    def _split(self, own: np.ndarray, low: np.ndarray, high: np.ndarray, whole: np.ndarray | None) -> dict:
        """A node: the box that its splines reach, and either two halves or a spline. whole: the points that may be within reach; all if absent."""
        whole = np.arange(len(self.s)) if whole is None else whole
        around = (high - low) * REACH
        if len(own) <= CELL:
            near = own if len(own) == len(self.s) else whole[((self.s[whole] >= low - around) & (self.s[whole] <= high + around)).all(1)]
            weights, affine = spline_through(self.s[near], self.d[near])
            return {"low": low - around, "high": high + around, "near": near, "weights": weights, "affine": affine}
        axis = int(np.argmax(high - low))
        cut = float(np.median(self.s[own, axis]))
        left = self.s[own, axis] <= cut
        if left.all() or not left.any():  # as many points in one place
            left = np.arange(len(own)) < len(own) // 2
        reach = whole[((self.s[whole] >= low - 2 * around) & (self.s[whole] <= high + 2 * around)).all(1)]
        halves = []
        for side in (left, ~left):
            a, b = low.copy(), high.copy()
            (b if side is left else a)[axis] = cut
            halves.append(self._split(own[side], a, b, reach))
        return {"low": np.minimum(halves[0]["low"], halves[1]["low"]), "high": np.maximum(halves[0]["high"], halves[1]["high"]), "halves": halves}

    def __call__(self, at: np.ndarray) -> np.ndarray:
        if "halves" not in self.root:
            r = self.root
            return apply_thin_plate(at, self.s[r["near"]], r["weights"], r["affine"])
        total, share = np.zeros((len(at), 2)), np.zeros(len(at))
        # Points beyond all cells take the value of the nearest place within the outermost box.
        box = np.clip(at, self.s.min(0), self.s.max(0))
        self._add(self.root, box, np.arange(len(at)), total, share)
        out = total / share[:, None]
        return out + (at - box)

    def _add(self, node: dict, at: np.ndarray, which: np.ndarray, total: np.ndarray, share: np.ndarray) -> None:
        p = at[which]
        which = which[((p > node["low"]) & (p < node["high"])).all(1)]
        if not len(which):
            return
        if "halves" in node:
            for half in node["halves"]:
                self._add(half, at, which, total, share)
            return
        middle, side = (node["low"] + node["high"]) / 2, np.maximum((node["high"] - node["low"]) / 2, 1e-12)
        t = np.abs((at[which] - middle) / side)
        w = ((1 - t) ** 4 * (4 * t + 1)).prod(1)
        total[which] += w[:, None] * apply_thin_plate(at[which], self.s[node["near"]], node["weights"], node["affine"])
        share[which] += w


def _statistics(err: np.ndarray, inside: np.ndarray) -> dict:
    """Of the inliers' errors; of all where there is no inlier."""
    used = err[inside] if inside.any() else err
    med = float(np.median(used))
    return {
        "inlier_count": int(inside.sum()), "inlier_ratio": float(inside.mean()), "median_error": med, "robust_rmse": med + 1.4826 * float(np.median(np.abs(used - med))),
        "mean_error": float(used.mean()), "std_error": float(used.std()), "max_error": float(used.max()),
    }


def fit_one(kind: str, s: np.ndarray, d: np.ndarray, threshold: float = 5.0, rough: np.ndarray | None = None) -> dict:
    """One row of TRANSFORM_SCHEMA without pair_id; ``error`` says why there is no transform.

    rough: the inliers of an affine map at twice the threshold, where they are known already.
    """
    out: dict = {"type": kind, "num_points": len(s)}
    if len(s) < LEAST_POINTS[kind]:
        return out | {"error": "insufficient_points"}
    if kind == "shift":
        m, inside = solve(kind, s, d), np.ones(len(s), bool)
        return out | {"matrix": m.ravel().tolist()} | _statistics(np.linalg.norm(_project(m, s) - d, axis=1), inside)
    if kind in ("similarity", "affine", "homography"):
        m, inside = ransac(kind, s, d, threshold)
        if m is None:
            return out | {"error": "degenerate_points"}
        return out | {"matrix": m.ravel().tolist()} | _statistics(np.minimum(np.linalg.norm(_project(m, s) - d, axis=1), 1e6), inside)
    inside = ransac("affine", s, d, 2 * threshold)[1] if rough is None else rough
    if inside.sum() < LEAST_POINTS[kind]:
        return out | {"error": "insufficient_points"}
    if kind == "spline":
        c, t = np.unique(s[inside], axis=0, return_index=True)
        t = d[inside][t]
        try:
            got = LocalSplines(c, t)(s)
        except np.linalg.LinAlgError:
            return out | {"error": "degenerate_points"}
        return out | {"ctrl_src": c.tolist(), "ctrl_dst": t.tolist()} | _statistics(np.linalg.norm(got - d, axis=1), inside)
    degree = int(kind[-1])
    b = basis(s[inside, 0], s[inside, 1], degree)
    cx, _, rank, _ = np.linalg.lstsq(b, d[inside, 0], rcond=None)
    cy = np.linalg.lstsq(b, d[inside, 1], rcond=None)[0]
    if rank < b.shape[1] - 1:
        return out | {"error": "rank_deficient"}
    if max(np.abs(cx).max(), np.abs(cy).max()) > 1e10:
        return out | {"error": "extreme_coefficients"}
    whole = basis(s[:, 0], s[:, 1], degree)
    return out | {"coef_x": cx.tolist(), "coef_y": cy.tolist(), "degree": degree} | _statistics(np.linalg.norm(np.c_[whole @ cx, whole @ cy] - d, axis=1), inside)


def mapped(row: dict, s: np.ndarray) -> np.ndarray:
    """Points through a fitted row."""
    if row.get("matrix"):
        return _project(np.array(row["matrix"]).reshape(3, 3), s)
    if row.get("coef_x"):
        return basis(s[:, 0], s[:, 1], row["degree"]) @ np.array([row["coef_x"], row["coef_y"]]).T
    return LocalSplines(np.array(row["ctrl_src"]), np.array(row["ctrl_dst"]))(s)


def held_errors(kind: str, s: np.ndarray, d: np.ndarray, held: np.ndarray, threshold: float, rough: np.ndarray | None) -> np.ndarray | None:
    """Errors, up to the threshold, on the held matches of a fit to the others; None where one has too few."""
    if not held.any():
        return None
    row = fit_one(kind, s[~held], d[~held], threshold, None if rough is None else rough[~held])
    return None if row.get("error") else np.minimum(np.linalg.norm(mapped(row, s[held]) - d[held], axis=1), threshold)


def judged(rows: list[dict], errors: list[np.ndarray | None]) -> None:
    """Set held_error and as_good: no worse than the least mean error, but for chance."""
    known = [e for e in errors if e is not None]
    best = min(known, key=lambda e: e.mean()) if known else None
    for row, e in zip(rows, errors, strict=True):
        if e is not None:
            more = e - best
            row |= {"held_error": float(e.mean()), "as_good": bool(more.mean() <= SURE * more.std() / len(more) ** 0.5 + 1e-6)}


def fit_all(df: DataFrame, kinds: Sequence[str] = tuple(LEAST_POINTS), threshold: float = 5.0, judge: bool = False) -> DataFrame:
    """A row per pair and type. judge: also fit each type to four fifths of the matches, by hash, and measure it on the others."""
    names = [c.split()[0] for c in TRANSFORM_SCHEMA.split(", ")]

    def fit(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("match_id")
        s, d, held = g[["src_x", "src_y"]].to_numpy(float), g[["dst_x", "dst_y"]].to_numpy(float), g["fold"].to_numpy() == 0
        rough = ransac("affine", s, d, 2 * threshold)[1] if len(s) >= 3 and not set(kinds) <= {"shift", "similarity", "affine", "homography"} else None
        rows = [{"pair_id": key[0]} | fit_one(k, s, d, threshold, rough) for k in kinds]
        if judge:
            judged(rows, [None if r.get("error") else held_errors(r["type"], s, d, held, threshold, rough) for r in rows])
        return pd.DataFrame([{n: r.get(n) for n in names} for r in rows], columns=names)

    fold = F.pmod(F.xxhash64("match_id"), F.lit(FOLDS)).cast("int").alias("fold")
    return df.select("pair_id", "match_id", "src_x", "src_y", "dst_x", "dst_y", fold).groupBy("pair_id").applyInPandas(fit, TRANSFORM_SCHEMA)


def candidate_kinds(next_scale: float | None = None) -> tuple[str, ...]:
    """Types that are tried at a scale: a spline, which goes through its own points, only on the way to a coarse next scale."""
    return tuple(k for k in LEAST_POINTS if k != "spline" or next_scale is not None and next_scale < SPLINE_SCALE)


def choose_best(transforms: DataFrame, keys: Sequence[str] = ("pair_id",)) -> DataFrame:
    """Per group a valid transform: the simplest of those that are as good as any on matches that they were not fitted to; where none
    was judged, the one of least robust RMSE, the simplest of equals."""
    order = F.array_position(F.array(*(F.lit(k) for k in LEAST_POINTS)), F.col("type"))
    good = F.coalesce("as_good", F.lit(False))
    w = W.partitionBy(*keys).orderBy(~good, F.when(good, order), "robust_rmse", order)
    return transforms.where(F.col("error").isNull()).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def compose_shifts(steps: DataFrame, order: str = "step") -> DataFrame:
    """Running sums of shifts; the steps are few, one per scale."""
    w = W.orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return steps.withColumn("cum_x", F.sum("shift_x").over(w)).withColumn("cum_y", F.sum("shift_y").over(w))


def compose_matrices(steps: DataFrame, keys: Sequence[str], order: str, matrix: str = "matrix") -> DataFrame:
    """The product of each group's 3 x 3 matrices in order, later ones on the left; a fold, since products do not commute."""
    eye = F.array(*(F.lit(float(i % 4 == 0)) for i in range(9)))

    def times(acc: Column, s: Column) -> Column:
        m = s["m"]
        return F.array(*(sum((m[3 * i + k] * acc[3 * k + j] for k in range(3)), F.lit(0.0)) for i in range(3) for j in range(3)))

    ordered = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(matrix).alias("m"))))
    return steps.groupBy(*keys).agg(ordered.alias("_s")).select(*keys, F.aggregate("_s", eye, times).alias(matrix))
