"""Court geometry fitted per source: homographies and polygons."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtspark.functions.geometry import COURT_LENGTH, COURT_WIDTH, NET_Y, SERVICE_LINE, SERVICE_LINE_FAR

# Court positions in metres of the 26 keypoints, four per line of the model's own order.
_L, _R, _N, _F = 0.0, COURT_WIDTH, 0.0, COURT_LENGTH
TEMPLATE_26 = [
    (_L, _N), (_L, _F), (_R, _N), (_R, _F),
    (_L, _N), (_L, _F), (_R, _N), (_R, _F),
    (_L, _N), (_L, _F), (_R, _N), (_R, _F),
    (_L, SERVICE_LINE), (_L, SERVICE_LINE_FAR), (_R, SERVICE_LINE), (_R, SERVICE_LINE_FAR),
    (_L, NET_Y), (_R, NET_Y), (_L, NET_Y), (_R, NET_Y),
    (_R / 2, SERVICE_LINE), (_R / 2, SERVICE_LINE_FAR), (_L, SERVICE_LINE), (_L, SERVICE_LINE_FAR), (_R, SERVICE_LINE), (_R, SERVICE_LINE_FAR),
]
# Corners in click order (far left, far right, near right, near left).
CORNERS = [(_L, _F), (_R, _F), (_R, _N), (_L, _N)]
# Keypoints that outline the playing area.
POLYGON_POINTS = [8, 9, 10, 11, 12, 13, 14, 15]


def court_template(spark) -> DataFrame:
    return spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(TEMPLATE_26)], "kpt int, court_x double, court_y double")


def _normalise(p):
    centre = p.mean(axis=0)
    spread = np.sqrt(((p - centre) ** 2).sum(axis=1)).mean()
    s = np.sqrt(2) / spread if spread > 0 else 1.0
    t = np.array([[s, 0, -s * centre[0]], [0, s, -s * centre[1]], [0, 0, 1.0]])
    return (p - centre) * s, t


def fit_plane(src, dst):
    """Least-squares homography src -> dst by the direct linear transform; None when the points do not determine one."""
    a, ta = _normalise(src)
    b, tb = _normalise(dst)
    one, zero = np.ones(len(a)), np.zeros((len(a), 3))
    p = np.column_stack([a, one])
    rows = np.vstack([np.hstack([p, zero, -b[:, :1] * p]), np.hstack([zero, p, -b[:, 1:] * p])])
    _, s, vt = np.linalg.svd(rows)
    if len(s) < 8 or s[7] < 1e-9 * s[0]:
        return None
    h = np.linalg.inv(tb) @ vt[-1].reshape(3, 3) @ ta
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None


def apply_plane(h, p):
    q = np.column_stack([p, np.ones(len(p))]) @ h.T
    return q[:, :2] / np.where(np.abs(q[:, 2:]) < 1e-12, np.nan, q[:, 2:])


def fit_robust(src, dst, threshold: float = 3.0, rounds: int = 300, seed: int = 7):
    """Seeded RANSAC over four-point fits, then a refit on the agreeing points. The threshold is in units of ``dst``."""
    if len(src) < 4:
        return None
    if len(src) == 4:
        return fit_plane(src, dst)
    rng = np.random.default_rng(seed)
    picks = np.argsort(rng.random((rounds, len(src))), axis=1)[:, :4]
    a, b = src[picks], dst[picks]
    x, y, u, v = a[..., 0], a[..., 1], b[..., 0], b[..., 1]
    one, zero = np.ones_like(x), np.zeros_like(x)
    left = np.concatenate([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y], -1), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y], -1)], axis=1)
    scale = np.abs(left).max(axis=1, keepdims=True)
    scaled = left / np.where(scale > 0, scale, 1.0)
    usable = np.abs(np.linalg.det(scaled)) > 1e-9
    if not usable.any():
        return None
    sol = np.linalg.solve(scaled[usable], np.concatenate([u, v], axis=1)[usable][..., None])[..., 0] / np.where(scale > 0, scale, 1.0)[usable][:, 0]
    best = None
    for h8 in sol:
        h = np.append(h8, 1.0).reshape(3, 3)
        err = np.sqrt(((apply_plane(h, src) - dst) ** 2).sum(axis=1))
        near = err <= threshold
        score = (int(near.sum()), -float(np.nansum(err[near])))
        if best is None or score > best[0]:
            best = (score, near)
    if best is None or best[0][0] < 4:
        return None
    return fit_plane(src[best[1]], dst[best[1]])


def fit_homographies(keypoints: DataFrame, keys: list[str], threshold: float = 3.0) -> DataFrame:
    """One homography per key from up to 26 keypoints; (0, 0) means unseen, fewer than four seen give null.

    ``keypoints``: keys, kpt, x, y. Points outside the template drop out and the newest duplicate-free
    set of 26 is kept by aggregation, so a group never holds more than 26 rows.
    """
    seen = keypoints.filter(F.col("kpt").between(0, 25)).groupBy(*keys, "kpt").agg(F.max(F.struct("x", "y")).alias("p")).select(*keys, "kpt", "p.x", "p.y")
    schema = T.StructType([*[keypoints.schema[k] for k in keys], T.StructField("visible", T.IntegerType()), T.StructField("h", T.ArrayType(T.DoubleType()))])
    template = np.array(TEMPLATE_26)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("kpt")
        xy = pdf[["x", "y"]].to_numpy(dtype="float64")
        vis = ~((xy[:, 0] == 0) & (xy[:, 1] == 0))
        dst = template[pdf["kpt"].to_numpy()[vis]]
        h = fit_robust(xy[vis], dst, threshold) if vis.sum() >= 4 else None
        return pd.DataFrame([(*[pdf[k].iloc[0] for k in keys], int(vis.sum()), None if h is None else h.ravel().tolist())], columns=schema.names)

    return seen.groupBy(*keys).applyInPandas(fit, schema)


def fit_corners(calibrations: DataFrame) -> DataFrame:
    """Exact homography from four clicked corners, no shuffle. ``corners``: array of four ``{x, y}``."""
    schema = T.StructType([*calibrations.schema.fields, T.StructField("h", T.ArrayType(T.DoubleType()))])
    dst = np.array(CORNERS)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hs = [fit_plane(np.array([(c["x"], c["y"]) for c in corners], dtype="float64"), dst) for corners in pdf["corners"]]
            yield pdf.assign(h=[None if h is None else h.ravel().tolist() for h in hs])

    return calibrations.mapInPandas(fit, schema)


def choose_homography(rows: DataFrame, manual: DataFrame, detected: DataFrame, keys: list[str]) -> DataFrame:
    """The manual homography of a source wins over the detected one (one row per source on the right sides)."""
    m = manual.select(*keys, F.col("h").alias("_m"))
    d = detected.select(*keys, F.col("h").alias("_d"))
    return rows.join(m, keys, "left").join(d, keys, "left").withColumn("h", F.coalesce("_m", "_d")).drop("_m", "_d")


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull, counter-clockwise, without points on its edges."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def half(seq):
        out = []
        for p in seq:
            while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(pts) + half(pts[::-1])


def court_polygons(points: DataFrame, keys: list[str], margin: float = 0.0) -> DataFrame:
    """Convex hull of the visible court points of each key, optionally shrunk toward its centre; null under three points.

    Duplicate keypoints are reduced first, so a group holds at most one row per keypoint number.
    """
    p = points.filter("x >= 0 AND y >= 0 AND NOT (x = 0 AND y = 0)").groupBy(*keys, "kpt").agg(F.max(F.struct("x", "y")).alias("p")).select(*keys, "p.x", "p.y")
    point = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
    schema = T.StructType([*[points.schema[k] for k in keys], T.StructField("polygon", T.ArrayType(point))])

    def outline(pdf: pd.DataFrame) -> pd.DataFrame:
        h = hull([(float(x), float(y)) for x, y in zip(pdf["x"], pdf["y"])])
        poly = None
        if len(h) >= 3:
            cx, cy = np.mean([q[0] for q in h]), np.mean([q[1] for q in h])
            poly = [{"x": float(cx + (x - cx) * (1 - margin)), "y": float(cy + (y - cy) * (1 - margin))} for x, y in h]
        return pd.DataFrame([(*[pdf[k].iloc[0] for k in keys], poly)], columns=schema.names)

    return p.groupBy(*keys).applyInPandas(outline, schema)
