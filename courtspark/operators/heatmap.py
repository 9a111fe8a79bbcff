"""Position density grids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtspark.functions.geometry import COURT_LENGTH, COURT_WIDTH, valid_position


def bin_positions(positions: DataFrame, cell: float | None = 0.1, keys: tuple[str, ...] = ("match_id", "slot")) -> DataFrame:
    """Count positions per small cell. A slot has at most 120 x 220 cells of 0.1 m however long the match is."""
    p = positions.filter(valid_position("court_x", "court_y"))
    if cell is None:
        x, y = F.col("court_x"), F.col("court_y")
    else:
        x, y = (F.round(F.col("court_x") / cell) * cell), (F.round(F.col("court_y") / cell) * cell)
    return p.select(*keys, x.alias("px"), y.alias("py")).groupBy(*keys, "px", "py").agg(F.count("*").alias("n"))


def kernel(bins: DataFrame, bandwidth: float, keys: tuple[str, ...]) -> DataFrame:
    """Gaussian kernel of each key: bandwidth factor squared times the sample covariance, from sums over the bins."""
    n, x, y = F.col("n"), F.col("px"), F.col("py")
    m = bins.groupBy(*keys).agg(
        F.count("*").alias("bins"), F.sum("n").alias("total"), F.sum(n * x).alias("sx"), F.sum(n * y).alias("sy"), F.sum(n * x * x).alias("sxx"), F.sum(n * x * y).alias("sxy"), F.sum(n * y * y).alias("syy")
    ).filter("total >= 2")
    t, b2 = F.col("total"), bandwidth * bandwidth
    cov = lambda ab, a, b: (F.col(ab) - F.col(a) * F.col(b) / t) / (t - 1) * b2
    k = m.select(*keys, "total", "bins", cov("sxx", "sx", "sx").alias("kxx"), cov("sxy", "sx", "sy").alias("kxy"), cov("syy", "sy", "sy").alias("kyy"))
    return k.withColumn("det", F.col("kxx") * F.col("kyy") - F.col("kxy") * F.col("kxy")).filter(F.col("det") > 1e-12)


#: Bins that one task adds up at a time, and the cells of a tile along x and y.
CHUNK_BINS, TILE_X, TILE_Y = 2048, 12, 24
#: Exponents below this add nothing that a double next to the peak could hold; factors are formed up to the second.
FAINT, SAFE = -45.0, 300.0


def tile_sums(gx: np.ndarray, gy: np.ndarray, px: np.ndarray, py: np.ndarray, n: np.ndarray, ixx: float, ixy: float, iyy: float) -> np.ndarray:
    """(len(gy), len(gx)) sums over the bins of n * exp(-(ixx dx^2 + 2 ixy dx dy + iyy dy^2) / 2).

    With positions taken from the tile's middle the mixed term splits into factors of one axis each, so the sum is a
    matrix product of (axis x bins) factors: exponentials are taken along the axes only, not for every cell.
    """
    cx, cy = (gx[0] + gx[-1]) / 2, (gy[0] + gy[-1]) / 2
    u, v, p, q = gx - cx, gy - cy, px - cx, py - cy
    # the least exponent of a bin over the tile: distance to it along each axis in the other's conditional spread
    ox, oy = np.maximum(np.abs(p) - u[-1], 0), np.maximum(np.abs(q) - v[-1], 0)
    near = -0.5 * np.maximum((ixx - ixy * ixy / iyy) * ox * ox, (iyy - ixy * ixy / ixx) * oy * oy) >= FAINT
    p, q, n = p[near], q[near], n[near]
    if not len(p):
        return np.zeros((len(gy), len(gx)))
    if abs(ixy) * (np.abs(p).max() + u[-1]) * (np.abs(q).max() + v[-1]) > SAFE:
        out = np.empty((len(gy), len(gx)))
        for k, y in enumerate(v):
            dx, dy = u[:, None] - p, y - q
            out[k] = np.exp(-0.5 * (ixx * dx * dx + 2 * ixy * dx * dy + iyy * dy * dy)) @ n
        return out
    # -ixy dx dy = -ixy (uv - uq - pv + pq)
    along_x = np.exp(-0.5 * ixx * (u[:, None] - p) ** 2 + ixy * u[:, None] * q)
    along_y = np.exp(-0.5 * iyy * (v[:, None] - q) ** 2 + ixy * v[:, None] * p - ixy * p * q)
    return (along_y * n) @ along_x.T * np.exp(-ixy * v[:, None] * u)


def heat_grid(positions: DataFrame, bandwidth: float = 0.15, nx: int = 120, ny: int = 240, cut: float = 0.05, cell: float | None = 0.1, keys: tuple[str, ...] = ("match_id", "slot")) -> DataFrame:
    """Density on an nx x ny grid over the court; cells under ``cut`` of the peak are null.

    Keys with one position or with all positions on a line have no grid. Positions are counted per bin (``cell`` None:
    per distinct position), a key's bins are dealt by hash into chunks of about ``CHUNK_BINS``, each chunk gives a
    partial grid in tiles, and the tiles are summed by key and tile: no task holds a whole key.
    """
    bins = bin_positions(positions, cell, keys)
    k = kernel(bins, bandwidth, keys)
    chunk = F.pmod(F.xxhash64("px", "py"), F.ceil(F.col("bins") / CHUNK_BINS)).cast("int")
    work = bins.join(k, list(keys)).withColumn("chunk", chunk)
    names = list(keys)
    key_types = ", ".join(f"{k} {positions.schema[k].dataType.simpleString()}" for k in keys)
    gx, gy = np.linspace(0.0, COURT_WIDTH, nx), np.linspace(0.0, COURT_LENGTH, ny)
    tiles = [(y, x) for y in range(0, ny, TILE_Y) for x in range(0, nx, TILE_X)]

    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        det = first["det"]
        px, py, n = (pdf[c].to_numpy(dtype="float64") for c in ("px", "py", "n"))
        sums = [tile_sums(gx[x : x + TILE_X], gy[y : y + TILE_Y], px, py, n, first["kyy"] / det, -first["kxy"] / det, first["kxx"] / det).ravel() for y, x in tiles]
        return pd.DataFrame({**{k: [first[k]] * len(tiles) for k in names}, "y0": [t[0] for t in tiles], "x0": [t[1] for t in tiles], "sums": sums})

    spread = int(positions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = work.repartition(spread, *keys, "chunk")  # few rows, much work: not to be packed into few tasks
    part = dealt.groupBy(*keys, "chunk").applyInPandas(partial, f"{key_types}, y0 int, x0 int, sums array<double>")
    wide = F.least(F.lit(TILE_X), F.lit(nx) - F.col("x0"))
    cells = part.select(*keys, "y0", "x0", F.posexplode("sums").alias("at", "sum")).groupBy(*keys, "y0", "x0", "at").agg(F.sum("sum").alias("sum"))
    cells = cells.select(*keys, (F.col("y0") + F.floor(F.col("at") / wide)).cast("int").alias("iy"), (F.col("x0") + F.col("at") % wide).cast("int").alias("ix"), "sum")
    peak = cells.groupBy(*keys).agg(F.max("sum").alias("peak")).join(k, list(keys)).select(*keys, "peak", (F.col("total") * 2 * F.pi() * F.sqrt("det")).alias("norm"))
    shown = F.when(F.col("sum") >= F.col("peak") * cut, F.col("sum") / F.col("norm"))
    return cells.join(peak, list(keys)).select(*keys, "iy", "ix", shown.alias("density"))
