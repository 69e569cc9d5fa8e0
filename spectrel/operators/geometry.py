"""Coordinates and rasters: transforms as column expressions, neighbourhoods on tiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrel.operators import raster


def rotate(x: str, y: str) -> tuple[Column, Column]:
    """(x, y) -> (y, -x)."""
    return F.col(y), -F.col(x)


def luminance(r: Column, g: Column, b: Column) -> Column:
    return (0.299 * r + 0.587 * g + 0.114 * b) / 255


def affine(x: Column, y: Column, m: np.ndarray) -> tuple[Column, Column]:
    return tuple(float(m[i, 0]) * x + float(m[i, 1]) * y + float(m[i, 2]) for i in range(2))


def fit_similarity(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Rotation, one scale and shift by least squares; three pairs at least."""
    if len(src) < 3:
        raise ValueError("three landmark pairs are needed")
    a, b = src - src.mean(0), dst - dst.mean(0)
    u, d, vt = np.linalg.svd(b.T @ a)
    sign = np.diag([1.0, np.sign(np.linalg.det(u @ vt)) or 1.0])
    r = u @ sign @ vt
    scale = (d * np.diag(sign)).sum() / (a**2).sum()
    out = np.eye(3)
    out[:2, :2] = scale * r
    out[:2, 2] = dst.mean(0) - scale * r @ src.mean(0)
    return out


def fit_tps(points: np.ndarray, values: np.ndarray) -> np.ndarray:
    """n kernel weights and three polynomial terms of the interpolating thin-plate spline, for each value column."""
    n = len(points)
    d2 = ((points[:, None] - points[None]) ** 2).sum(2)
    k = np.where(d2 > 0, 0.5 * d2 * np.log(np.where(d2 > 0, d2, 1)), 0)
    p = np.hstack([np.ones((n, 1)), points])
    top = np.vstack([np.hstack([k, p]), np.hstack([p.T, np.zeros((3, 3))])])
    return np.linalg.solve(top, np.vstack([values, np.zeros((3, values.shape[1]))]))


def tps(x: Column, y: Column, points: np.ndarray, w: np.ndarray) -> Column:
    """The spline's value as a column expression; landmarks are few."""
    total = float(w[-3]) + float(w[-2]) * x + float(w[-1]) * y
    for (px, py), c in zip(points.tolist(), w[:-3].tolist(), strict=True):
        d2 = (x - px) * (x - px) + (y - py) * (y - py)
        total = total + float(c) * F.when(d2 > 0, 0.5 * d2 * F.ln(F.when(d2 > 0, d2).otherwise(1.0))).otherwise(0.0)
    return total


def forward(x: Column, y: Column, m: np.ndarray, points: np.ndarray, w: np.ndarray) -> tuple[Column, Column]:
    """Affine map plus the spline displacement at the mapped point."""
    ax, ay = affine(x, y, m)
    return ax + tps(ax, ay, points, w[:, 0]), ay + tps(ax, ay, points, w[:, 1])


def inverse(df: DataFrame, x: str, y: str, m: np.ndarray, points: np.ndarray, w: np.ndarray, rounds: int = 50, tolerance: float = 0.5) -> DataFrame:
    """Adds inv_x, inv_y, converged: damped fixed-point steps from the inverse affine map, each row until it is near enough."""

    back = np.linalg.inv(m)

    def ahead(p: np.ndarray) -> np.ndarray:
        a = p @ m[:2, :2].T + m[:2, 2]
        d2 = ((a[:, None] - points[None]) ** 2).sum(2)
        k = np.where(d2 > 0, 0.5 * d2 * np.log(np.where(d2 > 0, d2, 1)), 0)
        return a + k @ w[:-3] + np.hstack([np.ones((len(a), 1)), a]) @ w[-3:]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            target = pdf[[x, y]].to_numpy(float)
            guess = target @ back[:2, :2].T + back[:2, 2]
            live = np.ones(len(guess), bool)
            for _ in range(rounds):
                if not live.any():
                    break
                off = ahead(guess[live]) - target[live]
                near = np.sqrt((off**2).sum(1)) < tolerance
                step = np.where(near[:, None], 0, 0.5 * off)
                guess[live] -= step
                live[np.flatnonzero(live)[near]] = False
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame({"inv_x": guess[:, 0], "inv_y": guess[:, 1], "converged": ~live})], axis=1)

    return df.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "inv_x double, inv_y double, converged boolean"]))


def strided_list(mask: DataFrame, spacing: int) -> DataFrame:
    """Every ``spacing``-th pixel of the mask's pixels in row-major order (the flat list is strided, not the grid)."""
    from spectrel.operators.peaks import numbered

    return numbered(mask, [F.col("y"), F.col("x")]).where(F.col("rn") % spacing == 0).select("x", "y")


def sobel(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """y, x, value: sqrt((gx^2 + gy^2) / 2); the border is repeated outside; pixels that are not there count 0. One exchange of rims."""
    return raster.to_pixels(raster.around(raster.to_tiles(pixels), 1, raster.edges(height, width)))


def morph(mask: DataFrame, offsets: list[tuple[int, int]], dilate: bool) -> DataFrame:
    """Dilate (largest) or erode (smallest) a value over offsets, a pixel's own among them; pixels beyond the border are ignored."""
    r, f = raster.shapes([([(0, 0), *offsets], dilate)])
    return raster.to_pixels(raster.around(raster.to_tiles(mask), r, f), dict(mask.dtypes)["value"])


def warp(pixels: DataFrame, targets: DataFrame) -> DataFrame:
    """y, x, value: bilinear samples of ``pixels`` at (sy, sx) of ``targets`` (y, x, sy, sx); missing corners count 0."""
    fy, fx = F.col("sy") - F.floor("sy"), F.col("sx") - F.floor("sx")
    corner = lambda dy, dx, k: F.struct((F.floor("sy") + dy).alias("py"), (F.floor("sx") + dx).alias("px"), k.alias("k"))
    cells = F.array(corner(0, 0, (1 - fy) * (1 - fx)), corner(0, 1, (1 - fy) * fx), corner(1, 0, fy * (1 - fx)), corner(1, 1, fy * fx))
    asked = targets.select("y", "x", F.explode(cells).alias("c")).select("y", "x", "c.py", "c.px", "c.k")
    there = pixels.select(F.col("y").cast("long").alias("py"), F.col("x").cast("long").alias("px"), "value")
    return asked.join(there, ["py", "px"], "left").groupBy("y", "x").agg(F.sum(F.coalesce(F.col("value"), F.lit(0.0)) * F.col("k")).alias("value"))


def nearest(points: DataFrame, x: float, y: float, zoom: float) -> DataFrame:
    """What an undo at (x, y) removes: the nearest point if it is nearer than 100 / zoom, else the last one. points: seq, x, y."""
    d = F.sqrt((F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y))
    best = points.agg(F.min(F.struct(d.alias("d"), "seq")).alias("b"), F.max("seq").alias("last"))
    return best.select(F.when(F.col("b.d") < 100.0 / zoom, F.col("b.seq")).otherwise(F.col("last")).alias("seq"))


def undo(points: DataFrame, x: float, y: float, zoom: float) -> DataFrame:
    """The points without the one that ``nearest`` names."""
    return points.join(F.broadcast(nearest(points, x, y, zoom)), "seq", "left_anti")  # one row


def crop(pixels: DataFrame, x0: int, x1: int, y0: int, y1: int) -> DataFrame:
    """The rows with x0 <= x < x1 and y0 <= y < y1."""
    return pixels.where((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))


def screen_to_pixel(c: Column, offset: float, zoom: float, size: int) -> Column:
    """Truncated and clamped to the image."""
    return F.least(F.greatest((c / zoom + offset).cast("int"), F.lit(0)), F.lit(size - 1))
