"""Registration of one image to another: masks, refinement of the affine map, spline warp, and what its plots show.

Images are tables (y, x, value). The refinement alone gathers two of them, at most ``max_pixels`` each, since a hundred dependent
small steps gain nothing from a cluster; of larger ones it gathers a mask of one bit a pixel, at most ``max_sent`` of these; all else
stays distributed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrel.operators import geometry, raster
from spectrel.runtime import settled

#: Structuring elements as (dy, dx): a 3 x 3 and a 5 x 5 ellipse (fixed values).
ELLIPSE_3 = [(0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)]
ELLIPSE_5 = [(-2, 0), *[(dy, dx) for dy in (-1, 0, 1) for dx in (-2, -1, 0, 1, 2)], (2, 0)]


#: A mask is closed by the larger ellipse, then opened by the smaller.
CLOSE_AND_OPEN = [(ELLIPSE_5, True), (ELLIPSE_5, False), (ELLIPSE_3, False), (ELLIPSE_3, True)]


def mask_tiles(tiles: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Tiles of 0 or 1: gray > threshold, closed and opened, with one exchange of rims for the four steps."""
    r, f = raster.shapes(CLOSE_AND_OPEN)
    above = lambda wide: np.where(np.isnan(wide), np.nan, wide > threshold)
    return raster.around(tiles, r, lambda wide, y0, x0: f(above(wide), y0, x0))


def tissue_mask(gray: DataFrame, threshold: float = 0.1) -> DataFrame:
    """y, x, value 0 or 1, as ``mask_tiles``."""
    return raster.to_pixels(mask_tiles(raster.to_tiles(gray), threshold), "int")


def grid(spark: SparkSession, height: int, width: int, spacing: int = 1) -> DataFrame:
    """y, x of every ``spacing``-th row and column."""
    wide = -(-width // spacing)
    k = spark.range(-(-height // spacing) * wide)
    return k.select((F.floor(F.col("id") / wide) * spacing).alias("y"), (F.col("id") % wide * spacing).alias("x"))


def warp_affine(pixels: DataFrame, m: np.ndarray, height: int, width: int) -> DataFrame:
    """The image under the map ``m``, bilinear, 0 outside: each target pixel looks up its origin."""
    return raster.to_pixels(raster.sampled(raster.to_tiles(pixels), raster.affine_origin(m), height, width))


def warp_spline(pixels: DataFrame, points: np.ndarray, w: np.ndarray, height: int, width: int) -> DataFrame:
    """The image sampled at each pixel less its spline displacement."""
    return raster.to_pixels(raster.sampled(raster.to_tiles(pixels), raster.spline_origin(points, w), height, width))


def resize(pixels: DataFrame, old: tuple[int, int], new: tuple[int, int], nearest: bool = False) -> DataFrame:
    """y, x, value of the image at another size (height, width): linear between pixel centres, clamped at the border, or nearest."""
    return raster.to_pixels(raster.sampled(raster.to_tiles(pixels), raster.resize_origin(old, new, nearest), *new))


def to_bytes(pixels: DataFrame) -> DataFrame:
    """Values 0 to 1 as 0 to 255, truncated."""
    return pixels.withColumn("value", F.floor(F.col("value") * 255).cast("int"))


def _dense(pixels: DataFrame, height: int, width: int) -> np.ndarray:
    return raster.gathered(raster.to_tiles(pixels), height, width)


def _sampled(image: np.ndarray, m: np.ndarray, height: int, width: int) -> np.ndarray:
    back = np.linalg.inv(m)
    y, x = np.mgrid[:height, :width]
    sx, sy = (back[i, 0] * x + back[i, 1] * y + back[i, 2] for i in range(2))
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    out = np.zeros((height, width))
    for dy in (0, 1):
        for dx in (0, 1):
            yy, xx = y0 + dy, x0 + dx
            inside = (yy >= 0) & (yy < image.shape[0]) & (xx >= 0) & (xx < image.shape[1])
            share = np.where(dy, sy - y0, 1 - (sy - y0)) * np.where(dx, sx - x0, 1 - (sx - x0))
            out[inside] += (share * inside)[inside] * image[yy[inside], xx[inside]]
    return out


def _edges(image: np.ndarray) -> np.ndarray:
    p = np.pad(image, 1, mode="edge")
    rows, columns = p[:-2] + 2 * p[1:-1] + p[2:], p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    return np.sqrt(((rows[:, 2:] - rows[:, :-2]) ** 2 + (columns[2:] - columns[:-2]) ** 2) / 32)


def simplex_search(cost, start: np.ndarray, rounds: int = 100, near: float = 1e-4) -> tuple[np.ndarray, float]:
    """Nelder-Mead with the usual coefficients; the first simplex changes each number by 5 % (a zero by 0.00025)."""
    points = [np.array(start, float)]
    for i in range(len(start)):
        p = points[0].copy()
        p[i] = p[i] * 1.05 if p[i] else 0.00025
        points.append(p)
    ranked = sorted(((cost(p), i, p) for i, p in enumerate(points)), key=lambda r: r[:2])
    ranked = [(v, p) for v, _, p in ranked]
    for _ in range(rounds):
        if max(abs(v - ranked[0][0]) for v, _ in ranked) <= near and max(np.abs(p - ranked[0][1]).max() for _, p in ranked) <= near:
            break
        worst, centre = ranked[-1], np.mean([p for _, p in ranked[:-1]], axis=0)
        at = lambda t: (lambda p: (cost(p), p))(centre + t * (worst[1] - centre))  # noqa: E731, B023
        new = at(-1.0)
        if new[0] < ranked[0][0]:
            far = at(-2.0)
            new = far if far[0] < new[0] else new
        elif new[0] >= ranked[-2][0]:
            inner = at(-0.5) if new[0] < worst[0] else at(0.5)
            new = inner if inner[0] < min(new[0], worst[0]) or (inner[0] <= new[0] < worst[0]) else None
        if new is None:
            best = ranked[0][1]
            ranked = [ranked[0], *[(cost(q), q) for q in (best + 0.5 * (p - best) for _, p in ranked[1:])]]
        else:
            ranked[-1] = new
        ranked.sort(key=lambda r: r[0])
    return ranked[0][1], ranked[0][0]


def _correlation_gathered(fixed: DataFrame, moving: DataFrame, fixed_size: tuple[int, int], moving_size: tuple[int, int]):
    gray, mask = raster.gathered(fixed, *fixed_size), raster.gathered(mask_tiles(fixed), *fixed_size)
    there, other = _edges(gray * mask).ravel(), raster.gathered(mask_tiles(moving), *moving_size)

    def correlation(m: np.ndarray) -> float:
        seen = _edges(_sampled(other, m, *fixed_size)).ravel()
        return float(np.corrcoef(there, seen)[0, 1]) if there.std() and seen.std() else 0.0

    return correlation


def _edges_there(fixed: DataFrame, fixed_size: tuple[int, int]) -> DataFrame:
    """Tiles of the edges of ``fixed`` within its mask. Pixels that are not there count 0."""
    height, width = fixed_size
    r, f = raster.shapes(CLOSE_AND_OPEN)
    inside = raster.around(fixed, r, lambda wide, y0, x0: wide[r:-r, r:-r] * f(np.where(np.isnan(wide), np.nan, wide > 0.1), y0, x0))
    whole = raster.sampled(inside, lambda x, y: (x, y), height, width)
    return raster.around(whole, 1, raster.edges(height, width))


def _correlation_sent(fixed: DataFrame, moving: DataFrame, fixed_size: tuple[int, int], moving_size: tuple[int, int]):
    """The same figure by one Spark job for each map, in which nothing is shuffled: the mask of ``moving`` is sent to every task once, a bit
    a pixel, and the edges of ``fixed`` lie in memory, cut to the image. Returns it and what frees both."""
    spark = fixed.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    there = raster.cut(_edges_there(fixed, fixed_size), *fixed_size).repartition(parts, "y0", "x0").persist()
    n, mean = there.count(), raster.cut_mean(there)
    bits = spark.sparkContext.broadcast(raster.gathered_bits(mask_tiles(moving), *moving_size))

    def correlation(m: np.ndarray) -> float:
        return raster.correlation_with_bits(there, bits, m, fixed_size, moving_size, mean) if n else 0.0

    return correlation, lambda: (there.unpersist(), bits.destroy())


def _correlation_distributed(fixed: DataFrame, moving: DataFrame, fixed_size: tuple[int, int]):
    """The same figure by one Spark job for each map, so that no image is gathered. Pixels that are not there count 0."""
    height, width = fixed_size
    there = settled(_edges_there(fixed, fixed_size))
    other = settled(mask_tiles(moving))

    def correlation(m: np.ndarray) -> float:
        return raster.correlation(there, raster.around(raster.sampled(other, raster.affine_origin(m), height, width), 1, raster.edges(height, width)))

    return correlation


def refine(fixed: DataFrame, moving: DataFrame, m: np.ndarray, fixed_size: tuple[int, int], moving_size: tuple[int, int], rounds: int = 100, max_pixels: int = 1_000_000, max_sent: int = 1_000_000_000) -> tuple[np.ndarray, float]:
    """The affine map (3 x 3) whose warped mask of ``moving`` has edges that correlate best with those of ``fixed``, and that correlation.

    The edges of ``fixed`` are those of its gray values within its mask. Without edges on either side the map stays, with correlation 0.
    Images of up to ``max_pixels`` are gathered; for larger ones each map that the search tries is a Spark job, with the same figures: up
    to ``max_sent`` pixels of ``moving`` one pass over ``fixed``, beyond that with shuffles of both.
    """
    fixed, moving = (settled(raster.to_tiles(image)) for image in (fixed, moving))
    free = lambda: None
    if max(a * b for a, b in (fixed_size, moving_size)) <= max_pixels:
        correlation = _correlation_gathered(fixed, moving, fixed_size, moving_size)
    elif moving_size[0] * moving_size[1] <= max_sent:
        correlation, free = _correlation_sent(fixed, moving, fixed_size, moving_size)
    else:
        correlation = _correlation_distributed(fixed, moving, fixed_size)

    def full(p: np.ndarray) -> np.ndarray:
        return np.array([[p[0], p[1], p[4]], [p[2], p[3], p[5]], [0, 0, 1]])

    def cost(p: np.ndarray) -> float:
        return 0.0 if abs(np.linalg.det(full(p))) < 1e-12 else -correlation(full(p))

    try:
        p, value = simplex_search(cost, np.array([m[0, 0], m[0, 1], m[1, 0], m[1, 1], m[0, 2], m[1, 2]]), rounds)
    finally:
        free()
    return full(p), -value


def landmark_errors(marks: DataFrame, m: np.ndarray, points: np.ndarray, w: np.ndarray) -> DataFrame:
    """landmark_id, he_x, he_y, error: how far each mapped landmark (maldi_x, maldi_y) is from its partner."""
    x, y = geometry.forward(F.col("maldi_x"), F.col("maldi_y"), m, points, w)
    dx, dy = x - F.col("he_x"), y - F.col("he_y")
    return marks.select("landmark_id", "he_x", "he_y", F.sqrt(dx * dx + dy * dy).alias("error"))


def displacements(rows: DataFrame, m: np.ndarray, points: np.ndarray, w: np.ndarray, least: float = 1.0) -> DataFrame:
    """Adds affine_x, affine_y, dx, dy, size, drawn to rows of maldi_x, maldi_y: the spline's part of the map."""
    ax, ay = geometry.affine(F.col("maldi_x"), F.col("maldi_y"), m)
    rows = rows.select("*", ax.alias("affine_x"), ay.alias("affine_y"))
    dx, dy = (geometry.tps(F.col("affine_x"), F.col("affine_y"), points, w[:, i]) for i in range(2))
    rows = rows.select("*", dx.alias("dx"), dy.alias("dy"))
    size = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    return rows.select("*", size.alias("size"), (size > least).alias("drawn"))


def vector_field(spark: SparkSession, height: int, width: int, m: np.ndarray, points: np.ndarray, w: np.ndarray, n: int = 20, least: float = 1.0) -> DataFrame:
    """``displacements`` on n by n points, ends included."""
    k = spark.range(n * n).select((F.col("id") % n * (width / (n - 1))).alias("maldi_x"), (F.floor(F.col("id") / n) * (height / (n - 1))).alias("maldi_y"))
    return displacements(k, m, points, w, least)


class Registration:
    """Landmarks (n, 2) of both images to a similarity map, refined if asked for, and the spline of what remains."""

    def __init__(self, marks: np.ndarray, seen: np.ndarray, fixed: DataFrame | None = None, moving: DataFrame | None = None, fixed_size: tuple[int, int] | None = None, moving_size: tuple[int, int] | None = None, rounds: int = 100):
        self.affine, self.correlation = geometry.fit_similarity(marks, seen), None
        if fixed is not None:
            self.affine, self.correlation = refine(fixed, moving, self.affine, fixed_size, moving_size, rounds)
        self.points = marks @ self.affine[:2, :2].T + self.affine[:2, 2]
        self.spline = geometry.fit_tps(self.points, seen - self.points)

    def coordinate_map(self, pixels: DataFrame, spacing: int = 1, size: tuple[int, int] | None = None, threshold: float = 0.1) -> DataFrame:
        """maldi_x, maldi_y, he_x, he_y: of every ``spacing``-th tissue pixel in row-major order, or of a whole grid if ``size`` is given."""
        if size is None:
            rows = geometry.strided_list(tissue_mask(pixels, threshold).where("value = 1"), spacing)
        else:
            rows = grid(pixels.sparkSession, *size, spacing)
        rows = rows.select(F.col("x").cast("double").alias("maldi_x"), F.col("y").cast("double").alias("maldi_y"))
        x, y = geometry.forward(F.col("maldi_x"), F.col("maldi_y"), self.affine, self.points, self.spline)
        return rows.select("maldi_x", "maldi_y", x.alias("he_x"), y.alias("he_y"))
