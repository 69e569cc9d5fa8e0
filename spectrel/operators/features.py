"""Pixel-by-feature tables as long (x, y, feature, value) rows: pivot, tiles, sparsity, scaling, moments."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectrel.functions.student import t_quantile
from spectrel.operators.peaks import long_form
from spectrel.runtime import settled


def total(peaks: DataFrame, *by: str, value: str = "intensity", how: str | Callable = "sum") -> DataFrame:
    """The values of each group by a named aggregate, or by a function of the group's values (a pandas Series), which then meet."""
    if not callable(how):
        return peaks.groupBy(*by).agg(getattr(F, how)(value).alias("value"))

    def run(keys, pdf):
        import pandas as pd

        return pd.DataFrame([[*keys, float(how(pdf[value]))]], columns=[*by, "value"])

    fields = [f.simpleString() for f in peaks.select(*by).schema.fields]
    return peaks.select(*by, value).groupBy(*by).applyInPandas(run, ", ".join([*(f.replace(":", " ", 1) for f in fields), "value double"]))


def pivot(peaks: DataFrame, keys: list[str], feature: str, labels: list, value: str = "intensity") -> DataFrame:
    """The wide matrix, 0-filled, for given labels (no pass over the data to find them)."""
    return peaks.groupBy(*keys).agg(*[F.sum(F.when(F.col(feature) == x, F.col(value)).otherwise(0.0)).alias(f"f{x}") for x in labels])


def tile_size(width: int, height: int, grid_size: int) -> int:
    k = math.sqrt(grid_size / (width * height))
    if k >= 1:
        raise ValueError("tiles would be finer than pixels")
    return math.ceil(1 / k)


def _tiles(coo: DataFrame, grid_size: int) -> tuple[int, DataFrame]:
    """The side of a tile and the number n of pixels in each. Pixels are those of ``coo``."""
    top = coo.agg(F.max("x"), F.max("y")).first()
    u = 1 if top[0] is None else tile_size(int(top[0]) + 1, int(top[1]) + 1, grid_size)
    pixels = coo.select("x", "y").distinct().groupBy(F.floor(F.col("x") / u).alias("tile_x"), F.floor(F.col("y") / u).alias("tile_y"))
    return u, pixels.agg(F.count(F.lit(1)).alias("n"))


#: Values of a group that may meet in one row, bins of a round of ``at_ranks``, and groups that may be sent to every task.
LISTED, BINS, SENT = 10_000, 256, 50_000


def at_ranks(values: DataFrame, keys: list[str], ranks: DataFrame, listed: int = LISTED) -> DataFrame:
    """keys, rank, value: the values (keys, value) of each group at the 0-based ranks (keys, rank) that are asked for. Exact.

    A group of up to ``listed`` values is sorted in one row. A larger one is searched by rounds: its values are counted in bins
    between the least and the largest, combined before the shuffle, and the bin that holds the rank is searched in turn, until it is small
    or all its values are equal. So however many values a group has, they do not meet.
    """
    all_ = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    todo, done = settled(ranks.join(all_, keys).withColumn("before", F.lit(0).cast("long"))), None
    own = [*keys, "rank"]
    while True:
        large = (F.col("count") > listed) & (F.col("hi") > F.col("lo"))
        ready = todo.where(~large)
        done = ready if done is None else done.unionByName(ready)
        todo = todo.where(large)
        if not (n := todo.count()):
            break
        held = values.join(F.broadcast(todo) if n <= SENT else todo, keys).where(F.col("value").between(F.col("lo"), F.col("hi")))
        place = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))
        bins = held.groupBy(*own, "before", place.alias("bin")).agg(F.count(F.lit(1)).alias("count"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        earlier = Window.partitionBy(*own).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("before", F.col("before") + F.coalesce(F.sum("count").over(earlier), F.lit(0)))
        todo = settled(bins.where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("count"))).select(*own, "count", "lo", "hi", "before"))
    equal = done.where("lo = hi").select(*own, F.col("lo").alias("value"))
    few = settled(done.where("lo < hi"))
    met = values.join(F.broadcast(few) if few.count() <= SENT else few, keys).where(F.col("value").between(F.col("lo"), F.col("hi")))
    sorted_ = met.groupBy(*own, "before").agg(F.array_sort(F.collect_list("value")).alias("v"))
    return equal.unionByName(sorted_.select(*own, F.get("v", (F.col("rank") - F.col("before")).cast("int")).alias("value")))


def tile_median(coo: DataFrame, grid_size: int, summed: bool = False) -> DataFrame:
    """tile_x, tile_y, feature, value: exact medians in which pixels without the feature count as 0.

    The matrix is not filled: a tile's median follows from the ranks of its values and its number of pixels.
    Values must not be negative; pixels are those of ``coo``; features of a tile without a value are absent (median 0).
    ``summed``: ``coo`` is a settled table with one row for a pixel and feature, and is taken as it is.
    """
    u, pixels = _tiles(coo, grid_size)
    return _tile_values(coo, u, pixels, "median", summed=summed)


def tile_aggregate(coo: DataFrame, grid_size: int, how: str | Callable | dict = "median") -> DataFrame:
    """As ``tile_median``, by median, sum, mean, min, max, a function of the tile's values (a pandas Series, zeros included), or
    a dict from feature to one of these, which leaves out other features. Pixels without the feature count as 0 in all of them."""
    u, pixels = _tiles(coo, grid_size)
    if not isinstance(how, dict):
        return _tile_values(coo, u, pixels, how)
    out = None
    for feature, one in how.items():
        part = _tile_values(coo.where(F.col("feature") == feature), u, pixels, one)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no aggregate is given")
    return out


def _tile_values(coo: DataFrame, u: int, pixels: DataFrame, how: str | Callable, listed: int = LISTED, summed: bool = False) -> DataFrame:
    if not callable(how) and how not in ("median", "sum", "mean", "min", "max"):
        raise ValueError(f"unknown aggregate {how}")
    cell = coo if summed else coo.groupBy("x", "y", "feature").agg(F.sum("value").alias("value"))
    cell = cell.withColumn("tile_x", F.floor(F.col("x") / u)).withColumn("tile_y", F.floor(F.col("y") / u))
    of_tile = cell.groupBy("tile_x", "tile_y", "feature")
    key = ["tile_x", "tile_y"]
    if how == "median":
        whole = [*key, "feature"]
        cell = cell if summed else settled(cell)
        of = cell.groupBy(*whole).agg(F.count(F.lit(1)).alias("k")).join(pixels, key)
        middle = F.explode(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))
        asked = of.select(*whole, (F.col("n") - F.col("k")).alias("zeros"), middle.alias("rank"))
        asked = settled(asked.select(*whole, (F.col("rank") - F.col("zeros")).alias("rank")))  # the zeros come first
        found = at_ranks(cell.select(*whole, "value"), whole, asked.where("rank >= 0").distinct(), listed)
        both = asked.join(found, [*whole, "rank"], "left")
        return both.groupBy(*whole).agg((F.sum(F.coalesce("value", F.lit(0.0))) / 2).alias("value"))
    if callable(how):
        full = of_tile.agg(F.collect_list(F.col("value").cast("double")).alias("v")).join(pixels, key).select(*key, "feature", "v", "n")

        def run(frames):
            import numpy as np
            import pandas as pd

            for pdf in frames:
                values = [float(how(pd.Series(np.concatenate([v, np.zeros(n - len(v))])))) for v, n in zip(pdf["v"], pdf["n"], strict=True)]
                yield pdf[[*key, "feature"]].assign(value=values)

        kind = dict(coo.dtypes)["feature"]
        return full.mapInPandas(run, f"tile_x long, tile_y long, feature {kind}, value double")
    own = of_tile.agg(F.sum("value").alias("s"), F.max("value").alias("hi"), F.min("value").alias("lo"), F.count(F.lit(1)).alias("k"))
    if how in ("sum", "max"):
        return own.select(*key, "feature", F.col("s" if how == "sum" else "hi").alias("value"))
    value = F.col("s") / F.col("n") if how == "mean" else F.when(F.col("k") < F.col("n"), 0.0).otherwise(F.col("lo"))
    return own.join(pixels, key).select(*key, "feature", value.alias("value"))


def to_vectors(tiles: DataFrame, labels: list) -> DataFrame:
    """id, x, y, v: a row per tile with its values in the order of ``labels``, 0 where it has none. Ids count rows of tiles, x + y * 2^31."""
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("feature")) - 1
    held = tiles.select("tile_x", "tile_y", place.cast("int").alias("k"), "value").where("k >= 0").groupBy("tile_x", "tile_y").agg(F.collect_list(F.struct("k", "value")).alias("e"))
    p = len(labels)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            e = batch.column(2)
            out = np.zeros((len(batch), p))
            row = np.repeat(np.arange(len(batch)), np.diff(e.offsets.to_numpy()))
            flat = e.flatten()
            out[row, flat.field("k").to_numpy()] = flat.field("value").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(out), pa.list_(pa.float64()))], names=["x", "y", "v"])

    made = held.select(F.col("tile_x").cast("long"), F.col("tile_y").cast("long"), "e").mapInArrow(run, "x long, y long, v array<double>")
    return made.select((F.col("x") + F.col("y") * (1 << 31)).alias("id"), "x", "y", "v")


def sparsity(data: DataFrame, by: str, threshold: float | None = None) -> DataFrame:
    """feature, count, occupancy, sparsity, in order of the feature. Presence is strict: intensity > threshold. Takes spectra or peaks."""
    peaks, by = long_form(data), "mz" if by == "mzs" else by
    spots = peaks.select("x", "y").distinct().agg(F.count(F.lit(1)).alias("n"))
    there = peaks if threshold is None else peaks.where(F.col("intensity") > threshold)
    counted = there.select(F.col(by).alias("feature"), "x", "y").distinct().groupBy("feature").agg(F.count(F.lit(1)).alias("count"))
    return counted.crossJoin(F.broadcast(spots)).select("feature", "count", (F.col("count") / F.col("n")).alias("occupancy"), (1 - F.col("count") / F.col("n")).alias("sparsity")).orderBy("feature")  # one row


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """bin, count: equal widths from least to largest, the last bin closed."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    if lo is None:
        return df.select(F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("count")).limit(0)
    width = (hi - lo) or 1.0
    return df.where(F.col(column).isNotNull()).groupBy(F.least(F.floor((F.col(column) - lo) / width * bins), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """z-scores with the population deviation; constant columns go, and none left is an error. Two passes, no window."""
    found = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first().asDict()
    keep = [c for c in columns if (found[f"s_{c}"] or 0) > 0]
    if not keep:
        raise ValueError("no column varies")
    drop = set(columns) - set(keep)
    return df.select(*[((F.col(c) - found[f"m_{c}"]) / found[f"s_{c}"]).alias(c) if c in keep else F.col(c) for c in df.columns if c not in drop])


def unit_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column over its Euclidean norm; a zero norm leaves it."""
    norms = df.agg(*[F.sqrt(F.sum(F.col(c) * F.col(c))).alias(c) for c in columns]).first().asDict()
    return df.select(*[(F.col(c) / norms[c] if norms.get(c) else F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def mean_interval(df: DataFrame, column: str, t: float | None = None, level: float = 0.95) -> DataFrame:
    """mean, low, high: mean +- t * population deviation / sqrt(n); t is Student's for the level unless it is given."""
    if t is None:
        t = t_quantile((1 + level) / 2, df.agg(F.count(column)).first()[0] - 1)
    e = df.agg(F.avg(column).alias("mean"), (t * F.stddev_pop(column) / F.sqrt(F.count(column))).alias("e"))
    return e.select("mean", (F.col("mean") - F.col("e")).alias("low"), (F.col("mean") + F.col("e")).alias("high"))


def mean_by_label(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """label, v: mean vectors of (id, v) by the labels (id, label); combined before the shuffle by position."""
    flat = rows.join(labels.select("id", "label"), "id").select("label", F.posexplode("v").alias("k", "x"))
    means = flat.groupBy("label", "k").agg(F.avg("x").alias("x"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda e: e["x"]).alias("v"))


def strided(df: DataFrame, row: str, col: str, height: int, width: int, target: int) -> DataFrame:
    """Every k-th row and column, so that about ``target`` pixels stay."""
    if target <= 0:
        return df.limit(0)
    k = math.sqrt(target / (height * width))
    steps = [max(1, n // max(1, int(n * k))) for n in (height, width)]
    return df.where((F.pmod(F.col(row), F.lit(steps[0])) == 0) & (F.pmod(F.col(col), F.lit(steps[1])) == 0))


def blend(a: Column, b: Column, alpha: float, bounds: tuple[float, float, float, float]) -> Column:
    """alpha a + (1 - alpha) b, each scaled to its own range."""
    a0, a1, b0, b1 = bounds
    return alpha * (a - a0) / (a1 - a0 + 1e-8) + (1 - alpha) * (b - b0) / (b1 - b0 + 1e-8)


def covariance(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, covariance (of the sample), correlation of each pair of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    got = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.covar_samp(a, b).alias("covariance"), F.corr(a, b).alias("correlation")) for a, b in pairs])
    return df.agg(got.alias("p")).select(F.inline("p"))


def coverage(df: DataFrame, column: str, threshold: float) -> DataFrame:
    """One row, coverage: the percentage of values above the threshold."""
    return df.agg((100.0 * F.count_if(F.col(column) > threshold) / F.count(F.lit(1))).alias("coverage"))


def drawn(df: DataFrame, n: int, *by: str, seed: int = 0, strict: bool = False) -> DataFrame:
    """A sample of ``n`` rows: those of the smallest MD5 of seed and the columns ``by`` (ties by these columns), the same on every run.

    Fewer rows are all taken, or an error if ``strict``. Only ``n`` rows of a task go on.
    """
    if strict and df.limit(n).count() < n:
        raise ValueError(f"there are fewer than {n} rows")
    names = by or tuple(df.columns)
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]))
    return df.orderBy(key, *names).limit(n)


def feature_sample(coo: DataFrame, n: int = 100, seed: int = 0, feature: str = "feature") -> DataFrame:
    """``n`` distinct features; an error if there are fewer."""
    return drawn(coo.select(feature).distinct(), n, feature, seed=seed, strict=True)


def cluster_image(labelled: DataFrame, n: int, value: str = "intensity", label: str = "cluster_label", single: bool = False) -> DataFrame:
    """x, y, value of the n-th (from 0) label in order: sums by pixel, null where the pixel has none of it. No rows give none.

    With ``single`` a pixel with two values of the label is an error, as in a table that has been aggregated by pixel.
    """
    labels = [r[0] for r in labelled.select(label).distinct().orderBy(label).limit(n + 1).collect()]
    if not labels:
        return labelled.select("x", "y", F.col(value).alias("value"))
    if n >= len(labels):
        raise ValueError(f"there are only {len(labels)} labels")
    own = F.when(F.col(label) == labels[n], F.col(value))
    one = F.when(F.count(own) > 1, F.raise_error(F.lit("a pixel has two values of the label")).cast("double")).otherwise(F.sum(own))
    return labelled.groupBy("x", "y").agg((one if single else F.sum(own)).alias("value"))
