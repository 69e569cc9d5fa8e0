"""Peaks: array filters, explode, and density clustering along the mass axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectrel.runtime import settled


def trim(spectra: DataFrame, lo: float, hi: float, mzs: str = "mzs", intensities: str = "intensities") -> DataFrame:
    """Keep the peaks with lo <= m/z <= hi in both arrays; spectra without one go."""
    pairs = F.filter(F.arrays_zip(F.col(mzs).alias("m"), F.col(intensities).alias("i")), lambda p: p["m"].between(lo, hi))
    kept = spectra.withColumn("_p", pairs).where(F.size("_p") > 0)
    return kept.withColumn(mzs, F.transform("_p", lambda p: p["m"])).withColumn(intensities, F.transform("_p", lambda p: p["i"])).drop("_p")


def explode(spectra: DataFrame, mzs: str = "mzs", intensities: str = "intensities") -> DataFrame:
    """A row per peak: the other columns, peak_idx, mz, intensity. Empty arrays give one row of nulls; unequal lengths raise."""
    same = F.when(F.size(mzs) == F.size(intensities), F.arrays_zip(F.col(mzs).alias("mz"), F.col(intensities).alias("intensity"))).otherwise(F.raise_error(F.lit("arrays of unequal length")))
    others = [c for c in spectra.columns if c not in (mzs, intensities)]
    return spectra.select(*others, F.posexplode_outer(same).alias("peak_idx", "p")).select(*others, "peak_idx", F.col("p.mz").alias("mz"), F.col("p.intensity").alias("intensity"))


NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def is_wide(df: DataFrame) -> bool:
    """Whether the frame holds spectra (arrays mzs and intensities) rather than peaks (numbers mz and intensity), at pixels x, y.

    A missing column is a ValueError, a column of another type a TypeError.
    """
    kinds = dict(df.dtypes)
    wide = "mzs" in kinds
    names = ("mzs", "intensities") if wide else ("mz", "intensity")
    if missing := [c for c in (*names, "x", "y") if c not in kinds]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    number = lambda kind: kind.split("(")[0] in NUMBERS
    right = lambda c: number(kinds[c].removeprefix("array<").removesuffix(">")) and kinds[c].startswith("array<") == (wide and c in names)
    if wrong := [c for c in (*names, "x", "y") if not right(c)]:
        raise TypeError("; ".join(f"{c} is {kinds[c]}" for c in wrong))
    return wide


def long_form(df: DataFrame) -> DataFrame:
    """Peaks of a frame of spectra or of peaks."""
    return explode(df).where("mz is not null") if is_wide(df) else df


def coerce(c: Column | str) -> Column:
    """Double, or null where the text is no number."""
    return (F.col(c) if isinstance(c, str) else c).cast("string").try_cast("double")


def by_size(df: DataFrame, least: int, *keys: str) -> DataFrame:
    """Rows of groups with at least ``least`` rows: a count that is combined before the shuffle, then a semi-join that Spark may split."""
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(*keys)
    return df.join(large, list(keys), "left_semi")


def numbered(df: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """Adds ``rn``, the 0-based rank in the order, without a single-partition sort: ranges, settled with each row's place in its range, plus offsets (one number a range)."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The id is the range's number and, in its low 33 bits, the row's place in the range, which is sorted by then.
    dealt = settled(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    own = F.shiftright("_m", 33).alias("_p")
    counts = dealt.groupBy(own).agg(F.count(F.lit(1)).alias("_c"))
    offsets = counts.withColumn("_o", F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).select("_p", F.coalesce("_o", F.lit(0)).alias("_o"))
    placed = dealt.select(*df.columns, own, F.col("_m").bitwiseAND((1 << 33) - 1).alias("_l"))
    return placed.join(F.broadcast(offsets), "_p").withColumn("rn", F.col("_o") + F.col("_l")).drop("_p", "_l", "_o")  # one row a range


def cluster(peaks: DataFrame, min_intensity: float, min_count: int, tol: float, tiebreak: list[str], chunk: int = 200_000) -> DataFrame:
    """Peaks with a cluster label, as the shifted-run rule gives it.

    In order of m/z a row is dense if the row ``min_count`` further on is nearer than ``tol`` (the last ``min_count`` rows are
    dense); each rise from sparse to dense starts a number; a row takes the number of the row before it if that is dense. The
    first row takes its own density. Label 0 goes, and so do labels with fewer than ``min_count`` rows.

    Rows are ranked globally and cut into chunks of ranks; a chunk also gets the ``min_count`` rows after it and the two before it,
    so every look-ahead stays inside; numbers are added up by chunk.
    """
    if min_count < 0:
        raise ValueError("min_count must not be negative")
    strong = peaks.where(F.col("intensity") > min_intensity)
    order = [F.col("mz"), *[F.col(c) for c in tiebreak]]
    ranked = numbered(strong, order)
    step = max(chunk, min_count + 2)
    k, r = F.floor(F.col("rn") / step), F.col("rn") % step
    copies = F.array_compact(F.array(F.struct(k.alias("c"), F.lit(True).alias("core")), F.when((r < min_count) & (k > 0), F.struct((k - 1).alias("c"), F.lit(False).alias("core"))), F.when(r >= step - 2, F.struct((k + 1).alias("c"), F.lit(False).alias("core")))))
    w = Window.partitionBy("c").orderBy("rn")
    rows = ranked.withColumn("_x", F.explode(copies)).select("*", "_x.c", "_x.core").drop("_x")
    ahead = F.lead("mz", min_count).over(w) if min_count else F.col("mz")
    dense = F.when(F.coalesce(ahead - F.col("mz"), F.lit(0.0)) < tol, 1).otherwise(0)
    # Beyond the end of the table a look-ahead counts 0; inside it never leaves the chunk and its halo.
    rows = rows.withColumn("d", dense).withColumn("before", F.lag("d").over(w))
    rows = rows.withColumn("rise", F.when(F.col("core"), F.greatest(F.col("d") - F.coalesce("before", "d"), F.lit(0))).otherwise(0))
    rows = rows.withColumn("local", F.sum("rise").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("core")
    # What follows reads this table several times, without its windows.
    rows = settled(rows.select(*peaks.columns, "c", "d", "before", "rise", "local"))
    base = rows.groupBy("c").agg(F.sum("rise").alias("s"), F.count(F.lit(1)).alias("n"))
    if (base.agg(F.sum("n")).first()[0] or 0) < min_count:
        raise ValueError("fewer rows than min_count")
    base = base.withColumn("b", F.coalesce(F.sum("s").over(Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("c", "b")
    # The rise of a row that follows a dense row is 0, so its own running number is that of the row before.
    label = F.when(F.col("before").isNull(), F.col("d")).otherwise(F.col("before") * (F.col("b") + F.col("local"))).cast("long")
    labelled = rows.join(base, "c").withColumn("cluster_label", label).where("cluster_label <> 0")
    return by_size(labelled.select(*peaks.columns, "cluster_label"), min_count, "cluster_label")


def ion_image(peaks: DataFrame, mz: float, tol: float, z: int | None = None) -> DataFrame:
    """x, y, value: the intensity within mz +- tol of every pixel, 0 where there is none; with ``z`` of that layer alone."""
    if z is not None:
        peaks = peaks.where(F.col("z") == z)
    near = F.when(F.abs(F.col("mz") - mz) <= tol, F.col("intensity")).otherwise(0.0)
    return peaks.groupBy("x", "y").agg(F.sum(near).alias("value"))
