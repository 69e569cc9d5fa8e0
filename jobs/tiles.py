"""Batch job: a table of peaks becomes a table of tiles by mass feature, and a catalogue of the features.

    python -m jobs.tiles --peaks DIR --output DIR [--config FILE]

Peaks (pixel_id, peak_idx, x, y, mz, intensity) above ``min_intensity`` are grouped along the mass axis into features of at least
``min_count`` peaks closer than ``tolerance`` (null: ``look_ahead`` times the mean distance of so many peaks); a feature's catalogue row has its masses, its number of peaks and the share of pixels that
have it; its tiles have the median intensity over their pixels, pixels without the feature counting as 0. ``output`` gets two
Parquet tables, ``tiles`` and ``catalogue``, partitioned by mass band (the feature's least mass over ``band``, whole part). Features are named
by their number in order of mass.

A rerun replaces both tables as a whole with the same rows. Intermediate tables lie in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.base import LOG, command_line, defaults_of, own_folder
from spectrel.operators import features, peaks
from spectrel.runtime import settled

#: The tables that are written.
CATALOGUE = "feature long, mz_low double, mz_high double, n_peaks long, n_pixels long, occupancy double, band int"
TILES = "tile_x long, tile_y long, feature long, value double, band int"
COLUMNS = ["pixel_id", "peak_idx", "x", "y", "mz", "intensity"]


def run_on(spark: SparkSession, rows: DataFrame, output: str, config: dict) -> None:
    """The job on a frame of peaks."""
    rows = rows.select(*COLUMNS).where("x is not null and y is not null and mz is not null")
    tolerance = config["tolerance"]
    if tolerance is None:
        all_ = rows.where(F.col("intensity") > config["min_intensity"]).agg(F.min("mz").alias("lo"), F.max("mz").alias("hi"), F.count(F.lit(1)).alias("n")).first()
        tolerance = (all_.hi - all_.lo) / all_.n * config["min_count"] * config["look_ahead"] if all_.n else 0.0
        LOG.info("the tolerance is %g", tolerance)
    clustered = peaks.cluster(rows, config["min_intensity"], config["min_count"], tolerance, ["pixel_id", "peak_idx", "intensity"])
    # One row for a pixel and feature, from which all else follows.
    cells = clustered.groupBy("x", "y", F.col("cluster_label").alias("feature")).agg(F.sum("intensity").alias("value"), F.min("mz").alias("low"), F.max("mz").alias("high"), F.count(F.lit(1)).alias("n"))
    cells = settled(cells)
    LOG.info("found %d peaks of features", cells.agg(F.sum("n")).first()[0] or 0)
    spots = cells.select("x", "y").distinct().count()
    masses = cells.groupBy("feature").agg(F.min("low").alias("mz_low"), F.max("high").alias("mz_high"), F.sum("n").alias("n_peaks"), F.count(F.lit(1)).alias("n_pixels"))
    catalogue = settled(masses.select("*", (F.col("n_pixels") / spots).alias("occupancy"), F.floor(F.col("mz_low") / config["band"]).cast("int").alias("band")))
    tiles = features.tile_median(cells.select("x", "y", "feature", "value"), config["grid_size"], summed=True)
    for name, table in (("catalogue", catalogue), ("tiles", tiles.join(catalogue.select("feature", "band"), "feature"))):
        # A band's features are spread over files, so that a band with most of them is no single task.
        dealt = table.repartition("band", F.pmod(F.xxhash64("feature"), F.lit(8)))
        dealt.write.mode("overwrite").partitionBy("band").parquet(f"{output}/{name}")
        LOG.info("wrote %d rows to %s/%s", spark.read.schema(table.schema).parquet(f"{output}/{name}").count(), output, name)


def run(spark: SparkSession, peaks: str, output: str, config: dict | None = None) -> None:
    """The job on a Parquet table of peaks."""
    rows = spark.read.parquet(peaks)
    LOG.info("read %d peaks from %s", rows.count(), peaks)
    run_on(spark, rows, output, config or defaults_of("tiles"))


def result(spark: SparkSession, output: str) -> DataFrame:
    """Each tile's row with what the catalogue says of its feature."""
    catalogue = spark.read.schema(CATALOGUE).parquet(f"{output}/catalogue").drop("band")
    return spark.read.schema(TILES).parquet(f"{output}/tiles").join(catalogue, "feature").select("band", "feature", "tile_x", "tile_y", "value", "mz_low", "mz_high", "n_peaks", "n_pixels", F.round("occupancy", 9).alias("occupancy"))


def job1_mass_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as peaks: an order is a pixel's spectrum, a price a mass."""
    output = own_folder(spark, "tiles")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey").alias("pixel_id"), F.col("l_linenumber").alias("peak_idx"), F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"),
        F.col("l_extendedprice").alias("mz"), F.col("l_quantity").alias("intensity"),
    )
    for _ in range(2):
        run_on(spark, rows, output, defaults_of("tiles"))
    return result(spark, output)


SQL = """
with s as (select l_orderkey pixel_id, l_linenumber peak_idx, l_partkey x, l_suppkey y, l_extendedprice mz, l_quantity intensity from lineitem where l_quantity > 5),
a as (select *, row_number() over w as rn, coalesce(lead(mz, 10) over w - mz, 0) as delta, (max(mz) over () - min(mz) over ()) / count(*) over () * 10 * 1.5 as tol from s window w as (order by mz, pixel_id, peak_idx, intensity)),
b as (select *, case when delta < tol then 1 else 0 end as d from a),
c as (select *, lag(d) over (order by rn) as before from b),
e as (select *, sum(greatest(d - coalesce(before, d), 0)) over (order by rn) as r from c),
f as (select *, cast(case when before is null then d else before * r end as bigint) as feature from e),
g as materialized (select x, y, mz, intensity, feature from (select *, count(*) over (partition by feature) as k from f where feature <> 0) where k >= 10),
n as (select count(*) as n from (select distinct x, y from g)),
l as (select feature, min(mz) as mz_low, max(mz) as mz_high, count(*) as n_peaks, count(distinct (x, y)) as n_pixels from g group by feature),
v as materialized (select x, y, feature, sum(intensity) as v from g group by all),
u as (select cast(ceil(1 / sqrt(400.0 / ((max(x) + 1) * (max(y) + 1)))) as bigint) as u from v),
p as (select distinct x, y from v), t as (select distinct x // u as tx, y // u as ty, feature from v, u),
m as (select p.x // u as tile_x, p.y // u as tile_y, t.feature, coalesce(v.v, 0) as v from p, u join t on t.tx = p.x // u and t.ty = p.y // u left join v on v.x = p.x and v.y = p.y and v.feature = t.feature)
select cast(floor(mz_low / 10000) as integer) as band, feature, tile_x, tile_y, median(v) as value, mz_low, mz_high, n_peaks, n_pixels, round(n_pixels / n, 9) as occupancy
from m join l using (feature), n group by all
"""

if __name__ == "__main__":
    command_line(__doc__, "tiles", {"peaks": "Parquet table of peaks", "output": "folder of the two tables"}, run)
