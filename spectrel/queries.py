"""Queries of the spectrometry operators over the driver's tables, and their SQL."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrel.operators import features, geometry, graph, peaks
from spectrel.plans import clustering, registration
from spectrel.plans.analysis import Analysis
from spectrel.plans.spaco import Spaco, significant
from spectrel.runtime import shared_folder, ship
from spectrel.sources.images import write_image
from spectrel.sources.imzml import read_image

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def peak_table(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").select(F.col("l_orderkey").alias("pixel_id"), F.col("l_linenumber").alias("peak_idx"), F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"), F.col("l_extendedprice").alias("mz"), F.col("l_quantity").alias("intensity"))


def spectra(spark: SparkSession, d: str) -> DataFrame:
    p = F.array_sort(F.collect_list(F.struct("mz", "intensity")))
    rows = peak_table(spark, d).groupBy("pixel_id").agg(p.alias("p"))
    return rows.select("pixel_id", F.transform("p", lambda x: x["mz"]).alias("mzs"), F.transform("p", lambda x: x["intensity"]).alias("intensities"))


CLUSTERS = """
with s as (select l_orderkey pixel_id, l_linenumber peak_idx, l_extendedprice mz, l_quantity intensity from lineitem where l_quantity > 5),
a as (select *, row_number() over w as rn, coalesce(lead(mz, 10) over w - mz, 0) as delta from s window w as (order by mz, pixel_id, peak_idx, intensity)),
b as (select *, case when delta < 30 then 1 else 0 end as d from a),
c as (select *, lag(d) over (order by rn) as before from b),
e as (select *, sum(greatest(d - coalesce(before, d), 0)) over (order by rn) as r from c),
f as (select *, cast(case when before is null then d else before * r end as bigint) as cluster_label from e),
g as (select *, count(*) over (partition by cluster_label) as k from f where cluster_label <> 0)
"""


def clusters(spark: SparkSession, d: str, min_count: int = 10, tol: float = 30.0) -> DataFrame:
    return peaks.cluster(peak_table(spark, d), 5, min_count, tol, ["pixel_id", "peak_idx", "intensity"])


def cluster_stats(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("cluster_label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("intensity"), 4).alias("total"))


@query(CLUSTERS + "select pixel_id, peak_idx, mz, intensity, cluster_label from g where k >= 10")
def peak_clusters(spark, d):
    return clusters(spark, d).select("pixel_id", "peak_idx", "mz", "intensity", "cluster_label")


@query(CLUSTERS + "select cluster_label, count(*) as n, round(sum(intensity), 4) as total from g where k >= 10 group by 1")
def peak_cluster_stats(spark, d):
    return cluster_stats(clusters(spark, d))


@query("select l_orderkey as pixel_id, count(*) as n, min(l_extendedprice) as lo, max(l_extendedprice) as hi, sum(l_quantity) as total from lineitem where l_extendedprice between 20000 and 40000 group by 1")
def mz_window_trim(spark, d):
    kept = peaks.trim(spectra(spark, d), 20000, 40000)
    return kept.select("pixel_id", F.size("mzs").cast("long").alias("n"), F.array_min("mzs").alias("lo"), F.array_max("mzs").alias("hi"), F.aggregate("intensities", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("select l_orderkey as pixel_id, cast(row_number() over (partition by l_orderkey order by l_extendedprice, l_quantity) - 1 as integer) as peak_idx, l_extendedprice as mz, l_quantity as intensity from lineitem")
def spectra_explode(spark, d):
    return peaks.explode(spectra(spark, d))


@query("select x, y, sum(case when abs(mz - 30000) <= 5000 then i else 0 end) as value from (select l_partkey x, l_suppkey y, l_extendedprice mz, l_quantity i from lineitem) group by x, y")
def ion_image(spark, d):
    return peaks.ion_image(peak_table(spark, d), 30000, 5000)


@query("select x, y, sum(case when abs(mz - 30000) <= 5000 then i else 0 end) as value from (select l_partkey x, l_suppkey y, l_extendedprice mz, l_quantity i from lineitem where l_linenumber = 2) group by x, y")
def ion_image_layer(spark, d):
    return peaks.ion_image(peak_table(spark, d).withColumn("z", F.col("peak_idx")), 30000, 5000, z=2)


@query("select event_id, try_cast(event_type as double) as a, try_cast(cast(value as varchar) as double) as b from events")
def type_coercion(spark, d):
    return t(spark, d, "events").select("event_id", peaks.coerce("event_type").alias("a"), peaks.coerce("value").alias("b"))


@query("select user_id, event_id from (select *, count(*) over (partition by user_id) k from events) where k >= 66")
def group_size_filter(spark, d):
    return peaks.by_size(t(spark, d, "events"), 66, "user_id").select("user_id", "event_id")


@query(CLUSTERS + ", k as (select g.*, l_partkey x, l_suppkey y from g join lineitem on l_orderkey = pixel_id and l_linenumber = peak_idx and l_extendedprice = mz where k >= 10) select x, y, sum(case when cluster_label = (select min(cluster_label) from k) then intensity end) as value from k group by 1, 2")
def cluster_ion_image(spark, d):
    return features.cluster_image(clusters(spark, d), 0)


def coo(spark, d):
    return peak_table(spark, d).select("x", "y", F.col("peak_idx").alias("feature"), F.col("intensity").alias("value"))


@query("select l_partkey x, l_suppkey y, " + ", ".join(f"sum(case when l_linenumber = {i} then l_quantity else 0 end) as f{i}" for i in range(1, 8)) + " from lineitem group by 1, 2")
def feature_matrix(spark, d):
    return features.pivot(peak_table(spark, d), ["x", "y"], "peak_idx", list(range(1, 8)))


@query("select l_partkey x, l_linenumber feature, sum(l_quantity) as value from lineitem group by 1, 2")
def feature_sum(spark, d):
    return features.total(peak_table(spark, d), "x", "peak_idx").select("x", F.col("peak_idx").alias("feature"), "value")


@query("""
with c as (select l_partkey x, l_suppkey y, l_linenumber feature, sum(l_quantity) v from lineitem group by all),
u as (select cast(ceil(1 / sqrt(400.0 / ((max(x) + 1) * (max(y) + 1)))) as bigint) u from c),
p as (select distinct x, y from c), f as (select distinct x // u tx, y // u ty, feature from c, u),
m as (select p.x // u tile_x, p.y // u tile_y, f.feature, coalesce(c.v, 0) v from p, u join f on f.tx = p.x // u and f.ty = p.y // u left join c on c.x = p.x and c.y = p.y and c.feature = f.feature)
select tile_x, tile_y, feature, median(v) as value from m group by all""")
def tile_median(spark, d):
    return features.tile_median(coo(spark, d), 400)


@query("""
with c as (select l_partkey x, l_suppkey y, l_linenumber feature, sum(l_quantity) v from lineitem group by all),
u as (select cast(ceil(1 / sqrt(400.0 / ((max(x) + 1) * (max(y) + 1)))) as bigint) u from c),
n as (select x // u tile_x, y // u tile_y, count(distinct (x, y)) n from c, u group by 1, 2)
select tile_x, tile_y, feature, round(sum(v) / any_value(n), 9) as value from c, u join n on n.tile_x = x // u and n.tile_y = y // u group by 1, 2, 3""")
def tile_mean(spark, d):
    return features.tile_aggregate(coo(spark, d), 400, "mean").withColumn("value", F.round("value", 9))


@query("""
with c as (select l_partkey x, l_suppkey y, l_linenumber feature, sum(l_quantity) v from lineitem where l_linenumber in (1, 2, 3) group by all),
u as (select cast(ceil(1 / sqrt(400.0 / ((max(l_partkey) + 1) * (max(l_suppkey) + 1)))) as bigint) u from lineitem),
p as (select distinct l_partkey x, l_suppkey y from lineitem), f as (select distinct x // u tx, y // u ty, feature from c, u),
m as (select p.x // u tile_x, p.y // u tile_y, f.feature, coalesce(c.v, 0) v from p, u join f on f.tx = p.x // u and f.ty = p.y // u left join c on c.x = p.x and c.y = p.y and c.feature = f.feature)
select tile_x, tile_y, feature, round(case feature when 1 then quantile_cont(v, 0.75) when 2 then max(v) else avg(v) end, 6) as value from m group by tile_x, tile_y, feature""")
def tile_by_feature(spark, d):
    """A function of its own for each of three features."""
    how = {1: lambda s: s.quantile(0.75), 2: "max", 3: "mean"}
    return features.tile_aggregate(coo(spark, d), 400, how).withColumn("value", F.round("value", 6))


@query("select l_linenumber feature, round(quantile_cont(l_quantity, 0.5), 6) as value from lineitem group by 1")
def feature_function(spark, d):
    return features.total(peak_table(spark, d), "peak_idx", how=lambda s: s.median()).select(F.col("peak_idx").alias("feature"), F.round("value", 6).alias("value"))


@query("with s as (select count(distinct (l_partkey, l_suppkey)) n from lineitem) select l_linenumber as feature, count(distinct (l_partkey, l_suppkey)) as count, round(count(distinct (l_partkey, l_suppkey)) / any_value(n), 9) as occupancy, round(1 - count(distinct (l_partkey, l_suppkey)) / any_value(n), 9) as sparsity from lineitem, s where l_quantity > 10 group by 1")
def feature_sparsity(spark, d):
    return features.sparsity(peak_table(spark, d), "peak_idx", 10).select("feature", "count", F.round("occupancy", 9).alias("occupancy"), F.round("sparsity", 9).alias("sparsity"))


@query("with b as (select min(value) lo, max(value) hi from events) select cast(least(floor((value - lo) / (hi - lo) * 50), 49) as bigint) as bin, count(*) as count from events, b group by 1")
def histogram(spark, d):
    return features.histogram(t(spark, d, "events"), "value")


STATS = ["l_quantity", "l_extendedprice", "l_discount"]


@query("select l_orderkey, l_linenumber, " + ", ".join(f"round((l_{c} - avg(l_{c}) over ()) / stddev_pop(l_{c}) over (), 6) as z_{c}" for c in ("quantity", "extendedprice", "discount")) + " from lineitem")
def standardize(spark, d):
    return features.standardise(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *STATS), STATS).select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c.replace("l_", "z_", 1)) for c in STATS])


@query("select round(l_quantity / sqrt(sum(l_quantity * l_quantity) over ()), 9) as q, l_orderkey, l_linenumber from lineitem")
def unit_columns(spark, d):
    return features.unit_columns(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"]).select(F.round("l_quantity", 9).alias("q"), "l_orderkey", "l_linenumber")


def _pairs_sql() -> str:
    one = "select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 9) as r, round(covar_samp({a}, {b}) / 1000, 6) as c from lineitem"
    return " union all ".join(one.format(a=x, b=y) for i, x in enumerate(STATS) for y in STATS[i + 1 :])


@query(_pairs_sql())
def pearson_covariance(spark, d):
    return features.covariance(t(spark, d, "lineitem"), STATS).select("a", "b", F.round("correlation", 9).alias("r"), F.round(F.col("covariance") / 1000, 6).alias("c"))


#: Student's quantile from the normal one by its expansion in the degrees of freedom.
Z = "1.959963984540054::double"


@query(f"""with s as (select avg(value) m, stddev_pop(value) s, count(value) n, count(value) - 1.0::double v from events),
q as (select *, {Z} + ({Z} ** 3 + {Z}) / (4 * v) + (5 * {Z} ** 5 + 16 * {Z} ** 3 + 3 * {Z}) / (96 * v * v) + (3 * {Z} ** 7 + 19 * {Z} ** 5 + 17 * {Z} ** 3 - 15 * {Z}) / (384 * v * v * v) as t from s)
select round(m, 6) as mean, round(m - t * s / sqrt(n), 6) as low, round(m + t * s / sqrt(n), 6) as high from q""")
def mean_interval(spark, d):
    return features.mean_interval(t(spark, d, "events"), "value").select(*[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@query("select distinct l_partkey as feature from lineitem qualify dense_rank() over (order by md5('7|' || l_partkey), l_partkey) <= 100")
def feature_sample(spark, d):
    return features.feature_sample(t(spark, d, "lineitem").select(F.col("l_partkey").alias("feature")), 100, seed=7)


@query("select event_id, value from events order by md5('0|' || event_id), event_id limit 250")
def row_sample(spark, d):
    return features.drawn(t(spark, d, "events").select("event_id", "value"), 250, "event_id")


def pixels(spark, d):
    """The events as an image 100 wide, gray in 0 to 1."""
    e = t(spark, d, "events")
    return e.select((F.col("event_id") / 100).cast("long").alias("y"), (F.col("event_id") % 100).alias("x"), (F.pmod(F.col("value"), F.lit(1.0))).alias("value"))


def height(p: DataFrame) -> int:
    return p.agg(F.max("y")).first()[0] + 1


PX = "with p as (select event_id // 100 as y, event_id % 100 as x, value % 1.0 as value from events) "


@query(PX + "select y, x, value from p where y % 3 = 0 and x % 3 = 0")
def strided_sample(spark, d):
    p = pixels(spark, d)
    h = height(p)
    return features.strided(p, "y", "x", h, 100, h * 100 // 9)


@query(PX + "select x, y from (select *, row_number() over (order by y, x) - 1 as rn from p where value > 0.5) where rn % 7 = 0")
def tissue_grid(spark, d):
    return geometry.strided_list(pixels(spark, d).where("value > 0.5"), 7)


@query(PX + "select round(100.0 * count(*) filter (where value > 0.1) / count(*), 9) as coverage from p")
def tissue_coverage(spark, d):
    return features.coverage(pixels(spark, d), "value", 0.1).select(F.round("coverage", 9).alias("coverage"))


@query(PX + "select y, x, value from p where x >= 10 and x < 30 and y >= 5 and y < 25")
def viewport_crop(spark, d):
    return geometry.crop(pixels(spark, d), 10, 30, 5, 25)


@query(PX + "select y, x, round(0.3 * (value - lo) / (hi - lo + 1e-8) + 0.7 * (x - 0.0) / (99.0 - 0.0 + 1e-8), 9) as value from p, (select min(value) lo, max(value) hi from p)")
def overlay_blend(spark, d):
    p = pixels(spark, d)
    lo, hi = p.agg(F.min("value"), F.max("value")).first()
    return p.select("y", "x", F.round(features.blend(F.col("value"), F.col("x"), 0.3, (lo, hi, 0.0, 99.0)), 9).alias("value"))


@query(PX + """, b as (select max(y) h, 99 w from p), o as (select * from (values (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)) t(dy, dx)),
n as (select p.y, p.x, dy, dx, least(greatest(p.y + dy, 0), h) as yy, least(greatest(p.x + dx, 0), w) as xx from p, o, b),
g as (select n.y, n.x, sum(coalesce(q.value, 0) * dx * case when dy = 0 then 0.5 else 0.25 end) gx, sum(coalesce(q.value, 0) * dy * case when dx = 0 then 0.5 else 0.25 end) gy from n left join p q on q.y = yy and q.x = xx group by 1, 2)
select y, x, round(sqrt((gx * gx + gy * gy) / 2), 9) as value from g""")
def sobel(spark, d):
    p = pixels(spark, d)
    return geometry.sobel(p, height(p), 100).select("y", "x", F.round("value", 9).alias("value"))


def _morph_sql() -> str:
    out, last = PX + ", m0 as (select y, x, case when value > 0.5 then 1 else 0 end as value from p)", "m0"
    for k, (offsets, best) in enumerate(((registration.ELLIPSE_5, "max"), (registration.ELLIPSE_5, "min"), (registration.ELLIPSE_3, "min"), (registration.ELLIPSE_3, "max")), 1):
        out += f", m{k} as (select m.y, m.x, {best}(q.value) as value from {last} m cross join (values {', '.join(map(str, offsets))}) o(dy, dx) join {last} q on q.y = m.y + o.dy and q.x = m.x + o.dx group by 1, 2)"
        last = f"m{k}"
    return out + f" select y, x, value from {last}"


@query(_morph_sql())
def tissue_mask(spark, d):
    return registration.tissue_mask(pixels(spark, d), 0.5)


@query(PX + """, b as (select max(y) + 1 h from p), t as (select i // 60 as y, i % 60 as x from range(90 * 60) r(i)),
s as (select y, x, least(greatest((y + 0.5::double) * (h / 90.0::double) - 0.5, 0), h - 1) sy, least(greatest((x + 0.5::double) * (100 / 60.0::double) - 0.5, 0), 99) sx from t, b),
c as (select *, floor(sy) y0, floor(sx) x0 from s)
select c.y, c.x, round(sum(coalesce(p.value, 0) * case when dy = 1 then sy - y0 else 1 - (sy - y0) end * case when dx = 1 then sx - x0 else 1 - (sx - x0) end), 6) as value
from c cross join (values (0, 0), (0, 1), (1, 0), (1, 1)) o(dy, dx) left join p on p.y = y0 + dy and p.x = x0 + dx group by 1, 2""")
def image_resize(spark, d):
    p = pixels(spark, d)
    return registration.resize(p, (height(p), 100), (90, 60)).select("y", "x", F.round("value", 6).alias("value"))


@query(PX + "select y, x, cast(floor(value * 255) as integer) as value from p")
def image_bytes(spark, d):
    return registration.to_bytes(pixels(spark, d))


@query(PX + "select cast(y as integer) as y, cast(x as integer) as x, cast(floor(value * 255) as integer) as value from p")
def image_file(spark, d):
    """The image as a file, read back."""
    p = pixels(spark, d)
    path = f"{shared_folder(spark).rstrip('/')}/spectrel/{spark.sparkContext.applicationId}/image-{uuid.uuid4().hex}.tif"
    write_image(registration.to_bytes(p), path, height(p), 100)
    return read_image(spark, path).select("y", F.col("x").cast("int").alias("x"), F.col("r").alias("value"))


@query(PX + ", m as (select y, x, case when value > 0.5 then 1 else 0 end as value from p) select a.y, a.x, max(b.value) as value from m a join m b on (b.y = a.y and abs(b.x - a.x) <= 1) or (b.x = a.x and abs(b.y - a.y) = 1) group by 1, 2")
def mask_dilate(spark, d):
    m = pixels(spark, d).withColumn("value", F.when(F.col("value") > 0.5, 1).otherwise(0))
    return geometry.morph(m, [(0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)], True)


@query(PX + "select a.y, a.x, round(0.25 * coalesce(a.value, 0) + 0.25 * coalesce(b.value, 0) + 0.25 * coalesce(c.value, 0) + 0.25 * coalesce(e.value, 0), 9) as value from p a left join p b on b.y = a.y and b.x = a.x + 1 left join p c on c.y = a.y + 1 and c.x = a.x left join p e on e.y = a.y + 1 and e.x = a.x + 1")
def bilinear_warp(spark, d):
    p = pixels(spark, d)
    return geometry.warp(p, p.select("y", "x", (F.col("y") + 0.5).alias("sy"), (F.col("x") + 0.5).alias("sx"))).select("y", "x", F.round("value", 9).alias("value"))


@query("select o_orderkey, o_totalprice as x2, -cast(o_custkey as double) as y2 from orders")
def rotate_coords(spark, d):
    x, y = geometry.rotate("x", "y")
    return t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("double").alias("x"), F.col("o_totalprice").alias("y")).select("o_orderkey", x.alias("x2"), y.alias("y2"))


@query("select p_partkey, round((0.299 * (p_partkey % 256) + 0.587 * p_size + 0.114 * (p_size % 7)) / 255, 9) as gray from part")
def luminance(spark, d):
    return t(spark, d, "part").select("p_partkey", F.round(geometry.luminance(F.col("p_partkey") % 256, F.col("p_size"), F.col("p_size") % 7), 9).alias("gray"))


MARKS = np.array([[0.0, 0.0], [90.0, 5.0], [10.0, 80.0], [95.0, 90.0], [50.0, 40.0]])
SEEN = np.array([[5.0, 3.0], [140.0, 20.0], [8.0, 130.0], [150.0, 145.0], [80.0, 66.0]])
AFFINE = geometry.fit_similarity(MARKS, SEEN)
MOVED = MARKS @ AFFINE[:2, :2].T + AFFINE[:2, 2]
SPLINE = geometry.fit_tps(MOVED, SEEN - MOVED)


def _similarity_by_products() -> np.ndarray:
    """The similarity map as SQL has it, by complex numbers: w = a z + b with a = sum(conj(z) w) / sum(|z|^2) of the centred points."""
    z, w = (p[:, 0] + 1j * p[:, 1] for p in (MARKS, SEEN))
    a = ((z - z.mean()).conj() * (w - w.mean())).sum() / (abs(z - z.mean()) ** 2).sum()
    b = w.mean() - a * z.mean()
    return np.array([[a.real, -a.imag, b.real], [a.imag, a.real, b.imag], [0, 0, 1]])


SQL_AFFINE = _similarity_by_products()
SQL_MOVED = np.array([[SQL_AFFINE[i, 0] * x + SQL_AFFINE[i, 1] * y + SQL_AFFINE[i, 2] for i in range(2)] for x, y in MARKS])


def _spline_by_null_space() -> np.ndarray:
    """The spline as SQL has it: weights in the space where they leave planes alone, then the plane of what remains."""
    d = np.hypot(*(SQL_MOVED[:, None] - SQL_MOVED).transpose(2, 0, 1))
    k = np.array([[r * r * np.log(r) if r else 0.0 for r in row] for row in d])
    q, r = np.linalg.qr(np.column_stack([np.ones(len(d)), SQL_MOVED]), mode="complete")
    v, null = SEEN - SQL_MOVED, q[:, 3:]
    weights = null @ np.linalg.solve(null.T @ k @ null, null.T @ v)
    return np.vstack([weights, np.linalg.solve(r[:3], q[:, :3].T @ (v - k @ weights))])


SQL_SPLINE = _spline_by_null_space()


def num(v) -> str:
    return f"({float(v)!r}::double)"


def _affine_sql(m: np.ndarray, x: str, y: str) -> list[str]:
    return [f"{num(m[i, 0])} * {x} + {num(m[i, 1])} * {y} + {num(m[i, 2])}" for i in range(2)]


def _tps_sql(x: str, y: str) -> list[str]:
    """The spline's displacements."""
    d2 = [f"(({x} - {num(p[0])}) * ({x} - {num(p[0])}) + ({y} - {num(p[1])}) * ({y} - {num(p[1])}))" for p in SQL_MOVED]
    return [f"({num(w[-3])} + {num(w[-2])} * {x} + {num(w[-1])} * {y}" + "".join(f" + {num(c)} * case when {d} > 0 then 0.5::double * {d} * ln(case when {d} > 0 then {d} else 1 end) else 0 end" for c, d in zip(w[:-3], d2, strict=True)) + ")" for w in SQL_SPLINE.T]


def _forward_sql(source: str) -> str:
    """Columns of ``source`` with ax, ay, dx, dy of its maldi_x, maldi_y."""
    a, s = _affine_sql(SQL_AFFINE, "maldi_x", "maldi_y"), _tps_sql("ax", "ay")
    return f"(select *, {s[0]} as dx, {s[1]} as dy from (select *, {a[0]} as ax, {a[1]} as ay from {source}))"


def mapped(spark, d):
    p = pixels(spark, d).select(F.col("x").cast("double").alias("maldi_x"), F.col("y").cast("double").alias("maldi_y"))
    x, y = geometry.forward(F.col("maldi_x"), F.col("maldi_y"), AFFINE, MOVED, SPLINE)
    return p.select("maldi_x", "maldi_y", x.alias("he_x"), y.alias("he_y"))


@query("select maldi_x, maldi_y, round(ax + dx, 5) as he_x, round(ay + dy, 5) as he_y from " + _forward_sql("(select event_id % 100 * 1.0::double as maldi_x, event_id // 100 * 1.0::double as maldi_y from events)"))
def coordinate_map(spark, d):
    return mapped(spark, d).select("maldi_x", "maldi_y", F.round("he_x", 5).alias("he_x"), F.round("he_y", 5).alias("he_y"))


#: The parts as landmarks that the spline was not made of: where a part is, and where it was seen.
PART_MARKS = "p_partkey as landmark_id, p_partkey % 97 * 1.0D as maldi_x, p_size * 1.5D as maldi_y, p_partkey % 97 * 1.6D + p_retailprice % 5 as he_x, p_size * 2.3D + p_retailprice % 3 as he_y"


@query("select landmark_id, round(sqrt((ax + dx - he_x) ** 2 + (ay + dy - he_y) ** 2), 5) as error from " + _forward_sql("(select " + PART_MARKS.replace("D ", "::double ") + " from part)"))
def landmark_errors(spark, d):
    marks = t(spark, d, "part").selectExpr(*PART_MARKS.split(", "))
    return registration.landmark_errors(marks, AFFINE, MOVED, SPLINE).select("landmark_id", F.round("error", 5).alias("error"))


@query("select maldi_x, maldi_y, round(dx, 4) + 0.0 as dx, round(dy, 4) + 0.0 as dy, sqrt(dx * dx + dy * dy) > 1 as drawn from " + _forward_sql("(select event_id % 100 * 1.0::double as maldi_x, event_id // 100 * 1.0::double as maldi_y from events)"))
def vector_field(spark, d):
    """At all pixels of the image."""
    rows = pixels(spark, d).select(F.col("x").cast("double").alias("maldi_x"), F.col("y").cast("double").alias("maldi_y"))
    return registration.displacements(rows, AFFINE, MOVED, SPLINE).select("maldi_x", "maldi_y", (F.round("dx", 4) + 0.0).alias("dx"), (F.round("dy", 4) + 0.0).alias("dy"), "drawn")  # no negative zeros


def _warp_sql(sx: str, sy: str) -> str:
    """Bilinear samples of the image on a grid of 160 by 160."""
    return PX + f""", t as (select i // 160 as y, i % 160 as x from range(25600) r(i)), s as (select y, x, {sx} as sx, {sy} as sy from t),
c as (select *, cast(floor(sy) as bigint) y0, cast(floor(sx) as bigint) x0 from s)
select c.y, c.x, round(sum(coalesce(p.value, 0) * case when dy = 1 then sy - y0 else 1 - (sy - y0) end * case when dx = 1 then sx - x0 else 1 - (sx - x0) end), 6) as value
from c cross join (values (0, 0), (0, 1), (1, 0), (1, 1)) o(dy, dx) left join p on p.y = y0 + dy and p.x = x0 + dx group by 1, 2"""


@query(_warp_sql(*_affine_sql(np.linalg.inv(SQL_AFFINE), "x", "y")))
def affine_warp(spark, d):
    return registration.warp_affine(pixels(spark, d), AFFINE, 160, 160).select("y", "x", F.round("value", 6).alias("value"))


@query(_warp_sql(*(f"{c} - {e}" for c, e in zip("xy", _tps_sql("x", "y"), strict=True))))
def spline_warp(spark, d):
    return registration.warp_spline(pixels(spark, d), MOVED, SPLINE, 160, 160).select("y", "x", F.round("value", 6).alias("value"))


@query()
def registered_map(spark, d):
    """Landmarks, refinement on the image itself and its mask, spline, and the map of all tissue pixels."""
    p = pixels(spark, d)
    size = (height(p), 100)
    return registration.Registration(MARKS, MARKS + np.array([2.0, 1.0]), p, p, size, size).coordinate_map(p, threshold=0.5)


@query()
def inverse_map(spark, d):
    ship(spark)
    return geometry.inverse(mapped(spark, d), "he_x", "he_y", AFFINE, MOVED, SPLINE)


def annotations(spark, d):
    return t(spark, d, "events").select(F.col("event_id").alias("seq"), (F.col("event_id") % 100).alias("x"), (F.col("event_id") / 100).cast("long").alias("y"))


def _nearest_sql(x: float, y: float, zoom: float) -> str:
    """The nearest point if it lies within the radius, else the last."""
    return f"""(select case when min(dist) < 100.0 / {zoom} then arg_min(seq, (dist, seq)) else max(seq) end as seq from (
      select seq, sqrt((x - {x}) * (x - {x}) + (y - {y}) * (y - {y})) as dist from (select event_id as seq, event_id % 100 as x, event_id // 100 as y from events)))"""


@query("select seq from " + _nearest_sql(50.0, 5.0, 1.0))
def nearest_annotation(spark, d):
    return geometry.nearest(annotations(spark, d), 50.0, 5.0, 1.0)


@query("select seq from " + _nearest_sql(50.3, 5.4, 500.0))
def nearest_annotation_beyond(spark, d):
    """No point is within the radius, so the last one is named."""
    return geometry.nearest(annotations(spark, d), 50.3, 5.4, 500.0)


@query("select event_id as seq, event_id % 100 as x, event_id // 100 as y from events where event_id <> " + _nearest_sql(50.3, 5.4, 20.0))
def undo_annotation(spark, d):
    return geometry.undo(annotations(spark, d), 50.3, 5.4, 20.0)


@query("select event_id, cast(least(greatest(cast(trunc(event_id / 1.25 + 7.0) as integer), 0), 639) as integer) as px from events")
def screen_to_pixel(spark, d):
    return t(spark, d, "events").select("event_id", geometry.screen_to_pixel(F.col("event_id"), 7.0, 1.25, 640).alias("px"))


def points(spark, d):
    return t(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 100).alias("x"), F.pmod(F.col("c_custkey") * 37, F.lit(101)).cast("double").alias("y"))


PTS = "with p as (select c_custkey id, c_acctbal / 100 x, ((c_custkey * 37) % 101) * 1.0::double y from customer), k as (select a.id src, b.id dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) w from p a, p b), e as (select src, dst, w from (select *, row_number() over (partition by src order by w, dst) r from k) where r <= 10) "


@query(PTS + "select src, dst, round(w, 9) as w from e")
def knn_euclid(spark, d):
    return graph.knn(points(spark, d), 10).select("src", "dst", F.round("w", 9).alias("w"))


@query(PTS + ", s as (select src, dst from (select *, row_number() over (partition by src order by w, dst) r from k where src <> dst) where r <= 4) select src, dst, 1.0::double as w from s union select dst, src, 1.0::double from s")
def knn_symmetric(spark, d):
    return graph.symmetric(graph.knn(points(spark, d), 4, with_self=False))


@query(PTS + "select least(src, dst) a, greatest(src, dst) b, round(sum(w), 9) as w from e group by 1, 2")
def undirected_graph(spark, d):
    return graph.undirected(graph.knn(points(spark, d), 10)).select("a", "b", F.round("w", 9).alias("w"))


@query(PTS + "select src as id, round(sum(w * x), 6) as y from e join p on p.id = e.dst group by 1")
def graph_matvec(spark, d):
    p = points(spark, d)
    return graph.matvec(graph.knn(p, 10), p.select("id", "x")).select("id", F.round("y", 6).alias("y"))


@query(PTS + "select round((select sum(x * x) / count(*) from p) + (select sum(w * a.x * b.x) from e join p a on a.id = src join p b on b.id = dst) / (select sum(w) from e), 6) as q")
def graph_quadratic_form(spark, d):
    p = points(spark, d)
    return graph.quadratic_form(graph.knn(p, 10), p.select("id", "x")).select(F.round("q", 6).alias("q"))


def vectors(spark, d):
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


@query("""with e as (select vec_id id, list_transform(embedding, lambda x: x::double) v from embeddings), n as (select id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) n from e),
k as (select a.id src, b.id dst, round(1 - list_dot_product(a.v, b.v) / (a.n * b.n), 9) w from n a join n b on a.id <> b.id)
select src, dst, round(w, 5) as w from (select *, row_number() over (partition by src order by w, dst) r from k) where r <= 10""")
def knn_cosine(spark, d):
    return graph.knn_vectors(vectors(spark, d), 10, "cosine").select("src", "dst", F.round("w", 5).alias("w"))


@query()
def kmeans_features(spark, d):
    return clustering.kmeans(vectors(spark, d), 8)


def spaco(spark, d) -> Spaco:
    v = vectors(spark, d)
    return Spaco(v, graph.symmetric(graph.knn_vectors(v, 5).where("src <> dst")))


@query()
def spaco_projection(spark, d):
    return spaco(spark, d).projection()


@query()
def spaco_projected_features(spark, d):
    """The standardised features projected onto the kept components."""
    return spaco(spark, d).projected()


@query()
def spaco_loadings(spark, d):
    """A row per whitened direction: its loadings on the kept components."""
    rows = [(i, list(map(float, r))) for i, r in enumerate(spaco(spark, d).loadings)]
    return spark.createDataFrame(rows, "direction int, v array<double>")


@query()
def spaco_test(spark, d):
    return spaco(spark, d).test()


@query()
def spaco_test_raw(spark, d):
    """Every column as it is, neither centred nor scaled."""
    return spaco(spark, d).test(vectors(spark, d))


@query()
def significant_features(spark, d):
    """The vectors' columns and sixteen columns of noise about 0 that the components were not made of; few of these are below the level."""
    noise = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda k: (F.pmod(F.xxhash64("id", k), F.lit(10007)) / 10007 - 0.5).cast("double"))
    rows = vectors(spark, d).select("id", F.concat(F.transform("v", lambda x: x.cast("double")), noise).alias("v"))
    return significant(spaco(spark, d).test(rows))


@query()
def adaptive_components(spark, d):
    """Scores of the components above the cut that permutations give."""
    s = spaco(spark, d)
    s.set_cut(s.adaptive_cut())
    return s.projection()


@query()
def feature_components(spark, d):
    return clustering.feature_components(spaco(spark, d))


@query()
def feature_communities(spark, d):
    return clustering.communities(clustering.similarity_graph(vectors(spark, d)))


@query()
def feature_layout(spark, d):
    return clustering.planar_layout(clustering.feature_components(spaco(spark, d)))


@query("select label, cast(k - 1 as integer) as k, round(avg(embedding[k]::double), 6) as x from embeddings, range(1, 65) r(k) group by label, k")
def mean_by_label(spark, d):
    rows = vectors(spark, d).select("id", F.transform("v", lambda x: x.cast("double")).alias("v"))
    means = features.mean_by_label(rows, t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label"))
    return means.select("label", F.posexplode("v").alias("k", "x")).select("label", "k", F.round("x", 6).alias("x"))


@query()
def mean_component_maps(spark, d):
    """Component scores times the mean feature vector of each group of features."""
    s = spaco(spark, d)
    c = clustering.feature_components(s)
    labels = clustering.groups(c, "kmeans", k=len(s.values))
    return clustering.mean_projection(s, features.mean_by_label(c, labels))


def analysis(spark, d) -> Analysis:
    """Fifty features over tiles of parts by suppliers; means, since most medians of these tables are 0."""
    rows = t(spark, d, "lineitem").select(F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"), F.col("l_quantity").cast("int").alias("feature"), F.col("l_extendedprice").alias("value"))
    return Analysis(rows, 400, "mean", 30)


@query()
def peaks_to_tests(spark, d):
    return analysis(spark, d).tests()


@query()
def peaks_to_communities(spark, d):
    return analysis(spark, d).communities()
