"""The spectrometry queries against DuckDB, and operators against small known cases."""

import os
import struct
import zlib
from types import SimpleNamespace as N

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrel import queries
from spectrel.functions.imhof import imhof_cdf
from spectrel.operators import features, geometry, graph, peaks
from spectrel.runtime import shared_folder
from spectrel.sources.imzml import read_image, read_imzml, sample_data, sample_edges


def rows_of(frame, columns):
    frame = frame[columns].astype(object)
    return sorted((tuple(round(float(x), 4) if isinstance(x, (float, np.floating)) else x for x in r) for r in frame.where(frame.notna(), None).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf, name):
    if "cluster" in name:  # the smallest tables have no clusters of the query's size
        sf = sf.replace("0.001", "0.01")
    con = duckdb.connect()
    for p in os.listdir(sf):
        con.execute(f"create view {p[:-8]} as select * from read_parquet('{sf}/{p}')")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), con.execute(queries.SQL[name]).fetchdf()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns) and len(want) > 0
    assert rows_of(got, columns) == rows_of(want, columns)


def test_label_shift(spark):
    mz = [0, 0.001, 0.002, 0.003, 1, 2, 3, 3.001, 3.002, 3.003, 3.004, 4, 5, 6]
    df = spark.createDataFrame([(float(m), 1.0, i) for i, m in enumerate(mz)], "mz double, intensity double, i int")
    for chunk in (4, 1000):
        got = peaks.cluster(df, 0.0, 2, 0.01, ["i"], chunk).collect()
        assert sorted((r.i, r.cluster_label) for r in got) == [(0, 1), (7, 1), (8, 1), (9, 1)]
    with pytest.raises(ValueError):
        peaks.cluster(df.limit(1), 0.0, 2, 0.01, ["i"])


def test_edges(spark):
    coo = spark.createDataFrame([(0, 0, 1, 5.0), (1, 0, 2, 1.0), (9, 9, 1, 2.0)], "x long, y long, feature int, value double")
    assert {(r.tile_x, r.feature): r.value for r in features.tile_median(coo, 4).collect()}[(0, 1)] == 2.5
    with pytest.raises(ValueError):
        features.tile_size(2, 2, 4)
    with pytest.raises(ValueError):
        features.standardise(spark.range(3).select(F.lit(1.0).alias("c")), ["c"])
    with pytest.raises(ValueError):
        geometry.fit_similarity(np.zeros((2, 2)), np.zeros((2, 2)))


def test_chi_square():
    assert imhof_cdf(5.991465, [1, 1]) == pytest.approx(0.95, abs=1e-4)
    assert imhof_cdf(3.841459, [1]) == pytest.approx(0.95, abs=1e-3)


def test_spline_meets_landmarks():
    moved = queries.MOVED
    d2 = ((moved[:, None] - moved[None]) ** 2).sum(2)
    k = np.where(d2 > 0, 0.5 * d2 * np.log(np.where(d2 > 0, d2, 1)), 0)
    w = queries.SPLINE
    assert np.allclose(moved + k @ w[:-3] + np.hstack([np.ones((len(moved), 1)), moved]) @ w[-3:], queries.SEEN)


def test_spaco_is_l_orthonormal(spark, sf):
    from spectrel.plans.spaco import apply_l

    s = queries.spaco(spark, sf)
    v, lv = (np.array(x) for x in zip(*((r.v, r.lv) for r in apply_l(s.projection(), s.graph).collect()), strict=True))
    assert np.allclose(v.T @ lv, np.eye(len(s.values)), atol=1e-6)
    few = len(s.values)
    s.set_cut(float(s.values[0]))
    assert len(s.values) <= few


def directed(spark):
    """Components over a directed graph, the table, and the dense L, scores and standardised features, made without Spark's sums."""
    from spectrel.operators import graph
    from spectrel.plans.spaco import Spaco

    rng = np.random.default_rng(5)
    v = rng.normal(size=(90, 6)) + np.arange(90)[:, None] * [0.05, 0.03, 0, 0, 0, 0]
    made = spark.createDataFrame([(i, float(i % 10), float(i // 10), [*map(float, v[i]), 1.0]) for i in range(90)], "id long, x double, y double, v array<double>")
    edges = graph.knn(made.select("id", "x", "y"), 5)
    s = Spaco(made.select("id", "v"), edges, keep=0.9)
    a = np.zeros((90, 90))
    for e in edges.collect():
        a[e.src, e.dst] = e.w
    assert not np.allclose(a, a.T)
    lap, z = np.eye(90) / 90 + a / np.abs(a).sum(), (v - v.mean(axis=0)) / v.std(axis=0)
    return s, made.select("id", "v"), lap, z @ s.whitener @ s.loadings, z


def test_sigma_of_a_directed_graph(spark):
    s, _, lap, vk, _ = directed(spark)
    assert vk.shape[1] >= 3 and np.abs(vk.T @ lap @ vk - np.eye(vk.shape[1])).max() > 1e-3
    basis = []
    for v in vk.T:
        for q in basis:
            v = v - (q @ lap @ v) * q
        basis.append(v / np.sqrt(v @ lap @ v))
    q = np.stack(basis, axis=1)
    want, raw = (np.linalg.eigvalsh(m.T @ lap @ lap @ m) for m in (q, vk))
    assert np.allclose(s.sigma(), want, rtol=1e-9) and not np.allclose(want, raw, rtol=1e-4)
    for r in s.test().collect():
        assert r.p_value == pytest.approx(1 - imhof_cdf(r.stat, want), abs=1e-6)
    s.loadings = np.column_stack([s.loadings[:, 0], s.loadings[:, 0], s.loadings[:, 1]])
    assert s.orthonormal().shape[1] == 2
    s.loadings = s.loadings[:, :1] * 0
    with pytest.raises(ValueError):
        s.orthonormal()


def test_projected_features_equal_dense(spark, sf):
    s, _, lap, vk, z = directed(spark)
    got = np.array([r.v for r in s.projected().orderBy("id").collect()])
    assert got.shape == (90, 6) and np.allclose(got, vk @ vk.T @ lap @ z)
    n = len(queries.t(spark, sf, "embeddings").select("vec_id").collect())
    rows = queries.QUERIES["spaco_projected_features"](spark, sf).collect()
    assert len({r.id for r in rows}) == n and {len(r.v) for r in rows} == {64}
    s, loadings = queries.spaco(spark, sf), queries.QUERIES["spaco_loadings"](spark, sf).orderBy("direction").collect()
    assert np.allclose(np.abs([r.v for r in loadings]), np.abs(s.loadings), atol=1e-6)


def given_to(monkeypatch, owner, name):
    """What each call of a function gets, defaults included."""
    import inspect

    real, seen = getattr(owner, name), []

    def call(*a, **k):
        bound = inspect.signature(real).bind(*a, **k)
        bound.apply_defaults()
        seen.append(bound.arguments)
        return real(*a, **k)

    monkeypatch.setattr(owner, name, call)
    return seen


def test_adaptive_query_runs_all_rounds(spark, sf, monkeypatch):
    from spectrel.plans.spaco import Spaco

    seen = given_to(monkeypatch, Spaco, "adaptive_cut")
    queries.QUERIES["adaptive_components"](spark, sf)
    assert [s["rounds"] for s in seen] == [1000]


def test_map_query_runs_all_rounds(spark, sf, monkeypatch):
    from spectrel.plans import registration

    seen = given_to(monkeypatch, registration, "simplex_search")
    queries.QUERIES["registered_map"](spark, sf)
    assert [s["rounds"] for s in seen] == [100]


def imzml_file(folder, spectra):
    data, items = b"\0" * 16, ""
    for x, y, m, i in spectra:
        arrays = ""
        for acc, values in (("MS:1000514", m), ("MS:1000515", i)):
            arrays += f'<binaryDataArray><cvParam accession="{acc}"/><cvParam accession="MS:1000523"/><cvParam accession="IMS:1000102" value="{len(data)}"/><cvParam accession="IMS:1000103" value="{len(values)}"/></binaryDataArray>'
            data += struct.pack(f"<{len(values)}d", *values)
        items += f'<spectrum><cvParam accession="IMS:1000050" value="{x}"/><cvParam accession="IMS:1000051" value="{y}"/>{arrays}</spectrum>'
    (folder / "a.imzML").write_text(f"<mzML>{items}</mzML>")
    (folder / "a.ibd").write_bytes(data)
    return str(folder / "a.imzML")


def test_imzml_round_trip(spark, tmp_path):
    spectra = [(1, 1, [1.0, 2.0], [5.0, 6.0]), (2, 1, [3.0], [7.0])]
    got = read_imzml(spark, imzml_file(tmp_path, spectra), 2).orderBy("pixel_id").collect()
    assert [(r.x, r.y, r.mzs, r.intensities) for r in got] == spectra


def test_imzml_reads_what_is_asked_for(spark, tmp_path, monkeypatch):
    """Conditions and masses against the same done afterwards, and the bytes that are read for them."""
    from pyspark.sql.datasource import EqualTo, LessThan

    from spectrel.sources import imzml

    rng = np.random.default_rng(6)
    spectra = [(x, y, m if (x + y) % 5 else m[::-1], rng.random(len(m)).tolist()) for x in range(6) for y in range(6) for m in [sorted(rng.uniform(0, 100, 50 + 20 * x).tolist())]]
    path = imzml_file(tmp_path, spectra)
    every = read_imzml(spark, path, 5)
    key = lambda df: sorted((r.pixel_id, r.x, r.y, tuple(r.mzs), tuple(r.intensities)) for r in df.collect())
    plan = read_imzml(spark, path, 5).where("x = 3 and y < 4 and z in (1, 2) and pixel_id >= 2 and size(mzs) > 3")
    assert key(plan) == [r for r in key(every) if r[1] == 3 and r[2] < 4] and len(plan.collect()) == 4
    assert key(read_imzml(spark, path, 3, (40.0, 45.0))) == key(peaks.trim(every, 40.0, 45.0)) and read_imzml(spark, path, 3, (200.0, 300.0)).count() == 0
    seen = []

    class Counted:
        def __init__(self, at):
            self.f = open(at, "rb")

        def read(self, n):
            seen.append(n)
            return self.f.read(n)

        def seek(self, at):
            self.f.seek(at)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

    monkeypatch.setattr(imzml, "opened", Counted)

    def count(options, filters):
        seen.clear()
        reader = imzml._Reader({"path": path, **options})
        left = list(reader.pushFilters(filters))
        parts = reader.partitions()
        sizes = [sum(1 for _ in reader.read(p)) for p in parts]
        return sum(seen), sum(sizes), len(parts), left

    whole, n, parts, _ = count({"partitions": 4}, [])
    assert whole == sum(16 * len(s[2]) for s in spectra) and n == 36 and parts == 4
    assert count({}, [EqualTo(("x",), 3)])[:2] == (6 * 16 * 110, 6)
    assert count({}, [EqualTo(("x",), 3), LessThan(("y",), 2)])[:2] == (2 * 16 * 110, 2) and len(count({}, [EqualTo(("other",), 1)])[3]) == 1
    assert count({"mz_min": "40", "mz_max": "45"}, [])[0] < 0.6 * whole


def test_t_quantile():
    from spectrel.functions.student import t_quantile

    for df, want in ((1, 12.7062), (2, 4.30265), (9, 2.26216), (99, 1.98422), (5000, 1.96044)):
        assert t_quantile(0.975, df) == pytest.approx(want, abs=2e-4)
    assert t_quantile(0.975, 0) == np.inf


@pytest.mark.parametrize("n", [1, 2, 5, 80, 257])
def test_permuted_is_a_bijection(n):
    from spectrel.plans.spaco import permuted

    a, b = (permuted(np.arange(n), n, 0, k) for k in (1, 2))
    assert sorted(a) == sorted(b) == list(range(n)) and (n < 6 or (a != b).any())
    assert (permuted(a, n, 0, 1, inverse=True) == np.arange(n)).all()
    if n == 80:  # every number comes to every place about equally often
        seen = np.zeros((n, n))
        for k in range(2000):
            seen[np.arange(n), permuted(np.arange(n), n, 3, k)] += 1
        assert 0.8 * n * n < ((seen - 25) ** 2 / 25).sum() < 1.2 * n * n


def test_null_is_the_same_both_ways_and_as_dense(spark):
    from spectrel.operators import graph
    from spectrel.plans.spaco import Spaco, permuted
    from spectrel.sources.imzml import sample_data

    made = sample_data(spark, 40, 6).persist()
    s = Spaco(made.select("id", "v"), graph.symmetric(graph.knn(made.select("id", "x", "y"), 4, with_self=False)), keep=0.9)
    sent = s.null_values(4, seed=5)
    assert np.allclose(sent, s.null_values(4, seed=5, max_bytes=0, block=3))
    w = np.stack([r.v for r in s.white.orderBy("id").collect()])
    adjacency = np.zeros((40, 40))
    for e in s.edges.collect():
        adjacency[e.src, e.dst] = e.w
    laplacian = np.eye(40) / 40 + adjacency / np.abs(adjacency).sum()
    dense = sorted(np.linalg.eigvals(p.T @ laplacian @ p).real.max() for p in (w[permuted(np.arange(40), 40, 5, k)] for k in range(4)))
    assert np.allclose(sent, dense)
    x = np.stack([r.v for r in made.orderBy("id").collect()])
    v = np.stack([r.v for r in s.projection().orderBy("id").collect()])
    want = ((v.T @ laplacian @ x) ** 2).sum(0) / np.diag(x.T @ laplacian @ x)
    assert np.allclose([r.stat for r in s.test(made).orderBy("feature").collect()], want)


def test_communities(spark):
    from spectrel.plans.clustering import communities

    ring = [(10 * c + i, 10 * c + j, 1.0) for c in range(4) for i in range(5) for j in range(i)] + [(10 * c, 10 * ((c + 1) % 4) + 1, 0.5) for c in range(4)] + [(99, 99, 1.0)]
    df = spark.createDataFrame(ring, "a long, b long, w double")
    got = {r.id: r.label for r in communities(df).collect()}
    assert sorted(got) == sorted({k for e in ring for k in e[:2]}) and len(set(got.values())) == 5
    assert all(got[10 * c] == got[10 * c + i] for c in range(4) for i in range(5)) and got[99] == 4
    assert communities(df.limit(0)).count() == 0
    none = communities(df.withColumn("w", -F.col("w"))).collect()
    assert len({r.label for r in none}) == len(none) == len(got)


@pytest.mark.parametrize(("least", "share"), [(0.1, 0.9), (-0.6, 0.5)])
def test_communities_against_all_partitions(spark, least, share):
    """Moves of single nodes end in a local optimum; among negative weights it can be well below the best (0.79 of the way here)."""
    from spectrel.plans.clustering import communities

    def partitions(n):
        if not n:
            yield []
            return
        for p in partitions(n - 1):
            for c in range(max(p, default=-1) + 2):
                yield [*p, c]

    rng, n = np.random.default_rng(6), 7
    a = np.triu(np.where(rng.random((n, n)) < 0.6, rng.uniform(least, 1, (n, n)), 0), 1)
    rows = [(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)]
    a = a + a.T
    free = a - np.outer(a.sum(1), a.sum(1)) / a.sum()
    quality = lambda p: float((free * np.equal.outer(p, p)).sum())
    assert a.sum() > 0 and (least > 0 or a.min() < 0)
    got = {r.id: r.label for r in communities(spark.createDataFrame(rows, "a long, b long, w double")).collect()}
    best, alone = max(map(quality, partitions(n))), quality(list(range(n)))
    assert set(got) == set(range(n)) and quality([got[i] for i in range(n)]) >= alone + share * (best - alone)


def test_layout_keeps_groups_apart(spark):
    from spectrel.plans.layout import curve, planar_layout

    assert curve(0.1) == (pytest.approx(1.577, abs=0.01), pytest.approx(0.895, abs=0.01))
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=5) + 30 * (i % 3)).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    at = np.array([[r.x, r.y] for r in planar_layout(df, epochs=200).orderBy("id").collect()])
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2)) + np.eye(60) * 1e9
    assert (d.argmin(1) % 3 == np.arange(60) % 3).mean() > 0.95
    assert [tuple(r) for r in planar_layout(df.limit(1)).collect()] == [(0, 0.0, 0.0)] and planar_layout(df.limit(0)).count() == 0


def test_simplex_finds_the_valley():
    from spectrel.plans.registration import simplex_search

    at, low = simplex_search(lambda p: (1 - p[0]) ** 2 + 100 * (p[1] - p[0] ** 2) ** 2, np.array([-1.2, 1.0]), 400)
    assert np.allclose(at, 1, atol=1e-2) and low < 1e-4


def test_registration(spark):
    from spectrel.plans import registration as reg

    y, x = np.mgrid[:40, :40]
    image = ((y > 8) & (y < 30) & (x > 12) & (x < 25)) * 0.8
    table = lambda a: spark.createDataFrame([(i, j, float(a[i, j])) for i in range(40) for j in range(40)], "y long, x long, value double")
    moving, m = table(image), np.array([[1.0, 0, 3], [0, 1, -2], [0, 0, 1]])
    dense = lambda df, h=40, w=40: reg._dense(df, h, w)
    fixed = reg.warp_affine(moving, m, 40, 40)
    assert np.array_equal(dense(fixed)[5:20, 17:25], image[7:22, 14:22]) and np.allclose(dense(fixed), reg._sampled(image, m, 40, 40))
    assert np.allclose(dense(geometry.sobel(moving, 40, 40)), reg._edges(image))
    start = m + np.array([[0, 0, 0.6], [0, 0, 0.5], [0, 0, 0]])
    found, corr = reg.refine(fixed, moving, start, (40, 40), (40, 40))
    assert corr > 0.9 and np.abs(found[:2, 2] - m[:2, 2]).max() < 3
    flat = moving.withColumn("value", F.lit(0.0))
    assert reg.refine(flat, flat, m, (40, 40), (40, 40), 3)[1] == 0
    assert np.array_equal(dense(reg.resize(moving, (40, 40), (40, 40))), image)
    assert np.array_equal(dense(reg.resize(moving, (40, 40), (20, 20), True), 20, 20), image[::2, ::2])
    still = reg.warp_spline(moving, queries.MOVED, np.zeros((8, 2)), 40, 40)
    assert np.array_equal(dense(still), image)
    r = reg.Registration(queries.MARKS, queries.SEEN)
    assert r.coordinate_map(moving, 4).count() == (21 * 12 - 4) // 4 and r.coordinate_map(moving, 7, (40, 40)).count() == 36
    field = reg.vector_field(spark, 40, 40, r.affine, r.points, r.spline, 5).collect()
    assert len(field) == 25 and max(f.maldi_x for f in field) == 40 and all(f.drawn == (f.size > 1) for f in field)


def test_inverse_of_forward(spark):
    df = spark.createDataFrame([(float(i), float(j)) for i in range(0, 90, 15) for j in range(0, 90, 15)], "x double, y double")
    a, b = geometry.forward(F.col("x"), F.col("y"), queries.AFFINE, queries.MOVED, queries.SPLINE)
    got = geometry.inverse(df.select("x", "y", a.alias("hx"), b.alias("hy")), "hx", "hy", queries.AFFINE, queries.MOVED, queries.SPLINE, tolerance=1e-6).collect()
    assert all(r.converged and abs(r.inv_x - r.x) < 1e-3 and abs(r.inv_y - r.y) < 1e-3 for r in got)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs_whole(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_csv_and_image_sinks(spark, tmp_path):
    import base64

    from spectrel.sources import imzml

    df = spark.createDataFrame([(1.0, 2.0, 3.5, 4.5)], "maldi_x double, maldi_y double, he_x double, he_y double")
    assert imzml.write_map(df, str(tmp_path / "map"), True) is df
    assert [tuple(map(float, r)) for r in spark.read.option("header", True).csv(str(tmp_path / "map")).collect()] == [(1.0, 2.0, 3.5, 4.5)]
    imzml.write_annotations(spark.createDataFrame([("i", "central", 1, 2), ("i", "portal", 3, 4)], "image string, structure string, x int, y int"), str(tmp_path / "notes"))
    assert {(r.structure, r._c0, r._c1) for r in spark.read.csv(str(tmp_path / "notes")).collect()} == {("central", "1", "2"), ("portal", "3", "4")}
    # A 2 x 1 bitmap with 24 bits a pixel: red, then blue.
    body = base64.b64encode(b"BM" + struct.pack("<IHHI", 62, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2, 1, 1, 24, 0, 8, 0, 0, 0, 0) + bytes([0, 0, 255, 255, 0, 0, 0, 0]))
    (tmp_path / "a.bmp").write_bytes(base64.b64decode(body))
    got = imzml.read_image(spark, str(tmp_path / "a.bmp")).orderBy("x").collect()
    assert [(r.y, r.x, r.r, r.g, r.b) for r in got] == [(0, 0, 255, 0, 0), (0, 1, 0, 0, 255)]
    assert imzml.first_image(str(tmp_path), "a") is None
    (tmp_path / "a.tif").write_bytes(b"")
    assert imzml.first_image(str(tmp_path), "a").endswith("a.tif")


def test_entry_and_cluster_image(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 1
    df = spark.createDataFrame([(0, 0, 3, 1.0), (0, 0, 3, 2.0), (1, 0, 7, 5.0)], "x long, y long, cluster_label long, intensity double")
    assert sorted(tuple(r) for r in features.cluster_image(df, 0).collect()) == [(0, 0, 3.0), (1, 0, None)]
    assert features.cluster_image(df.limit(0), 0).count() == 0
    with pytest.raises(ValueError):
        features.cluster_image(df, 2)


@pytest.mark.parametrize("how", ["median", "sum", "mean", "min", "max"])
def test_tiles_equal_a_filled_matrix(spark, how):
    rng = np.random.default_rng(2)
    rows = [(int(x), int(y), int(f), float(rng.integers(1, 9))) for x in range(12) for y in range(12) for f in rng.integers(0, 5, 3) if (x + y) % 3]
    got = features.tile_aggregate(spark.createDataFrame(rows, "x long, y long, feature int, value double"), 16, how).collect()
    filled = {}
    for x, y, f, v in rows:
        filled.setdefault((x, y), np.zeros(5))[f] += v
    tiles = {}
    for (x, y), v in filled.items():
        tiles.setdefault((x // 3, y // 3), []).append(v)
    want = {k: getattr(np, how)(np.array(v), axis=0) for k, v in tiles.items()}
    assert got and all(r.value == pytest.approx(want[r.tile_x, r.tile_y][r.feature]) for r in got)
    assert {(r.tile_x, r.tile_y, r.feature) for r in got} == {(x // 3, y // 3, f) for x, y, f, _ in rows}
    with pytest.raises(ValueError):
        features.tile_aggregate(spark.createDataFrame(rows, "x long, y long, feature int, value double"), 16, "mode")


def test_vectors_and_analysis(spark):
    from spectrel.plans.analysis import Analysis

    df = spark.createDataFrame([(0, 1, "b", 2.0), (0, 1, "a", 1.0), (3, 0, "c", 5.0), (3, 0, "z", 9.0)], "tile_x long, tile_y long, feature string, value double")
    got = {(r.x, r.y): (r.id, r.v) for r in features.to_vectors(df, ["a", "b", "c"]).collect()}
    assert got == {(0, 1): (1 << 31, [1.0, 2.0, 0.0]), (3, 0): (3, [0.0, 0.0, 5.0])}
    rng = np.random.default_rng(0)
    rows = [(x, y, f, float(abs(rng.normal()) + (20 * (x > 15) if f < 2 else 0))) for x in range(30) for y in range(30) for f in range(6)]
    made = Analysis(spark.createDataFrame(rows, "x long, y long, feature int, value double"), 225, "median", 9, binary=True)
    found = {made.labels[r.feature]: r.stat for r in made.tests().collect()}
    assert len(found) == 6 and min(found[0], found[1]) > max(found[f] for f in (2, 3, 4, 5))
    assert {r.id for r in made.communities(4).collect()} == set(range(6))


def test_input_is_checked(spark):
    wide = spark.createDataFrame([(1, 1, [1.0, 2.0], [5.0, 0.0]), (2, 1, [1.0], [3.0]), (3, 1, [], [])], "x int, y int, mzs array<double>, intensities array<double>")
    long = peaks.explode(wide).where("mz is not null")
    assert peaks.is_wide(wide) and not peaks.is_wide(long)
    same = [sorted(map(tuple, features.sparsity(d, "mzs", 0.5).collect())) for d in (wide.where("x < 3"), long)]
    assert same[0] == same[1] == [(1.0, 2, 1.0, 0.0)]
    with pytest.raises(ValueError):
        peaks.is_wide(wide.drop("intensities"))
    with pytest.raises(TypeError):
        peaks.is_wide(wide.withColumn("intensities", F.lit("no")))
    with pytest.raises(TypeError):
        peaks.is_wide(long.withColumn("x", F.lit("a")))


def test_samples_and_single_values(spark):
    df = spark.range(50).select(F.col("id").alias("feature"))
    assert features.feature_sample(df, 20).count() == 20 and features.drawn(df, 80).count() == 50
    assert sorted(features.drawn(df, 5).collect()) == sorted(features.drawn(df.repartition(7), 5).collect())
    with pytest.raises(ValueError):
        features.feature_sample(df, 51)
    rows = spark.createDataFrame([(0, 0, 1, 2.0), (0, 0, 2, 3.0), (1, 0, 1, 4.0)], "x int, y int, cluster_label int, intensity double")
    assert {(r.x, r.value) for r in features.cluster_image(rows, 0, single=True).collect()} == {(0, 2.0), (1, 4.0)}
    with pytest.raises(Exception, match="two values"):
        features.cluster_image(rows.unionByName(rows), 0, single=True).collect()


def test_aggregates_by_function_and_dict(spark):
    coo = spark.createDataFrame([(x, y, f, float(x + 2 * y + f)) for x in range(8) for y in range(8) for f in (1, 2, 3) if (x + y + f) % 3], "x int, y int, feature int, value double")
    tell = lambda df: {(r.tile_x, r.tile_y, r.feature): round(r.value, 9) for r in df.collect()}
    for name, function in (("median", lambda s: s.median()), ("mean", lambda s: s.mean()), ("max", lambda s: s.max()), ("min", lambda s: s.min()), ("sum", lambda s: s.sum())):
        assert tell(features.tile_aggregate(coo, 16, name)) == tell(features.tile_aggregate(coo, 16, function))
    some = tell(features.tile_aggregate(coo, 16, {1: "median", 3: lambda s: s.sum()}))
    median, total = tell(features.tile_aggregate(coo, 16, "median")), tell(features.tile_aggregate(coo, 16, "sum"))
    assert some == {k: (median if k[2] == 1 else total)[k] for k in median if k[2] != 2}
    with pytest.raises(ValueError):
        features.tile_aggregate(coo, 16, "mode")
    with pytest.raises(ValueError):
        features.tile_aggregate(coo, 16, {})


def test_neighbours_of_a_dense_spot_and_of_equal_points(spark):
    rng = np.random.default_rng(0)
    at = np.vstack([rng.random((60, 2)) * 1000, rng.random((300, 2)) * 0.01 + 500, np.full((40, 2), 7.0)])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "id long, x double, y double")
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2))
    for own in (True, False):
        want = set()
        for i in range(len(at)):
            order = sorted((j for j in range(len(at)) if own or j != i), key=lambda j: (d[i, j], j))[:5]
            want |= {(i, j) for j in order}
        assert {(r.src, r.dst) for r in graph.knn(df, 5, with_self=own).collect()} == want


def test_points_at_one_place_are_few_pairs(spark, monkeypatch):
    """Thousands of points at one place and tiles dealt to several tasks: as brute force says, with no task measuring all pairs."""
    n = 6000
    monkeypatch.setattr(graph, "ASKED", 1000)
    at = np.vstack([np.full((n, 2), 3.0), np.random.default_rng(2).random((50, 2)) * 9])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "id long, x double, y double")
    for own in (True, False):
        got = {}
        for r in graph.knn(df, 3, with_self=own).collect():
            got.setdefault(r.src, []).append((r.w, r.dst))
        assert len(got) == len(at)
        for i in (0, 1, 2, 3, 500, n - 1, *range(n, len(at))):
            d = np.sqrt(((at - at[i]) ** 2).sum(1))
            order = [int(j) for j in np.lexsort((np.arange(len(at)), d))[:4] if own or j != i][:3]
            assert [j for _, j in sorted(got[i])] == order


def test_edges_need_their_nodes(spark):
    made = sample_data(spark, 30, 3).persist()
    edges = sample_edges(made, 4).persist()
    graph.check_nodes(edges, made)
    pairs = {(r.src, r.dst) for r in edges.collect()}
    assert pairs == {(b, a) for a, b in pairs} and all(a != b for a, b in pairs) and len(pairs) >= 120
    with pytest.raises(ValueError):
        graph.check_nodes(edges, made.where("id <> 3"))


def test_imhof_with_all_its_arguments():
    rng = np.random.default_rng(0)
    w, dfs, ncs, sigma = [1.0, 0.5, -0.3], [1, 3, 2], [0.0, 1.5, 0.7], 0.4
    draws = sum(c * rng.noncentral_chisquare(h, max(m, 1e-12), 400_000) for c, h, m in zip(w, dfs, ncs, strict=True))
    for q in (0.5, 2.0, 5.0):
        assert imhof_cdf(q, w, dfs=dfs, ncs=ncs) == pytest.approx((draws <= q).mean(), abs=0.004)
        assert imhof_cdf(q, w, dfs=dfs, ncs=ncs, sigma=sigma) == pytest.approx((draws + 2 * sigma * rng.normal(size=len(draws)) <= q).mean(), abs=0.004)
    assert imhof_cdf(2 * 1.2815515, [], sigma=1.0) == pytest.approx(0.9, abs=1e-6) and imhof_cdf(1.0, []) == 1.0
    assert imhof_cdf(5.991465, [1.0], dfs=[2]) == pytest.approx(0.95, abs=1e-5)
    with pytest.raises(ValueError):
        imhof_cdf(1.0, [1.0, 2.0], dfs=[1])


def test_noise_is_not_significant(spark, sf):
    found = {r.feature for r in queries.significant_features(spark, sf).collect()}
    assert len(found & set(range(64))) > 50 and len(found & set(range(64, 80))) <= 5


def test_image_with_alpha(spark, tmp_path):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    pixels = [(10, 20, 30, 40), (50, 60, 70, 255)]
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" + b"".join(map(bytes, pixels)))) + chunk(b"IEND", b"")
    (tmp_path / "a.png").write_bytes(png)
    got = read_image(spark, str(tmp_path / "a.png"), alpha=True).orderBy("x").collect()
    assert [(r.r, r.g, r.b, r.a) for r in got] == pixels


def test_no_local_folder_off_local_masters(spark):
    sc = N(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError):
        shared_folder(N(sparkContext=sc, conf=N(get=lambda k, d: None)))


def test_communities_of_many_parts(spark):
    """Planted groups are found however the graph is dealt into parts, and no step lowers the quality."""
    from spectrel.plans import communities as c

    rng = np.random.default_rng(1)
    pairs = {(i, j) for i in range(120) for j in range(i) if rng.random() < (0.5 if i // 30 == j // 30 else 0.02)}
    edges = spark.createDataFrame([(int(a), int(b), 1.0) for a, b in sorted(pairs)], "a long, b long, w double")

    def quality(label):
        k, inside = np.zeros(120), 0
        for a, b in pairs:
            k[[a, b]] += 1
            inside += 2 * (label[a] == label[b])
        groups = {}
        for u, x in enumerate(k):
            groups[label[u]] = groups.get(label[u], 0) + x
        return inside / k.sum() - sum(x * x for x in groups.values()) / k.sum() ** 2

    whole = {r.id: r.label for r in c.communities(edges).collect()}
    dealt = {r.id: r.label for r in c.communities(edges, part=700).collect()}
    for found in (whole, dealt):
        assert len(found) == 120 and len({(i // 30, found[i]) for i in found}) == len(set(found.values())) == 4
    assert quality(dealt) >= 0.99 * quality(whole)
    both = edges.selectExpr("a as src", "b as dst", "w").union(edges.selectExpr("b", "a", "w"))
    level = c._Level(both.groupBy("src").agg(F.sum("w").alias("k")).selectExpr("src as id", "k", "2 * src as label"), both, 2.0 * len(pairs), 1.0, 400)
    assert level.parts > 3
    nodes, moved = level.moved(3)
    assert moved and level.quality(nodes) > level.quality(level.nodes)


def test_a_round_of_moves_is_one_table_and_one_sum(spark, monkeypatch):
    """However many rounds a level takes, each costs one table and one quality (and those of moves that are taken back)."""
    from spectrel.plans import communities as c

    pairs = [(int(i), int(j)) for i, j in np.random.default_rng(3).integers(0, 90, (600, 2)) if i != j and (i // 30 == j // 30 or (i + j) % 5 == 0)]
    edges = spark.createDataFrame([(i, j, 1.0) for i, j in {(min(p), max(p)) for p in pairs}], "src long, dst long, w double")
    both = edges.union(edges.selectExpr("dst", "src", "w"))
    level = c._Level(both.groupBy("src").agg(F.sum("w").alias("k")).selectExpr("src as id", "k", "2 * src as label"), both, 2.0 * edges.count(), 1.0, 300)
    seen = {"tables": 0, "sums": [], "rounds": 0}
    table, quality, by_part = c.written, c._Level.quality, c._Level._by_part
    monkeypatch.setattr(c, "written", lambda df: (seen.update(tables=seen["tables"] + 1), table(df))[1])
    monkeypatch.setattr(c._Level, "quality", lambda self, nodes: (seen["sums"].append(q := quality(self, nodes)), q)[1])
    monkeypatch.setattr(c._Level, "_by_part", lambda self, *a: (seen.update(rounds=seen["rounds"] + 1), by_part(self, *a))[1])
    nodes, moved = level.moved(1)
    back = sum(b < max(seen["sums"][: i + 1]) - 1e-9 for i, b in enumerate(seen["sums"][1:]))
    assert level.parts > 1 and moved and seen["rounds"] > 1
    assert seen["tables"] <= seen["rounds"] + 1 and len(seen["sums"]) <= seen["rounds"] + 1 + back
    assert quality(level, nodes) == pytest.approx(max(seen["sums"]))
    named = {r.label: r.least for r in nodes.groupBy("label").agg(F.min("id").alias("least")).collect()}
    assert all(label == 2 * least for label, least in named.items())


def test_a_levels_edges_are_packed_once(spark, monkeypatch):
    """Steps read a row per home instead of edges, measure what they begin with, and fold to the sums between groups; rounds end when they add little."""
    from spectrel.plans import communities as c

    rng = np.random.default_rng(5)
    a = np.triu(np.where(rng.random((120, 120)) < np.where(np.equal.outer(np.arange(120) // 30, np.arange(120) // 30), 0.5, 0.02), rng.uniform(0.5, 1, (120, 120)), 0), 1)
    a = a + a.T
    a[119] = a[:, 119] = 0  # a node without edges
    both = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "src long, dst long, w double")
    nodes = spark.createDataFrame([(i, float(a[i].sum()) + (i == 119), 2 * i) for i in range(120)], "id long, k double, label long")
    total = float(a.sum()) + 1
    level = c._Level(nodes, both, total, 1.0, 300)
    packs = level.packs.collect()
    assert level.parts > 3 and len(packs) <= level.homes and sum(r.edges for r in packs) == both.count() and level.n == sum(r.nodes for r in packs) == 120
    k = a.sum(1) + (np.arange(120) == 119)
    quality = lambda label: (a * np.equal.outer(label, label)).sum() - sum(k[label == x].sum() ** 2 for x in set(label.tolist())) / total
    step = level._by_part(level.nodes, "move", 1, 0)
    assert "src" not in step._jdf.queryExecution().optimizedPlan().toString()
    assert level.quality(step) == pytest.approx(quality(2 * np.arange(120)))
    nodes, moved = level.moved(1)
    label = np.array([r.label for r in nodes.orderBy("id").collect()])
    assert moved and level.quality(nodes) == pytest.approx(quality(label)) and label[119] == 238
    rows = level.refined(nodes, 1).orderBy("id")
    fine = np.array([r.fine for r in rows.collect()])
    assert all(len(set(label[fine == x].tolist())) == 1 for x in set(fine.tolist())) and len(set(fine.tolist())) < 60
    made = level.folded(rows, 10)
    apart = ~np.equal.outer(fine, fine)
    got = {(int(u), int(e[d])): w for r in made.packs.collect() for e, d_, w_, u_ in [(np.frombuffer(r.ends, "<i8"), np.frombuffer(r.dst, "<i4"), np.frombuffer(r.w, "<f8"), np.repeat(np.frombuffer(r.ids, "<i8"), np.frombuffer(r.degree, "<i4")))] for u, d, w in zip(u_, d_, w_, strict=True)}
    want = {}
    for i, j in zip(*np.nonzero(a * apart), strict=True):
        want[int(fine[i]), int(fine[j])] = want.get((int(fine[i]), int(fine[j])), 0.0) + a[i, j]
    assert got == pytest.approx(want) and made.nodes.agg(F.sum("k")).first()[0] == pytest.approx(total)
    seen, by_part = [], c._Level._by_part
    monkeypatch.setattr(c, "LEAST", 2.0)
    monkeypatch.setattr(c._Level, "_by_part", lambda self, *x: (seen.append(x[1]), by_part(self, *x))[1])
    level.moved(1)
    assert seen == ["move", "move"]


def test_refinement_without_gathering(spark):
    from spectrel.plans import registration

    at = [(y, x, 1.0 if 6 <= y < 16 and 5 <= x < 19 else 0.05 * ((y * x) % 3)) for y in range(24) for x in range(24)]
    image = spark.createDataFrame(at, "y long, x long, value double").persist()
    start = np.array([[1.0, 0.0, 1.0], [0.0, 1.0, -1.0], [0, 0, 1]])
    gathered = registration.refine(image, image, start, (24, 24), (24, 24), rounds=3)
    apart = registration.refine(image, image, start, (24, 24), (24, 24), rounds=3, max_pixels=100)
    assert np.allclose(gathered[0], apart[0], atol=1e-6) and gathered[1] == pytest.approx(apart[1], abs=1e-9)


def test_ranking_moves_each_row_once(spark):
    """After the ranges nothing but one number a range is shuffled; ranks are those of a sort, ties and empty ranges included."""
    from spectrel.operators.peaks import numbered

    rows = [(i, (i * 7919) % 13) for i in range(500)]
    for part, n in ((rows, 7), (rows[:3], 7), ([], 3)):
        got = numbered(spark.createDataFrame(part, "id long, v long"), [F.col("v"), F.desc("id")], n)
        assert got.columns == ["id", "v", "rn"]
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # of the counts
        assert [(r.id, r.v) for r in sorted(got.collect(), key=lambda r: r.rn)] == sorted(part, key=lambda r: (r[1], -r[0]))
        assert sorted(r.rn for r in got.collect()) == list(range(len(part)))


def test_tile_median_of_summed_cells(spark):
    """A table with one row for a pixel and feature gives the same medians and is neither grouped nor settled again."""
    from spectrel.operators import features
    from spectrel.runtime import settled

    rng = np.random.default_rng(4)
    rows = [(int(x), int(y), int(f), float(v)) for x, y, f, v in zip(*rng.integers(0, 12, (2, 900)), rng.integers(0, 3, 900), rng.integers(1, 50, 900), strict=True)]
    coo = spark.createDataFrame(rows, "x long, y long, feature long, value double")
    cells = settled(coo.groupBy("x", "y", "feature").agg(F.sum("value").alias("value")))
    assert cells.count() < len(rows)
    sort = lambda df: sorted(tuple(r) for r in df.collect())
    assert sort(features.tile_median(cells, 9, summed=True)) == sort(features.tile_median(coo, 9))


def test_refinement_by_a_sent_mask(spark):
    """A mask of bits, sent, gives the figures of the images at the driver and of the shuffled ones, at sizes that fill no tile or byte."""
    from spectrel.operators import raster
    from spectrel.plans import registration

    rng = np.random.default_rng(2)
    h, w = 270, 261
    y, x = np.mgrid[:h, :w]
    image = np.where((y > 40) & (y < 266) & (x > 30) & (x < 259) & ((y - 150) ** 2 + (x - 130) ** 2 > 900), rng.uniform(0.2, 1, (h, w)), 0.0)
    at = spark.createDataFrame([(int(i), int(j), float(image[i, j])) for i in range(h) for j in range(w) if (i + j) % 97], "y long, x long, value double").persist()
    tiles = registration.settled(raster.to_tiles(at))
    size = (h, w)
    whole = registration._correlation_gathered(tiles, tiles, size, size)
    sent, free = registration._correlation_sent(tiles, tiles, size, size)
    apart = registration._correlation_distributed(tiles, tiles, size)
    for m in ([[1, 0, 0], [0, 1, 0]], [[1.05, 0.02, 3.3], [-0.01, 0.97, -7.2]], [[0.5, 0, -60], [0, 2, 90.5]], [[1, 0, 1e12], [0, 1, 0]]):
        m = np.array([*m, [0, 0, 1]], float)
        assert sent(m) == pytest.approx(whole(m), abs=1e-9) and sent(m) == pytest.approx(apart(m), abs=1e-9)
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("sent"))
    spark.sparkContext.setJobGroup("sent", "one map")
    sent(np.eye(3))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs() <= 2  # the pass and its sum, no shuffle of tiles
    free()
    start = np.array([[1.0, 0.0, 1.0], [0.0, 1.0, -1.0], [0, 0, 1]])
    found = [registration.refine(at, at, start, size, size, rounds=2, **k) for k in ({}, {"max_pixels": 100}, {"max_pixels": 100, "max_sent": 100})]
    assert all(np.allclose(f[0], found[0][0], atol=1e-6) and f[1] == pytest.approx(found[0][1], abs=1e-9) for f in found)


def test_blocked_product_of_a_directed_graph(spark):
    """Against dense matrices, both ways, over several blocks; as many rows are shuffled as cells, whatever the number of features."""
    from spectrel.operators import blocks

    rng = np.random.default_rng(7)
    n = 230
    ids = rng.permutation(5000)[:n]
    a = np.where(rng.random((n, n)) < 0.03, rng.normal(size=(n, n)), 0)
    edges = spark.createDataFrame([(int(ids[i]), int(ids[j]), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "src long, dst long, w double")
    lap = np.eye(n) / n + a / np.abs(a).sum()
    for p in (1, 70):
        x = rng.normal(size=(n, p))
        rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, v array<double>")
        g = blocks.BlockedGraph(edges, rows, rows=50)
        assert g.n == n and g.cells.count() <= 25 and g.cells.agg(F.sum("k")).first()[0] == np.count_nonzero(a)
        for transpose, m in ((False, lap), (True, lap.T)):
            made = g.product(g.pack(rows), transpose)
            got = {r.id: r.lv for r in blocks.unpack(made, lv="lm").collect()}
            assert np.allclose([got[int(i)] for i in ids], m @ x) and made.count() == 5
        assert "explode" not in made._jdf.queryExecution().toString().lower()
    with pytest.raises(ValueError):
        blocks.BlockedGraph(edges, rows.where(F.col("id") != int(ids[0])))
    order = spark.range(64).select(F.col("id").alias("k"), (F.col("id") % 8).alias("x"), F.floor(F.col("id") / 8).alias("y")).select("x", "y", blocks.interleaved("x", "y").alias("z")).collect()
    assert sorted(r.z for r in order) == list(range(64)) and all(r.z == sum((r.x >> b & 1) << 2 * b | (r.y >> b & 1) << 2 * b + 1 for b in range(3)) for r in order)


def test_a_block_is_sent_once_whatever_its_cells(spark, monkeypatch):
    """A graph whose edges connect nearly all pairs of blocks is applied by as many packs as blocks, more only where edges fill several."""
    from spectrel.operators import blocks

    rng = np.random.default_rng(3)
    n = 200
    a = np.where(rng.random((n, n)) < 0.05, rng.normal(size=(n, n)), 0)
    a[:, 7] = 1.0
    edges = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "src long, dst long, w double")
    x = rng.normal(size=(n, 3))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    for pack, held in ((1 << 16, 16 << 20), (40, 100)):
        monkeypatch.setattr(blocks, "PACK", pack)
        monkeypatch.setattr(blocks, "HELD", held)
        g = blocks.BlockedGraph(edges, rows, rows=10)
        assert g.cells.count() > 300 and (g.packs.count() == 20 if pack > 40 else g.packs.count() > 20)
        for transpose, m in ((False, a), (True, a.T)):
            got = {r.id: r.lv for r in blocks.unpack(g.product(g.pack(rows), transpose), lv="lm").collect()}
            assert np.allclose([got[i] for i in range(n)], (np.eye(n) / n + m / np.abs(a).sum()) @ x)


def brute_neighbours(ids, x, k, metric):
    if metric == "cosine":
        norm = np.sqrt((x * x).sum(1, keepdims=True))
        u = x / np.where(norm > 0, norm, 1)
        w = 1 - u @ u.T
        w[ids[:, None] == ids] = np.inf
    else:
        w = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    near = {int(i): np.lexsort((ids, np.round(d, 9)))[:k] for i, d in zip(ids, w, strict=True)}
    return {i: [(int(ids[j]), round(float(d[j]), 6)) for j in near[i] if np.isfinite(d[j])] for (i, d) in zip(near, w, strict=True)}


@pytest.mark.parametrize("metric", ["euclid", "cosine"])
@pytest.mark.parametrize("case", ["groups", "equal", "few"])
def test_vector_neighbours_equal_brute_force(spark, metric, case):
    rng = np.random.default_rng(0)
    x = {"groups": rng.normal(size=(300, 7)) + 40 * np.eye(7)[rng.integers(0, 7, 300)], "equal": np.repeat(rng.integers(0, 3, (5, 4)).astype(float), 40, axis=0), "few": np.concatenate([np.zeros((3, 2)), rng.normal(size=(4, 2))])}[case]
    ids = rng.permutation(1000)[: len(x)]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, v array<double>")
    for k in (1, 12):
        got = {}
        for r in graph.knn_vectors(df, k, metric, rows=32).collect():
            got.setdefault(r.src, []).append((round(r.w, 9), r.dst, round(r.w, 6)))
        assert {i: [(d, w) for _, d, w in sorted(v)] for i, v in got.items()} == brute_neighbours(ids, x, k, metric)
    if case == "groups":
        made = graph.vector_blocks(df, 3, metric, 32)
        assert graph.block_pairs(made).count() < 0.6 * made.count() ** 2  # pairs of far groups are left out


def test_vector_blocks_are_sent_to_groups_and_not_to_blocks(spark):
    """No pruning helps here, yet what is sent grows with the blocks times a few groups; and of equal rows a few are met."""
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 9)))], "id long, v array<double>")
    made = graph.vector_blocks(df, 3, "euclid", 8)
    many = made.count()
    sent = graph.dealt(made, 4, made.agg(F.max("block")).first()[0] + 1).select("group", "b", "least").collect()
    assert graph.block_pairs(made).count() > 0.9 * many**2 and len(sent) <= 4 * many and len({(r.group, r.b) for r in sent}) == len(sent)
    assert len({r.b for r in sent if r.least < 0}) == many == sum(r.least < 0 for r in sent)
    y = np.repeat(rng.normal(size=(3, 2)), 50, axis=0)
    assert graph._targets(np.arange(150), y, 2)[0].tolist() == [0, 1, 2, 50, 51, 52, 100, 101, 102]


def test_vector_neighbours_are_searched_once(spark, sf, monkeypatch):
    seen = given_to(monkeypatch, graph, "vector_blocks")
    s = queries.spaco(spark, sf)
    assert s.test().count() > 0 and s.projection().count() > 0 and len(s.sigma()) > 0 and len(seen) == 1
    assert "MapInArrow" not in s.edges._jdf.queryExecution().toString()
    assert graph.knn_vectors(spark.createDataFrame([], "id long, v array<double>"), 3).count() == 0


def dense_morph(image, offsets, dilate):
    there, out = ~np.isnan(image), np.full(image.shape, np.nan)
    for y, x in zip(*np.nonzero(there), strict=True):
        seen = [image[y - dy, x - dx] for dy, dx in offsets if 0 <= y - dy < image.shape[0] and 0 <= x - dx < image.shape[1] and there[y - dy, x - dx]]
        out[y, x] = (max if dilate else min)(seen)
    return out


def test_tiles_equal_dense_images(spark):
    """Small tiles, an image of an odd size with holes: masks, edges, warps and their correlation against dense arrays."""
    from spectrel.operators import raster
    from spectrel.plans import registration as reg

    rng = np.random.default_rng(2)
    h, w, side = 37, 53, 16
    image = rng.random((h, w))
    holes = image.copy()
    holes[rng.random((h, w)) < 0.1] = np.nan
    holes[16:32, 16:32] = np.nan  # a whole tile
    df = lambda a: spark.createDataFrame([(int(y), int(x), float(a[y, x])) for y, x in zip(*np.nonzero(~np.isnan(a)), strict=True)], "y long, x long, value double")

    def dense(tiles, h=h, w=w):
        out = np.full((h, w), np.nan)
        for r in raster.to_pixels(tiles, side=side).collect():
            out[r.y, r.x] = r.value
        return out

    for a in (image, holes):
        tiles = raster.to_tiles(df(a), side)
        assert np.array_equal(dense(tiles), a, equal_nan=True) and np.array_equal(raster.gathered(tiles, h, w, side), np.nan_to_num(a))
        r, f = raster.shapes(reg.CLOSE_AND_OPEN)
        want = np.where(np.isnan(a), np.nan, a > 0.4)
        made = raster.around(raster.to_tiles(df(want), side), r, f, side)
        for offsets, dilate in reg.CLOSE_AND_OPEN:
            want = dense_morph(want, offsets, dilate)
        assert r == 6 and np.array_equal(dense(made), want, equal_nan=True)
        assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2  # pixels to tiles, and rims
        edges = raster.around(tiles, 1, raster.edges(h, w), side)
        assert np.allclose(dense(edges), np.where(np.isnan(a), np.nan, reg._edges(np.nan_to_num(a))), equal_nan=True)
        m = np.array([[0.9, 0.2, -3.3], [-0.15, 1.1, 4.0], [0, 0, 1]])
        warped = raster.sampled(tiles, raster.affine_origin(m), 41, 30, side)
        assert np.allclose(dense(warped, 41, 30), reg._sampled(np.nan_to_num(a), m, 41, 30))
        small = raster.sampled(tiles, raster.resize_origin((h, w), (5, 4)), 5, 4, side)
        assert np.allclose(dense(small, 5, 4), reg._sampled(np.nan_to_num(a), np.linalg.inv(np.array([[w / 4, 0, 0.5 * w / 4 - 0.5], [0, h / 5, 0.5 * h / 5 - 0.5], [0, 0, 1]])), 5, 4))
        both = ~np.isnan(a)
        assert raster.correlation(tiles, edges, side) == pytest.approx(np.corrcoef(a[both], dense(edges)[both])[0, 1])
    assert raster.correlation(tiles, raster.sampled(tiles, lambda x, y: (x + 1000, y), h, w, side), side) == 0
    with pytest.raises(Exception, match="twice"):
        raster.to_tiles(df(image).unionAll(df(image)), side).count()
    assert raster.to_tiles(df(image).limit(0), side).count() == 0


def test_groups_by_method(spark):
    """Planted groups by either method; k-means is no worse than the planted centres, and every vector is with its nearest centre."""
    from spectrel.plans import clustering

    rng = np.random.default_rng(4)
    x = 8 * np.eye(4)[rng.integers(0, 4, 120)] + rng.normal(size=(120, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    cost = lambda label: sum(((x[label == c] - x[label == c].mean(0)) ** 2).sum() for c in np.unique(label))
    planted = x.argmax(1)
    for method in ("kmeans", "communities"):
        found = np.array([r.label for r in clustering.groups(df, method).orderBy("id").collect()])
        sizes = np.bincount(found)
        assert list(sizes) == sorted(sizes, reverse=True) and len({*zip(planted, found, strict=True)}) == len(sizes) == 4
    found = np.array([r.label for r in clustering.kmeans(df, 7).orderBy("id").collect()])
    assert cost(found) < cost(planted)
    centres = np.stack([x[found == c].mean(0) for c in range(7)])
    assert (((x[:, None] - centres) ** 2).sum(2).argmin(1) == found).all()
    assert {r.label for r in clustering.kmeans(df, 1).collect()} == {0}
    for wrong in (lambda: clustering.kmeans(df, 0), lambda: clustering.kmeans(df.limit(0), 2), lambda: clustering.groups(df, "other")):
        with pytest.raises(ValueError):
            wrong()


def test_feature_components_and_maps_equal_dense(spark):
    from spectrel.plans import clustering

    s, _, lap, vk, z = directed(spark)
    c = z.T @ lap @ vk
    c = c / np.sqrt((c**2).sum(axis=0))
    got = np.array([r.v for r in clustering.feature_components(s).orderBy("id").collect()])
    assert np.allclose(got, c)
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "id long, label int")
    maps = clustering.mean_projection(s, features.mean_by_label(clustering.feature_components(s), labels))
    want = vk @ np.stack([c[::2].mean(0), c[1::2].mean(0)], axis=1)
    assert np.allclose([r.v for r in maps.orderBy("id").collect()], want)


def test_imhof_keeps_its_accuracy():
    """Chi-square distributions in closed form: few and many degrees, tiny and mixed weights, far quantiles, and the case of one degree."""
    from math import erf, exp, factorial, sqrt

    even = lambda x, k: 1 - exp(-x / 2) * sum((x / 2) ** i / factorial(i) for i in range(k // 2))
    n = 40_000
    for acc in (1e-4, 1e-6, 1e-8):
        for x in (2.0, 15.0, 20.0, 31.41, 80.0):
            assert abs(imhof_cdf(2 / n * x, np.full(20, 2 / n), acc=acc) - even(x, 20)) <= acc
        assert abs(imhof_cdf(5.0, [1.0], dfs=[2], acc=acc) - even(5.0, 2)) <= acc
        # The difference of two exponentials of one scale is Laplace's distribution.
        for x in (-3.0, 0.5, 4.0):
            laplace = 0.5 * exp(x / 2) if x < 0 else 1 - 0.5 * exp(-x / 2)
            assert abs(imhof_cdf(x, [1.0, -1.0], dfs=[2, 2], acc=acc) - laplace) <= acc
    for x in (0.1, 1.0, 3.841459, 10.0):
        assert abs(imhof_cdf(x, [1.0], acc=1e-5) - erf(sqrt(x / 2))) <= 1e-5
    assert imhof_cdf(0.5, [3.0, 1e-9, 0.0], dfs=[4, 1, 1]) == pytest.approx(even(0.5 / 3, 4), abs=2e-6)
    with pytest.raises(ArithmeticError):
        imhof_cdf(0.0, [1.0, -1.0], acc=1e-15)


def test_ranks_without_lists(spark):
    """Groups far larger than what may meet in a row, with ties, wide ranges and one value only; ranks against sorted values."""
    rng = np.random.default_rng(3)
    groups = {0: rng.normal(size=3000), 1: np.repeat([1.0, 2.0, 2.0, 5.0], 500), 2: np.exp(rng.normal(size=1000) * 20), 3: np.full(700, 4.5), 4: np.array([1.0, 7.0]), 5: np.array([3.0])}
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in rng.permutation(v)], "g int, value double").repartition(4)
    want = {(g, r): sorted(v)[r] for g, v in groups.items() for r in {0, len(v) // 3, len(v) // 2, len(v) - 1}}
    asked = spark.createDataFrame(list(want), "g int, rank long")
    for listed in (20, 10_000):
        assert {(r.g, r["rank"]): r.value for r in features.at_ranks(df, ["g"], asked, listed).collect()} == want
    one = spark.createDataFrame([(i % 30, i // 30, "f", float(rng.random())) for i in range(900) if i % 7], "x long, y long, feature string, value double").unionAll(spark.createDataFrame([(0, 0, "g", 1.0), (29, 29, "g", 1.0)], "x long, y long, feature string, value double"))
    u, pixels = 40, one.select("x", "y").distinct().groupBy(F.floor(F.col("x") / 40).alias("tile_x"), F.floor(F.col("y") / 40).alias("tile_y")).agg(F.count(F.lit(1)).alias("n"))
    small = {r.feature: r.value for r in features._tile_values(one, u, pixels, "median", 10).collect()}
    cells = one.groupBy("x", "y").pivot("feature", ["f", "g"]).agg(F.sum("value")).na.fill(0).toPandas()
    assert small == {"f": cells["f"].median(), "g": 0.0}


def test_layout_of_many_parts(spark):
    """Groups stay apart when the rows are dealt into parts, and a dense version gives the same memberships."""
    from spectrel.plans import layout

    rng = np.random.default_rng(1)
    n, k = 1500, 8
    x = rng.normal(size=(n, 4)) + 25 * np.eye(4)[np.arange(n) % 3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    at = np.array([[r.x, r.y] for r in layout.planar_layout(df, k, epochs=200, part=400).orderBy("id").collect()])
    d = ((at[:, None] - at) ** 2).sum(2) + np.eye(n) * 1e9
    assert at.shape == (n, 2) and (d.argmin(1) % 3 == np.arange(n) % 3).mean() > 0.97
    p = np.zeros((n, n))
    w = np.sqrt(((x[:, None] - x) ** 2).sum(2)) + np.eye(n) * 1e9
    for i in range(n):
        near = np.argsort(w[i])[: k - 1]
        gap = w[i, near] - w[i, near].min()
        lo, hi = 1e-12, w[i, near].max() * 1e3
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if np.exp(-gap / mid).sum() < np.log2(k) else (lo, mid)
        p[i, near] = np.exp(-gap / hi)
    p = p + p.T - p * p.T
    made = layout.memberships(graph.knn_vectors(df, k).where("src <> dst"), k).collect()
    assert len(made) == np.count_nonzero(np.triu(p)) and np.allclose([p[r.a, r.b] for r in made], [r.w for r in made], atol=1e-6)


def test_written_images_are_read_back(spark, tmp_path):
    """Gray and colour, several strips and one without pixels; what fails leaves no file and what was there before."""
    from spectrel.sources.images import write_image

    rng = np.random.default_rng(5)
    h, w = 150, 40
    image = rng.integers(0, 256, (h, w, 3))
    at = [(y, x, *map(int, image[y, x])) for y in range(h) for x in range(w) if not 64 <= y < 128]
    df = spark.createDataFrame(at, "y int, x int, r int, g int, b int").repartition(5)
    image[64:128] = 0
    for columns, name in ((("r", "g", "b"), "colour.tif"), (("g",), "gray.tif")):
        path = str(tmp_path / name)
        write_image(df, path, h, w, columns)
        got = np.zeros((h, w, 3), int)
        for p in read_image(spark, path).collect():
            got[p.y, p.x] = p.r, p.g, p.b
        assert np.array_equal(got, image if len(columns) == 3 else np.repeat(image[:, :, 1:2], 3, axis=2))
    before = (tmp_path / "gray.tif").read_bytes()
    wrong = [df.limit(0), df.withColumn("g", F.lit(300)), df.unionAll(df), df.withColumn("y", F.col("y") + 100), df.withColumn("x", F.col("x") - 1)]
    for bad in wrong:
        for name in ("gray.tif", "new.tif"):
            with pytest.raises(Exception, match="no image|from 0 to 255|twice|outside"):
                write_image(bad, str(tmp_path / name), h, w, ("g",))
    assert (tmp_path / "gray.tif").read_bytes() == before and not (tmp_path / "new.tif").exists() and not list(tmp_path.glob("*.writing"))
    write_image(df.withColumn("g", F.lit(7)), str(tmp_path / "gray.tif"), h, w, ("g",))
    assert (tmp_path / "gray.tif").read_bytes() != before


def test_null_of_a_directed_graph_over_blocks(spark):
    """Both ways over several blocks, and dense eigenvalues of the permuted forms; the largest of matrices with complex pairs."""
    from spectrel.plans import spaco

    rng = np.random.default_rng(8)
    n, p = 130, 14
    v = rng.normal(size=(n, p)) + 0.05 * np.arange(n)[:, None] * rng.normal(size=p)
    made = spark.createDataFrame([(3 * i, float(i % 13), float(i // 13), v[i].tolist()) for i in range(n)], "id long, x double, y double, v array<double>")
    edges = graph.knn(made.select("id", "x", "y"), 6)
    s = spaco.Spaco(made.select("id", "v"), edges, keep=0.99)
    s.graph = spaco.BlockedGraph(edges, made.select("id"), rows=40)
    s.white_packed = s.graph.product(s.graph.pack(s.white.select("id", "v")))
    w = np.stack([r.v for r in s.white.orderBy("id").collect()])
    a = np.zeros((n, n))
    for e in edges.collect():
        a[e.src // 3, e.dst // 3] = e.w
    lap = np.eye(n) / n + a / np.abs(a).sum()
    dense = sorted(np.linalg.eigvals(m.T @ lap @ m).real.max() for m in (w[spaco.permuted(np.arange(n), n, 2, k)] for k in range(3)))
    assert w.shape[1] > 8 and np.allclose(s.null_values(3, seed=2), dense, rtol=1e-5) and np.allclose(s.null_values(3, seed=2, max_bytes=0, block=2), dense, rtol=1e-5)
    matrices = rng.normal(size=(20, 60, 60))
    found = spaco.largest(lambda z: np.stack([m @ z[:, i] for i, m in enumerate(matrices)], axis=1), 60, 20, 0)
    assert np.allclose(found, [np.linalg.eigvals(m).real.max() for m in matrices], rtol=1e-5)


def test_leading_pairs_without_the_matrix(spark, monkeypatch):
    """Against all eigenvalues of the matrix, and components of a table whose columns are far more than its rows."""
    from spectrel.plans import spaco

    rng = np.random.default_rng(9)
    for rows, p, keep in ((500, 120, 0.6), (40, 300, 0.9), (40, 300, 0.9999), (30, 7, 1 - 1e-9)):
        x = rng.normal(size=(rows, p)) * np.exp(-np.arange(p) / 20)
        c = x.T @ x
        values, vectors = np.linalg.eigh(c)
        r = int(np.searchsorted(np.cumsum(values[::-1]) / np.trace(c), keep)) + 1
        got, basis = spaco.leading(lambda q: x.T @ (x @ q), p, np.trace(c), keep, block=8)
        assert len(got) == r and np.allclose(got, values[::-1][:r], rtol=1e-8) and np.allclose(np.abs((basis * vectors[:, ::-1][:, :r]).sum(axis=0)), 1, atol=1e-8)
    n, p = 50, 20_000
    v = rng.normal(size=(n, 3)) @ rng.normal(size=(3, p)) + 0.05 * rng.normal(size=(n, p))
    made = spark.createDataFrame([(i, float(i % 10), float(i // 10), v[i].tolist()) for i in range(n)], "id long, x double, y double, v array<double>")
    edges = graph.symmetric(graph.knn(made.select("id", "x", "y"), 4))
    s = spaco.Spaco(made.select("id", "v"), edges, keep=0.9)
    assert s.whitener.shape == (p, 3) and s.projection().count() == n and len(s.columns) == p
    z = (v - v.mean(0)) / v.std(0)
    assert np.allclose(np.linalg.svd(z, compute_uv=False)[:3] ** 2 / (n - 1), 1 / (s.whitener**2).sum(axis=0), rtol=1e-8)
    few = made.select("id", F.slice("v", 1, 12).alias("v"))
    want = spaco.Spaco(few, edges, keep=0.99).all_values
    monkeypatch.setattr(spaco, "WIDE", 5)
    assert np.allclose(spaco.Spaco(few, edges, keep=0.99).all_values, want, rtol=1e-8)
