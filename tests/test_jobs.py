"""The two jobs: against their SQL, over growing input, and run again."""

import json
import logging
import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from jobs import base, queries, terms, tiles
from spectrel.queries import peak_table

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_sql(spark, sf, name):
    at = sf.replace("0.001", "0.01")
    con = duckdb.connect()
    for p in ("lineitem", "documents"):
        con.execute(f"create view {p} as select * from read_parquet('{at}/{p}.parquet')")
    state = lambda: ({k: v for k, v in spark.conf.getAll.items() if k.startswith("spark.sql")}, len(spark.catalog.listTables()), len(spark.streams.active))
    before = state()
    got = __spark_entry__.queries()[name](spark, at).toPandas()
    want = con.execute(__spark_entry__.oracle_sql()[name]).fetchdf()[list(got.columns)]
    assert len(got) > 100 and sorted(map(tuple, got.values.tolist()), key=repr) == sorted(map(tuple, want.values.tolist()), key=repr)
    assert before == state()


def catalogue_of(docs, least=2):
    """(source, feature): samples, occurrences, samples of the source."""
    n, has, found = Counter(), Counter(), Counter()
    for text, source in docs:
        words = (text or "").lower().split()
        n[source] += 1
        has.update((source, w) for w in set(words))
        found.update((source, w) for w in words)
    return {k: (has[k], found[k], round(has[k] / n[k[0]], 9)) for k in has if has[k] >= least}


def read(spark, out):
    return {(r.source, r.feature): (r.n_samples, r.n_found, r.occupancy) for r in terms.result(spark, out).collect()}


def test_terms_take_only_what_is_new(spark, tmp_path, caplog):
    """Three deliveries; a source of its own stays as it is, one that is met again is counted anew. Odd sources keep apart."""
    docs = [[("a B b c", "web"), ("b C", "web"), (None, None), ("x x", None), ("x y", None), ("q", ""), ("q r", "")], [("c d d", "web"), ("d", "web"), ("7", "1/2=3"), ("7 é", "1/2=3")], [("x", None), ("", "web")]]
    folder, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    seen, stamps = [], {}
    for batch in docs:
        seen += batch
        spark.createDataFrame(batch, "text string, source string").withColumn("doc_id", F.lit(1)).coalesce(1).write.mode("append").parquet(folder)
        with caplog.at_level(logging.INFO, "spectrel.jobs"):
            assert terms.run(spark, folder, out, mark) == len(batch)
        assert f"read {len(batch)} new samples" in caplog.text
        assert read(spark, out) == catalogue_of(seen)
        assert terms.run(spark, folder, out, mark) == 0 and read(spark, out) == catalogue_of(seen)
        stamps[len(seen)] = {p.name: max(f.stat().st_mtime_ns for f in p.glob("*.parquet")) for p in Path(out, "catalogue").glob("part=*")}
    assert stamps[7]["part=s_"] == stamps[13]["part=s_"] and stamps[7]["part=none"] < stamps[13]["part=none"]
    # The last batch once more, as after a failure between its writes.
    again = spark.createDataFrame(docs[2], "text string, source string")
    terms.take(again, 2, out, 2)
    assert read(spark, out) == catalogue_of(seen)


def test_terms_in_several_batches(spark, tmp_path):
    docs = [(f"w{i % 3} w{i % 5} all", f"s{i % 2}") for i in range(40)]
    spark.createDataFrame(docs, "text string, source string").repartition(5).write.parquet(str(tmp_path / "in"))
    at = [str(tmp_path / x) for x in ("in", "out", "mark")]
    assert terms.run(spark, *at, {"least": 3, "files": 2}) == 40 and read(spark, at[1]) == catalogue_of(docs, 3)
    assert len({r.batch for r in spark.read.parquet(at[1] + "/samples").collect()}) == 3


def test_terms_of_no_rows(spark, tmp_path):
    at = [str(tmp_path / x) for x in ("in", "out", "mark")]
    spark.createDataFrame([], "text string, source string").write.parquet(at[0])
    assert terms.run(spark, *at) == 0 and terms.result(spark, at[1]).count() == 0


def test_tiles_replace_what_was_there(spark, sf, tmp_path):
    rows, out, config = peak_table(spark, sf.replace("0.001", "0.01")), str(tmp_path / "out"), base.defaults_of("tiles")
    tiles.run_on(spark, rows, out, config)
    first = sorted(tiles.result(spark, out).collect())
    tiles.run_on(spark, rows.where("mz < 40000"), out, config)
    fewer = tiles.result(spark, out)
    assert 0 < fewer.count() < len(first) and fewer.agg(F.max("mz_high")).first()[0] < 40000
    tiles.run_on(spark, rows, out, config)
    assert sorted(tiles.result(spark, out).collect()) == first
    tiles.run_on(spark, rows, str(tmp_path / "none"), config | {"min_intensity": 49, "tolerance": 1e9})  # all is dense, so there is no feature
    assert tiles.result(spark, str(tmp_path / "none")).count() == 0
    bands = {p.name for p in Path(out, "tiles").glob("band=*")}
    assert bands == {p.name for p in Path(out, "catalogue").glob("band=*")} == {f"band={r.band}" for r in first} and len(bands) > 2


def test_command_line(spark, sf, tmp_path):
    """A run of its own process, with a file of settings; unknown settings are an error."""
    (tmp_path / "own.json").write_text(json.dumps({"least": 5}))
    docs = [("a b", "s")] * 6 + [("c", "s")] * 4
    spark.createDataFrame(docs, "text string, source string").coalesce(1).write.parquet(str(tmp_path / "in"))
    call = [sys.executable, "-m", "jobs.terms", "--documents", f"{tmp_path}/in", "--output", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/mark", "--config", f"{tmp_path}/own.json"]
    done = subprocess.run(call, cwd=ROOT, capture_output=True, text=True, timeout=300, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] pyspark-shell"})
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read 10 new samples" in done.stderr and read(spark, f"{tmp_path}/out") == catalogue_of(docs, 5)
    with pytest.raises(ValueError):
        base.settings(spark, f"{tmp_path}/own.json", {"most": 1})


def test_terms_after_a_failure(spark, tmp_path, monkeypatch):
    """A batch fails after its counts were written and before the catalogue was: the next run takes it again, and nothing counts twice."""
    docs = [[("a a b", "s"), ("b", "t")], [("a c c", "s"), ("c", "s")]]
    at = [str(tmp_path / x) for x in ("in", "out", "mark")]
    write = lambda rows: spark.createDataFrame(rows, "text string, source string").coalesce(1).write.mode("append").parquet(at[0])
    write(docs[0])
    assert terms.run(spark, *at, {"least": 1, "files": 10}) == 2
    write(docs[1])
    real = terms.catalogue

    def fails(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(terms, "catalogue", fails)
    with pytest.raises(Exception, match="lost"):
        terms.run(spark, *at, {"least": 1, "files": 10})
    assert read(spark, at[1]) == catalogue_of(docs[0], 1)
    monkeypatch.setattr(terms, "catalogue", real)
    assert terms.run(spark, *at, {"least": 1, "files": 10}) == 2
    assert read(spark, at[1]) == catalogue_of(docs[0] + docs[1], 1) and not spark.streams.active


def test_tiles_after_a_failure(spark, sf, tmp_path, monkeypatch):
    rows, out, config = peak_table(spark, sf.replace("0.001", "0.01")), str(tmp_path / "out"), base.defaults_of("tiles")
    tiles.run_on(spark, rows, out, config)
    want = sorted(tiles.result(spark, out).collect())
    monkeypatch.setattr(tiles.features, "tile_median", lambda *_: rows.select("mz").where("raise_error('lost') is null"))
    with pytest.raises(Exception):  # noqa: B017
        tiles.run_on(spark, rows.where("mz < 50000"), out, config)
    monkeypatch.undo()
    tiles.run_on(spark, rows, out, config)
    assert sorted(tiles.result(spark, out).collect()) == want
