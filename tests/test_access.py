import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerframe.errors import OutOfBounds, RecordError
from ledgerframe.operators.access import Opened, SearchJob, column_numpy, column_scan, from_records, null_bitmap, scan
from ledgerframe.sources import fixtures, tools
from ledgerframe.sources.recordfile import files_at, register


def indexed(spark, n=10):
    return spark.range(n).select("id", F.when(F.col("id") % 2 == 0, F.col("id") * 0.5).alias("half"), F.col("id").alias("_record_index"))


def test_scan_visits_each_record_with_the_fields_it_has(spark):
    rows = scan(indexed(spark), lambda r, i: {"i": i, "keys": ",".join(sorted(r))} if i != 3 else None, "i long, keys string").collect()
    assert {r.i: r["keys"] for r in rows} == {i: "half,id" if i % 2 == 0 else "id" for i in range(10) if i != 3}


def test_columns_for_local_use(spark):
    frame = indexed(spark)
    assert [r.value for r in column_scan(frame, "half").orderBy("_record_index").collect()] == [i / 2 if i % 2 == 0 else None for i in range(10)]
    assert [r.absent for r in null_bitmap(frame, "half").orderBy("_record_index").collect()] == [i % 2 == 1 for i in range(10)]
    got = column_numpy(frame, "half")
    assert got.dtype == np.float64 and np.nansum(got) == 10.0 and np.isnan(got).sum() == 5


def test_from_records(spark):
    frame = from_records(spark, ["a", "b", "c"], [{"a": 1}, {"b": 2.5, "a": None}, {"b": 1}])
    assert frame.dtypes == [("a", "bigint"), ("b", "double"), ("c", "string")]
    assert [tuple(r) for r in frame.collect()] == [(1, None, None), (None, 2.5, None), (None, 1.0, None)]
    assert from_records(spark, ["a"], [], {"a": "long"}).count() == 0
    with pytest.raises(ValueError):
        from_records(spark, ["a"], [{"z": 1}])


def test_hints(spark, tmp_path):
    indexed(spark).write.parquet(str(tmp_path / "t"))
    frame = spark.read.parquet(str(tmp_path / "t"))
    assert [Opened(frame, h).strategy() for h in ("unknown", "sequential", "random", "partial")] == ["adaptive", "adaptive", "lazy", "lazy"]
    table = Opened(frame)
    for i in range(102):
        assert table.access(i % 10).count() == 1
    assert table.cache_stats()["kept"] and table.strategy() == "eager"
    table.pause()
    table.warmup()
    assert not table.cache_stats()["kept"]
    table.resume()
    table.warmup()
    assert table.cache_stats()["kept"]
    table.pause()
    whole = Opened(frame, "full")
    assert whole.cache_stats()["kept"]
    whole.pause()
    with pytest.raises(ValueError):
        Opened(frame, "soon")


def test_search_job(spark, tmp_path):
    frame = spark.range(100).select("id", F.format_string("Name %d", "id").alias("name"))
    job = SearchJob(frame, "name", "name 9", str(tmp_path / "a"))
    assert sorted(r.id for r in job.result().collect()) == [9, *range(90, 100)] and job.progress() == 1.0
    job = SearchJob(frame.where(F.expr("reflect('java.lang.Thread', 'holdsLock', 'x') = 'false'")).repartition(2), "name", "x", str(tmp_path / "b"))
    job.cancel()
    assert job.result() is None
    with pytest.raises(Exception, match="no_such|raise|USER"):
        SearchJob(frame.withColumn("name", F.raise_error(F.lit("no_such")).cast("string")), "name", "x", str(tmp_path / "c")).result()


def test_cancelled_search_stops_soon(spark, tmp_path):
    slow = spark.range(0, 1_000_000_000_000, 1, 4).select(F.sha2(F.col("id").cast("string"), 512).alias("name"))
    job, begun = SearchJob(slow, "name", "no such text", str(tmp_path / "slow")), time.time()
    time.sleep(1)
    assert 0 <= job.progress() < 1
    job.cancel()
    assert job.result() is None and time.time() - begun < 30


def test_tools_by_path(spark, tmp_path):
    frame = fixtures.sparse(fixtures.flat(spark, 50), 10, "id", "username").coalesce(1)
    paths = fixtures.write_all(frame, str(tmp_path / "all"))
    for layout in ("row", "compact", "columnar", "paged"):
        (path,) = files_at(paths[layout])
        assert tools.inspected(path)["record_count"] == 50 and len(tools.inspected(path, None)["records"]) == 50
        assert [f["name"] for f in tools.described(path)] == list(fixtures.FLAT)
        assert tools.fetched(path, 10)["score"] == 1.0 and "score" not in tools.fetched(path, 11)
        with pytest.raises(OutOfBounds):
            tools.fetched(path, -1)
        assert tools.to_json(spark, path, limit=1).startswith('[{"id":') and tools.to_json(spark, path, limit=0) == "[]"
        with pytest.raises(RecordError):
            tools.to_json(spark, path, limit=-1)
        sizes = tools.file_statistics(spark, paths[layout])
        assert sizes.agg(F.sum("total")).first()[0] == tools.inspected(path)["size_bytes"]
    tools.to_csv(spark, paths["columnar"], str(tmp_path / "csv"), ["username", "id"])
    assert tools.imported(spark, str(tmp_path / "csv"), "csv", str(tmp_path / "back"), "columnar") == 50
    assert tools.imported(spark, paths["json"], "ndjson", str(tmp_path / "back2"), "paged") == 50
    assert tools.opened(spark, str(tmp_path / "back")).drop("_record_index", "_file", "_null_fields").columns == ["username", "id"]
    with pytest.raises(RecordError):
        tools.imported(spark, paths["json"], "toml", str(tmp_path / "x"))
    assert tools.listed(spark, str(tmp_path / "back")).first().record_count == 50


def test_columns_are_read_alone(spark, tmp_path):
    register(spark)
    paths = fixtures.write_all(fixtures.flat(spark, 20), str(tmp_path / "all"))
    for layout in ("columnar", "paged", "row"):
        load = spark.read.format("recordfile").option("columns", "score, id").load
        assert load(paths[layout]).columns == ["score", "id", "_record_index", "_null_fields", "_file"]
        assert load(paths[layout]).agg(F.sum("score"), F.sum("id")).first()[1] == 190
        assert spark.read.format("recordfile").schema("_record_index long").load(paths[layout]).count() == 20
    with pytest.raises(Exception, match="no such column"):
        spark.read.format("recordfile").option("columns", "none").load(paths["row"]).count()
