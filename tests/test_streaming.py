import json

import pytest
from pyspark.sql import functions as F

from ledgerframe.errors import UnsupportedLayout
from ledgerframe.streaming.ingest import append_log, auto_seal, complete_pages, deliver, live_spans, paged, running_totals, seal_pages, sealing, span_lines, stream_metrics, windowed_counts
from ledgerframe.operators.spans import SPAN, seal, segment_statistics
from ledgerframe.sources.recordfile import register


def write_lines(folder, name, numbers):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({"trace_id": f"{i:032x}", "span_id": f"{i + 1:016x}", "start_time_ns": i, "duration_ns": i}) for i in numbers) + "\nbroken\n")


def test_log_seal_and_restart(spark, tmp_path):
    lines, log, segments = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "segments")
    write_lines(lines, "a", range(5))
    for batch in (range(5), range(5, 9)):
        write_lines(lines, f"f{batch[0]}", batch) if batch[0] else None
        append_log(span_lines(spark, str(lines)), log, str(tmp_path / "c1")).awaitTermination()
        sealing(span_lines(spark, str(lines)), segments, str(tmp_path / "c2")).awaitTermination()
    assert spark.read.schema(SPAN).parquet(log).count() == 9
    both = live_spans(spark, segments, log)
    assert both.count() == 18 and both.agg(F.sum("duration_ns")).first()[0] == 72


def test_totals_and_pages(spark, tmp_path):
    source = str(tmp_path / "src")
    spark.range(100).withColumn("v", F.col("id") * 1.0).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("id long, v double").parquet(source)
    running_totals(stream, "v", "totals").awaitTermination()
    assert tuple(spark.table("totals").first()) == (100, 4950.0)
    paged(stream, str(tmp_path / "pages"), str(tmp_path / "c"), "id", 32).awaitTermination()
    register(spark)
    back = spark.read.format("recordfile").load(str(tmp_path / "pages"))
    assert sorted(r.id for r in back.collect()) == list(range(96))
    assert seal_pages(spark, str(tmp_path / "pages"), str(tmp_path / "c"), stream.schema, "id", 32) == 4
    assert seal_pages(spark, str(tmp_path / "pages"), str(tmp_path / "c"), stream.schema, "id", 32) == 4
    assert sorted(r.id for r in back.collect()) == list(range(96))  # files found when the table was opened
    back = spark.read.format("recordfile").load(str(tmp_path / "pages"))
    assert sorted(r.id for r in back.collect()) == list(range(100))
    assert complete_pages(back.select("id"), "id", 32).count() == 3
    with pytest.raises(UnsupportedLayout):
        paged(stream, str(tmp_path / "x"), str(tmp_path / "y"), "id", layout="columnar")


def test_windows(spark):
    spans = spark.createDataFrame([(0, 0, i, None, "", "s", i * 30_000_000_000, 1, 0, None) for i in range(4)], SPAN)
    assert sorted(r.n for r in windowed_counts(spans).collect()) == [2, 2]


def test_auto_seal_goes_on_and_shows_each_span_once(spark, tmp_path):
    lines, segments, checkpoint = tmp_path / "in", str(tmp_path / "segments"), str(tmp_path / "c")
    seen = []
    for first in (0, 5, 9, 30):
        write_lines(lines, f"f{first}", range(first, {0: 5, 5: 9, 9: 30, 30: 33}[first]))
        query = auto_seal(span_lines(spark, str(lines)), segments, checkpoint, every=8)
        query.awaitTermination()
        seen.append(sorted(r.duration_ns for r in live_spans(spark, segments, checkpoint=checkpoint).collect()))
    assert seen == [list(range(n)) for n in (5, 9, 30, 33)]
    assert segment_statistics(spark, segments).first().segment_count >= 2
    metrics = stream_metrics(query)
    assert metrics["batches"] == 1 and metrics["rows"] >= 3 and metrics["first_rows_ms"] > 0


def test_sealing_a_log_again_replaces_its_segment(spark, tmp_path):
    log, segments = str(tmp_path / "log"), str(tmp_path / "segments")
    spark.createDataFrame([(0, 0, i, None, "", "s", 9 - i, 1, 0, None) for i in range(4)], SPAN).write.parquet(log)
    assert seal(spark, log, segments)["records"] == 4
    assert seal(spark, log, segments, drop=True)["records"] == 4
    assert live_spans(spark, segments).count() == 4
    assert spark.read.schema(SPAN).parquet(log).count() == 0 and seal(spark, log, segments)["records"] == 0


def test_callbacks(spark, tmp_path):
    source, got = str(tmp_path / "src"), []
    spark.range(5).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("id long").parquet(source)
    deliver(stream, str(tmp_path / "c"), got.append, lambda s: got.append(s.names), lambda: got.append("end"))
    assert got[0] == ["id"] and got[-1] == "end" and sorted(r["id"] for r in got[1:-1]) == list(range(5))
    failures = []
    deliver(stream, str(tmp_path / "d"), lambda r: r["none"], on_end=lambda: failures.append("end"), on_error=failures.append)
    assert len(failures) == 1 and isinstance(failures[0], Exception)
