"""Text records, the data source, conversion and spans through Spark."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerframe.errors import DepthLimit, ListTypeMismatch, MacroUnresolved, Overflow, ParseFailure, RecordError, UnsupportedLayout
from ledgerframe.operators import registry
from ledgerframe.operators.inference import infer_types
from ledgerframe.operators.spans import SPAN, find_span, find_time, find_trace, ingest_json, live_view, seal, segment_statistics
from ledgerframe.sources import codec, convert
from ledgerframe.sources.recordfile import directory_index, inspect, read_log, read_through_spark, register, write_log
from ledgerframe.sources.textfmt import parse, plain, read_text_records, records

TEXT = r'''
@layout columnar
# people
person { id: =1  name: "Zoë \"q\" é" tags: ["a", "b"] at: @2026-01-02T03:04:05.5 raw: <DEADbeef> }
person { id: =2, name: ^, sub { x: ~1.5e3 flag: ?true } tags: [] level: $info }
'''


def test_text_records():
    source = parse(TEXT)
    rows, schema = records(source)
    assert source.pragmas == {"layout": "columnar"}
    assert rows[0]["name"] == 'Zoë "q" é' and rows[0]["tags"] == ["a", "b"] and rows[0]["raw"] == b"\xde\xad\xbe\xef"
    assert rows[0]["at"] == 1767323045500000000 and rows[0]["sub"] is None
    assert rows[1] == {"id": 2, "name": None, "tags": [], "at": None, "raw": None, "sub": {"x": 1500.0, "flag": True}, "level": "info", "_null_fields": ["name"]}
    assert schema["sub"].dataType.simpleString() == "struct<x:double,flag:boolean>"


def test_macros():
    source = parse('a: =7 b: !@a * 2 + 1 c: !@a / 2 d: !-7 / 2 e: !"v" + "-" + @a f: !len("é") + len(@e) g: !now() h: !@a % 4 - ~0.5 url: !"@e/x"', clock=lambda: 99)
    got = {k: plain(v) for k, v in source.entries}
    assert got == {"a": 7, "b": 15, "c": 3, "d": -3, "e": "v-7", "f": 5, "g": 99, "h": 2.5, "url": "v-7/x"}


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("a: [=1, ~2.0]", ListTypeMismatch), ('a: "\\q"', ParseFailure), ("a: =99999999999999999999", Overflow), ("a: <abc>", ParseFailure), ("a: !@b", MacroUnresolved), ("a { b: =1", ParseFailure),
        ("a: !=9223372036854775807 + =1", Overflow), ("a: !=1 / =0", MacroUnresolved), ("a: 5", ParseFailure), ("a{" * 70 + "}" * 70, DepthLimit), ("a: @2026-13-01", ParseFailure),
    ],
)
def test_text_errors(text, error):
    with pytest.raises(error):
        parse(text)


def test_repeated_keys_are_a_list():
    rows, _ = records(parse("c { item { n: =1 } item { n: =2 } } c { item { n: =3 } }"))
    assert [r["item"] for r in rows] == [[{"n": 1}, {"n": 2}], [{"n": 3}]]


def test_text_source(spark, tmp_path):
    (tmp_path / "a.txt").write_text(TEXT)
    got = read_text_records(spark, str(tmp_path)).orderBy("_record_index").collect()
    assert [r.id for r in got] == [1, 2] and got[1].sub.x == 1500.0 and got[1]._null_fields == ["name"]


@pytest.mark.parametrize("layout", ["row", "compact", "columnar", "paged"])
def test_data_source(spark, tmp_path, layout):
    register(spark)
    frame = spark.range(500).select("id", (F.col("id") * 0.5).alias("score"), F.when(F.col("id") % 10 == 0, F.concat(F.lit("é"), F.col("id"))).alias("name"), (F.col("id") % 2 == 0).alias("even"), (F.col("id") * 1000).alias("at_ns"))
    path = str(tmp_path / "out")
    frame.repartition(3).write.format("recordfile").mode("append").option("layout", layout).option("page_size", 64).save(path)
    back = spark.read.format("recordfile").load(path)
    assert back.columns == [*frame.columns, "_record_index", "_null_fields", "_file"]
    assert convert.verified_copy(frame, back.select(*frame.columns))
    assert convert.verified_copy(frame, read_through_spark(spark, path, frame.schema).select(*frame.columns))
    listing = directory_index(spark, path).collect()
    assert sum(r.record_count for r in listing) == 500 and all(r.size_bytes for r in listing)
    data = open(listing[0].path.removeprefix("file:"), "rb").read()
    assert inspect(data)["layout"] == layout and len(inspect(data)["records"]) == 3
    frame.limit(5).coalesce(1).write.format("recordfile").mode("overwrite").option("layout", layout).save(path)
    assert spark.read.format("recordfile").load(path).count() == 5


def test_json(spark, tmp_path):
    rows = [{"id": 1, "f": "1.5", "n": {"a": True, "deep": {"x": "2026-01-01"}}, "l": [1]}, {"id": 2, "f": None, "n": {"a": False}}, {"id": 3, "f": "7.25", "extra": "z"}]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (tmp_path / "b.json").write_text(json.dumps({"records": rows}))
    for name in "ab":
        got = convert.read_json(spark, str(tmp_path / f"{name}.json")).orderBy("id")
        assert {c: k for c, k in got.dtypes} == {"id": "bigint", "f": "double", "n.a": "boolean", "n.deep.x": "bigint", "l": "string", "extra": "string"}
        assert [r["n.deep.x"] for r in got.collect()] == [1767225600000000000, None, None]
    lines = [json.loads(r.value) for r in got.select(convert.json_ready(got).alias("value")).collect()]
    assert lines[1] == {"id": 2, "n.a": False} and lines[0]["f"] == 1.5


def test_export_nulls_and_bytes(spark):
    frame = spark.createDataFrame([(1, None, b"\xff", float("nan"), ["name"]), (2, None, None, 0.5, [])], "id long, name string, raw binary, x double, _null_fields array<string>")
    assert json.loads(convert.json_array(frame)) == [{"id": 1, "name": None, "raw": "/w==", "x": None}, {"id": 2, "x": 0.5}]
    assert json.loads(convert.json_array(frame, 1, "hex"))[0]["raw"] == "ff"


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,flag,when\n1,"a ""q"", b",true,2026-01-01T00:00:01\n2,,false,\n')
    got = convert.read_csv(spark, str(tmp_path / "a.csv")).orderBy("id")
    assert [tuple(r) for r in got.collect()] == [(1, 'a "q", b', True, 1767225601000000000), (2, None, False, None)]
    convert.write_csv(got, str(tmp_path / "out"), ["name", "id"])
    assert [tuple(r) for r in convert.read_csv(spark, str(tmp_path / "out")).orderBy("id").collect()] == [('a "q", b', 1), (None, 2)]
    with pytest.raises(RecordError):
        convert.write_csv(got, str(tmp_path / "no"), ["nope"])
    (tmp_path / "b.csv").write_text("1\tx\n2\ty\n")
    assert convert.read_csv(spark, str(tmp_path / "b.csv"), "\t", header=False).columns == ["col_0", "col_1"]
    assert dict(convert.read_csv(spark, str(tmp_path / "a.csv"), hint={"id": "string", "flag": "bool"}).dtypes) == {"id": "string", "flag": "boolean"}


def test_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<rows><row id="1"><name>x</name><sub><n>1.5</n></sub></row><row id="2"><name>y</name></row></rows>')
    got = convert.read_xml(spark, str(tmp_path / "a.xml"), "row").orderBy("id")
    assert dict(got.dtypes) == {"id": "bigint", "name": "string", "sub.n": "double"} and [r.name for r in got.collect()] == ["x", "y"]
    assert "@id" in convert.read_xml(spark, str(tmp_path / "a.xml"), "row", "prefix").columns
    (tmp_path / "b.xml").write_text('<!DOCTYPE r [<!ENTITY e "x">]><r><row><a>&e;</a></row></r>')
    with pytest.raises(ParseFailure):
        convert.read_xml(spark, str(tmp_path / "b.xml"), "row")


def test_inference(spark):
    rows = [("1", "1", "true", "2026-01-01", "00ff00ff00ff00ff", "", "99999999999999999999"), ("+2", "2.5", "FALSE", "", "ab" * 8, None, "1")]
    got = {r.field: r.kind for r in infer_types(spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string, g string")).collect()}
    assert got == {"a": "int", "b": "string", "c": "bool", "d": "time", "e": "hex", "f": "null", "g": "string"}


def test_spans(spark, tmp_path):
    lines = [json.dumps({"trace_id": f"{i // 4:032x}", "span_id": f"{i + 1:016x}", "name": f"op{i}", "start_time_ns": 1000 - i, "payload": {"k": i}}) for i in range(8)]
    lines += ["not json", json.dumps({"trace_id": "12", "span_id": "1"}), "", json.dumps({"trace_id": "f" * 32, "span_id": "f" * 16, "parent_span_id": "1"})]
    spans, rejected = ingest_json(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert rejected.count() == 2 and spans.count() == 9
    assert [r.span_id for r in find_trace(spans, 0, 1).collect()] == [8, 7, 6, 5]
    assert find_span(spans, -1, -1, -1).first().parent_span_id == 1
    assert [r.start_time_ns for r in find_time(spans, 995, 997).collect()] == [995, 996, 997]
    assert json.loads(find_span(spans, 0, 0, 1).first().payload) == {"k": 0}
    log, segments = str(tmp_path / "log"), str(tmp_path / "segments")
    spans.coalesce(1).write.parquet(log)
    assert seal(spark, log, segments)["records"] == 9
    assert live_view(spark, segments, log).count() == 18
    stats = segment_statistics(spark, segments, log).first()
    assert (stats.segment_count, stats.sealed_records, stats.wal_records) == (1, 9, 9)
    raw = [r.asDict() | {"payload": b"{}"} for r in spans.collect()]
    (tmp_path / "raw").write_bytes(codec.log_header() + b"".join(map(codec.log_record, raw)) + b"OXYN\x40")
    back = read_log(spark, str(tmp_path / "raw"))
    assert back.schema == SPAN and back.count() == 9


def test_logs_of_bounded_size(spark, tmp_path):
    rows = spark.range(3000).selectExpr("id AS span_id", "id * 3 AS start_time_ns", "CASE WHEN id % 3 > 0 THEN concat('n', id) END AS name", "CASE WHEN id = 7 THEN '{}' END AS payload")
    given = rows.select(*(F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in SPAN))
    path = str(tmp_path / "logs")
    assert write_log(given.repartition(2), path, 20_000) == 3000
    sizes = [f.stat().st_size for f in (tmp_path / "logs").iterdir()]
    assert len(sizes) > 6 and max(sizes) < 20_200 and sum(sizes) > 100_000
    back = read_log(spark, path)
    assert back.schema == SPAN and sorted(map(str, back.collect())) == sorted(map(str, given.collect()))
    empty = str(tmp_path / "none")
    assert write_log(given.limit(0), empty) == 0 and read_log(spark, empty).collect() == []


def test_registry(spark, tmp_path):
    path, base = str(tmp_path / "schemas"), spark.range(1).schema
    more = spark.range(1).withColumn("x", F.lit("a")).schema
    first = registry.push(spark, path, "s", base)
    assert registry.push(spark, path, "s", base) == first
    second = registry.push(spark, path, "s", more)
    assert registry.by_hash(spark, path, second).first().version == 2 and registry.listing(spark, path).count() == 2
    with pytest.raises(registry.SchemaConflict):
        registry.push(spark, path, "s", base)


@pytest.mark.parametrize("layout", ["row", "paged"])
def test_files_that_grow(spark, tmp_path, layout):
    """Only complete records or pages are read, each once, also when more bytes come; a columnar file is refused."""
    from ledgerframe.sources.codec import Field, decode_header, write_file
    from ledgerframe.sources.recordfile import HIDDEN, Growing, schema_of

    fields = [Field("id", "="), Field("name", '"')]
    rows = [{"id": i, "name": f"n{i}"} if i % 3 else {"id": i} for i in range(40)]
    data = write_file(fields, rows, layout, 8)
    data = data[: decode_header(data).tail] if layout == "row" else data
    path = tmp_path / "in" / "a"
    path.parent.mkdir()
    reader = Growing(str(path.parent), StructType([*schema_of(fields).fields, *HIDDEN.fields]))
    offset, got, steps = reader.initialOffset(), [], []
    for size in (20, len(data) // 3, len(data) // 2, len(data)):
        path.write_bytes(data[:size])
        new, end = reader.read(offset)
        new = list(new)
        assert list(reader.readBetweenOffsets(offset, end)) == new
        steps.append(len(new))
        got, offset = got + new, end
    assert [(r[0], r[1], r[2]) for r in got] == [(r["id"], r.get("name"), i) for i, r in enumerate(rows)]
    assert steps[0] == 0 and all(steps[1:])
    path.write_bytes(write_file(fields, rows, "columnar"))
    with pytest.raises(UnsupportedLayout):
        reader.read(reader.initialOffset())


def test_long_headers_are_read_whole(spark, tmp_path, monkeypatch):
    from ledgerframe.sources.codec import Field, write_file
    from ledgerframe.sources.recordfile import read_header

    fields = [Field(f"field_{i}", "=") for i in range(300)]
    (tmp_path / "x").write_bytes(write_file(fields, [{"field_7": 1}], "row"))
    monkeypatch.setattr("ledgerframe.sources.recordfile.HEADER_BYTES", 64)
    header, data = read_header(str(tmp_path / "x"))
    assert len(header.fields) == 300 and len(data) == header.start
