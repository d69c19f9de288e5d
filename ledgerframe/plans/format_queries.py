"""Queries that carry tables through the record formats, the span ingest and a stream, and back."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerframe.functions.predicates import eq, where
from ledgerframe.operators import registry
from ledgerframe.operators.spans import ingest_json, printable
from ledgerframe.sources import convert
from ledgerframe.sources.codec import log_header, log_record, recover_log
from ledgerframe.sources.recordfile import directory_index, register
from ledgerframe.sources.scratch import scratch_path
from ledgerframe.sources.textfmt import read_text_records
from ledgerframe.streaming.ingest import running_totals

COLUMNS = ("c_custkey", "c_name", "c_acctbal", "rich", "sparse")
COLUMNS_SQL = "c_custkey, c_name, c_acctbal, c_acctbal > 0 AS rich, CASE WHEN c_custkey % 10 = 0 THEN c_mktsegment END AS sparse"


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flat table with every scalar type and a field that is present in a tenth of the rows."""
    sparse = F.when(F.col("c_custkey") % 10 == 0, F.col("c_mktsegment")).alias("sparse")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_acctbal", (F.col("c_acctbal") > 0).alias("rich"), sparse)


def through_files(frame: DataFrame, layout: str) -> DataFrame:
    """frame, written by the data source as files of the layout and read again by it."""
    spark, path = frame.sparkSession, scratch_path(frame.sparkSession, "records")
    register(spark)
    frame.write.format("recordfile").mode("append").options(layout=layout, page_size=256).save(path)
    return spark.read.format("recordfile").load(path.removeprefix("file://")).select(*frame.columns)


def layout_query(layout: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: through_files(customers(spark, sf_dir), layout)


def layout_stream(layout: str) -> Callable[[SparkSession, str], DataFrame]:
    """Files read as a stream, as if they still grew, into a table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame, source, out = customers(spark, sf_dir), scratch_path(spark, "growing"), scratch_path(spark, "streamed")
        register(spark)
        frame.write.format("recordfile").mode("append").options(layout=layout, page_size=256).save(source)
        stream = spark.readStream.format("recordfile").load(source.removeprefix("file://")).select(*frame.columns)
        query = stream.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "progress")).start(out)
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return spark.read.schema(frame.schema).parquet(out)

    return run


def layout_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same predicate gives the same rows whatever the layout."""
    frame = customers(spark, sf_dir)
    out = None
    for layout in ("row", "compact", "columnar", "paged"):
        rows = where(through_files(frame, layout), ~eq("sparse", "BUILDING") & eq("rich", True)).agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))
        rows = rows.select(F.lit(layout).alias("layout"), "n", "total")
        out = rows if out is None else out.unionByName(rows)
    return out


def text_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written as source files of the text format and compiled to rows; a macro adds to the key."""
    nation, path = spark.read.parquet(f"{sf_dir}/nation.parquet"), scratch_path(spark, "source")
    source = F.format_string('nation { key: =%d name: "%s" next: !@key + =1 label: !"n-" + @name region: ^ }', "n_nationkey", "n_name")
    nation.select(source.alias("value")).repartition(4).write.text(path)
    schema = T.StructType.fromDDL("key long, name string, next long, label string")
    rows = read_text_records(spark, path, schema)
    return rows.select("key", "name", "next", "label", F.array_contains("_null_fields", "region").alias("region_is_null"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with a field that is missing in some rows, text that needs quotes, and numbers of both kinds."""
    size = F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")).alias("size")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("key"), F.concat(F.col("p_name"), F.lit(' "a", b')).alias("name"), size, F.round("p_retailprice", 2).alias("price"), (F.col("p_size") > 25).alias("large"))


def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported as one object per line, imported with inferred types."""
    path = scratch_path(spark, "json")
    convert.write_json(_parts(spark, sf_dir), path)
    return convert.read_json(spark, path, lines=True).select("key", "name", "size", "price", "large")


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    convert.write_csv(_parts(spark, sf_dir), path, delimiter=";")
    return convert.read_csv(spark, path, delimiter=";").select("key", "name", "size", "price", "large")


def csv_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a schema hint nothing is inferred: a number stays text where the hint says so."""
    path = scratch_path(spark, "csv")
    convert.write_csv(_parts(spark, sf_dir), path)
    return convert.read_csv(spark, path, hint={"key": "string", "price": "f64"})


def xml_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as elements with an attribute, in one document."""
    path = scratch_path(spark, "xml")
    element = F.format_string('<nation id="%d"><name>%s</name></nation>', "n_nationkey", "n_name")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(element.alias("e"))
    nation.agg(F.concat(F.lit("<list>"), F.array_join(F.collect_list("e"), "\n"), F.lit("</list>")).alias("value")).write.text(path)  # 25 nations
    return convert.read_xml(spark, path, "nation").select("id", "name")


def registry_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a subject and one of another, in the order of the registry."""
    path, schema = scratch_path(spark, "registry"), spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", "r_name").schema
    registry.push(spark, path, "region", schema)
    registry.push(spark, path, "region", T.StructType([*schema, T.StructField("note", T.StringType())]))
    registry.push(spark, path, "region", T.StructType([*schema, T.StructField("note", T.StringType())]))  # known: no new version
    registry.push(spark, path, "other", schema)
    return registry.listing(spark, path).select("subject", "version", "key_count", "policy")


def file_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by the index of a folder's files."""
    frame, path = customers(spark, sf_dir), scratch_path(spark, "records")
    register(spark)
    frame.write.format("recordfile").mode("append").options(layout="paged", page_size=256).save(path)
    return directory_index(spark, path).agg(F.sum("record_count").alias("records"), F.min(F.col("size_bytes") > 0).alias("sized"))


def _span_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    start = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    line = F.to_json(F.struct(
        F.lower(F.lpad(F.hex("user_id"), 32, "0")).alias("trace_id"), F.lower(F.lpad(F.hex(F.col("event_id") + 1), 16, "0")).alias("span_id"),
        F.col("event_type").alias("name"), start.alias("start_time_ns"), F.col("props").alias("payload"),
    ))
    return events.select(F.when(F.col("event_id") % 50 == 0, "{broken").otherwise(line).alias("value"))


def span_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans, _ = ingest_json(_span_lines(spark, sf_dir))
    return printable(spans).select("trace_id", "span_id", "name", "service", "start_time_ns", "duration_ns", "payload")


def span_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejected = ingest_json(_span_lines(spark, sf_dir))
    return rejected.agg(F.count("*").alias("rejected"))


def log_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans through append logs that end in a torn record, which recovery leaves out."""
    spans, _ = ingest_json(_span_lines(spark, sf_dir))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [r | {"payload": r["payload"].encode()} for r in part.to_pylist()]
            log = log_header() + b"".join(map(log_record, rows))
            back, _ = recover_log(log + log_record(rows[0])[:-9] if rows else log)
            yield pa.RecordBatch.from_arrays([pa.array([r["span_id"] for r in back], pa.int64()), pa.array([r["start_time_ns"] for r in back], pa.int64())], ["span_id", "start_time_ns"])

    return spans.mapInArrow(run, "span_id long, start_time_ns long")


def streaming_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and sum of a table read as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    name = f"totals_{uuid.uuid4().hex}"
    running_totals(spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet"), "user_id", name).awaitTermination()
    return spark.table(name).select("n", "total")


_SPANS_SQL = "SELECT lpad(lower(to_hex(user_id)), 32, '0') AS trace_id, event_id + 1 AS span_id, event_type AS name, '' AS service, epoch_ns(ts) AS start_time_ns, CAST(0 AS BIGINT) AS duration_ns, props AS payload FROM events WHERE event_id % 50 <> 0"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "layout_row": layout_query("row"), "layout_compact": layout_query("compact"), "layout_columnar": layout_query("columnar"), "layout_paged": layout_query("paged"), "layout_filter": layout_filter,
    "text_compile": text_compile, "span_ingest": span_ingest, "span_rejects": span_rejects, "log_recovery": log_recovery, "streaming_totals": streaming_totals,
    "stream_row": layout_stream("row"), "stream_compact": layout_stream("compact"), "stream_paged": layout_stream("paged"), "file_index": file_index,
    "json_round_trip": json_round_trip, "csv_round_trip": csv_round_trip, "csv_hint": csv_hint, "xml_import": xml_import, "registry_versions": registry_versions,
}
_PARTS_SQL = "SELECT CAST(p_partkey AS BIGINT) AS key, p_name || ' \"a\", b' AS name, CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_size AS BIGINT) END AS size, round(p_retailprice, 2) AS price, p_size > 25 AS large FROM part"
ORACLE_SQL: dict[str, str] = {x: f"SELECT {COLUMNS_SQL} FROM customer" for x in ("layout_row", "layout_compact", "layout_columnar", "layout_paged", "stream_row", "stream_compact", "stream_paged")} | {
    "json_round_trip": _PARTS_SQL, "csv_round_trip": _PARTS_SQL, "csv_hint": f"SELECT CAST(key AS VARCHAR) AS key, price FROM ({_PARTS_SQL})",
    "xml_import": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation",
    "registry_versions": "SELECT * FROM (VALUES ('other', CAST(1 AS BIGINT), CAST(2 AS BIGINT), 'additive_only'), ('region', 1, 2, 'additive_only'), ('region', 2, 3, 'additive_only')) AS t(subject, version, key_count, policy)",
    "file_index": "SELECT count(*) AS records, true AS sized FROM customer",
    "layout_filter": f"SELECT layout, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM (SELECT {COLUMNS_SQL} FROM customer), (VALUES ('row'), ('compact'), ('columnar'), ('paged')) AS l(layout) WHERE NOT coalesce(sparse = 'BUILDING', false) AND rich GROUP BY layout",
    "text_compile": "SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS name, CAST(n_nationkey + 1 AS BIGINT) AS next, 'n-' || n_name AS label, true AS region_is_null FROM nation",
    "span_ingest": _SPANS_SQL,
    "span_rejects": "SELECT count(*) AS rejected FROM events WHERE event_id % 50 = 0",
    "log_recovery": f"SELECT span_id, start_time_ns FROM ({_SPANS_SQL})",
    "streaming_totals": "SELECT count(*) AS n, CAST(sum(user_id) AS BIGINT) AS total FROM events",
}
