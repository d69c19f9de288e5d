"""Queries through streams, tools by path, callbacks, fixtures and cell conversions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerframe.errors import OutOfBounds
from ledgerframe.functions import scalars as X
from ledgerframe.operators import access, registry, spans
from ledgerframe.operators import records as R
from ledgerframe.plans.format_queries import COLUMNS_SQL, customers
from ledgerframe.sources import convert, fixtures, tools
from ledgerframe.sources.recordfile import files_at, read_log, register, write_log
from ledgerframe.sources.scratch import scratch_path
from ledgerframe.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by their dense number, with a field that a tenth of them have."""
    part = F.when(F.col("event_id") % 10 == 0, F.col("value")).alias("part")
    return read(spark, sf_dir, "events").select("event_id", "event_type", "value", part, F.col("event_id").alias(R.INDEX))


def event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = {"trace_id_hi": F.lit(0), "trace_id_lo": F.col("user_id"), "span_id": F.col("event_id"), "name": F.col("event_type"), "start_time_ns": F.unix_micros(F.col("ts").cast("timestamp")) * 1000}
    return read(spark, sf_dir, "events").select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in spans.SPAN))


def table_stream(frame: DataFrame, files: int, each: int) -> DataFrame:
    """The table as a stream of some micro-batches."""
    path = scratch_path(frame.sparkSession, "source")
    frame.repartition(files).write.parquet(path)
    return frame.sparkSession.readStream.schema(frame.schema).option("maxFilesPerTrigger", each).parquet(path)


EVENT_SPANS_SQL = "SELECT user_id AS trace_id_lo, event_id AS span_id, epoch_ns(ts) AS start_time_ns FROM events"
SPAN_COLUMNS = ("trace_id_lo", "span_id", "start_time_ns")


@query("SELECT event_id, event_type, value FROM events")
def page_stream(spark, sf_dir):
    """Events that arrive out of order in several micro-batches, written page by page and sealed."""
    frame = read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    folder, checkpoint = scratch_path(spark, "pages"), scratch_path(spark, "progress")
    stream = table_stream(frame, 6, 2)
    ingest.paged(stream, folder, checkpoint, "event_id", 256).awaitTermination()
    ingest.seal_pages(spark, folder, checkpoint, stream.schema, "event_id", 256)
    return tools.opened(spark, folder.removeprefix("file://")).select(*frame.columns)


@query(EVENT_SPANS_SQL)
def auto_seal(spark, sf_dir):
    """Spans of several micro-batches: segments of 2,000 or more, and what waits."""
    segments, checkpoint = scratch_path(spark, "segments"), scratch_path(spark, "progress")
    ingest.auto_seal(table_stream(event_spans(spark, sf_dir), 5, 1), segments, checkpoint, 2_000).awaitTermination()
    return ingest.live_spans(spark, segments, checkpoint=checkpoint).select(*SPAN_COLUMNS)


@query(EVENT_SPANS_SQL)
def live_spans(spark, sf_dir):
    """A log sealed twice, of which the second changes nothing, and a log that still grows."""
    log, late, segments = scratch_path(spark, "log"), scratch_path(spark, "late"), scratch_path(spark, "segments")
    rows = event_spans(spark, sf_dir)
    rows.where("span_id % 3 <> 0").write.parquet(log)
    rows.where("span_id % 3 = 0").write.parquet(late)
    spans.seal(spark, log, segments)
    spans.seal(spark, log, segments, drop=True)
    return ingest.live_spans(spark, segments, late).select(*SPAN_COLUMNS)


@query("SELECT count(*) AS records, (count(*) + 2) // 3 AS batches_of_three, true AS ended FROM nation")
def stream_callbacks(spark, sf_dir):
    """Records handed to a callback as they arrive (25 nations)."""
    seen, ended = [], []
    ingest.deliver(table_stream(read(spark, sf_dir, "nation"), 3, 1), scratch_path(spark, "progress"), lambda r: seen.append(r["n_nationkey"]), on_end=lambda: ended.append(True))
    return spark.createDataFrame([(len(set(seen)), -(-len(seen) // 3), ended == [True])], "records long, batches_of_three long, ended boolean")


@query("SELECT count(*) AS rows, true AS timed FROM events")
def stream_metrics(spark, sf_dir):
    source = table_stream(read(spark, sf_dir, "events"), 4, 1)
    job = source.writeStream.format("noop").option("checkpointLocation", scratch_path(spark, "progress")).trigger(availableNow=True).start()
    job.awaitTermination()
    got = ingest.stream_metrics(job)
    return spark.createDataFrame([(got["rows"], got["first_rows_ms"] > 0 and got["rows_per_second"] > 0)], "rows long, timed boolean")


@query("SELECT event_id, upper(event_type) AS kind, value IS NOT NULL AND event_id % 10 = 0 AS has_part FROM events WHERE value > 100")
def scan_visit(spark, sf_dir):
    """A callback for each record, which sees the fields that are present."""
    visit = lambda r, i: {"event_id": i, "kind": r["event_type"].upper(), "has_part": "part" in r} if r.get("value", 0) > 100 else None
    return access.scan(numbered_events(spark, sf_dir), visit, "event_id long, kind string, has_part boolean")


@query("SELECT event_id AS _record_index, CASE WHEN event_id % 10 = 0 THEN value END AS value FROM events")
def column_scan(spark, sf_dir):
    return access.column_scan(numbered_events(spark, sf_dir), "part")


@query("SELECT event_id AS _record_index, event_id % 10 <> 0 OR value IS NULL AS absent FROM events")
def null_bitmap(spark, sf_dir):
    return access.null_bitmap(numbered_events(spark, sf_dir), "part")


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(n_regionkey) AS DOUBLE) AS total FROM nation")
def column_array(spark, sf_dir):
    """A small table's column as a local array."""
    values = access.column_numpy(read(spark, sf_dir, "nation"), "n_regionkey")
    return spark.createDataFrame([(len(values), float(values.sum()))], "n long, total double")


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(NULL AS DOUBLE), 'x'), (2, 0.5, NULL), (NULL, 3.0, 'y')) AS t(id, score, name)")
def from_records(spark, sf_dir):
    return access.from_records(spark, ["id", "score", "name"], [{"id": 1, "name": "x"}, {"id": 2, "score": 0.5}, {"score": 3, "name": "y"}])


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the')")
def search_job(spark, sf_dir):
    """A search beside its caller, which tells how far it is and could be cancelled."""
    job = access.SearchJob(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", "The", scratch_path(spark, "found"))
    return job.result().select("doc_id")


@query("SELECT c_custkey FROM customer WHERE contains(lower(c_name), '7')")
def search_default_column(spark, sf_dir):
    frame = read(spark, sf_dir, "customer")
    return R.search_text(frame, R.default_search_column(frame.schema), "7").select("c_custkey")


@query("SELECT * FROM (VALUES ('unknown', 'adaptive', false), ('sequential', 'eager', true), ('random', 'lazy', false), ('full', 'eager', true), ('partial', 'lazy', false)) AS t(hint, strategy, kept)")
def open_hints(spark, sf_dir):
    """What each hint makes of a small table after one access."""
    rows = []
    for hint in access.HINTS:
        table = access.Opened(read(spark, sf_dir, "region").withColumn(R.INDEX, F.col("r_regionkey")), hint)
        table.access(0)
        stats = table.cache_stats()
        rows.append((hint, stats["strategy"], stats["kept"]))
        table.pause()
    return spark.createDataFrame(rows, "hint string, strategy string, kept boolean")


@query("SELECT c_custkey, true AS inside, true AS outside FROM customer ORDER BY c_custkey LIMIT 1")
def record_bounds(spark, sf_dir):
    """A record by its index, and an error for one that is not there."""
    frame = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias(R.INDEX))
    found, n = R.record_row(frame, 0), frame.count()
    outside = []
    for i in (-1, n):
        try:
            R.record_row(frame, i)
        except OutOfBounds:
            outside.append(i)
    return spark.createDataFrame([(found["c_custkey"], found[R.INDEX] == 0, outside == [-1, n])], "c_custkey long, inside boolean, outside boolean")


@query("SELECT event_id, value FROM events WHERE event_id BETWEEN 10 AND 29")
def viewport(spark, sf_dir):
    return R.viewport(numbered_events(spark, sf_dir), 10, 29).select("event_id", "value")


def written(frame: DataFrame, layout: str, **options: object) -> str:
    path = scratch_path(frame.sparkSession, layout)
    register(frame.sparkSession)
    frame.write.format("recordfile").mode("append").options(layout=layout, **options).save(path)
    return path.removeprefix("file://")


@query(f"SELECT {COLUMNS_SQL} FROM customer")
def transcode(spark, sf_dir):
    """Row files into columnar ones, and those into pages."""
    frame = customers(spark, sf_dir)
    columnar, paged = scratch_path(spark, "columnar").removeprefix("file://"), scratch_path(spark, "paged").removeprefix("file://")
    tools.transcoded(tools.opened(spark, written(frame, "row")), columnar, "columnar")
    tools.transcoded(tools.opened(spark, columnar), paged, "paged")
    return tools.opened(spark, paged).select(*frame.columns)


@query("SELECT layout, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer, (VALUES ('row'), ('columnar'), ('paged')) AS l(layout) GROUP BY layout")
def read_columns(spark, sf_dir):
    """One column of files of each layout."""
    out = None
    for layout in ("row", "columnar", "paged"):
        rows = spark.read.format("recordfile").option("columns", "c_acctbal").load(written(customers(spark, sf_dir), layout))
        rows = rows.agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total")).select(F.lit(layout).alias("layout"), "n", "total")
        out = rows if out is None else out.unionByName(rows)
    return out


_WIDE_SQL = "SELECT '{0}' AS field, coalesce(sum(octet_length(encode({1}))), 0) + 4 * (count(*) + 1) AS payload, (count(*) + 7) // 8 AS bits FROM customer"


@query(
    "SELECT field, CAST(payload AS BIGINT) AS payload, CAST((payload + 7) // 8 * 8 - payload AS BIGINT) AS padding, CAST((bits + 7) // 8 * 8 AS BIGINT) AS bitmap FROM ("
    + _WIDE_SQL.format("c_name", "c_name") + " UNION ALL " + _WIDE_SQL.format("sparse", "CASE WHEN c_custkey % 10 = 0 THEN c_mktsegment END")
    + " UNION ALL SELECT f.field, 8 * count(*), (count(*) + 7) // 8 FROM customer, (VALUES ('c_custkey'), ('c_acctbal'), ('rich')) AS f(field) GROUP BY f.field)"
)
def file_statistics(spark, sf_dir):
    """Bytes by column as they are in one file."""
    sizes = tools.file_statistics(spark, written(customers(spark, sf_dir).coalesce(1), "columnar"))
    return sizes.where("part = 'column'").select("field", "payload", "padding", "bitmap")


@query("SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'n_nationkey', '=', '7'), (1, 'n_name', '\"', (SELECT n_name FROM nation WHERE n_nationkey = 7))) AS t(slot, name, sigil, value)")
def record_by_path(spark, sf_dir):
    """A file's fields from its header and one record of it by index."""
    (path,) = files_at(written(read(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").coalesce(1), "compact"))
    record = tools.fetched(path, 7)
    return spark.createDataFrame([(f["slot"], f["name"], f["sigil"], str(record[f["name"]])) for f in tools.described(path)], "slot long, name string, sigil string, value string")


@query("SELECT c_custkey, c_name FROM customer")
def export_import(spark, sf_dir):
    """Two columns of record files as CSV, imported again as record files."""
    table, target = scratch_path(spark, "csv"), scratch_path(spark, "back").removeprefix("file://")
    tools.to_csv(spark, written(customers(spark, sf_dir), "paged"), table, ["c_name", "c_custkey"])
    tools.imported(spark, table, "csv", target, "columnar")
    return tools.opened(spark, target).select("c_custkey", "c_name")


@query("SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS name FROM nation")
def compile_files(spark, sf_dir):
    """Text sources compiled into record files."""
    source, target = scratch_path(spark, "source"), scratch_path(spark, "compiled").removeprefix("file://")
    text = F.format_string('nation { key: =%d name: "%s" }', "n_nationkey", "n_name")
    read(spark, sf_dir, "nation").select(text.alias("value")).coalesce(1).write.text(source)
    tools.compiled(spark, source, target)
    return tools.opened(spark, target).select("key", "name")


def _fixture_sql(columns: str) -> str:
    return f"SELECT {columns} FROM range((SELECT count(*) FROM events)) AS r(i)"


@query(_fixture_sql(f"i AS id, printf('user_%07d', i) AS username, printf('user%d@example.com', i) AS email, 20 + i % 50 AS age, round(100 + i * 1.37::DOUBLE, 2) AS balance, i % 3 <> 0 AS active, round((i % 100) / 10.0::DOUBLE, 1) AS score, CAST({fixtures.CREATED_NS} AS BIGINT) AS created_at"))
def fixture_flat(spark, sf_dir):
    return fixtures.flat(spark, read(spark, sf_dir, "events").count())


@query(_fixture_sql("i AS id, i % 256 AS bucket, i % 97 + 1 AS quantity, round(i * 1.11::DOUBLE, 4) AS amount, round(0.01::DOUBLE + (i % 50) * 0.001::DOUBLE, 6) AS rate, round((i % 1000) / 10.0::DOUBLE, 2) AS score, i % 64 AS category, i % 5 <> 0 AS active"))
def fixture_dense(spark, sf_dir):
    return fixtures.dense(spark, read(spark, sf_dir, "events").count())


@query("SELECT format, count(*) AS n, CAST(sum(i) AS BIGINT) AS ids, count(*) FILTER (WHERE i % 10 = 0) AS scored FROM range((SELECT count(*) FROM nation)) AS r(i), (VALUES ('row'), ('compact'), ('columnar'), ('paged'), ('json'), ('csv')) AS f(format) GROUP BY format")
def fixture_files(spark, sf_dir):
    """Sparse records in every format."""
    frame = fixtures.sparse(fixtures.flat(spark, read(spark, sf_dir, "nation").count()), 10, "id")
    paths = {k: p.removeprefix("file://") for k, p in fixtures.write_all(frame, scratch_path(spark, "fixtures")).items()}
    readers = {"json": lambda p: convert.read_json(spark, p, lines=True), "csv": lambda p: convert.read_csv(spark, p)}
    out = None
    for name, path in paths.items():
        rows = readers.get(name, lambda p: tools.opened(spark, p))(path)
        rows = rows.agg(F.count("*").alias("n"), F.sum("id").cast("long").alias("ids"), F.count("score").alias("scored")).select(F.lit(name).alias("format"), "n", "ids", "scored")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT event_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS day FROM events")
def epoch_day(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", X.epoch_days(F.col("ts")).alias("day"))


@query("SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_type END AS decoded FROM events")
def hex_cells(spark, sf_dir):
    """Hex digits to bytes; an odd number of digits is no value."""
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.hex("event_type"), F.lit("a"))).otherwise(F.hex("event_type"))
    return read(spark, sf_dir, "events").select("event_id", X.hex_bytes(text).cast("string").alias("decoded"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id END AS whole, CASE WHEN event_id % 3 <> 2 THEN CAST(event_id + CASE WHEN event_id % 3 = 1 THEN 0.5 ELSE 0 END AS DOUBLE) END AS number, CASE WHEN event_id % 3 = 2 THEN event_id % 2 = 0 END AS truth FROM events")
def coerce_cells(spark, sf_dir):
    """Text as integers, numbers and truth values; what doesn't fit is absent."""
    key = F.col("event_id")
    text = F.when(key % 3 == 0, key.cast("string")).when(key % 3 == 1, F.concat(key.cast("string"), F.lit(".5"))).otherwise(F.when(key % 2 == 0, "TRUE").otherwise("false"))
    cells = read(spark, sf_dir, "events").select("event_id", text.alias("text"))
    return cells.select("event_id", *(X.coerce(F.col("text"), kind).alias(name) for name, kind in (("whole", "int"), ("number", "float"), ("truth", "bool"))))


_SIZE_SQL = "WHEN size < {0} THEN printf('%.1f {1}', round(size / {2}::DOUBLE, 1)) "


@query("SELECT c_custkey, CASE WHEN size < 1024 THEN printf('%d B', size) " + _SIZE_SQL.format(1 << 20, "KiB", 1 << 10) + _SIZE_SQL.format(1 << 30, "MiB", 1 << 20) + _SIZE_SQL.format(1 << 62, "GiB", 1 << 30) + "END AS size FROM (SELECT c_custkey, c_custkey * c_custkey * 997 AS size FROM customer)")
def readable_sizes(spark, sf_dir):
    size = F.col("c_custkey") * F.col("c_custkey") * 997
    return read(spark, sf_dir, "customer").select("c_custkey", X.human_bytes(size).alias("size"))


@query("SELECT * FROM (VALUES ('customer'), ('customer_2'), ('_2nd'), ('a_b'), ('a_b_2'), ('field')) AS t(name)")
def identifiers(spark, sf_dir):
    return spark.createDataFrame([(n,) for n in X.unique_names(["customer", "customer", "2nd", "a b", "a-b", ""])], "name string")


@query("SELECT 'nation' AS subject, CAST(1 AS BIGINT) AS version, CAST(3 AS BIGINT) AS key_count")
def schema_by_hash(spark, sf_dir):
    """A registered schema by its hash, with or without 0x."""
    path = scratch_path(spark, "registry")
    key = registry.push(spark, path, "nation", read(spark, sf_dir, "nation").schema)
    registry.push(spark, path, "region", read(spark, sf_dir, "region").schema)
    return registry.by_hash(spark, path, f"0x{key.upper()}").select("subject", "version", "key_count")


@query("SELECT event_id AS span_id, event_type AS name FROM events")
def log_files(spark, sf_dir):
    """Spans of append logs, some a partition, as a table."""
    folder = scratch_path(spark, "logs")
    write_log(event_spans(spark, sf_dir).repartition(max(3, spark.sparkContext.defaultParallelism)), folder)
    return read_log(spark, folder).select("span_id", "name")
