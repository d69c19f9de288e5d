"""Registered queries and their SQL counterparts.

Each entry applies one operator to whole tables.  Record indexes of Parquet tables are defined by the
primary key's order.  sparse() is a column that is present in a tenth of the events, to exercise absence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerframe.functions import scalars as X
from ledgerframe.functions.predicates import Not, eq, first_match, gt, lt, truth, where
from ledgerframe.operators import inference, ordinals, reducers, spans
from ledgerframe.operators import records as R
from ledgerframe.operators import registry
from ledgerframe.plans import format_queries, tool_queries
from ledgerframe.sources import convert
from ledgerframe.sources.scratch import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
Query = Callable[..., DataFrame]
SPARSE_SQL = "CASE WHEN event_id % 10 = 0 THEN value END"


def sparse() -> Column:
    return F.when(F.col("event_id") % 10 == 0, F.col("value"))


def query(table: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function of a table (and, for more, of a reader of tables) under its own name."""

    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
            return f(read(table), read) if f.__code__.co_argcount > 1 else f(read(table))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def events_index(events: DataFrame) -> DataFrame:
    """event_id is dense and starts at zero, so it is the record index."""
    return events.withColumn(R.INDEX, F.col("event_id"))


@query("events", "SELECT user_id, round(sum(value), 2) AS total_value, count(*) AS n_events FROM events WHERE event_type = 'error' AND value > 100.0 GROUP BY user_id ORDER BY total_value DESC, user_id LIMIT 10")
def flagship_error_value(events):
    hot = where(events, eq("event_type", "error") & gt("value", 100.0))
    by_user = hot.groupBy("user_id").agg(F.round(F.sum("value"), 2).alias("total_value"), F.count("*").alias("n_events"))
    return by_user.orderBy(F.desc("total_value"), "user_id").limit(10)


# --- scans, projections, point access -------------------------------------------------------------


@query("nation", "SELECT * FROM nation")
def scan_all(nation):
    return nation


@query("lineitem", "SELECT l_shipdate, l_returnflag, l_extendedprice, l_orderkey FROM lineitem")
def project_columns(lineitem):
    return lineitem.select("l_shipdate", "l_returnflag", "l_extendedprice", "l_orderkey")


@query("orders", "SELECT o_orderkey, o_custkey, o_totalprice, i AS _record_index FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i = 42")
def point_lookup(orders):
    return R.records_at(orders.select("o_orderkey", "o_custkey", "o_totalprice"), [42], "o_orderkey")


@query("lineitem", "SELECT l_orderkey, l_partkey, l_quantity, l_tax, l_returnflag FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i FROM lineitem) WHERE i IN (7, 77, 777, 1777, 2777)")
def selective_read(lineitem):
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = R.records_at(lineitem.select(*keys, "l_quantity", "l_tax", "l_returnflag"), [7, 77, 777, 1777, 2777], *keys)
    return rows.select("l_orderkey", "l_partkey", "l_quantity", "l_tax", "l_returnflag")


@query("events", "SELECT event_id, user_id, value FROM events WHERE event_id % 20 = 0 AND event_id < 20 * 500")
def scattered_access(events):
    return R.scattered(events_index(events), 20).select("event_id", "user_id", "value")


@query("customer", "SELECT CAST(sum(length(c_name) + c_nationkey + CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) AS BIGINT) AS checksum FROM customer")
def multi_field_scan(customer):
    return customer.agg(F.sum(F.length("c_name") + F.col("c_nationkey") + (F.col("c_acctbal") > 0).cast("int")).alias("checksum"))


@query("events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def nested_path(events):
    rows = events.select("event_id", F.from_json("props", "k long").alias("props"))
    return rows.select("event_id", R.get(rows, "props.k", "i64").alias("k"))


@query("nation", "SELECT n_nationkey, NULL::VARCHAR AS name_as_number, NULL::VARCHAR AS missing FROM nation")
def typed_getters(nation):
    return nation.select("n_nationkey", R.get(nation, "n_name", "i64").cast("string").alias("name_as_number"), R.get(nation, "no_such_field").cast("string").alias("missing"))


@query("region", "SELECT * FROM (VALUES ('r_regionkey', 0), ('r_name', 1)) AS t(field, slot)")
def schema_keys(region):
    return region.sparkSession.createDataFrame([(f, i) for i, f in enumerate(region.columns)], "field string, slot int")


@query("orders", "SELECT count(*) AS record_count FROM orders")
def record_count(orders):
    return orders.agg(F.count("*").alias("record_count"))


# --- predicates ------------------------------------------------------------------------------------


def _predicate(name, table, pred, sql, columns):
    run = lambda spark, sf_dir: where(spark.read.parquet(f"{sf_dir}/{table}.parquet"), pred).select(*columns)
    QUERIES[name], ORACLE_SQL[name] = run, f"SELECT {', '.join(columns)} FROM {table} WHERE {sql}"


_L, _E = ("l_orderkey", "l_linenumber", "l_quantity"), ("event_id", "event_type", "value")
_predicate("filter_eq_str", "lineitem", eq("l_returnflag", "R"), "l_returnflag = 'R'", _L)
_predicate("filter_eq_i64", "lineitem", eq("l_linenumber", 1), "l_linenumber = 1", _L)
_predicate("filter_eq_f64", "lineitem", eq("l_quantity", 17.0), "l_quantity = 17.0", _L)
_predicate("filter_gt", "events", gt("value", 100.0), "value > 100", _E)
_predicate("filter_lt", "events", lt("value", 1.0), "value < 1", _E)
_predicate("filter_and", "events", eq("event_type", "click") & gt("value", 50.0), "event_type = 'click' AND value > 50", _E)
_predicate("filter_or", "events", gt("value", 150.0) | lt("value", 0.5), "value > 150 OR value < 0.5", _E)
_predicate("filter_not", "events", ~eq("event_type", "click"), "event_type <> 'click'", _E)
_predicate("filter_unknown_key", "events", eq("no_such_field", 1), "false", _E)
_predicate("filter_not_unknown_key", "events", ~gt("no_such_field", 1.0), "true", _E)
_predicate("filter_wrong_type", "events", eq("value", "100") | ~eq("event_type", 5), "true", _E)


@query("labels", "SELECT doc_id, (toxic = 1) AS is_toxic FROM labels WHERE (toxic = 1) = true")
def filter_eq_bool(labels):
    return where(labels.select("doc_id", (F.col("toxic") == 1).alias("is_toxic")), eq("is_toxic", True))


@query("events", f"SELECT event_id, sparse FROM (SELECT event_id, {SPARSE_SQL} AS sparse FROM events) WHERE NOT coalesce(sparse > 10, false)")
def filter_not_absent(events):
    return where(events.select("event_id", sparse().alias("sparse")), Not(gt("sparse", 10.0)))


@query("events", f"SELECT count(*) FILTER (WHERE coalesce(sparse > 10, false)) AS above, count(*) FILTER (WHERE NOT coalesce(sparse > 10, false)) AS others FROM (SELECT {SPARSE_SQL} AS sparse FROM events)")
def predicate_truth(events):
    rows = events.select(sparse().alias("sparse"))
    return rows.agg(F.count_if(truth(rows, gt("sparse", 10.0))).alias("above"), F.count_if(truth(rows, ~gt("sparse", 10.0))).alias("others"))


@query("events", "SELECT event_id, value FROM events WHERE event_type = 'purchase' AND value > 90 ORDER BY event_id LIMIT 1")
def find_first(events):
    return first_match(events.select("event_id", "value", "event_type"), eq("event_type", "purchase") & gt("value", 90.0), "event_id").select("event_id", "value")


@query("events", "SELECT count(*) AS n FROM events WHERE value > 80")
def filter_count(events):
    return where(events, gt("value", 80.0)).agg(F.count("*").alias("n"))


@query("documents", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the')")
def search_substring_ci(documents):
    return R.search_text(documents, "text", " The ".strip()).select("doc_id")


@query("part", "SELECT p_partkey, p_size FROM part WHERE p_size = 15 OR contains(CAST(p_size AS VARCHAR), '15')")
def search_numeric_or_text(part):
    return R.search_text(part, "p_size", "15").select("p_partkey", "p_size")


@query("documents", "SELECT doc_id FROM documents WHERE contains(lower(text), 'tion') AND doc_id IN (SELECT doc_id FROM documents WHERE contains(lower(text), 'the'))")
def search_within(documents):
    first = R.search_text(documents, "text", "the")
    return R.search_within(R.search_text(documents, "text", "TION"), first, "doc_id").select("doc_id")


def _turns(conversations: DataFrame) -> tuple[DataFrame, int]:
    """Turns as spans of their conversation, and a conversation that exists."""
    spans = conversations.withColumns({"trace_id_hi": F.lit(0).cast("long"), "trace_id_lo": F.col("conv_id").cast("long"), "span_id": F.col("turn").cast("long"), "start_time_ns": F.col("turn").cast("long")})
    return spans, conversations.where("conv_id <= 40").agg(F.max("conv_id")).first()[0]


@query("conversations", "SELECT conv_id, turn, role FROM conversations WHERE conv_id = (SELECT max(conv_id) FROM conversations WHERE conv_id <= 40) ORDER BY turn")
def trace_lookup(conversations):
    turns, chosen = _turns(conversations)
    return spans.find_trace(turns, 0, chosen).select("conv_id", "turn", "role")


@query("conversations", "SELECT conv_id, turn, text FROM conversations WHERE turn = 1 AND conv_id = (SELECT max(conv_id) FROM conversations WHERE conv_id <= 40) LIMIT 1")
def span_lookup(conversations):
    turns, chosen = _turns(conversations)
    return spans.find_span(turns, 0, chosen, 1).select("conv_id", "turn", "text")


@query("events", "SELECT event_id, user_id, epoch_ns(ts) AS start_time_ns FROM events WHERE epoch_ns(ts) BETWEEN (SELECT min(epoch_ns(ts)) FROM events WHERE event_id IN (100, 500)) AND (SELECT max(epoch_ns(ts)) FROM events WHERE event_id IN (100, 500))")
def time_window(events):
    rows = events.select("event_id", "user_id", X.timestamp_ns(F.col("ts")).alias("start_time_ns"), F.lit(0).alias("trace_id_hi"), F.col("user_id").alias("trace_id_lo"), F.col("event_id").alias("span_id"))
    ends = rows.where("event_id IN (100, 500)").agg(F.min("start_time_ns").alias("first"), F.max("start_time_ns").alias("last")).first()
    return spans.find_time(rows, ends["first"], ends["last"]).select("event_id", "user_id", "start_time_ns")


# --- reducers --------------------------------------------------------------------------------------


@query("lineitem", "SELECT round(sum(l_extendedprice), 2) AS total FROM lineitem")
def col_sum_f64(lineitem):
    return reducers.col_sum(lineitem, "l_extendedprice", decimals=2)


@query("lineitem", "SELECT CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem")
def col_sum_i64(lineitem):
    return reducers.col_sum(lineitem, "l_linenumber")


@query("orders", "SELECT min(o_totalprice) AS min_value, max(o_totalprice) AS max_value, count(o_totalprice) > 0 AS has_result FROM orders")
def col_min_max(orders):
    return reducers.col_min_max(orders, "o_totalprice")


@query("events", f"SELECT round(sum({SPARSE_SQL}), 2) AS total FROM events")
def sum_sparse(events):
    return reducers.col_sum(events.select(sparse().alias("sparse")), "sparse", decimals=2)


@query("events", "SELECT CAST(NULL AS DOUBLE) AS total")
def sum_all_absent(events):
    return reducers.col_sum(events.select(F.lit(None).cast("double").alias("never")), "never")


@query("events", "SELECT 0.0::DOUBLE AS total")
def sum_or_zero(events):
    return reducers.col_sum_or_zero(events.where("value < -1e9"), "value")


@query("lineitem", "SELECT count(DISTINCT l_partkey) AS n_distinct FROM lineitem")
def count_distinct_category(lineitem):
    return reducers.count_distinct(lineitem, "l_partkey")


@query("lineitem", "SELECT l_suppkey, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_suppkey ORDER BY total DESC, l_suppkey LIMIT 12")
def group_sum_topn(lineitem):
    return reducers.group_sum_top(lineitem, "l_suppkey", "l_extendedprice")


@query("customer", "SELECT coalesce(n_name, 'nation ' || c_nationkey) AS n_name, total FROM (SELECT c_nationkey, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY c_nationkey) LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey")
def group_sum_label(customer, read):
    sums = customer.groupBy("c_nationkey").agg(F.round(F.sum("c_acctbal"), 2).alias("total"))
    names = read("nation").where("n_nationkey < 20")
    default = F.concat(F.lit("nation "), F.col("c_nationkey").cast("string"))
    return R.decoded(sums, "c_nationkey", names, "n_nationkey", "n_name", default).select("n_name", "total")


@query("lineitem", "SELECT l_orderkey, l_linenumber, l_returnflag AS label FROM lineitem")
def dictionary_decode(lineitem):
    # three distinct flags at most: the code table is one row per flag
    codes = lineitem.select(F.col("l_returnflag").alias("label")).distinct().withColumn("code", F.ascii("label"))
    coded = lineitem.select("l_orderkey", "l_linenumber", F.ascii("l_returnflag").alias("flag_code"))
    return R.decoded(coded, "flag_code", codes, "code", "label").select("l_orderkey", "l_linenumber", "label")


@query("events", f"SELECT field, present, round(CAST(present * 1000 AS DOUBLE) / n) / 10 AS percent FROM (SELECT 'event_id' AS field, count(event_id) AS present, count(*) AS n FROM events UNION ALL SELECT 'sparse', count({SPARSE_SQL}), count(*) FROM events)")
def fill_rate(events):
    return reducers.fill_rate(events.select("event_id", sparse().alias("sparse")))


@query("documents", "SELECT CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents")
def string_length_sum(documents):
    return reducers.string_bytes(documents, "text")


@query("events", "SELECT quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events")
def latency_percentiles(events):
    return reducers.latency_percentiles(events, "value")


@query("events", f"SELECT count(DISTINCT ({SPARSE_SQL}) IS NULL) <= 1 AS uniform FROM events")
def uniform_masks(events):
    return reducers.is_uniform(events.select("event_id", sparse().alias("sparse")))


@query("lineitem", "SELECT 'l_returnflag' AS field, count(*) AS rows, count(DISTINCT l_returnflag) AS n_distinct, count(*) >= 32 AND count(DISTINCT l_returnflag) <= 0.5 * count(*) AS promote FROM lineitem UNION ALL SELECT 'l_shipmonth', count(*), count(DISTINCT l_extendedprice || ''), count(*) >= 32 AND count(DISTINCT l_extendedprice || '') <= 0.5 * count(*) FROM lineitem")
def promotion_scan(lineitem):
    rows = lineitem.select("l_returnflag", F.col("l_extendedprice").alias("l_shipmonth"))
    return reducers.promotion_scan(rows, "l_returnflag", "l_shipmonth")


@query("lineitem", """
SELECT field, min_value, max_value, CASE WHEN min_value >= 0 AND max_value <= 255 THEN 1 WHEN min_value >= -32768 AND max_value < 32768 THEN 2 WHEN min_value >= -2147483648 AND max_value < 2147483648 THEN 4 ELSE 8 END AS width
FROM (SELECT 'l_linenumber' AS field, CAST(min(l_linenumber) AS BIGINT) AS min_value, CAST(max(l_linenumber) AS BIGINT) AS max_value FROM lineitem UNION ALL SELECT 'l_orderkey', min(l_orderkey), max(l_orderkey) FROM lineitem UNION ALL SELECT 'l_suppkey', min(l_suppkey), max(l_suppkey) FROM lineitem)
""")
def width_infer(lineitem):
    return reducers.width_scan(lineitem, "l_linenumber", "l_orderkey", "l_suppkey")


@query("customer", """
WITH c AS (SELECT count(*) AS n, CAST(sum(octet_length(encode(c_name))) AS BIGINT) AS a, CAST(sum(octet_length(encode(c_mktsegment))) AS BIGINT) AS b FROM customer),
f AS (SELECT 'c_custkey' AS field, n * 8 AS payload, 0 AS padding, n FROM c UNION ALL SELECT 'c_nationkey', n * 8, 0, n FROM c UNION ALL SELECT 'c_acctbal', n * 8, 0, n FROM c
  UNION ALL SELECT 'c_name', a + 4 * (n + 1), (a + 4 * (n + 1) + 7) // 8 * 8 - a - 4 * (n + 1), n FROM c UNION ALL SELECT 'c_mktsegment', b + 4 * (n + 1), (b + 4 * (n + 1) + 7) // 8 * 8 - b - 4 * (n + 1), n FROM c),
t AS (SELECT field, CAST(payload AS BIGINT) AS payload, CAST(padding AS BIGINT) AS padding, CAST(((n + 7) // 8 + 7) // 8 * 8 AS BIGINT) AS bitmap FROM f)
SELECT field, payload, padding, bitmap, payload + padding + bitmap AS total, round((payload + padding + bitmap) * 1000.0::DOUBLE / CAST((SELECT sum(payload + padding + bitmap) FROM t) AS BIGINT)) / 10 AS percent FROM t
""")
def byte_stats(customer):
    return reducers.byte_statistics(customer)


# --- ordinals --------------------------------------------------------------------------------------


@query("events", "SELECT event_id // 256 AS page, min(event_id) AS start_index, max(event_id) AS end_index, count(*) AS n_rows FROM events GROUP BY 1")
def page_assign(events):
    return ordinals.page_table(events, "event_id", 256)


@query("events", "SELECT event_id // 256 AS page, min(event_id) AS start_index, max(event_id) AS end_index, count(*) AS n_rows FROM events GROUP BY 1 HAVING 700 BETWEEN min(event_id) AND max(event_id)")
def page_locate(events):
    return ordinals.page_of(events, "event_id", 256, 700)


@query("events", "SELECT event_id, event_id // 1024 AS block, first_value(user_id) OVER w AS anchor, user_id - first_value(user_id) OVER w AS delta FROM events WINDOW w AS (PARTITION BY event_id // 1024 ORDER BY event_id)")
def delta_index(events):
    return ordinals.delta_index(events, "event_id", "user_id")


@query("events", """
WITH s AS (SELECT user_id, abs(event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS step FROM events),
c AS (SELECT user_id, count(*) AS observations, count(*) FILTER (WHERE step <= 10) AS sequential, count(*) FILTER (WHERE step > 100) AS random FROM s GROUP BY user_id)
SELECT *, CASE WHEN observations < 8 THEN 'unknown' WHEN sequential > 3 * random THEN 'sequential' WHEN random > sequential THEN 'random' ELSE 'mixed' END AS pattern FROM c
""")
def access_pattern(events):
    rows = events.select("user_id", "event_id", F.struct("ts", "event_id").alias("at"))
    return ordinals.access_pattern(rows, "user_id", "at", "event_id")


@query("events", "SELECT user_id, CAST(unnest(range(max(event_id) + 1, least(max(event_id) + 5, (SELECT count(*) FROM events)))) AS BIGINT) AS next_index FROM events GROUP BY user_id")
def predict_next(events):
    last = events.groupBy("user_id").agg(F.max("event_id").alias("last"))
    return last.select("user_id", F.explode(ordinals.predict_next(F.col("last"), 4, events.count())).alias("next_index"))


@query("events", """
WITH p AS (SELECT DISTINCT user_id, event_id // 16 AS page FROM events),
a AS (SELECT *, CASE WHEN page - lag(page) OVER (PARTITION BY user_id ORDER BY page) > 2 THEN 1 ELSE 0 END AS apart FROM p),
i AS (SELECT *, sum(apart) OVER (PARTITION BY user_id ORDER BY page) AS island FROM a)
SELECT user_id, min(page) AS start_page, max(page) AS end_page, count(*) AS n_pages FROM i GROUP BY user_id, island
""")
def range_coalesce(events):
    return ordinals.coalesced_ranges(events.select("user_id", F.expr("event_id div 16").alias("page")), "user_id", "page")


@query("events", "SELECT event_id, value FROM events WHERE event_id IN (SELECT k * ((SELECT count(*) FROM events) - 1) // (200 - 1) FROM range(200) AS r(k))")
def sample_series(events):
    return ordinals.sampled(events.select("event_id", "value"), "event_id", 200, events.count())


@query("events", "SELECT DISTINCT event_id // 16 AS page FROM events WHERE value > 100 AND event_id // 16 NOT IN (SELECT event_id // 16 FROM events WHERE event_type = 'error')")
def pages_to_fetch(events):
    paged = events.withColumn("page", F.expr("event_id div 16"))
    return ordinals.missing_pages(paged.where("value > 100"), paged.where("event_type = 'error'"), "page")


# --- segments and sets -----------------------------------------------------------------------------


@query("events", "SELECT event_id, value, NULL::VARCHAR AS note FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, value, 'late' FROM events WHERE event_id % 2 = 1")
def segment_union(events):
    sealed = events.where("event_id % 2 = 0").select("event_id", "value")
    return R.concatenated(sealed, events.where("event_id % 2 = 1").select("event_id", "value", F.lit("late").alias("note")))


@query("events", "SELECT count(DISTINCT seg) FILTER (WHERE seg >= 0) AS segment_count, count(*) FILTER (WHERE seg >= 0) AS sealed_records, count(*) FILTER (WHERE seg < 0) AS wal_records FROM (SELECT CASE WHEN event_type = 'error' THEN -1 ELSE event_id // 300 END AS seg FROM events)")
def segment_stats(events):
    """Segments of 300 events each and a live log, written as files and counted."""
    spark = events.sparkSession
    segments, log = scratch_path(spark, "segments"), scratch_path(spark, "log")
    part = F.expr("event_id div 300").alias("segment")
    rows = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != "span_id" else F.col("event_id").cast("long").alias("span_id") for f in spans.SPAN]
    events.where("event_type <> 'error'").select(*rows, part).repartition("segment").write.partitionBy("segment").parquet(segments)
    events.where("event_type = 'error'").select(*rows).write.parquet(log)
    return spans.segment_statistics(spark, segments, log)


@query("orders", "SELECT o_orderkey, 'left' AS side FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 'right' FROM orders WHERE o_orderstatus <> 'O' AND o_orderkey % 3 = 0")
def round_trip_difference(orders):
    left = orders.where("o_orderstatus = 'O'").select("o_orderkey")
    return R.difference(left, orders.where("o_orderkey % 3 = 0").select("o_orderkey"))


@query("nation", "SELECT * FROM (VALUES ('n_nationkey', 'int', 'int', 'same'), ('n_name', 'string', 'string', 'same'), ('n_regionkey', 'int', 'bigint', 'changed'), ('added_field', NULL, 'string', 'added')) AS t(name, left_type, right_type, change)")
def schema_diff(nation):
    spark = nation.sparkSession
    later = nation.withColumn("n_regionkey", F.col("n_regionkey").cast("long")).withColumn("added_field", F.lit("x"))
    return registry.schema_diff(registry.as_table(spark, nation.schema), registry.as_table(spark, later.schema))


# --- inference, scalars, export --------------------------------------------------------------------

_CLASS_SQL = """CASE WHEN v IS NULL OR v = '' THEN NULL WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN 'int' WHEN regexp_full_match(v, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN 'float'
WHEN lower(v) IN ('true', 'false') THEN 'bool' WHEN regexp_full_match(v, '[0-9TZ:.+-]{8,}') AND (contains(v, '-') OR contains(v, 'T')) THEN 'time' WHEN regexp_full_match(v, '([0-9a-fA-F]{2}){8,}') THEN 'hex' ELSE 'string' END"""


@query("events", f"""
WITH t AS (SELECT unnest([{{'field': 'id', 'v': CAST(event_id AS VARCHAR)}}, {{'field': 'mixed', 'v': CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE CAST(user_id AS VARCHAR) || '.5' END}},
  {{'field': 'kind', 'v': event_type}}, {{'field': 'flag', 'v': CASE WHEN value > 50 THEN 'true' ELSE 'False' END}}, {{'field': 'day', 'v': strftime(ts, '%Y-%m-%d')}},
  {{'field': 'code', 'v': CASE WHEN event_id % 3 = 0 THEN '' ELSE lpad(lower(to_hex(event_id)), 16, 'a') END}}, {{'field': 'none', 'v': ''}}], recursive := true) FROM events),
k AS (SELECT field, {_CLASS_SQL} AS k FROM t),
g AS (SELECT field, count(*) AS total, count(k) AS present, count(DISTINCT k) AS n, min(k) AS one, list(DISTINCT k) AS ks FROM k GROUP BY field)
SELECT field, CASE WHEN n = 0 THEN 'null' WHEN n = 1 THEN one ELSE 'string' END AS kind, coalesce(array_to_string(list_filter(['int', 'float', 'bool', 'time', 'hex', 'string'], lambda c : list_contains(ks, c)), ','), '') AS classes, present, total, present < total AS optional FROM g
""")
def schema_infer(events):
    text = lambda c: F.col(c).cast("string")
    rows = events.select(
        text("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, text("user_id")).otherwise(F.concat(text("user_id"), F.lit(".5"))).alias("mixed"), F.col("event_type").alias("kind"),
        F.when(F.col("value") > 50, "true").otherwise("False").alias("flag"), F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.when(F.col("event_id") % 3 == 0, "").otherwise(F.lpad(F.lower(F.hex("event_id")), 16, "a")).alias("code"), F.lit("").alias("none"),
    )
    return inference.infer_types(rows)


@query("events", "SELECT event_id, epoch_ns(ts) AS ts_ns FROM events")
def time_to_ns(events):
    return events.select("event_id", X.timestamp_ns(F.col("ts")).alias("ts_ns"))


@query("events", "SELECT event_id, epoch_ns(date_trunc('second', ts)) + event_id % 1000 AS ns, epoch_ns(CAST(CAST(ts AS DATE) AS TIMESTAMP)) AS day_ns FROM events")
def time_literals(events):
    fraction = F.lpad((F.col("event_id") % 1000).cast("string"), 9, "0")
    literal = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss."), fraction)
    return events.select("event_id", X.time_ns(literal).alias("ns"), X.time_ns(F.date_format("ts", "yyyy-MM-dd")).alias("day_ns"))


@query("events", "SELECT event_id, lpad(lower(to_hex(event_id)), 16, '0') AS span, lpad(lower(to_hex(user_id)), 16, '0') || lpad(lower(to_hex(event_id)), 16, '0') AS trace, event_id AS parsed FROM events")
def hex_id(events):
    span = X.hex_id(F.col("event_id"))
    return events.select("event_id", span.alias("span"), X.trace_hex(F.col("user_id"), F.col("event_id")).alias("trace"), X.hex_long(span).alias("parsed"))


@query("events", "SELECT event_id, to_base64(encode(props)) AS payload, lower(to_hex(encode(props))) AS payload_hex FROM events")
def base64_payload(events):
    binary = F.encode("props", "UTF-8")
    return events.select("event_id", X.bytes_text(binary).alias("payload"), X.bytes_text(binary, "hex").alias("payload_hex"))


@query("orders", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE round(o_totalprice, 2) END AS price FROM orders")
def numeric_cells(orders):
    shown = F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.concat(F.lit("$"), F.format_number("o_totalprice", 2)))
    return orders.select("o_orderkey", X.numeric_cell(shown).alias("price"))


@query("orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def export_limit(orders):
    return R.export_limit(orders.select("o_orderkey", "o_totalprice"), 100, F.desc("o_totalprice"), "o_orderkey")


@query("customer", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 40")
def limit_offset(customer):
    return R.page_of_rows(customer.select("c_custkey", "c_name"), 20, 40, "c_custkey")


@query("orders", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 3")
def inspect_head(orders):
    return R.export_limit(orders.select("o_orderkey", "o_orderstatus"), 3, "o_orderkey")


@query("events", "SELECT event_id, CASE WHEN event_id = 0 THEN 9.5 ELSE value END AS value FROM events")
def patch_value(events):
    return R.patched(events_index(events.select("event_id", "value")), 0, "value", 9.5).select("event_id", "value")


@query("events", f"SELECT event_id, '{{\"event_id\":' || event_id || CASE WHEN event_id % 10 = 0 THEN ',\"event_type\":\"' || event_type || '\"' ELSE '' END || '}}' AS line FROM events")
def export_json_lines(events):
    kind = F.when(F.col("event_id") % 10 == 0, F.col("event_type")).alias("event_type")
    rows = events.select("event_id", kind)
    return rows.select("event_id", convert.json_ready(rows).alias("line"))


@query("events", "SELECT (SELECT round(sum(value), 2) FROM events) AS total, CAST(sum(user_id) AS BIGINT) AS picked FROM events WHERE event_id IN (SELECT (k * 7919 + 13) % (SELECT count(*) FROM events) FROM range(100) AS r(k))")
def mixed_workload(events):
    n = events.count()
    picked = [(k * 7919 + 13) % n for k in range(100)]
    return events.agg(F.round(F.sum("value"), 2).alias("total"), F.sum(F.when(F.col("event_id").isin(picked), F.col("user_id"))).alias("picked"))


@query("events", "SELECT e.event_id, p.event_id AS parent_id, round(e.value - p.value, 6) AS change FROM events e LEFT JOIN events p ON e.user_id = p.user_id AND p.event_id = e.event_id - 1")
def parent_spans(events):
    """Extension: each span with its parent, by a reference to the record before it."""
    parent = events.select("user_id", F.col("event_id").alias("parent_id"), F.col("value").alias("parent_value"))
    child = events.select("user_id", "event_id", "value", (F.col("event_id") - 1).alias("parent_id"))
    found = child.join(parent.withColumn("known", F.lit(True)), ["user_id", "parent_id"], "left")
    return found.select("event_id", F.when(F.col("known"), F.col("parent_id")).alias("parent_id"), F.round(F.col("value") - F.col("parent_value"), 6).alias("change"))


QUERIES |= format_queries.QUERIES | tool_queries.QUERIES
ORACLE_SQL |= format_queries.ORACLE_SQL | tool_queries.ORACLE_SQL
