"""Span tables: sealed segments and a live append log queried as one."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerframe.functions.scalars import hex_long, trace_halves, trace_hex
from ledgerframe.operators.records import concatenated
from ledgerframe.sources.recordfile import filesystem

SPAN = T.StructType([
    T.StructField("trace_id_hi", T.LongType()), T.StructField("trace_id_lo", T.LongType()), T.StructField("span_id", T.LongType()),
    T.StructField("parent_span_id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("service", T.StringType()),
    T.StructField("start_time_ns", T.LongType()), T.StructField("duration_ns", T.LongType()), T.StructField("status_code", T.LongType()),
    T.StructField("payload", T.StringType()),
])
SPAN_JSON = "trace_id string, span_id string, parent_span_id string, name string, service string, start_time_ns long, duration_ns long, status_code long, payload string, _corrupt string"
ORDER = ("start_time_ns", "trace_id_hi", "trace_id_lo", "span_id")


def ingest_json(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(spans, rejected lines) of newline-delimited JSON; a line without valid ids, or no JSON, is rejected."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = lines.where(F.trim(column) != "").select(F.col(column).alias("line"), F.from_json(column, SPAN_JSON, options).alias("s"))
    high, low = trace_halves(F.col("s.trace_id"))
    span = hex_long(F.col("s.span_id"))
    payload = F.coalesce(F.get_json_object("line", "$.payload"), F.col("s.payload"))
    rows = parsed.select(
        "line", high.alias("trace_id_hi"), low.alias("trace_id_lo"), span.alias("span_id"), hex_long(F.col("s.parent_span_id")).alias("parent_span_id"),
        *(F.coalesce(f"s.{c}", F.lit("")).alias(c) for c in ("name", "service")), *(F.coalesce(f"s.{c}", F.lit(0).cast("long")).alias(c) for c in ("start_time_ns", "duration_ns", "status_code")),
        payload.alias("payload"), F.col("s._corrupt").isNotNull().alias("corrupt"),
    )
    good = ~F.col("corrupt") & F.col("trace_id_hi").isNotNull() & F.col("span_id").isNotNull()
    return rows.where(good).select(*SPAN.names), rows.where(~F.coalesce(good, F.lit(False))).select("line")


def live_view(spark: SparkSession, segments: str, log: str | None = None) -> DataFrame:
    """Spans of all sealed segments (Parquet) and, if given, of the live log; nothing is dropped as a repeat."""
    sealed = spark.read.schema(SPAN).option("recursiveFileLookup", True).parquet(segments)
    return concatenated(sealed, spark.read.schema(SPAN).parquet(log)) if log else sealed


def find_trace(spans: DataFrame, high: int, low: int) -> DataFrame:
    return spans.where((F.col("trace_id_hi") == high) & (F.col("trace_id_lo") == low)).orderBy(*ORDER)


def find_span(spans: DataFrame, high: int, low: int, span_id: int) -> DataFrame:
    """The span, or no row."""
    return find_trace(spans, high, low).where(F.col("span_id") == span_id).limit(1)


def find_time(spans: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """Spans that start in the window, both ends included."""
    return spans.where(F.col("start_time_ns").between(start_ns, end_ns)).orderBy(*ORDER)


def printable(spans: DataFrame) -> DataFrame:
    """Spans with their trace id as 32 hex digits."""
    return spans.withColumn("trace_id", trace_hex(F.col("trace_id_hi"), F.col("trace_id_lo")))


def segment_statistics(spark: SparkSession, segments: str, log: str | None = None) -> DataFrame:
    """One row: segment_count, sealed_records, wal_records."""
    per_file = spark.read.schema(SPAN).option("recursiveFileLookup", True).parquet(segments).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"))
    sealed = per_file.agg(F.count("*").alias("segment_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("sealed_records"))
    live = spark.read.schema(SPAN).parquet(log).agg(F.count("*").alias("wal_records")) if log else spark.range(1).select(F.lit(0).cast("long").alias("wal_records"))
    return sealed.crossJoin(live)  # one row each


def seal(spark: SparkSession, log: str, segments: str, drop: bool = False) -> dict[str, object]:
    """Write the log's spans as one segment in time order and, if asked, drop the files it came from.

    The segment is named after the log's files, so sealing the same log again replaces it.  Spans logged
    meanwhile stay in the log.
    """
    files = sorted(spark.read.schema(SPAN).parquet(log).inputFiles())
    if not files:
        return {"records": 0, "path": None}
    name = hashlib.blake2b("\n".join(files).encode(), digest_size=8).hexdigest()
    path = f"{segments.rstrip('/')}/segment={name}"
    spark.read.schema(SPAN).parquet(*files).orderBy(*ORDER).write.mode("overwrite").parquet(path)
    n = spark.read.schema(SPAN).parquet(path).count()
    for file in files if drop else []:
        fs, inner = filesystem(file)
        fs.delete_file(inner)
    return {"records": n, "path": path}
