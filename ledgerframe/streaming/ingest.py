"""Streaming: span logs, pages, incremental sums, sealing into segments."""

from __future__ import annotations

from collections.abc import Callable

from pyarrow.fs import FileType
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerframe.errors import UnsupportedLayout
from ledgerframe.operators.ordinals import page_table
from ledgerframe.operators.spans import ORDER, SPAN, ingest_json, live_view
from ledgerframe.sources.recordfile import files_at, filesystem, register

PAGE_FIELD, FILLED_FIELD = "__page", "__filled"


def span_lines(spark: SparkSession, path: str, files_per_trigger: int = 1_000) -> DataFrame:
    """A stream of spans from newline-delimited JSON files as they arrive; malformed lines are left out."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return ingest_json(lines)[0]


def append_log(spans: DataFrame, log: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream of spans to the live log; the checkpoint makes a restart go on where it stopped."""
    writer = spans.writeStream.format("parquet").outputMode("append").option("path", log).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def sealing(spans: DataFrame, segments: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch becomes one segment, in time order, named by its number, so a replay replaces it."""

    def seal(batch: DataFrame, number: int) -> None:
        batch.sortWithinPartitions(*ORDER).write.mode("overwrite").parquet(f"{segments}/segment={number:016d}")

    return spans.writeStream.foreachBatch(seal).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def auto_seal(spans: DataFrame, segments: str, checkpoint: str, every: int = 10_000) -> StreamingQuery:
    """Spans wait in a log until there are `every` of them or more; those become one segment in time order.

    The log is a table beside the checkpoint, one state a micro-batch, so a replay finds what the batch before
    left and replaces what it wrote itself.  live_spans shows the segments and the log, each span once.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark, log = batch.sparkSession, f"{checkpoint}-waiting"
        rows = batch.select(*SPAN.names)
        if number:
            rows = rows.unionByName(spark.read.schema(SPAN).parquet(f"{log}/{number - 1}"))
        rows.write.mode("overwrite").parquet(f"{log}/{number}")
        whole = spark.read.schema(SPAN).parquet(f"{log}/{number}")
        if whole.count() >= every:
            whole.orderBy(*ORDER).write.mode("overwrite").parquet(f"{segments}/segment={number:016d}")
            spark.createDataFrame([], SPAN).write.mode("overwrite").parquet(f"{log}/{number}")
        forget(f"{log}/{number - 2}")

    return spans.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def forget(path: str) -> None:
    """Delete a folder that may not exist."""
    fs, inner = filesystem(path)
    if fs.get_file_info(inner).type == FileType.Directory:
        fs.delete_dir(inner)


def latest(folder: str) -> tuple[int, str] | None:
    """The greatest number among a folder's numbered tables, and that table's path."""
    numbers = {int(n) for f in files_at(folder) if (n := f.split("/")[-2]).isdigit()}
    return (max(numbers), f"{folder}/{max(numbers)}") if numbers else None


def live_spans(spark: SparkSession, segments: str, log: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Spans of all sealed segments and of the log so far: a folder, or what auto_seal's checkpoint has waiting.

    A log that sealing() reads as well holds the sealed spans too; then ask for one of the two.
    """
    waiting = latest(f"{checkpoint}-waiting") if checkpoint else None
    log = waiting[1] if waiting else log
    if not files_at(segments):
        return spark.read.schema(SPAN).parquet(log) if log else spark.createDataFrame([], SPAN)
    return live_view(spark, segments, log)


def running_totals(stream: DataFrame, value: str, name: str) -> StreamingQuery:
    """Count and sum of all rows so far, kept as an in-memory table of one row."""
    totals = stream.agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return totals.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()


def paged(stream: DataFrame, path: str, checkpoint: str, index: str, page_rows: int = 4_096, layout: str = "paged") -> StreamingQuery:
    """Write a stream as paged record files: a page leaves as soon as all its records are there.

    index numbers the records from 0 without gaps.  Records of a page that is not complete wait in a table
    beside the checkpoint; seal_pages writes them as the last page.  A replayed micro-batch replaces its
    files.  Only the paged layout can stream.
    """
    if layout != "paged":
        raise UnsupportedLayout("only pages can be written to a stream")

    def flush(batch: DataFrame, number: int) -> None:
        spark, waiting = batch.sparkSession, f"{checkpoint}-waiting"
        register(spark)
        rows = batch
        if number:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(f"{waiting}/{number - 1}"))
        page = F.expr(f"`{index}` div {page_rows}")
        marked = rows.withColumn(PAGE_FIELD, page).withColumn(FILLED_FIELD, F.count("*").over(Window.partitionBy(PAGE_FIELD)) == page_rows).persist()
        try:
            full = marked.where(FILLED_FIELD).sortWithinPartitions(PAGE_FIELD, index).select(*batch.columns)
            full.write.format("recordfile").mode("overwrite").options(layout="paged", page_size=page_rows).save(f"{path}/batch={number:016d}")
            marked.where(~F.col(FILLED_FIELD)).select(*batch.columns).write.mode("overwrite").parquet(f"{waiting}/{number}")
        finally:
            marked.unpersist()
        forget(f"{waiting}/{number - 2}")

    return stream.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def seal_pages(spark: SparkSession, path: str, checkpoint: str, schema: T.StructType, index: str, page_rows: int = 4_096) -> int:
    """Write the records that wait for a page to fill as the last pages; their number.  Done again, it replaces them."""
    found = latest(f"{checkpoint}-waiting")
    if not found:
        return 0
    register(spark)
    rest = spark.read.schema(schema).parquet(found[1])
    page = F.expr(f"`{index}` div {page_rows}")
    out = rest.repartition(page).sortWithinPartitions(index)
    out.write.format("recordfile").mode("overwrite").options(layout="paged", page_size=page_rows).save(f"{path}/last")
    return rest.count()


def deliver(
    stream: DataFrame, checkpoint: str, on_record: Callable[[dict], None], on_schema: Callable[[T.StructType], None] | None = None,
    on_end: Callable[[], None] | None = None, on_error: Callable[[Exception], None] | None = None,
) -> None:
    """Call back on the driver for the schema, each record as it arrives, the end of what there is, and a failure.

    Records come one partition at a time, so the driver holds no more than one; a replayed micro-batch
    repeats its records.  Without on_error a failure is raised.
    """
    if on_schema:
        on_schema(stream.schema)

    def pass_on(batch: DataFrame, number: int) -> None:
        for row in batch.toLocalIterator():
            on_record(row.asDict(recursive=True))

    try:
        stream.writeStream.foreachBatch(pass_on).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    except Exception as e:
        if not on_error:
            raise
        on_error(e)
        return
    if on_end:
        on_end()


def stream_metrics(query: StreamingQuery) -> dict[str, float | int | None]:
    """From a query's recent progress: rows, batches, time to the first rows, rows a second, slowest write of a batch."""
    steps = [p for p in query.recentProgress if p["numInputRows"]]
    spent = [p["durationMs"].get("triggerExecution", 0) for p in steps]
    rows = sum(p["numInputRows"] for p in steps)
    return {
        "batches": len(steps), "rows": rows, "first_rows_ms": spent[0] if spent else None,
        "rows_per_second": 1_000 * rows / sum(spent) if sum(spent) else None, "slowest_write_ms": max((p["durationMs"].get("addBatch", 0) for p in steps), default=None),
    }


def complete_pages(frame: DataFrame, index: str, page_rows: int) -> DataFrame:
    """Pages of a growing table that are full."""
    return page_table(frame, index, page_rows).where(F.col("n_rows") == page_rows)


def windowed_counts(spans: DataFrame, width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Extension: spans by service and time window, with a watermark for late data."""
    stamped = spans.withColumn("at", F.timestamp_micros((F.col("start_time_ns") / 1000).cast("long")))
    return stamped.withWatermark("at", late).groupBy(F.window("at", width), "service").agg(F.count("*").alias("n"))
