"""Column reducers and grouped summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col_sum(frame: DataFrame, column: str, alias: str = "total", decimals: int | None = None) -> DataFrame:
    """Sum of the present values; NULL if there is none.  decimals fixes the result against order of addition."""
    if column not in frame.columns:
        return frame.limit(0).agg(F.sum(F.lit(None).cast("double")).alias(alias))
    total = F.try_sum(column) if isinstance(frame.schema[column].dataType, T.IntegralType) else F.sum(column)
    return frame.agg((F.round(total, decimals) if decimals is not None else total).alias(alias))


def col_sum_or_zero(frame: DataFrame, column: str, alias: str = "total") -> DataFrame:
    return frame.agg(F.coalesce(F.sum(column), F.lit(0.0)).alias(alias))


def not_nan(frame: DataFrame, column: str) -> Column:
    """The column with NaN as absent, so that min and max follow IEEE order."""
    c = F.col(column)
    return F.when(~F.isnan(c), c) if isinstance(frame.schema[column].dataType, (T.FloatType, T.DoubleType)) else c


def col_min_max(frame: DataFrame, column: str) -> DataFrame:
    """Least and greatest present value; NULL for both tells that there is none."""
    c = not_nan(frame, column)
    return frame.agg(F.min(c).alias("min_value"), F.max(c).alias("max_value"), (F.count(c) > 0).alias("has_result"))


def count_distinct(frame: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    return frame.agg((F.approx_count_distinct(column) if approximate else F.count_distinct(column)).alias("n_distinct"))


def group_sum_top(frame: DataFrame, key: str, value: str, n: int = 12, decimals: int = 2) -> DataFrame:
    """The n keys with the largest sums; ties go to the smaller key."""
    sums = frame.groupBy(key).agg(F.round(F.sum(value), decimals).alias("total"))
    return sums.orderBy(F.desc("total"), key).limit(n)


def fill_rate(frame: DataFrame, *columns: str) -> DataFrame:
    """(field, present, percent): share of rows in which each column is present, to one decimal.  One pass."""
    columns = columns or tuple(frame.columns)
    counts = frame.agg(F.count("*").alias("n"), *(F.count(c).alias(f"c{i}") for i, c in enumerate(columns)))
    rows = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"c{i}").alias("present")) for i, c in enumerate(columns)))
    share = F.when(F.col("n") > 0, F.round(F.col("present") * F.lit(1000.0) / F.col("n")) / 10)
    return counts.select("n", F.inline(rows)).select("field", "present", share.alias("percent"))


def string_bytes(frame: DataFrame, column: str) -> DataFrame:
    return frame.agg(F.sum(F.octet_length(column)).alias("bytes"))


def latency_percentiles(frame: DataFrame, column: str) -> DataFrame:
    """P50, P95 and P99 by nearest rank."""
    at = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{column}`)")
    return frame.agg(at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def is_uniform(frame: DataFrame) -> DataFrame:
    """Whether all records have the same fields present."""
    mask = F.concat_ws("", *(F.isnull(c).cast("int").cast("string") for c in frame.columns))
    return frame.select(mask.alias("mask")).agg((F.count_distinct("mask") <= 1).alias("uniform"))


def promotion_scan(frame: DataFrame, *columns: str, min_rows: int = 32, max_ratio: float = 0.5) -> DataFrame:
    """(field, rows, n_distinct, promote): whether a text column is worth a dictionary.

    Each column is counted by value on its own, so rows are not copied for each column that is counted.
    """
    out = None
    for c in columns:
        values = frame.select(F.col(c).alias("value")).where(F.col("value").isNotNull()).groupBy("value").agg(F.count("*").alias("n"))
        counts = values.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("n_distinct")).select(F.lit(c).alias("field"), "rows", "n_distinct")
        out = counts if out is None else out.unionByName(counts)
    promote = (F.col("rows") >= min_rows) & (F.col("n_distinct") <= max_ratio * F.col("rows"))
    return out.select("*", promote.alias("promote"))


def width_scan(frame: DataFrame, *columns: str) -> DataFrame:
    """(field, min_value, max_value, width): the fewest bytes that hold each integer column: 1 (unsigned), 2, 4 or 8."""
    bounds = frame.agg(*(x for i, c in enumerate(columns) for x in (F.min(c).cast("long").alias(f"l{i}"), F.max(c).cast("long").alias(f"h{i}"))))
    rows = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"l{i}").alias("min_value"), F.col(f"h{i}").alias("max_value")) for i, c in enumerate(columns)))
    low, high = F.col("min_value"), F.col("max_value")
    within = lambda bits: (low >= -(1 << bits)) & (high < (1 << bits))
    width = F.when((low >= 0) & (high <= 255), 1).when(within(15), 2).when(within(31), 4).otherwise(8)
    return bounds.select(F.inline(rows)).select("*", width.alias("width"))


def byte_statistics(frame: DataFrame) -> DataFrame:
    """(field, payload, padding, bitmap, total, percent): bytes of each column in a columnar file, largest first.

    Fixed-width cells take eight bytes a row; text and binary take their bytes, an offset of four bytes a
    row and one more, and padding to eight; each column has a presence bitmap.
    """
    flat = [f for f in frame.schema if isinstance(f.dataType, (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.TimestampType, T.TimestampNTZType))]
    wide = [isinstance(f.dataType, (T.StringType, T.BinaryType)) for f in flat]
    sums = [F.coalesce(F.sum(F.octet_length(f.name)), F.lit(0)).alias(f"s{i}") for i, f in enumerate(flat) if wide[i]]
    counts = frame.agg(F.count("*").alias("n"), *sums)
    n = F.col("n")
    up8 = lambda x: F.expr(f"({x} + 7) div 8 * 8")
    entries = []
    for i, f in enumerate(flat):
        payload = F.expr(f"s{i} + 4 * (n + 1)") if wide[i] else n * 8
        padding = up8(f"s{i} + 4 * (n + 1)") - payload if wide[i] else F.lit(0).cast("long")
        entries.append(F.struct(F.lit(f.name).alias("field"), payload.cast("long").alias("payload"), padding.cast("long").alias("padding"), up8("(n + 7) div 8").cast("long").alias("bitmap")))
    rows = counts.select(F.inline(F.array(*entries))).withColumn("total", F.col("payload") + F.col("padding") + F.col("bitmap"))
    whole = rows.agg(F.sum("total").alias("__all"))  # one row
    share = F.round(F.col("total") * F.lit(1000.0) / F.col("__all")) / 10
    return rows.crossJoin(F.broadcast(whole)).select("field", "payload", "padding", "bitmap", "total", share.alias("percent")).orderBy(F.desc("total"), "field")
