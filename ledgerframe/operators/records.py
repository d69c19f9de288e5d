"""Projections, ordinals, point access, search, limits and set operations on record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerframe.errors import OutOfBounds
from ledgerframe.functions.predicates import column_of, field_type
from ledgerframe.functions.scalars import contains_fold

INDEX = "_record_index"
NULLS = "_null_fields"
#: Records up to this index are found without an index of the whole table.
TOP_ROWS = 1 << 16


def with_index(frame: DataFrame, *keys: str) -> DataFrame:
    """frame with its dense, zero-based record index in order of the keys.

    Rows are range-partitioned and sorted, numbered inside each partition, and shifted by the number
    of rows before it, so no single task sees all rows.  The per-partition counts are one small row each.
    """
    parts = frame.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = parts.withColumns({"__part": F.spark_partition_id(), "__n": F.monotonically_increasing_id()})
    counts = placed.groupBy("__part").agg(F.count("*").alias("__rows"), F.min("__n").alias("__first"))
    before = counts.withColumn("__base", F.sum("__rows").over(Window.orderBy("__part")) - F.col("__rows")).select("__part", "__base", "__first")
    joined = placed.join(before, "__part")
    return joined.withColumn(INDEX, F.col("__base") + F.col("__n") - F.col("__first")).drop("__part", "__n", "__base", "__first", "__rows")


def records_at(frame: DataFrame, wanted: list[int], *keys: str) -> DataFrame:
    """The records at the wanted indexes, in order of the keys, with their index; a negative index is an error.

    Where all lie among the first TOP_ROWS records, each task sends its first ones only and nothing is
    sorted whole; beyond that all records are indexed.
    """
    if min(wanted, default=0) < 0:
        raise OutOfBounds(f"record index {min(wanted)} is negative")
    last = max(wanted, default=-1)
    rows = numbered(frame.orderBy(*keys).limit(last + 1), *keys) if last < TOP_ROWS else with_index(frame, *keys)
    return rows.where(F.col(INDEX).isin(wanted))


def numbered(frame: DataFrame, *keys: str) -> DataFrame:
    """frame with its record index by a window: simple, for tables that one task can sort."""
    return frame.withColumn(INDEX, F.row_number().over(Window.orderBy(*keys)).cast("long") - 1)


def get(frame: DataFrame, path: str, kind: str | None = None) -> Column:
    """A field by (dotted) path: absent if unknown or not of the kind (i64, f64, bool, str)."""
    found = field_type(frame.schema, path)
    types = {"i64": T.LongType, "f64": T.DoubleType, "bool": T.BooleanType, "str": T.StringType}
    if found is None:
        return F.lit(None)
    if kind and not isinstance(found, types[kind]) and not (kind == "i64" and isinstance(found, T.IntegralType)):
        return F.lit(None).cast(types[kind]())
    return column_of(frame.schema, path)


def is_absent(name: str, marks: str = NULLS) -> Column:
    """Whether a field is absent, as opposed to present with the value null."""
    return F.col(name).isNull() & ~F.coalesce(F.array_contains(marks, name), F.lit(False))


def record(frame: DataFrame, index: int) -> DataFrame:
    """The record at an index, as a table of one row or none; a negative index is an error."""
    if index < 0:
        raise OutOfBounds(f"record index {index} is negative")
    return frame.where(F.col(INDEX) == index)


def record_row(frame: DataFrame, index: int) -> dict:
    """The record at an index as a dict; OutOfBounds if there is none."""
    found = record(frame, index).limit(1).collect()
    if not found:
        raise OutOfBounds(f"no record {index}")
    return found[0].asDict(recursive=True)


def scattered(frame: DataFrame, step: int, limit: int = 500) -> DataFrame:
    """Every step-th record, up to limit of them, in order."""
    return frame.where((F.col(INDEX) % step == 0) & (F.col(INDEX) < step * limit))


def head(frame: DataFrame, n: int | None) -> DataFrame:
    """The first n records by index; all if n is None or negative."""
    return frame if n is None or n < 0 else frame.where(F.col(INDEX) < n)


def export_limit(frame: DataFrame, n: int = 100, *order: str | Column) -> DataFrame:
    """n rows in the given order; -1 means all, 0 none."""
    rows = frame.orderBy(*order) if order else frame
    return rows if n < 0 else rows.limit(n)


def page_of_rows(frame: DataFrame, limit: int, offset: int, *order: str) -> DataFrame:
    return frame.orderBy(*order).offset(offset).limit(limit)


def search_text(frame: DataFrame, column: str, needle: str) -> DataFrame:
    """Rows whose text holds the needle, in any case; a needle that is a number also matches numeric columns by value."""
    kind = frame.schema[column].dataType
    if isinstance(kind, T.StringType):
        return frame.where(contains_fold(F.col(column), needle))
    text = needle.strip()
    match = F.contains(F.col(column).cast("string"), F.lit(text.lower()))
    try:
        match = (F.col(column) == F.lit(float(text))) | match
    except ValueError:
        pass
    return frame.where(match)


def search_within(frame: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """Rows of frame whose key is in an earlier result."""
    return frame.join(matches.select(key), key, "left_semi")


def default_search_column(schema: T.StructType, preferred: str = "username") -> str | None:
    """The preferred column if it holds text, else the first that does."""
    texts = [f.name for f in schema if isinstance(f.dataType, T.StringType)]
    return preferred if preferred in texts else next(iter(texts), None)


def concatenated(*frames: DataFrame) -> DataFrame:
    """All rows of all tables, repeats kept; a field that a table lacks is absent in its rows."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def decoded(frame: DataFrame, code: str, dictionary: DataFrame, key: str, label: str, default: Column | None = None) -> DataFrame:
    """frame with the dictionary's label for a code; default where it has none.  The planner picks the join by size."""
    looked = frame.join(dictionary.select(F.col(key).alias("__key"), F.col(label).alias("__label")), F.col(code) == F.col("__key"), "left")
    value = F.col("__label") if default is None else F.coalesce("__label", default)
    return looked.withColumn(label, value).drop("__key", "__label")


def patched(frame: DataFrame, index: int, column: str, value: float) -> DataFrame:
    """frame with one value of one record replaced."""
    return frame.withColumn(column, F.when(F.col(INDEX) == index, F.lit(value)).otherwise(F.col(column)))


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one side has, with the side; empty if both hold the same rows as often."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def page(frame: DataFrame, size: int) -> Column:
    """The page of each record."""
    return F.floor(F.col(INDEX) / size).cast("long")


def column_prefetch(frame: DataFrame, *columns: str) -> DataFrame:
    """The columns, cached for repeated access."""
    return frame.select(*columns).cache()


def viewport(frame: DataFrame, start: int, end: int) -> DataFrame:
    """Records start to end, both included, cached."""
    return frame.where(F.col(INDEX).between(start, end)).cache()
