"""Types of text columns, inferred in one aggregation over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerframe.functions.scalars import CLASSES, class_code, coerce

SIGILS = {"int": "=", "float": "~", "bool": "?", "time": "@", "hex": "<", "string": '"', "null": "^"}


def infer_types(frame: DataFrame, *columns: str, order: str | None = None, policy: str = "string") -> DataFrame:
    """(field, kind, classes, present, total, optional) of text columns.

    A value has the first class it fits; empty text is a null.  A column of one class has that kind; of
    none, null.  For more, int and float together included, the policy decides: string, error (the kind
    is conflict), or first (the class of the first row by `order`).
    """
    columns = columns or tuple(c for c, kind in frame.dtypes if kind == "string" and c != order)
    marked = frame.select(*(class_code(F.col(c)).alias(f"k{i}") for i, c in enumerate(columns)), *([F.col(order).alias("__order")] if order else []))
    aggregates = [F.count("*").alias("total")]
    for i in range(len(columns)):
        aggregates += [F.count(f"k{i}").alias(f"p{i}"), F.coalesce(F.bit_or(F.expr(f"shiftleft(1, k{i})")), F.lit(0)).alias(f"c{i}")]  # a bit for each class met
        if policy == "first":
            aggregates.append(F.min_by(f"k{i}", F.when(F.col(f"k{i}").isNotNull(), F.col("__order"))).alias(f"f{i}"))
    counts = marked.agg(*aggregates)
    entries, every = [], F.array(*map(F.lit, CLASSES))
    for i, c in enumerate(columns):
        held = F.array_compact(F.array(*(F.when(F.col(f"c{i}").bitwiseAND(1 << k) != 0, name) for k, name in enumerate(CLASSES))))
        first = F.get(every, F.col(f"f{i}")) if policy == "first" else F.lit({"error": "conflict"}.get(policy, "string"))
        kind = F.when(F.size(held) == 0, "null").when(F.size(held) == 1, F.get(held, F.lit(0))).otherwise(first)
        entries.append(F.struct(F.lit(c).alias("field"), kind.alias("kind"), F.array_join(held, ",").alias("classes"), F.col(f"p{i}").alias("present")))
    return counts.select("total", F.inline(F.array(*entries))).select("field", "kind", "classes", "present", "total", (F.col("present") < F.col("total")).alias("optional"))


def typed(frame: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Text columns as values of their kinds; what doesn't parse is absent."""
    return frame.select(*(coerce(F.col(f"`{c}`"), kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in frame.columns))
