"""A small predicate algebra with two-valued logic over missing fields.

A predicate is never NULL: a comparison on an absent value, on an unknown field or against a value of
another kind is false, and Not() of such a comparison is true.  Only Not() wraps its child in a
coalesce; And/Or are monotone, so leaving their leaves bare gives the same rows from a filter and keeps
simple comparisons in a shape that is pushed down to the scan.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_FLOATS = (T.FloatType, T.DoubleType)


class Pred:
    """Base class; combine with &, | and ~."""

    def column(self, schema: T.StructType) -> Column:
        raise NotImplementedError

    def __and__(self, other: Pred) -> Pred:
        return And(self, other)

    def __or__(self, other: Pred) -> Pred:
        return Or(self, other)

    def __invert__(self) -> Pred:
        return Not(self)


def field_type(schema: T.StructType, path: str) -> T.DataType | None:
    """Type of a (dotted) field; None if there is none."""
    if path in schema.names:
        return schema[path].dataType
    head, _, rest = path.partition(".")
    if rest and head in schema.names and isinstance(schema[head].dataType, T.StructType):
        return field_type(schema[head].dataType, rest)
    return None


def column_of(schema: T.StructType, path: str) -> Column:
    return F.col(f"`{path}`") if path in schema.names else F.col(".".join(f"`{p}`" for p in path.split(".")))


@dataclass(frozen=True)
class Compare(Pred):
    """field == / > / < value, by the kinds of field and value."""

    field: str
    op: str
    value: bool | int | float | str | bytes

    def column(self, schema: T.StructType) -> Column:
        kind, value = field_type(schema, self.field), self.value
        if kind is None or not self._comparable(kind):
            return F.lit(False)
        if isinstance(value, float) and math.isnan(value):
            return F.lit(False)
        c = column_of(schema, self.field)
        literal = F.lit(value).cast("double") if isinstance(value, float) else F.lit(value)
        test = {"eq": c == literal, "gt": c > literal, "lt": c < literal}[self.op]
        # NaN sorts above all numbers here, but is neither equal to nor above anything in IEEE
        return test & ~F.isnan(c) if isinstance(kind, _FLOATS) and self.op == "gt" else test

    def _comparable(self, kind: T.DataType) -> bool:
        if isinstance(self.value, bool):
            return isinstance(kind, T.BooleanType) and self.op == "eq"
        if isinstance(self.value, (int, float)):
            return isinstance(kind, _NUMBERS)
        if isinstance(self.value, bytes):
            return isinstance(kind, T.BinaryType) and self.op == "eq"
        return isinstance(kind, T.StringType) and self.op == "eq"


@dataclass(frozen=True)
class And(Pred):
    left: Pred
    right: Pred

    def column(self, schema: T.StructType) -> Column:
        return self.left.column(schema) & self.right.column(schema)


@dataclass(frozen=True)
class Or(Pred):
    left: Pred
    right: Pred

    def column(self, schema: T.StructType) -> Column:
        return self.left.column(schema) | self.right.column(schema)


@dataclass(frozen=True)
class Not(Pred):
    inner: Pred

    def column(self, schema: T.StructType) -> Column:
        return ~F.coalesce(self.inner.column(schema), F.lit(False))


@dataclass(frozen=True)
class Always(Pred):
    def column(self, schema: T.StructType) -> Column:
        return F.lit(True)


@dataclass(frozen=True)
class Custom(Pred):
    """A user's predicate: a function of the schema that gives a boolean column."""

    build: Callable[[T.StructType], Column]

    def column(self, schema: T.StructType) -> Column:
        return F.coalesce(self.build(schema), F.lit(False))


def eq(field: str, value: bool | int | float | str | bytes) -> Pred:
    return Compare(field, "eq", value)


def gt(field: str, value: int | float) -> Pred:
    return Compare(field, "gt", value)


def lt(field: str, value: int | float) -> Pred:
    return Compare(field, "lt", value)


def where(frame: DataFrame, pred: Pred) -> DataFrame:
    """Rows for which the predicate is true; lazy, so limit() stops early."""
    return frame.where(pred.column(frame.schema))


def truth(frame: DataFrame, pred: Pred) -> Column:
    """The predicate as a column that is never NULL."""
    return F.coalesce(pred.column(frame.schema), F.lit(False))


def first_match(frame: DataFrame, pred: Pred, *order: str) -> DataFrame:
    """The first row that matches, in the given order."""
    found = where(frame, pred)
    return (found.orderBy(*order) if order else found).limit(1)
