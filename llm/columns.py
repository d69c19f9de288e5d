"""Columns by place, so that no name in the input can clash with a name that an operator uses inside."""

from __future__ import annotations

from pyspark.sql import DataFrame


def place(frame: DataFrame, name: str) -> int:
    """Where a column is: by its exact name, or else by its name without regard to case."""
    names = frame.columns
    return names.index(name) if name in names else [n.lower() for n in names].index(name.lower())


def numbered(frame: DataFrame) -> DataFrame:
    """frame with its columns named c0, c1, ..."""
    return frame.toDF(*(f"c{i}" for i in range(len(frame.columns))))


def untouched(frame: DataFrame, *replaced: str) -> list[int]:
    """Places of the columns whose names, without regard to case, are none of the given ones."""
    gone = {n.lower() for n in replaced}
    return [i for i, n in enumerate(frame.columns) if n.lower() not in gone]
