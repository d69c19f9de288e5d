"""Tables of made-up records by formula, at any size, and their files in every format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerframe.sources import convert
from ledgerframe.sources.recordfile import register

# The moment that every record of the flat table was made, and its fields' formulas.
CREATED_NS = 1_777_593_600_000_000_000
FLAT = {
    "id": "id", "username": "format_string('user_%07d', id)", "email": "format_string('user%d@example.com', id)", "age": "20 + id % 50",
    "balance": "round(100 + id * 1.37D, 2)", "active": "id % 3 <> 0", "score": "round((id % 100) / 10D, 1)", "created_at": f"{CREATED_NS}L",
}
# Formulas of the dense numeric table.
DENSE = {
    "id": "id", "bucket": "id % 256", "quantity": "id % 97 + 1", "amount": "round(id * 1.11D, 4)", "rate": "round(0.01D + (id % 50) * 0.001D, 6)",
    "score": "round((id % 1000) / 10D, 2)", "category": "id % 64", "active": "id % 5 <> 0",
}


def generated(spark: SparkSession, n: int, formulas: dict[str, str]) -> DataFrame:
    return spark.range(n).select(*(F.expr(e).alias(name) for name, e in formulas.items()))


def flat(spark: SparkSession, n: int) -> DataFrame:
    """n records of eight fields of every scalar kind."""
    return generated(spark, n, FLAT)


def dense(spark: SparkSession, n: int) -> DataFrame:
    """n records of eight fields, seven of them numbers."""
    return generated(spark, n, DENSE)


def sparse(frame: DataFrame, every: int = 10, *kept: str) -> DataFrame:
    """frame with all but the kept columns present in one record of `every` only."""
    return frame.select(*(c if c in kept else F.when(F.col("id") % every == 0, F.col(c)).alias(c) for c in frame.columns))


def write_all(frame: DataFrame, folder: str) -> dict[str, str]:
    """The table as record files of every layout, JSON lines and CSV below a folder; the path of each by its name."""
    register(frame.sparkSession)
    paths = {name: f"{folder.rstrip('/')}/{name}" for name in ("row", "compact", "columnar", "paged", "json", "csv")}
    for name, path in paths.items():
        if name == "json":
            convert.write_json(frame, path)
        elif name == "csv":
            convert.write_csv(frame, path)
        else:
            frame.write.format("recordfile").mode("overwrite").option("layout", name).save(path)
    return paths
