"""A schema registry kept as a table, and schema comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerframe.errors import SchemaConflict

TABLE = "hash string, subject string, version long, policy string, key_count long, fields array<struct<name:string,type:string>>"


def schema_hash(schema: T.StructType) -> str:
    """16 hex digits that depend on the names and types in order."""
    import hashlib

    return hashlib.blake2b("\n".join(f"{f.name}\t{f.dataType.simpleString()}" for f in schema).encode(), digest_size=8).hexdigest()


def as_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(schema)], "slot long, name string, type string")


def schema_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(name, left_type, right_type, change) for every field of either side: same, changed, added or removed."""
    a, b = left.select("name", F.col("type").alias("left_type")), right.select("name", F.col("type").alias("right_type"))
    change = F.when(F.col("left_type").isNull(), "added").when(F.col("right_type").isNull(), "removed").when(F.col("left_type") == F.col("right_type"), "same").otherwise("changed")
    return a.join(b, "name", "full_outer").select("name", "left_type", "right_type", change.alias("change"))


def push(spark: SparkSession, path: str, subject: str, schema: T.StructType, policy: str = "additive_only") -> str:
    """Register a schema; a change that the policy (reject, additive_only, any) forbids is a SchemaConflict."""
    key = schema_hash(schema)
    try:
        known = spark.read.schema(TABLE).parquet(path).where(F.col("subject") == subject).orderBy(F.desc("version")).limit(1).collect()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = []
    if known and known[0].hash == key:
        return key
    if known and policy != "any":
        old = [(f.name, f.type) for f in known[0].fields]
        new = [(f.name, f.dataType.simpleString()) for f in schema]
        if policy == "reject" or new[: len(old)] != old:
            raise SchemaConflict(f"{subject}: the schema may not change so under {policy}")
    fields = [(f.name, f.dataType.simpleString()) for f in schema]
    row = (key, subject, known[0].version + 1 if known else 1, policy, len(fields), fields)
    spark.createDataFrame([row], TABLE).write.mode("append").parquet(path)
    return key


def listing(spark: SparkSession, path: str, limit: int = 50, offset: int = 0) -> DataFrame:
    return spark.read.schema(TABLE).parquet(path).orderBy("subject", "version").offset(offset).limit(limit)


def by_hash(spark: SparkSession, path: str, key: str) -> DataFrame:
    return spark.read.schema(TABLE).parquet(path).where(F.col("hash") == key.lower().removeprefix("0x").rjust(16, "0"))
