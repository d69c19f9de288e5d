"""Lineage cuts in the folder that all executors share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths of written tables that nothing has deleted yet, by the application they belong to.
_written: dict[str, list[str]] = {}
#: Those of them that a stage of a pipeline has written for itself.
_staged: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or the checkpoint folder set on its context.

    Where both are unset, a local session gets a temporary folder; on a cluster that is a ValueError.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return spark.sparkContext.getCheckpointDir()


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored(frame: DataFrame, label: str = "table") -> DataFrame:
    """frame, computed once and written to the shared folder.

    It survives lost executors, and what reads it knows its size, so joins are planned by it.
    """
    path = fresh_path(frame.sparkSession, label)
    frame.write.parquet(path)
    table = frame.sparkSession.read.schema(frame.schema).parquet(path)
    table.stored_at = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame, shuffles: bool = True) -> None:
    """Delete stored tables that nothing reads any more, and (if `shuffles`) what finished jobs have shuffled."""
    for table in tables:
        spark = table.sparkSession
        _delete(spark, table.stored_at)
        _written[spark.sparkContext.applicationId].remove(table.stored_at)
    if tables and shuffles:
        release_shuffles(tables[0].sparkSession)


def release_shuffles(spark: SparkSession) -> None:
    """Spark deletes a shuffle's files when the driver's garbage collection meets it: collect now."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def stage_tables(docs: DataFrame) -> Iterator[None]:
    """A stage of a pipeline that reads docs: what earlier stages stored inside such a block goes, but for tables that docs reads."""
    spark = docs.sparkSession
    app = spark.sparkContext.applicationId
    written, staged = _written.setdefault(app, []), _staged.setdefault(app, [])
    needed = [re.sub("^file:/+", "/", f) for f in docs.inputFiles()]
    for path in [p for p in staged if not any(f.startswith(re.sub("^file:/+", "/", p)) for f in needed)]:
        if path in written:
            _delete(spark, path)
            written.remove(path)
        staged.remove(path)
    release_shuffles(spark)
    before = set(written)
    try:
        yield
    finally:
        staged += [p for p in written if p not in before]


def largest(frame: DataFrame, column: str, most: int) -> DataFrame:
    """Rows with the largest whole numbers (from 1) in a column: exactly `most` of them, or all if there are fewer.

    A histogram of at most 4096 buckets, 64 to the octave, finds the buckets that fit whole.  Of the one
    that straddles the limit a hash of the rows decides, by a second histogram, and only the rest of one
    of its 4096 parts goes through a limit: tasks send no rows that are not in the result but for that
    part's.  frame should be stored: it is read three times.
    """
    bucket, part = F.floor(F.log2(F.col(column)) * 64).cast("int"), F.pmod(F.xxhash64(*frame.columns), F.lit(4096))

    def fitting(rows: DataFrame, key: Column, room: int) -> tuple[list[int], int | None, int]:
        """Buckets that fit whole from the largest down, the one that straddles the limit, and the room left for it."""
        sizes = {r.key: r.n for r in rows.groupBy(key.alias("key")).agg(F.count("*").alias("n")).collect()}
        whole: list[int] = []
        for b in sorted(sizes, reverse=True):
            if sizes[b] > room:
                return whole, b, room
            whole.append(b)
            room -= sizes[b]
        return whole, None, room

    whole, cut, room = fitting(frame, bucket, most)
    if cut is None:
        return frame
    out, straddling = frame.where(bucket > cut), frame.where(bucket == cut)
    whole, last, room = fitting(straddling, part, room)
    out = out.unionByName(straddling.where(part >= min(whole))) if whole else out
    return out.unionByName(straddling.where(part == last).limit(room)) if room else out
