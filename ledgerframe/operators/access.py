"""Ways to walk a table: callbacks, searches that can be stopped, hints on how it will be read, local columns."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerframe.operators.ordinals import NEAR_STEP
from ledgerframe.operators.records import INDEX, search_text

HINTS = ("unknown", "sequential", "random", "full", "partial")
#: A table up to this size is kept whole under the hint "full"; one beyond LAZY_BYTES never is.
EAGER_BYTES = 10 << 20
LAZY_BYTES = 50 << 20
#: So many near accesses in a row make an adaptive table one that is kept.
SEQUENTIAL_RUN = 100


def scan(frame: DataFrame, visit: Callable[[dict, int], dict | None], schema: str | T.StructType, index: str = INDEX) -> DataFrame:
    """visit(record, its index) for every record, inside Arrow batches; what it returns is a row, None is none.

    The record holds the fields that are present.  The order is that of each partition only.
    """
    target = frame.sparkSession.createDataFrame([], schema).schema

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(target)
        for part in parts:
            seen = ({k: v for k, v in row.items() if v is not None} for row in part.to_pylist())
            made = [got for row in seen if (got := visit(row, row.pop(index, None))) is not None]
            yield pa.RecordBatch.from_pylist(made, schema=out)

    return frame.mapInArrow(run, target)


class SearchJob:
    """A search that runs beside its caller, tells how far it is and can be cancelled.

    result() is the matches' table, written once to `path`; None after a cancellation.
    """

    def __init__(self, frame: DataFrame, column: str, needle: str, path: str):
        self.spark, self.path, self.group = frame.sparkSession, path, f"search-{uuid.uuid4().hex}"
        self.found, self.stopped, self.error = search_text(frame, column, needle), False, None
        self.thread = threading.Thread(target=self._run, daemon=True)
        self.thread.start()

    def _run(self) -> None:
        context = self.spark.sparkContext
        context.setJobGroup(self.group, "search", interruptOnCancel=True)
        try:
            if not self.stopped:
                self.found.write.mode("overwrite").parquet(self.path)
        except Exception as e:  # handed to the caller by result()
            self.error = e

    def progress(self) -> float:
        """Share of the tasks of the stages begun so far that are done."""
        tracker = self.spark.sparkContext.statusTracker()
        jobs = filter(None, map(tracker.getJobInfo, tracker.getJobIdsForGroup(self.group)))
        stages = [s for j in jobs for s in map(tracker.getStageInfo, j.stageIds) if s]
        tasks = sum(s.numTasks for s in stages)
        return sum(s.numCompletedTasks for s in stages) / tasks if tasks else float(not self.thread.is_alive())

    def cancel(self) -> None:
        self.stopped = True
        while self.thread.is_alive():  # a job may begin after the first call
            self.spark.sparkContext.cancelJobGroup(self.group)
            self.thread.join(0.1)

    def result(self) -> DataFrame | None:
        self.thread.join()
        if self.stopped:
            return None
        if self.error:
            raise self.error
        return self.spark.read.schema(self.found.schema).parquet(self.path)


class Opened:
    """A table with a hint on how it will be read, which decides whether Spark keeps it.

    full: kept at once up to EAGER_BYTES; every hint: never beyond LAZY_BYTES; sequential: kept at the first
    access; random and partial: not kept; else kept after SEQUENTIAL_RUN near accesses in a row.  The size is
    the planner's estimate.  Kept tables spill to the executors' disks.
    """

    def __init__(self, frame: DataFrame, hint: str = "unknown"):
        if hint not in HINTS:
            raise ValueError(f"no such hint: {hint}")
        self.frame, self.hint, self.paused, self.kept = frame, hint, False, False
        self.size = int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        self.accesses, self.near, self.last = 0, 0, None
        if self.strategy() == "eager":
            self.warmup()

    def strategy(self) -> str:
        if self.size > LAZY_BYTES or self.hint in ("random", "partial"):
            return "lazy"
        if self.hint == "full" and self.size <= EAGER_BYTES or self.near >= SEQUENTIAL_RUN or self.hint == "sequential" and self.accesses:
            return "eager"
        return "adaptive"

    def access(self, index: int) -> DataFrame:
        """The record at an index of the table's index column."""
        self.accesses += 1
        self.near = self.near + 1 if self.last is not None and abs(index - self.last) <= NEAR_STEP else 0
        self.last = index
        if self.strategy() == "eager" and not self.kept:
            self._keep()
        return self.frame.where(F.col(INDEX) == index)

    def _keep(self) -> None:
        if not self.paused:
            self.frame.persist(StorageLevel.MEMORY_AND_DISK)
            self.kept = True

    def warmup(self) -> None:
        """Read the table into the executors' storage now."""
        self._keep()
        if self.kept:
            self.frame.count()

    def pause(self) -> None:
        """Keep nothing until resume()."""
        self.paused = True
        if self.kept:
            self.frame.unpersist()
            self.kept = False

    def resume(self) -> None:
        self.paused = False

    def cache_stats(self) -> dict[str, object]:
        return {"kept": self.kept, "paused": self.paused, "strategy": self.strategy(), "accesses": self.accesses, "near_run": self.near, "size_bytes": self.size}


def column_scan(frame: DataFrame, column: str, index: str = INDEX) -> DataFrame:
    """(index, value) of every record, absent ones as NULL."""
    return frame.select(index, F.col(f"`{column}`").alias("value"))


def null_bitmap(frame: DataFrame, column: str, index: str = INDEX) -> DataFrame:
    """(index, absent) of every record."""
    return frame.select(index, F.col(f"`{column}`").isNull().alias("absent"))


def column_view(frame: DataFrame, column: str) -> pa.ChunkedArray:
    """One column on the driver as Arrow buffers; it must fit there."""
    return frame.select(f"`{column}`").toArrow().column(0)


def column_numpy(frame: DataFrame, column: str) -> np.ndarray:
    """One numeric column on the driver as float64, absent values as NaN; it must fit there."""
    return column_view(frame.select(F.col(f"`{column}`").cast("double").alias("value")), "value").to_numpy()


def from_records(spark: SparkSession, keys: Sequence[str], rows: Iterable[dict], kinds: dict[str, str] | None = None) -> DataFrame:
    """A table of records with the keys in order; a key that a record lacks is absent, other keys are an error.

    kinds gives types by key; those of the others follow from the first value present, text where there is none.
    """
    rows = list(rows)
    unknown = {k for r in rows for k in r} - set(keys)
    if unknown:
        raise ValueError(f"keys not declared: {', '.join(sorted(unknown))}")
    names = {bool: "boolean", int: "long", float: "double", bytes: "binary", bytearray: "binary"}
    first = {k: next((r[k] for r in rows if r.get(k) is not None), None) for k in keys}
    types = {k: names.get(type(v), "string") for k, v in first.items()} | (kinds or {})
    floats = {k for k in keys if types[k] == "double"}
    data = [tuple(float(v) if k in floats and (v := r.get(k)) is not None else r.get(k) for k in keys) for r in rows]
    return spark.createDataFrame(data, ", ".join(f"`{k}` {types[k]}" for k in keys))
