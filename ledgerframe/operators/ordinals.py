"""Logic on record ordinals: pages, deltas, access patterns, ranges, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits of the access-pattern classes.
NEAR_STEP, FAR_STEP, MIN_OBSERVATIONS = 10, 100, 8


def page_table(frame: DataFrame, index: str, size: int) -> DataFrame:
    """(page, start, end, rows) of pages of `size` records."""
    number = F.expr(f"{index} div {size}")
    return frame.groupBy(number.alias("page")).agg(F.min(index).alias("start_index"), F.max(index).alias("end_index"), F.count("*").alias("n_rows"))


def page_of(frame: DataFrame, index: str, size: int, wanted: int) -> DataFrame:
    """The page that holds a record, from that page's records alone."""
    first = wanted // size * size
    here = frame.where(F.col(index).between(first, first + size - 1))
    return locate(page_table(here, index, size), wanted)


def locate(pages: DataFrame, index: int) -> DataFrame:
    """The page that holds a record."""
    return pages.where(F.lit(index).between(F.col("start_index"), F.col("end_index")))


def delta_index(frame: DataFrame, index: str, offset: str, block: int = 1024) -> DataFrame:
    """(index, block, anchor, delta): offsets as a difference to the first offset of their block."""
    number = F.expr(f"{index} div {block}")
    anchors = Window.partitionBy("block").orderBy(index)
    placed = frame.select(F.col(index), number.alias("block"), F.col(offset))
    return placed.withColumn("anchor", F.first(offset).over(anchors)).select(index, "block", "anchor", (F.col(offset) - F.col("anchor")).alias("delta"))


def access_pattern(accesses: DataFrame, key: str, order: str, index: str) -> DataFrame:
    """(key, observations, sequential, random, pattern) of the accesses of each key, in order."""
    step = F.abs(F.col(index) - F.lag(index).over(Window.partitionBy(key).orderBy(order)))
    steps = accesses.select(key, step.alias("step"))
    counts = steps.groupBy(key).agg(F.count("*").alias("observations"), F.count_if(F.col("step") <= NEAR_STEP).alias("sequential"), F.count_if(F.col("step") > FAR_STEP).alias("random"))
    pattern = (
        F.when(F.col("observations") < MIN_OBSERVATIONS, "unknown").when(F.col("sequential") > 3 * F.col("random"), "sequential")
        .when(F.col("random") > F.col("sequential"), "random").otherwise("mixed")
    )
    return counts.withColumn("pattern", pattern)


def predict_next(last: Column, depth: int, count: int) -> Column:
    """The next `depth` ordinals after last that exist."""
    return F.filter(F.sequence(last + 1, last + depth), lambda i: i < count)


def coalesced_ranges(pages: DataFrame, key: str, page: str, gap: int = 1) -> DataFrame:
    """(key, start, end, pages): runs of pages, joined over gaps of up to `gap` missing pages; repeats count once."""
    order = Window.partitionBy(key).orderBy(page)
    apart = pages.select(key, page).distinct().withColumn("apart", (F.col(page) - F.lag(page).over(order) > gap + 1).cast("int"))
    islands = apart.withColumn("island", F.sum(F.coalesce("apart", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(key, "island").agg(F.min(page).alias("start_page"), F.max(page).alias("end_page"), F.count("*").alias("n_pages")).drop("island")


def sampled(frame: DataFrame, index: str, points: int, count: int) -> DataFrame:
    """Up to `points` records at even distances, the first and the last included."""
    points = min(points, count)
    if points < 1:
        return frame.limit(0)
    wanted = sorted({k * (count - 1) // (points - 1) if points > 1 else 0 for k in range(points)})
    return frame.where(F.col(index).isin(wanted))


def missing_pages(needed: DataFrame, present: DataFrame, page: str) -> DataFrame:
    """Pages that are needed but not present, each once."""
    return needed.select(page).distinct().join(present.select(page), page, "left_anti")
