import pytest
from pyspark.sql import functions as F

import __spark_entry__
from ledgerframe.errors import OutOfBounds
from ledgerframe.functions import scalars as X
from ledgerframe.operators import ordinals, reducers
from ledgerframe.operators import records as R


def test_index_is_dense_and_ordered(spark):
    frame = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k")).repartition(7)
    got = R.with_index(frame, "k").orderBy(R.INDEX).collect()
    assert [r[R.INDEX] for r in got] == list(range(1000)) and [r.k for r in got] == sorted(r.k for r in got)


def test_record_access(spark):
    frame = R.numbered(spark.range(5), "id")
    assert R.record_row(frame, 3) == {"id": 3, R.INDEX: 3}
    for bad in (5, -1):
        with pytest.raises(OutOfBounds):
            R.record_row(frame, bad)
    assert R.head(frame, 2).count() == 2 and R.head(frame, None).count() == 5 and R.export_limit(frame, 0).count() == 0 and R.export_limit(frame, -1).count() == 5


def test_absent_or_null(spark):
    frame = spark.createDataFrame([(None, []), (None, ["a"]), (1, [])], "a long, _null_fields array<string>")
    assert [r.x for r in frame.select(R.is_absent("a").alias("x")).collect()] == [True, False, False]


def test_patterns(spark):
    runs = {"seq": range(20), "rand": [*range(8), *(200 * k for k in range(1, 30))], "few": range(5)}
    rows = [(k, i, v) for k, values in runs.items() for i, v in enumerate(values)]
    got = ordinals.access_pattern(spark.createDataFrame(rows, "k string, i long, x long"), "k", "i", "x").collect()
    assert {r.k: r.pattern for r in got} == {"seq": "sequential", "rand": "random", "few": "unknown"}
    assert spark.range(1).select(ordinals.predict_next(F.lit(9), 4, 12).alias("p")).first().p == [10, 11]


def test_scalars(spark):
    frame = spark.createDataFrame([("$1,200.50", "1969-12-31T23:59:59.000000001", "0xFFFFFFFFFFFFFFFF"), ("5%", "-5", "zz"), ("n/a", "2026-02-30", None)], "cell string, time string, id string")
    got = frame.select(X.numeric_cell(F.col("cell")), X.time_ns(F.col("time")), X.hex_long(F.col("id"))).collect()
    assert [tuple(r) for r in got] == [(1200.5, -999999999, -1), (5.0, -5, None), (None, None, None)]
    assert X.unique_names(["a b", "a-b", "", "9x"]) == ["a_b", "a_b_2", "field", "_9x"]


def test_fill_and_empty(spark):
    frame = spark.createDataFrame([(1, None), (2, "x"), (3, None)], "a long, b string")
    assert [tuple(r) for r in reducers.fill_rate(frame).collect()] == [("a", 3, 100.0), ("b", 1, 33.3)]
    assert reducers.col_sum(frame.limit(0), "a").first().total is None and reducers.col_sum(frame, "nope").first().total is None


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
