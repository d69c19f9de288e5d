"""The predicate algebra on small rows with absent values, NaN and other kinds of values."""

import math

import pytest
from pyspark.sql import functions as F

from ledgerframe.functions.predicates import Custom, Not, eq, first_match, gt, lt, truth, where

ROWS = [(1, "alice", 95.0, True), (2, "bob", 42.0, False), (3, "carol", 88.0, True), (4, "dave", 15.0, False), (5, "eve", 77.0, True)]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(ROWS, "id long, username string, score double, active boolean")


@pytest.fixture(scope="module")
def sparse(spark):
    return spark.createDataFrame([(1, None), (2, math.nan), (3, 1.0), (4, math.inf)], "id long, score double")


def ids(frame):
    return sorted(r.id for r in frame.collect())


@pytest.mark.parametrize(
    ("pred", "want"),
    [
        (eq("active", True), [1, 3, 5]), (gt("score", 80.0), [1, 3]), (lt("score", 50), [2, 4]), (eq("active", True) & gt("score", 80.0), [1, 3]),
        (gt("score", 90.0) | lt("score", 20.0), [1, 4]), (~eq("active", True), [2, 4]), (eq("nothing", 1), []), (~eq("nothing", 1), [1, 2, 3, 4, 5]),
        (eq("username", "eve"), [5]), (eq("username", 5), []), (eq("score", "95"), []), (eq("active", 1), []), (eq("id", 3), [3]), (gt("score", math.nan), []), (lt("score", math.nan), []),
        (Custom(lambda schema: F.col("id") % 2 == 0), [2, 4]),
    ],
)
def test_rows(people, pred, want):
    assert ids(where(people, pred)) == want


@pytest.mark.parametrize(("pred", "want"), [(gt("score", 0.0), [3, 4]), (Not(gt("score", 0.0)), [1, 2]), (eq("score", math.nan), []), (lt("score", 5.0), [3]), (~lt("score", 5.0), [1, 2, 4])])
def test_absent_and_nan(sparse, pred, want):
    assert ids(where(sparse, pred)) == want
    assert sorted(r.id for r in sparse.select("id", truth(sparse, pred).alias("t")).where("t").collect()) == want
    assert sparse.select(truth(sparse, pred).alias("t")).where("t IS NULL").count() == 0


def test_first(people):
    assert first_match(people, eq("active", True), "id").first().username == "alice"


def test_comparisons_reach_the_scan(spark, tmp_path, people):
    people.write.parquet(f"{tmp_path}/p")
    plan = where(spark.read.parquet(f"{tmp_path}/p"), gt("id", 3) & eq("username", "eve"))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThan(id,3)" in plan and "EqualTo(username,eve)" in plan


def test_nested_path(spark):
    frame = spark.createDataFrame([((1, (2,)),), ((1, (3,)),), (None,)], "a struct<b:long,c:struct<d:long>>")
    assert where(frame, eq("a.c.d", 3)).count() == 1 and where(frame, ~eq("a.c.d", 3)).count() == 2
