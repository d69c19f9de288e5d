from pyspark.sql import functions as F

from llm.storage import discard, largest, stage_tables, stored


def test_largest(spark):
    rows = stored(spark.createDataFrame([(i, 1) for i in range(100)] + [(200 + i, 7) for i in range(10)] + [(300, 50)], "k long, n long"))
    assert largest(rows, "n", 1).collect() == [(300, 50)]
    assert {r.k for r in largest(rows, "n", 11).collect()} == {*range(200, 210), 300}
    for most in (0, 3, 11, 64, 111, 500):
        got = largest(rows, "n", most).collect()
        assert len(got) == len(set(got)) == min(most, 111)
    assert largest(rows.where("n < 0"), "n", 5).collect() == []


def test_stage_tables_go_when_nothing_reads_them(spark):
    docs = stored(spark.range(5))
    with stage_tables(docs):
        own = stored(docs.select(F.col("id") + 1))
    outside = stored(spark.range(3))
    with stage_tables(own):  # still read
        assert own.count() == 5
    with stage_tables(docs):
        pass
    exists = lambda t: spark._jvm.java.io.File(t.stored_at.removeprefix("file:")).exists()
    assert not exists(own) and exists(outside) and exists(docs)
    discard(outside)
    assert not exists(outside)
