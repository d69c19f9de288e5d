"""Queries over record indexes take the number of records from the table."""

from ledgerframe.plans.catalog import QUERIES


def test_sample_series_reaches_the_last_record(spark, tmp_path):
    for n in (1, 150, 5_000):
        spark.range(n).selectExpr("id AS event_id", "CAST(id AS DOUBLE) AS value").write.parquet(f"{tmp_path}/{n}/events.parquet")
        points = min(200, n)
        want = sorted({k * (n - 1) // max(points - 1, 1) for k in range(points)})
        assert sorted(r.event_id for r in QUERIES["sample_series"](spark, f"{tmp_path}/{n}").collect()) == want
