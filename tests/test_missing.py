"""Missing and damaged input gets a defined result, and wrong schemas are refused."""

import pytest
from pyspark.sql import functions as F

from wayscore import schemas
from wayscore.operators import clusters, decision, provider, quality, risk, scoring, tracks
from wayscore.sources import files

NAN = float("nan")


def test_missing_positions_are_failed_records(spark):
    kind = "event_id long, city string, latitude double, longitude double"
    a = spark.createDataFrame([(i, "A", 25.0, 121.0) for i in range(5)], kind)
    b = spark.createDataFrame(
        [(0, "A", 25.0, 121.0), (1, "A", None, 121.0), (2, "A", NAN, 121.0), (3, "A", 25.001, 121.0)], kind
    )
    row = provider.city_risk_summary(provider.provider_error(a, b)).first()
    assert (row.failed_records, row.risk_rate) == (3, 0.5)
    nothing = provider.city_decision(provider.city_risk_summary(provider.provider_error(a, b.limit(0)))).first()
    assert (nothing.avg_error_meters, nothing.failed_records, nothing.decision) == (None, 5, "Review")


def test_drift_needs_a_position(spark, points):
    df = points([(1, "u", 1, None, 121.0, "Taipei"), (2, "u", 2, NAN, 121.0, "Taipei")])
    assert [tuple(r) for r in quality.drift(df).select("home_km", "is_drift").collect()] == [(None, None)] * 2


def test_wrong_columns_are_refused(spark, tmp_path):
    path = str(tmp_path / "points")
    spark.createDataFrame([("u", 1, 1.0, 2.0, "c")], "user_id string, timestamp long, lat double, lon double, city string").write.parquet(path)
    with pytest.raises(ValueError, match="latitude: missing"):
        files.read_parquet(spark, path, schemas.GPS_POINTS)
    with pytest.raises(ValueError, match="longitude"):
        files.read_first_available(spark, [("parquet", path)], schemas.GPS_POINTS)


def test_missing_speed_has_no_score_text_or_advice(spark):
    kind = "driver_id string, label string, average_speed double, stuck_count int, total_km double"
    df = spark.createDataFrame(
        [("a", "Risk", None, 1, 1.0), ("b", "Risk", NAN, 1, 1.0), ("c", "Risk", 5.0, 9, 1.0)], kind
    )
    rows = {r.driver_id: r for r in risk.risk_insights(df).collect()}
    assert rows["a"].management_advice is None and rows["a"].speed is None
    assert rows["b"].ai_sentiment is None and rows["c"].ai_sentiment == "NEGATIVE"
    assert decision.slowest_drivers(df, 1).first().driver_id == "c"
    assert risk.risky_drivers(df, n=None).count() == 3
    means = spark.createDataFrame([(0, None), (1, 3.0), (2, 9.0)], "cluster int, mean_value double")
    assert tuple(clusters.lowest_and_highest(means).first()) == (1, 2)


def test_model_that_does_not_load_says_why(spark):
    def broken():
        raise OSError("no weights here")

    df = spark.createDataFrame([("x",)], "`a b` string")
    row = scoring.score_partitions(df, "a b", "a b", load_model=broken).first()
    assert "no weights here" in row.error


def test_more_runs_than_partitions(spark, points):
    df = points([(i, f"u{i % 2}", i // 7, 25 + i * 1e-4, 121.0, "Taipei") for i in range(600)])
    split = tracks.add_previous_point(df, hot_rows=10, run_rows=20)
    plain = tracks.add_previous_point(df)
    columns = ["event_id", "prev_lat", "prev_lon", "point_no"]
    assert split.select(columns).exceptAll(plain.select(columns)).count() == 0
    assert split.count() == 600


def test_sample_without_limit(spark, points):
    df = points([(i, "u", i, 25.0, 121.0, "Taipei") for i in range(1, 101)])
    sample = quality.systematic_sample(df, every=10, per_city=None)
    assert sample.agg(F.sum("event_id"), F.count("*")).first()[:] == (sum(range(1, 101, 10)), 10)
