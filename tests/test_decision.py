import random

import pytest
from pyspark.sql import functions as F

from wayscore.operators import decision, ranking, tracks


def test_matrix_scores_before_rounding(spark):
    steps = spark.createDataFrame(
        [("Taipei", "a", 1, 0.00004, 0), ("Taipei", "a", None, 0.0, 1), ("Hsinchu", "a", 3, 2.0, 0)],
        "city string, user_id string, timestamp long, step_distance_km double, is_stuck int",
    )
    rows = {r["city"]: r for r in decision.decision_matrix(steps).collect()}
    assert rows["Taipei"]["total_km"] == 0.0
    assert rows["Taipei"]["total_records"] == 1
    assert rows["Taipei"]["final_score"] == pytest.approx(-20.0)
    assert rows["Hsinchu"]["final_score"] == 200.0
    weighted = decision.decision_matrix(steps, km_weight=1, stuck_weight=0).collect()
    assert sorted(r["final_score"] for r in weighted) == [0.0, 2.0]


def test_matrix_counts_every_row(points):
    pick = random.Random(3)
    rows = [
        (i, f"u{pick.randrange(5)}", i, pick.uniform(24, 25), 121.0, pick.choice(["T", "H"]))
        for i in range(200)
    ]
    plain = decision.decision_matrix(tracks.add_steps(points(rows)))
    hot = decision.decision_matrix(tracks.add_steps(points(rows), hot_rows=10, run_rows=10))
    assert plain.agg(F.sum("total_records")).first()[0] == 200
    key = ("city", "user_id")
    assert sorted(map(tuple, plain.select(*key, "stuck_count", "final_score").collect())) == sorted(
        map(tuple, hot.select(*key, "stuck_count", "final_score").collect())
    )


def test_rank_is_the_global_order(spark):
    pick = random.Random(5)
    rows = [("c", f"u{i:03d}", 0.0, 1, 0, float(pick.randrange(40))) for i in range(300)]
    schema = "city string, user_id string, total_km double, total_records long, stuck_count long, final_score double"
    matrix = spark.createDataFrame(rows, schema).repartition(7)
    found = {r["user_id"]: r["rank"] for r in decision.ranked(matrix).collect()}
    wanted = sorted(rows, key=lambda r: (-r[5], r[1]))
    assert [found[r[1]] for r in wanted] == list(range(1, 301))
    assert ranking.add_rank(matrix.limit(0), F.asc("city")).count() == 0
    top = decision.top_drivers(matrix, 4).collect()
    assert [r["user_id"] for r in top] == [r[1] for r in wanted[:4]]


def test_speed_of_a_track_without_duration(points):
    df = points(
        [
            (1, "one", 5, 25.0, 121.0, "T"),
            (2, "same", 5, 25.0, 121.0, "T"),
            (3, "same", 5, 25.1, 121.0, "T"),
            (4, "far", 0, 25.0, 121.0, "T"),
            (5, "far", 7200, 26.0, 121.0, "T"),
        ]
    )
    rows = {r["driver_id"]: r for r in decision.driver_features(tracks.add_steps(df)).collect()}
    assert rows["one"]["average_speed"] == rows["same"]["average_speed"] == 0.0
    assert rows["far"]["average_speed"] == pytest.approx(rows["far"]["total_km"] / 2)


def test_slowest(spark):
    rows = [("b", 2.0), ("a", 2.0), ("c", 1.0), ("d", 9.0)]
    df = spark.createDataFrame(rows, "driver_id string, average_speed double")
    assert [r["driver_id"] for r in decision.slowest_drivers(df).collect()] == ["c", "a", "b"]
