"""Fixed-start K-means, questions about cities, the survivorship report and map markers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wayscore import fixed
from wayscore.operators import lloyd, provider, quality, risk, tracks

FEATURES = "driver_id string, total_km double, average_speed double, stuck_count long"


def brute_lloyd(rows, k, rounds=100):
    """Clusters of standardised rows, and their centres."""
    n, d = len(rows), len(rows[0])
    mean = [sum(r[j] for r in rows) / n for j in range(d)]
    sd = [math.sqrt(sum((r[j] - mean[j]) ** 2 for r in rows) / n) for j in range(d)]
    z = [[(r[j] - mean[j]) / sd[j] if sd[j] > 0 else 0.0 for j in range(d)] for r in rows]
    centres = lloyd.starting_centres(k, d)
    for _ in range(rounds):
        place = [min(range(k), key=lambda i: sum((a - b) ** 2 for a, b in zip(r, centres[i]))) for r in z]
        for i in range(k):
            own = [r for r, p in zip(z, place) if p == i]
            if own:
                centres[i] = [sum(c) / len(own) for c in zip(*own)]
    return place, centres


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_lloyd_against_brute_force(spark, k):
    pick = random.Random(k)
    rows = [(f"d{i}", pick.gauss(i % 3 * 9, 2), pick.gauss(i % 2 * 30, 5), pick.randint(0, 4)) for i in range(120)]
    rows += rows[:5]  # equal rows are fitted as one with a weight
    df = spark.createDataFrame([(f"{i}", *r[1:]) for i, r in enumerate(rows)], FEATURES).repartition(7)
    fit = lloyd.lloyd(df, k=k)
    want, centres = brute_lloyd([r[1:] for r in rows], k)
    got = {int(r.driver_id): r.cluster for r in fit.rows.collect()}
    assert [got[i] for i in range(len(rows))] == want
    for a, b in zip(fit.centres, centres):
        assert a == pytest.approx(b)
    assert 1 <= fit.rounds < 100


def test_lloyd_at_the_edges(spark):
    none = spark.createDataFrame([], FEATURES)
    assert lloyd.lloyd(none).rows.count() == 0
    assert lloyd.lloyd(none, scale=False).rows.count() == 0
    same = spark.createDataFrame([(f"{i}", 1.0, 2.0, 3) for i in range(4)], FEATURES)
    assert {r.cluster for r in lloyd.lloyd(same).rows.collect()} == {1}  # the mean is the middle centre
    odd = spark.createDataFrame([("a", 1.0, None, 3), ("b", 5.0, 4.0, 3), ("c", 9.0, 1.0, 1)], FEATURES)
    assert {r.driver_id: r.cluster is None for r in lloyd.lloyd(odd).rows.collect()} == {"a": True, "b": False, "c": False}
    assert lloyd.lloyd(odd, max_rounds=1).rounds == 1
    with pytest.raises(ValueError, match="average_speed, stuck_count"):
        lloyd.lloyd(spark.createDataFrame([("a", 1.0)], "driver_id string, total_km double"))


def test_cluster_report_counts_every_row(spark):
    df = spark.createDataFrame([(f"{i}", float(i % 3), float(i % 3 * 10), i % 3) for i in range(30)], FEATURES)
    rows = lloyd.cluster_report(df).collect()
    assert sorted(r.n for r in rows) == [10, 10, 10] and all(abs(r.squares) < 1e-9 for r in rows)


def test_cities_named_in_questions(spark):
    cities = spark.createDataFrame([("Taipei",), ("New Taipei",), ("嘉義",), ("",), (None,), ("Taipei",)], "city string")
    texts = ["new TAIPEI or 嘉義市?", "taipe", None, "", "taipeitaipei", "no place", "taipeitaipei"]
    asked = spark.createDataFrame([*enumerate(texts)], "question_id long, question string")
    found = provider.cities_named(asked, cities)
    got = sorted((r.question_id, r.city or "") for r in found.collect())
    want = [(0, "New Taipei"), (0, "Taipei"), (0, "嘉義"), (1, ""), (2, ""), (3, ""), (4, "Taipei"), (5, ""), (6, "Taipei")]
    assert got == want
    assert provider.cities_named(asked, cities.limit(0)).where("city IS NULL").count() == len(texts)
    assert provider.cities_named(asked.limit(0), cities).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_questions_without_a_city_need_a_review(spark):
    errors = spark.createDataFrame([("A", 1.0), ("A", 2.0), ("B", 90.0), ("C", None)], "city string, error_meters double")
    asked = spark.createDataFrame([("to a?",), ("?",), ("b",), ("c",)], "question string")
    got = provider.question_decisions(asked, provider.city_risk_summary(errors)).collect()
    assert {(r.question, r.city, r.decision) for r in got} >= {("?", None, "Review"), ("b", "B", "No-Go")}
    assert {r.decision for r in got if r.city == "A"} == {"Go"} and {r.decision for r in got if r.city == "C"} == {"Review"}


def test_survivorship_by_hand(spark, points):
    rows = [(i, "long", 10 * i, 1.0 + i, 1.0, "X") for i in range(6)] + [(10 + i, "short", i, 2.0, 2.0, "X") for i in range(2)]
    rows += [(20, "lost", 1, 0.0, 0.0, "Y"), (21, "lost", 2, 0.0, 0.0, "Y"), (22, "lost", 3, 0.0, 0.0, "Y")]
    report = quality.survivorship(tracks.add_steps(points(rows)), most_points=2)
    got = {r.city: r for r in report.collect()}
    x, y = got["X"], got["Y"]
    assert (x.tracks, x.seen_tracks, x.visible_rate, x.points, x.seen_points) == (2, 1, 0.5, 8, 2)
    assert x.stall_share == pytest.approx(3 / 8) and x.seen_stall_share == 1.0 and x.seen_mean_step_km == 0.0
    assert (y.seen_tracks, y.seen_points, y.lost_share, y.seen_lost_share, y.seen_stall_share) == (0, 0, 1.0, None, None)
    assert quality.survivorship(tracks.add_steps(points([])), 2).count() == 0


def test_last_positions_skip_unknown_ones(spark, points):
    nan = float("nan")
    rows = [(1, "a", 5, 1.0, 1.0, "X"), (2, "a", 5, 2.0, 2.0, "X"), (3, "a", 9, 0.0, 0.0, "X"), (4, "a", 8, nan, 1.0, "X")]
    rows += [(5, "a", 7, None, 1.0, "X"), (6, "b", 1, 0.0, 0.0, "X"), (7, None, 3, 4.0, 4.0, "X")]
    got = {r.user_id: (r.timestamp, r.latitude) for r in tracks.last_positions(points(rows)).collect()}
    assert got == {"a": (5, 2.0), None: (3, 4.0)}


def test_markers_of_drivers(spark):
    drivers = spark.createDataFrame(
        [("a", 12.34, 5, fixed.LABEL_RISK), ("b", None, None, None), ("c", 70.06, 0, fixed.LABEL_GOOD)],
        "driver_id string, average_speed double, stuck_count int, label string",
    )
    places = spark.createDataFrame([("a", 25.0, 121.0), ("z", 1.0, 1.0)], "driver_id string, latitude double, longitude double")
    got = {r.driver_id: tuple(r)[1:] for r in risk.map_markers(drivers, places, risk.risk_insights(drivers)).collect()}
    pending = fixed.ADVICE_PENDING
    assert got == {
        "a": (25.0, 121.0, fixed.LABEL_RISK, "#ff4d4d", "12.3 km/h", "5 times", fixed.OBSERVE_ADVICE),
        "b": (None, None, None, fixed.UNKNOWN_COLOUR, None, "0 times", pending),
        "c": (None, None, fixed.LABEL_GOOD, "#2ecc71", "70.1 km/h", "0 times", pending),
    }


def test_markers_of_given_tables_have_places(spark, given):
    from wayscore.plans.catalog import QUERIES

    rows = QUERIES["map_markers"](spark, given)
    assert rows.where(F.col("latitude").isNotNull()).count() == rows.count() > 0
    assert rows.where(F.col("advice") != fixed.ADVICE_PENDING).count() > 0
