import random

import pytest

from wayscore.operators import quality, tracks


def test_anomalies_split_completely(points):
    rows = [
        (1, "a", 1, 0.0, 0.0, "Taipei"),
        (2, "a", 2, 25.0, 121.0, "Taipei"),
        (3, "a", 3, None, 0.0, "Taipei"),
        (4, "a", 4, float("nan"), 0.0, None),
    ]
    df = points(rows)
    assert quality.anomaly_points(df).count() == 1
    assert quality.normal_points(df).count() == 3
    counts = {r["city"]: (r["normal_points"], r["anomaly_points"]) for r in quality.geo_counts(df).collect()}
    assert counts == {"Taipei": (2, 1), None: (1, 0)}


def test_drift_catches_points_around_the_origin(spark, points):
    df = points(
        [
            (1, "a", 1, 25.03, 121.56, "Taipei"),
            (2, "a", 2, 0.0, 0.0, "Taipei"),
            (3, "a", 3, 0.0001, -0.0001, "Taipei"),
            (4, "a", 4, 25.0, 121.0, "Nowhere"),
        ]
    )
    found = {r["event_id"]: r["is_drift"] for r in quality.drift(df).collect()}
    assert found == {1: False, 2: True, 3: True, 4: None}
    table = spark.createDataFrame(
        [("Taipei", 25.0330, 121.5654)], "city string, home_lat double, home_lon double"
    )
    assert {r["event_id"]: r["is_drift"] for r in quality.drift(df, table).collect()} == found
    assert quality.anomaly_points(df).count() == 1


def test_nan_report(points):
    df = points(
        [
            (1, "a", 1, 25.0, 121.0, "T"),
            (2, "a", 2, float("nan"), 121.0, "T"),
            (3, "a", 3, None, 121.0, "T"),
            (4, "a", 4, 25.0, 121.0, "T"),
        ]
    )
    row = quality.nan_report(tracks.add_steps(df)).first().asDict()
    assert row == {
        "total_rows": 4, "null_inputs": 1, "nan_inputs": 1, "nan_distances": 0, "stuck_rows": 4
    }


@pytest.mark.parametrize("task_rows", [10_000, 50])
@pytest.mark.parametrize("same_time", [False, True])
def test_systematic_sample_is_exact(points, task_rows, same_time):
    pick = random.Random(9)
    rows = []
    for i in range(900):
        city = "Big" if i % 3 else pick.choice(["Small", None])
        time = 7 if same_time else pick.choice([None, *range(50_000)])
        lat = 0.0 if i % 13 == 0 else 25.0
        rows.append((i, "u", time, lat, 0.0 if i % 13 == 0 else 121.0, city))
    found = quality.systematic_sample(
        points(rows).repartition(6), every=4, per_city=30, task_rows=task_rows
    ).collect()
    for city in ("Big", "Small", None):
        normal = [r for r in rows if r[5] == city and r[3] != 0.0]
        normal.sort(key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        wanted = [r[0] for r in normal[::4][:30]]
        mine = sorted((r["sample_no"], r["event_id"]) for r in found if r["city"] == city)
        assert [m[1] for m in mine] == wanted
        assert [m[0] for m in mine] == list(range(1, len(wanted) + 1))


def test_sample_of_nothing(points):
    assert quality.systematic_sample(points([])).count() == 0


def test_coverage(points):
    rows = [(i, "u", i, 25.0 + (i % 11) / 10, 121.0 + (i % 11) / 10, "T") for i in range(110)]
    rows += [(200, "u", 1, 0.0, 0.0, "T"), (201, "u", 1, None, 1.0, "T")]
    found = {r["zone"]: r for r in quality.coverage(points(rows)).collect()}
    assert {z: r["full_points"] for z, r in found.items()} == {
        "core": 70, "edge": 40, "anomaly": 1, "unlocated": 1
    }
    assert found["anomaly"]["sampled_points"] == 1
    assert found["core"]["recall"] == pytest.approx(found["core"]["sampled_points"] / 70)


def test_a_box_without_extent_is_core(points):
    zones = quality.add_zones(points([(1, "u", 1, 25.0, 121.0, "T")])).collect()
    assert [r["zone"] for r in zones] == ["core"]


def test_grid(points):
    rows = [
        (1, "u", 1, 0.011, -0.001, "T"),
        (2, "u", 2, 0.019, -0.009, "T"),
        (3, "v", 1, float("nan"), 0.001, "T"),
        (4, "w", 1, None, 0.001, "T"),
    ]
    grid = quality.grid_density(tracks.add_steps(points(rows)), 0.01).collect()
    cells = {(r["lat_cell"], r["lon_cell"]): (r["n_points"], r["stuck_count"]) for r in grid}
    assert cells == {(1, -1): (2, 1), (None, 0): (2, 2)}
