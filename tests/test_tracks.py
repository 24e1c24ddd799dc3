import random

import pytest
from hypothesis import given as any_of
from hypothesis import settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayscore.operators import ranking, tracks


def by_id(df, *columns):
    return {r["event_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def brute_force(rows):
    """Previous position and number of each point, in plain Python."""
    def key(row):
        return (row[1] is not None, row[1] or "", row[2] is not None, row[2] or 0, row[0])

    out, last, number = {}, None, 0
    for row in sorted(rows, key=key):
        same = last is not None and last[1] == row[1]
        number = number + 1 if same else 1
        out[row[0]] = (last[3], last[4], number) if same else (None, None, number)
        last = row
    return out


def skewed(n=600, seed=1):
    """A third of the rows are one user's, with many equal times; some users are NULL."""
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        user = "hot" if i % 3 == 0 else None if i % 11 == 0 else f"u{pick.randrange(20)}"
        time = 1000 if user == "hot" and i % 2 else pick.randrange(500)
        time = None if i % 37 == 0 else time
        lat = None if i % 41 == 0 else round(pick.uniform(24, 25), 4)
        rows.append((i, user, time, lat, round(pick.uniform(120, 121), 4), "Taipei"))
    return rows


def test_first_point_is_stuck(points):
    df = points(
        [
            (1, "a", 10, 25.0, 121.0, "Taipei"),
            (2, "a", 20, 25.0, 121.0, "Taipei"),
            (3, "a", 30, 25.1, 121.0, "Taipei"),
            (4, "b", 10, 24.0, 120.0, "Hsinchu"),
        ]
    )
    steps = by_id(tracks.add_steps(df), "prev_lat", "step_distance_km", "is_stuck")
    assert steps[1] == (None, 0.0, 1)
    assert steps[2] == (25.0, 0.0, 1)
    assert steps[3][0] == 25.0 and steps[3][1] > 11 and steps[3][2] == 0
    assert steps[4] == (None, 0.0, 1)


@pytest.mark.parametrize("hot_rows", [10_000, 120, 25, 7])
def test_hot_tracks_give_the_same_rows(spark, points, hot_rows):
    rows = skewed()
    df = points(rows).repartition(5)
    assert (not tracks.hot_tracks(df, hot_rows=hot_rows).isEmpty()) == (hot_rows < 10_000)
    lagged = tracks.add_previous_point(df, hot_rows=hot_rows, run_rows=hot_rows)
    assert lagged.columns[-3:] == ["prev_lat", "prev_lon", "point_no"]
    assert by_id(lagged, "prev_lat", "prev_lon", "point_no") == brute_force(rows)


@settings(max_examples=8, deadline=None)
@any_of(
    st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 5)), min_size=1, max_size=60),
    st.integers(1, 30),
)
def test_any_split_gives_the_same_rows(points, users, hot_rows):
    rows = [(i, u, t, 20.0 + i, 100.0 + i, "T") for i, (u, t) in enumerate(users)]
    lagged = tracks.add_previous_point(points(rows), hot_rows=hot_rows, run_rows=hot_rows)
    assert by_id(lagged, "prev_lat", "prev_lon", "point_no") == brute_force(rows)


def test_null_users_can_be_hot(points):
    rows = [(i, None, i % 4, 25.0 + i / 100, 121.0, "Taipei") for i in range(60)]
    lagged = tracks.add_previous_point(points(rows), hot_rows=10, run_rows=10)
    assert by_id(lagged, "prev_lat", "prev_lon", "point_no") == brute_force(rows)


def test_short_runs_need_no_part_each(points):
    """The driver gets a sample of keys, a task result and a file per part."""
    rows = skewed(2000)
    lagged = tracks.add_previous_point(points(rows), hot_rows=7, run_rows=5)
    assert len([f for f in lagged.inputFiles() if "/track-runs-" in f]) <= 2
    assert by_id(lagged, "prev_lat", "prev_lon", "point_no") == brute_force(rows)


@pytest.mark.parametrize("run_rows, part_rows", [(1, 1), (5, 60), (7, 30), (60, 5)])
def test_runs_and_parts_of_any_size(points, run_rows, part_rows):
    rows = skewed()
    lagged = tracks.add_previous_point(
        points(rows).repartition(3), hot_rows=7, run_rows=run_rows, part_rows=part_rows
    )
    assert by_id(lagged, "prev_lat", "prev_lon", "point_no") == brute_force(rows)


def test_hot_track_is_spread(points):
    rows = [(i, "hot", 5, 25.0, 121.0, "Taipei") for i in range(1000)]
    cut = ranking.store_ordered(
        points(rows), "runs", "user_id", "timestamp", "event_id", parts=11
    )
    sizes = [r["count"] for r in cut.groupBy("part").count().collect()]
    assert sum(sizes) == 1000 and max(sizes) < 300
    marks = [r["event_id"] for r in cut.orderBy("row_mark").collect()]
    assert marks == list(range(1000))


def test_empty_and_single(points):
    assert tracks.add_steps(points([])).count() == 0
    one = tracks.add_steps(points([(1, "a", 1, 25.0, 121.0, "Taipei")])).collect()
    assert len(one) == 1 and one[0]["is_stuck"] == 1


def test_preview_is_the_head_of_the_track(points):
    df = points(skewed())
    for n in (1, 5, 15):
        found = tracks.track_preview(df, "hot", n).orderBy("timestamp").collect()
        whole = (
            tracks.user_track(df, "hot").orderBy("timestamp", "event_id").limit(n).collect()
        )
        assert [r["timestamp"] for r in found] == [r["timestamp"] for r in whole]
        assert sorted(r["distance_km"] for r in found) == pytest.approx(
            sorted(r["step_distance_km"] for r in whole)
        )


def test_markers(points):
    df = points(skewed())
    numbers = {k: v[2] for k, v in brute_force(skewed()).items()}
    found = {r["event_id"]: r["point_no"] for r in tracks.track_markers(df).collect()}
    assert found == {k: n for k, n in numbers.items() if n in (1, 16)}


@pytest.mark.parametrize("hot_rows", [10_000, 20])
def test_trajectory_segments_join_to_the_track(points, hot_rows):
    rows = skewed(300)
    segments = tracks.trajectories(
        points(rows), segment_points=8, hot_rows=hot_rows, run_rows=hot_rows
    ).collect()
    assert max(s["n_points"] for s in segments) <= 8
    order = brute_force(rows)
    for user in {r[1] for r in rows}:
        mine = sorted((s for s in segments if s["user_id"] == user), key=lambda s: s["segment"])
        path = [(p["latitude"], p["longitude"]) for s in mine for p in s["path"]]
        track = sorted((r for r in rows if r[1] == user), key=lambda r: order[r[0]][2])
        assert path == [(r[3], r[4]) for r in track]


def test_other_key_and_order(spark):
    df = spark.createDataFrame(
        [("x", 2, 1.0, 2.0), ("x", 1, 3.0, 4.0)], "car string, at int, latitude double, longitude double"
    )
    found = tracks.add_previous_point(df, key="car", order=["at"]).filter(F.col("at") == 2).first()
    assert (found["prev_lat"], found["prev_lon"], found["point_no"]) == (3.0, 4.0, 2)
