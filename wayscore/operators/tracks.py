"""Track operators: previous point, step distance, stalls, order in a track.

A track is all points of one ``user_id`` in time order. Most tracks fit one
task, so they are windowed after a single hash exchange on the key. A track
may also hold a large part of the whole table; such hot tracks are found by a
count first and are cut into sorted runs of even size, whose edges are stitched
through a small table. Both ways give the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayscore.functions.geo import at_origin, distance_km, located
from wayscore.operators.ranking import row_in_part, store_ordered
from wayscore.session import store

# Tracks above this many rows are cut into runs of this many rows.
HOT_TRACK_ROWS = 10_000_000
RUN_ROWS = 10_000_000
# Shorter runs share tasks of about this many rows.
PART_ROWS = 250_000


def track_order(points: DataFrame) -> list[str]:
    """Time first, then whatever makes the order total."""
    ties = ["event_id"] if "event_id" in points.columns else ["latitude", "longitude"]
    return ["timestamp", *ties]


def hot_tracks(
    points: DataFrame, key: str = "user_id", hot_rows: int = HOT_TRACK_ROWS
) -> DataFrame:
    """``(hot_key, track_rows)`` of all tracks too big for one task, stored.

    Reads the key column only and counts before it shuffles. Being stored, the
    table's size is known to the optimizer, which picks the join.
    """
    counted = points.groupBy(F.col(key).alias("hot_key")).agg(
        F.count(F.lit(1)).alias("track_rows")
    )
    return store(counted.filter(F.col("track_rows") > hot_rows), "hot-tracks")


def _is_hot(points: DataFrame, hot: DataFrame, key: str) -> Column:
    return points[key].eqNullSafe(hot["hot_key"])


def _within_tracks(points: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    at = Window.partitionBy(key).orderBy(*order)
    return points.withColumns(
        {
            "prev_lat": F.lag("latitude").over(at),
            "prev_lon": F.lag("longitude").over(at),
            "point_no": F.row_number().over(at).cast("long"),
        }
    )


def _within_runs(
    points: DataFrame, key: str, order: Sequence[str], run_rows: int, parts: int
) -> DataFrame:
    """Previous point and number of points whose tracks span several tasks.

    Range partitioning on (key, order) cuts a track at any point, also among
    equal times. Every ``run_rows`` rows of a part of that order are a run, named
    by the mark of its first row; a track goes on in the next run where the last
    one ended. The driver gets a sample of keys, a task result and a file per
    part, so the number of parts does not follow from that of short runs.
    """
    ordered = store_ordered(points, "track-runs", key, *order, parts=parts)
    ordered = ordered.withColumn("run_mark", F.col("row_mark") - row_in_part() % run_rows)
    # The first row of a track in a run takes what the track carried there, so the
    # window need not tell the tracks of a run apart.
    at = Window.partitionBy("run_mark").orderBy("row_mark")
    # As many partitions as parts, so that long runs do not pile up in a task.
    inside = ordered.repartition(parts, "run_mark").withColumns(
        {"run_lat": F.lag("latitude").over(at), "run_lon": F.lag("longitude").over(at)}
    )
    # One row per run and track in it, stored so that its size is known to the join.
    ends = ordered.groupBy("run_mark", key).agg(
        F.count(F.lit(1)).alias("run_rows"),
        F.min("row_mark").alias("first_mark"),
        F.max_by("latitude", "row_mark").alias("last_lat"),
        F.max_by("longitude", "row_mark").alias("last_lon"),
    )
    along = Window.partitionBy(key).orderBy("run_mark")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        F.col("run_mark").alias("carry_run"),
        F.col(key).alias("carry_key"),
        "first_mark",
        F.lag("last_lat").over(along).alias("carried_lat"),
        F.lag("last_lon").over(along).alias("carried_lon"),
        F.coalesce(F.sum("run_rows").over(earlier), F.lit(0)).alias("rows_before"),
    )
    carry = store(carried, "run-ends")
    stitched = inside.join(
        carry,
        (inside["run_mark"] == carry["carry_run"]) & inside[key].eqNullSafe(carry["carry_key"]),
    )
    first = F.col("row_mark") == F.col("first_mark")
    return stitched.select(
        *points.columns,
        F.when(first, F.col("carried_lat")).otherwise(F.col("run_lat")).alias("prev_lat"),
        F.when(first, F.col("carried_lon")).otherwise(F.col("run_lon")).alias("prev_lon"),
        (F.col("rows_before") + F.col("row_mark") - F.col("first_mark") + 1).alias("point_no"),
    )


def add_previous_point(
    points: DataFrame,
    key: str = "user_id",
    order: Sequence[str] | None = None,
    hot_rows: int = HOT_TRACK_ROWS,
    run_rows: int = RUN_ROWS,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Add ``prev_lat``, ``prev_lon`` and the 1-based ``point_no`` of each point.

    Hot tracks are cut into runs of at most ``run_rows`` rows; a task takes one
    run, or as many short ones as make about ``part_rows`` rows.
    """
    order = list(order or track_order(points))
    hot = hot_tracks(points, key, hot_rows)
    total = hot.agg(F.sum("track_rows")).first()[0]
    if not total:
        return _within_tracks(points, key, order)
    same = _is_hot(points, hot, key)
    parts = math.ceil(total / max(run_rows, part_rows)) + 1
    calm = _within_tracks(points.join(hot, same, "left_anti"), key, order)
    busy = _within_runs(points.join(hot, same, "left_semi"), key, order, run_rows, parts)
    return calm.unionByName(busy)


def add_steps(
    points: DataFrame,
    key: str = "user_id",
    order: Sequence[str] | None = None,
    hot_rows: int = HOT_TRACK_ROWS,
    run_rows: int = RUN_ROWS,
) -> DataFrame:
    """Add the distance from the previous point and the stuck flag.

    The first point of a track has no previous one: distance 0.0, stuck.
    """
    km = distance_km("prev_lat", "prev_lon", "latitude", "longitude")
    return (
        add_previous_point(points, key, order, hot_rows, run_rows)
        .withColumn("step_distance_km", km)
        .withColumn("is_stuck", F.when(F.col("step_distance_km") == 0.0, 1).otherwise(0))
    )


def user_track(points: DataFrame, user_id: str, hot_rows: int = HOT_TRACK_ROWS) -> DataFrame:
    """Steps of one user; the filter reaches the scan."""
    return add_steps(points.filter(F.col("user_id") == user_id), hot_rows=hot_rows)


def city_points(points: DataFrame, city: str) -> DataFrame:
    return points.filter(F.col("city") == city)


def track_preview(points: DataFrame, user_id: str, n: int) -> DataFrame:
    """The first ``n`` points of a user with their step distances.

    The steps of the first n points need only those points, so the limit is
    taken before the window.
    """
    first = (
        points.filter(F.col("user_id") == user_id).orderBy(*track_order(points)).limit(n)
    )
    at = Window.partitionBy("user_id").orderBy(*track_order(points))
    km = distance_km(
        F.lag("latitude").over(at), F.lag("longitude").over(at), "latitude", "longitude"
    )
    return first.select("user_id", "timestamp", "latitude", km.alias("distance_km"))


def track_markers(points: DataFrame, numbers: Sequence[int] = (1, 16)) -> DataFrame:
    """The n-th points of every track, such as its start.

    The upper bound on the row number is applied per map task before the
    exchange, so a hot track sends no more than that many rows per task.
    """
    at = Window.partitionBy("user_id").orderBy(*track_order(points))
    return (
        points.withColumn("point_no", F.row_number().over(at))
        .filter(F.col("point_no") <= max(numbers))
        .filter(F.col("point_no").isin(*numbers))
    )


def trajectories(
    points: DataFrame,
    segment_points: int = 1000,
    hot_rows: int = HOT_TRACK_ROWS,
    run_rows: int = RUN_ROWS,
) -> DataFrame:
    """Ordered coordinate lists per user, in numbered segments.

    A segment holds at most ``segment_points`` points, so that no list and no
    group grows with the track; segments in order make up the whole track.
    """
    numbered = add_previous_point(points, hot_rows=hot_rows, run_rows=run_rows)
    fix = F.struct("point_no", "latitude", "longitude")
    return (
        numbered.withColumn("segment", F.floor((F.col("point_no") - 1) / segment_points))
        .groupBy("user_id", "segment")
        .agg(F.count(F.lit(1)).alias("n_points"), F.array_sort(F.collect_list(fix)).alias("fixes"))
        .select(
            "user_id",
            "segment",
            "n_points",
            F.transform(
                "fixes",
                lambda p: F.struct(
                    p["latitude"].alias("latitude"), p["longitude"].alias("longitude")
                ),
            ).alias("path"),
        )
    )


def last_positions(points: DataFrame, key: str = "user_id") -> DataFrame:
    """The last known position of each track; points without one, and (0, 0), are not positions.

    One row per track and task is shuffled, also of a track that holds most rows.
    """
    placed = points.where(located("latitude", "longitude") & ~at_origin())
    last = F.max_by(F.struct("timestamp", "latitude", "longitude"), F.struct(*track_order(points)))
    return placed.groupBy(key).agg(last.alias("last")).select(key, "last.*")
