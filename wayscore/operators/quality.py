"""Data-quality operators: anomalies, drift, NaN counts, samples, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayscore import fixed
from wayscore.functions.geo import at_origin, distance_km, located
from wayscore.operators.tracks import add_previous_point, track_order
from wayscore.session import store


def flag_anomalies(points: DataFrame) -> DataFrame:
    return points.withColumn("is_anomaly", at_origin())


def normal_points(points: DataFrame) -> DataFrame:
    return points.filter(~at_origin())


def anomaly_points(points: DataFrame) -> DataFrame:
    return points.filter(at_origin())


def geo_counts(points: DataFrame) -> DataFrame:
    """Normal and anomalous points per city in one pass."""
    return points.groupBy("city").agg(
        F.count_if(~at_origin()).alias("normal_points"),
        F.count_if(at_origin()).alias("anomaly_points"),
    )


def nan_report(steps: DataFrame) -> DataFrame:
    """NULL and NaN coordinates that came in, and NaN distances that came out."""
    return steps.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("latitude").isNull() | F.col("longitude").isNull()).alias("null_inputs"),
        F.count_if(F.isnan("latitude") | F.isnan("longitude")).alias("nan_inputs"),
        F.count_if(F.isnan("step_distance_km")).alias("nan_distances"),
        F.count_if(F.col("is_stuck") == 1).alias("stuck_rows"),
    )


def drift(
    points: DataFrame,
    homes: DataFrame | Sequence[tuple[str, float, float]] = fixed.HOME_COORDINATES,
    limit_km: float = 100.0,
) -> DataFrame:
    """Distance of every point from its city's home coordinate.

    Also catches points that wander around (0, 0) after a jump, which the exact
    test misses. A city without a home, and a point without a position, gets NULL. ``homes`` is a short list, which
    becomes a literal in the plan, or a table ``city, home_lat, home_lon``, which
    is joined in the way its size asks for.
    """
    if isinstance(homes, DataFrame):
        placed = points.join(homes, "city", "left")
        lat, lon = F.col("home_lat"), F.col("home_lon")
    else:
        pairs = [F.lit(p) for c, *home in homes for p in (c, home)]
        placed = points.withColumn("_home", F.try_element_at(F.create_map(*pairs), "city"))
        lat, lon = F.col("_home")[0], F.col("_home")[1]
    known = located(lat, lon, "latitude", "longitude")
    km = F.when(known, distance_km(lat, lon, "latitude", "longitude"))
    return placed.select(
        *points.columns, km.alias("home_km"), (km > limit_km).alias("is_drift")
    )


# A sampled city's early rows are spread over tasks of this many rows.
SAMPLE_TASK_ROWS = 5_000_000


def _whole_sample(points: DataFrame, every: int) -> DataFrame:
    """Every n-th normal point of a city, however many; big cities are split into runs."""
    numbered = add_previous_point(normal_points(points), key="city")
    return numbered.filter((F.col("point_no") - 1) % every == 0).select(
        *points.columns, ((F.col("point_no") - 1) / every + 1).cast("long").alias("sample_no")
    )


def systematic_sample(
    points: DataFrame,
    every: int = 10,
    per_city: int | None = 500,
    bin_seconds: int = 3600,
    task_rows: int = SAMPLE_TASK_ROWS,
) -> DataFrame:
    """Every n-th normal point of a city in time order, the first ``per_city`` or all.

    Only the first ``every * (per_city - 1) + 1`` points of a city can be in
    the sample. Counts per city and time bin, added up on the map side, tell up
    to which bin they reach; later rows are dropped by a filter. The remaining
    rows are cut to the needed number per (city, salt) and then per city, with
    as many salts as a city with very many early rows asks for. Every step
    keeps a superset of the needed points, so the sample is exact.
    """
    if per_city is None:
        return _whole_sample(points, every)
    order = track_order(points)
    needed = every * (per_city - 1) + 1
    # Rows without a time come first, as they do in the order.
    no_time = -(1 << 62)
    time_bin = F.coalesce(F.floor(F.col("timestamp") / bin_seconds), F.lit(no_time))
    binned = normal_points(points).withColumn("bin", time_bin)
    counted = binned.groupBy("city", "bin").agg(F.count(F.lit(1)).alias("rows"))
    by_time = Window.partitionBy("city").orderBy("bin")
    so_far = by_time.rowsBetween(Window.unboundedPreceding, 0)
    # No bin is empty, so the first ``needed`` bins of a city are enough.
    first_bins = counted.withColumn("bin_no", F.row_number().over(by_time)).filter(
        F.col("bin_no") <= needed
    )
    reach = store(
        first_bins.withColumn("seen", F.sum("rows").over(so_far))
        .filter(F.col("seen") - F.col("rows") < needed)
        .groupBy(F.col("city").alias("reach_city"))
        .agg(F.max("bin").alias("last_bin"), F.max("seen").alias("early_rows")),
        "sample-reach",
    )
    limits = reach.agg(F.max("early_rows").alias("rows"), F.max("last_bin").alias("bin")).first()
    salts = (limits["rows"] or 0) // task_rows + 1
    # A bound on the time itself lets the scan skip row groups.
    in_time = F.col("timestamp").isNull()
    if limits["bin"] is not None and limits["bin"] > no_time:
        in_time |= F.col("timestamp") < (limits["bin"] + 1) * bin_seconds
    early = binned.filter(in_time).join(
        reach, binned["city"].eqNullSafe(reach["reach_city"]) & (F.col("bin") <= F.col("last_bin"))
    )

    def first_points(df: DataFrame, *keys: str) -> DataFrame:
        at = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn("n", F.row_number().over(at)).filter(F.col("n") <= needed)

    if salts > 1:
        salted = early.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
        early = first_points(salted, "city", "salt")
    return (
        first_points(early, "city")
        .filter((F.col("n") - 1) % every == 0)
        .select(*points.columns, ((F.col("n") - 1) / every + 1).cast("long").alias("sample_no"))
    )


def grid_density(steps: DataFrame, cell_degrees: float = 0.005) -> DataFrame:
    """Points, stalls and mean step per grid cell; counted before the shuffle.

    Points without a coordinate are counted under a NULL cell.
    """

    def cell(degrees: str):
        return F.floor(F.when(~F.isnan(degrees), F.col(degrees)) / cell_degrees)

    return (
        steps.withColumn("lat_cell", cell("latitude"))
        .withColumn("lon_cell", cell("longitude"))
        .groupBy("lat_cell", "lon_cell")
        .agg(
            F.count(F.lit(1)).alias("n_points"),
            F.sum("is_stuck").alias("stuck_count"),
            F.avg("step_distance_km").alias("mean_step_km"),
        )
    )


def add_zones(points: DataFrame, margin: float = 0.15) -> DataFrame:
    """``core`` or ``edge`` of the city's bounding box, ``anomaly`` or ``unlocated``.

    The boxes are one row per city. They are stored before the join, so the
    optimizer knows their size: it broadcasts a small table and otherwise
    shuffles, with skewed cities split at run time.
    """
    located = F.coalesce(~(F.isnan("latitude") | F.isnan("longitude")), F.lit(False))
    located &= F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    boxes = store(
        normal_points(points)
        .filter(located)
        .groupBy("city")
        .agg(
            F.min("latitude").alias("south"),
            F.max("latitude").alias("north"),
            F.min("longitude").alias("west"),
            F.max("longitude").alias("east"),
        )
        .withColumnRenamed("city", "box_city"),
        "city-boxes",
    )

    # A box without extent has no edge.
    def inside(value: str, low: str, high: str):
        width = F.col(high) - F.col(low)
        share = F.when(width > 0, (F.col(value) - F.col(low)) / width).otherwise(0.5)
        return share.between(margin, 1 - margin)

    core = inside("latitude", "south", "north") & inside("longitude", "west", "east")
    zone = (
        F.when(~located, "unlocated")
        .when(at_origin(), "anomaly")
        .when(core, "core")
        .otherwise("edge")
    )
    return (
        points.join(boxes, points["city"].eqNullSafe(boxes["box_city"]), "left")
        .withColumn("zone", zone)
        .select(*points.columns, "zone")
    )


def coverage(
    points: DataFrame, record_id: str = "event_id", every: int = 10, margin: float = 0.15
) -> DataFrame:
    """What a 1-in-``every`` sample sees of each zone, against all data."""
    sampled = F.pmod(F.col(record_id), F.lit(every)) == 0
    return (
        add_zones(points, margin)
        .groupBy("zone")
        .agg(
            F.count(F.lit(1)).alias("full_points"),
            F.count_if(sampled).alias("sampled_points"),
        )
        .withColumn("recall", F.col("sampled_points") / F.col("full_points"))
    )


def survivorship(steps: DataFrame, most_points: int, key: str = "user_id") -> DataFrame:
    """What a service that drops tracks of more than ``most_points`` points shows per city, against all data.

    The dropped tracks leave no trace in its figures: ``seen_`` columns are over the others only. The
    share of requests that seem to succeed is ``visible_rate``; a figure without any track is NULL.
    """
    tracks = steps.groupBy("city", key).agg(
        F.count("*").alias("points"),
        F.sum("is_stuck").alias("stalls"),
        F.sum("step_distance_km").alias("km"),
        F.count_if(at_origin()).alias("lost"),
    )
    seen = F.col("points") <= most_points

    def share(part: str, whole: str, only: Column | None = None) -> Column:
        total = lambda c: F.sum(c if only is None else F.when(only, F.col(c)))
        return F.try_divide(total(part), total(whole))

    return tracks.groupBy("city").agg(
        F.count("*").alias("tracks"),
        F.count_if(seen).alias("seen_tracks"),
        (F.count_if(seen) / F.count("*")).alias("visible_rate"),
        F.sum("points").alias("points"),
        F.coalesce(F.sum(F.when(seen, F.col("points"))), F.lit(0)).alias("seen_points"),
        share("stalls", "points").alias("stall_share"),
        share("stalls", "points", seen).alias("seen_stall_share"),
        share("km", "points").alias("mean_step_km"),
        share("km", "points", seen).alias("seen_mean_step_km"),
        share("lost", "points").alias("lost_share"),
        share("lost", "points", seen).alias("seen_lost_share"),
    )
