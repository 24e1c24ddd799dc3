"""The given tables, read as GPS points, providers, drivers and requests.

Every adapter is row-local: it needs no shuffle, whatever the data size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayscore import fixed, schemas


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(schemas.EVENTS).parquet(f"{sf_dir}/events.parquet")


def epoch_seconds(ts: str = "ts") -> Column:
    """Seconds since 1970 of a zone-less timestamp, whatever the session zone."""
    day = F.unix_date(F.col(ts).cast("date")).cast("long")
    return day * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def gps_points(events: DataFrame) -> DataFrame:
    """Events as GPS points of two cities.

    A vehicle moves to a new place every six hours and stands still between,
    so two events of a user in the same six hours are a stall. One event in 40
    has the receiver's (0, 0) fix.
    """
    with_time = events.select("event_id", "user_id", epoch_seconds().alias("timestamp"))
    slot = F.floor(F.col("timestamp") / 21600)
    north = F.col("user_id") % 2 == 0
    lost = F.col("event_id") % 40 == 25

    def place(city_even: float, city_odd: float, by_slot: int, by_user: int) -> Column:
        base = F.when(north, city_even).otherwise(city_odd)
        offset = ((slot * by_slot + F.col("user_id") * by_user) % 201 - 100) * 0.0001
        return F.when(lost, 0.0).otherwise(F.round(base + offset, 6))

    return with_time.select(
        "event_id",
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("user_id"),
        "timestamp",
        place(25.033, 24.8138, 37, 11).alias("latitude"),
        place(121.5654, 120.9675, 53, 7).alias("longitude"),
        F.when(north, "Taipei").otherwise("Hsinchu").alias("city"),
    )


def damaged_points(points: DataFrame) -> DataFrame:
    """Points with NULL and NaN latitudes among them."""
    latitude = (
        F.when(F.col("event_id") % 97 == 0, F.lit(float("nan")))
        .when(F.col("event_id") % 89 == 0, F.lit(None).cast("double"))
        .otherwise(F.col("latitude"))
    )
    return points.withColumn("latitude", latitude)


def provider_a(events: DataFrame) -> DataFrame:
    """All points under three cities; a lost fix has no position."""
    points = gps_points(events)
    fixed_position = F.col("event_id") % 40 != 25
    number = F.substring("user_id", 6, 20).cast("long") % 3
    city = F.when(number == 0, "Taipei").when(number == 1, "Hsinchu").otherwise("Kaohsiung")
    return points.select(
        "event_id",
        city.alias("city"),
        F.when(fixed_position, F.col("latitude")).alias("latitude"),
        F.when(fixed_position, F.col("longitude")).alias("longitude"),
    )


def provider_b(events: DataFrame) -> DataFrame:
    """The same records, displaced north by a step that depends on the city."""
    step = (
        F.when(F.col("city") == "Taipei", 0.000001)
        .when(F.col("city") == "Hsinchu", 0.00001)
        .otherwise(0.000006)
    )
    moved = F.round(F.col("latitude") + (F.col("event_id") % 100) * step, 7)
    return provider_a(events).select("event_id", moved.alias("latitude"), "longitude")


def drivers(customer: DataFrame) -> DataFrame:
    """Customers as drivers, labelled by fixed speed limits."""
    key = F.col("c_custkey")
    speed = 10.0 + (key * 53 % 700) / 10.0
    label = (
        F.when(speed < 30, fixed.LABEL_RISK)
        .when(speed > 60, fixed.LABEL_GOOD)
        .otherwise(fixed.LABEL_NORMAL)
    )
    return customer.select(
        F.concat(F.lit("D_"), key.cast("string")).alias("driver_id"),
        (5.0 + (key * 37 % 4500) / 100.0).alias("total_km"),
        speed.alias("average_speed"),
        (key * 7 % 10).cast("int").alias("stuck_count"),
        label.alias("label"),
    )


def driver_requests(events: DataFrame) -> DataFrame:
    """Events as scoring requests; an ``error`` event reports no speed."""
    speed = F.when(F.col("event_type") != "error", 10.0 + F.col("event_id") * 53 % 70)
    return events.select(
        F.col("event_id").alias("request_id"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("driver_id"),
        speed.cast("double").alias("speed"),
        (F.col("event_id") * 7 % 26).cast("int").alias("stuck_count"),
        epoch_seconds().alias("requested_at"),
    )


def questions(events: DataFrame) -> DataFrame:
    """A question per user about the cities of the provider comparison; some name two, some none."""
    number = F.col("question_id")
    text = (
        F.when(number % 4 == 0, F.concat(F.lit("Can we switch in taipei for user_"), number.cast("string"), F.lit("?")))
        .when(number % 4 == 1, F.lit("Hsinchu or KAOHSIUNG: which one first?"))
        .when(number % 4 == 2, F.concat(F.lit("我們在Taipei該換誰家 "), number.cast("string")))
        .otherwise(F.lit("Is it safe to switch?"))
    )
    return events.select(F.col("user_id").alias("question_id")).distinct().withColumn("question", text)
