"""Explicit schemas; nothing here is inferred from data."""

from pyspark.sql import types as T

GPS_POINTS = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("city", T.StringType()),
    ]
)

# The same points with the record id that the given tables carry.
GPS_RECORDS = T.StructType([T.StructField("event_id", T.LongType()), *GPS_POINTS.fields])

DECISION_MATRIX = T.StructType(
    [
        T.StructField("city", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("total_km", T.DoubleType()),
        T.StructField("total_records", T.LongType()),
        T.StructField("stuck_count", T.LongType()),
        T.StructField("final_score", T.DoubleType()),
    ]
)

CLUSTERED_DRIVERS = T.StructType(
    [
        T.StructField("driver_id", T.StringType()),
        T.StructField("total_km", T.DoubleType()),
        T.StructField("average_speed", T.DoubleType()),
        T.StructField("stuck_count", T.LongType()),
        T.StructField("cluster", T.IntegerType()),
        T.StructField("label", T.StringType()),
    ]
)

CITY_RISK = T.StructType(
    [
        T.StructField("city", T.StringType()),
        T.StructField("avg_error_meters", T.DoubleType()),
        T.StructField("risk_rate", T.DoubleType()),
        T.StructField("verdict", T.StringType()),
    ]
)

DRIVER_REQUESTS = T.StructType(
    [
        T.StructField("request_id", T.LongType()),
        T.StructField("driver_id", T.StringType()),
        T.StructField("speed", T.DoubleType()),
        T.StructField("stuck_count", T.IntegerType()),
    ]
)

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
