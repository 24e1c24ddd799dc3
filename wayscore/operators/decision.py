"""The decision matrix and the driver features derived from steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayscore import fixed
from wayscore.functions.decisions import mobility_score
from wayscore.operators.ranking import add_rank, top_n


def decision_matrix(
    steps: DataFrame,
    km_weight: float = fixed.KM_WEIGHT,
    stuck_weight: float = fixed.STUCK_WEIGHT,
) -> DataFrame:
    """Per (city, user): distance, records, stalls and score.

    The exchange on ``user_id`` that made the steps also serves this grouping.
    The score uses the unrounded distance; rounding comes last.
    """
    grouped = steps.groupBy("city", "user_id").agg(
        F.sum("step_distance_km").alias("km"),
        F.count("timestamp").alias("total_records"),
        F.sum("is_stuck").alias("stuck_count"),
    )
    score = mobility_score(F.col("km"), F.col("stuck_count"), km_weight, stuck_weight)
    return grouped.select(
        "city",
        "user_id",
        F.round("km", 4).alias("total_km"),
        "total_records",
        "stuck_count",
        F.round(score, 2).alias("final_score"),
    )


def _best_first():
    return F.desc("final_score"), F.asc("user_id"), F.asc("city")


def ranked(matrix: DataFrame) -> DataFrame:
    """The whole matrix, best score first, with its rank."""
    return add_rank(matrix, *_best_first())


def top_drivers(matrix: DataFrame, n: int = 5) -> DataFrame:
    return top_n(matrix, n, *_best_first())


def driver_features(steps: DataFrame) -> DataFrame:
    """Distance, mean speed and stalls per driver, the input of clustering.

    Mean speed is distance over the hours between the first and last point;
    0.0 when no time passed.
    """
    grouped = steps.groupBy("user_id").agg(
        F.sum("step_distance_km").alias("total_km"),
        F.sum("is_stuck").alias("stuck_count"),
        ((F.max("timestamp") - F.min("timestamp")) / 3600.0).alias("hours"),
    )
    speed = F.when(F.col("hours") > 0, F.col("total_km") / F.col("hours")).otherwise(0.0)
    return grouped.select(
        F.col("user_id").alias("driver_id"),
        "total_km",
        speed.alias("average_speed"),
        "stuck_count",
    )


def slowest_drivers(drivers: DataFrame, n: int = 3) -> DataFrame:
    return top_n(drivers, n, F.asc_nulls_last("average_speed"), F.asc("driver_id"))
