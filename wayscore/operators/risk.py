"""Risk reports over labelled drivers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayscore import fixed
from wayscore.functions.decisions import (
    advice,
    congestion_text,
    has_word,
    lookup,
    matches,
    risk_level,
    speed_text,
    stops_text,
)
from wayscore.operators.clusters import value_counts
from wayscore.operators.decision import slowest_drivers
from wayscore.operators.ranking import top_n
from wayscore.operators.scoring import score_by_rule


def _slowest_first():
    return F.asc_nulls_last("average_speed"), F.asc("driver_id")


def risky_drivers(
    drivers: DataFrame, pattern: str = fixed.RISK_PATTERN, n: int | None = 5, otherwise: int = 3
) -> DataFrame:
    """Up to ``n`` drivers (all for None) whose label matches, or else the slowest few.

    Whether any label matches is decided inside the plan.
    """
    at_risk = drivers.filter(matches(F.col("label"), pattern))
    fallback = slowest_drivers(drivers, otherwise).filter(~at_risk.limit(1).exists())
    return top_n(at_risk, n, *_slowest_first()).unionByName(fallback)


def status_texts(drivers: DataFrame) -> DataFrame:
    return drivers.select(
        "driver_id",
        stops_text().alias("stops_text"),
        congestion_text().alias("congestion_text"),
        speed_text().alias("speed"),
    )


def risk_scores(scored: DataFrame) -> DataFrame:
    """Risk level and confidence per scored driver."""
    return scored.select(
        "driver_id",
        risk_level(F.col("sentiment")).alias("risk_level"),
        F.round(F.coalesce("score", F.lit(0.0)), 4).alias("ai_confidence"),
    )


def risk_advice(scored: DataFrame) -> DataFrame:
    return scored.select(
        "driver_id",
        F.col("sentiment").alias("ai_sentiment"),
        risk_level(F.col("sentiment")).alias("risk_level"),
        advice(F.col("sentiment")).alias("management_advice"),
    )


def risk_insights(drivers: DataFrame, scorer=None) -> DataFrame:
    """Advice for the risky drivers, or for the slowest if none is risky."""
    score = scorer or (lambda df: score_by_rule(df, "average_speed"))
    return score(risky_drivers(drivers)).select(
        "driver_id",
        "label",
        speed_text().alias("speed"),
        F.col("sentiment").alias("ai_sentiment"),
        advice(F.col("sentiment")).alias("management_advice"),
    )


def alert_actions(
    drivers: DataFrame, word: str = fixed.RED_ALERT_WORD, n: int | None = 5, scorer=None
) -> DataFrame:
    """Actions for the first drivers whose label holds ``word``."""
    score = scorer or (lambda df: score_by_rule(df, "average_speed"))
    chosen = top_n(drivers.filter(has_word(F.col("label"), word)), n, *_slowest_first())
    action = advice(F.col("sentiment"), fixed.INTERVIEW_ACTION, fixed.OBSERVE_ACTION)
    return score(chosen).select(
        "driver_id",
        F.col("label").alias("status"),
        F.col("sentiment").alias("ai_sentiment"),
        action.alias("management_action"),
    )


def fleet_kpis(drivers: DataFrame, word: str = fixed.RISK_WORD) -> DataFrame:
    """Drivers, drivers at risk and mean speed in one pass."""
    return drivers.agg(
        F.count(F.lit(1)).alias("total_drivers"),
        F.count_if(has_word(F.col("label"), word)).alias("high_risk_drivers"),
        F.avg("average_speed").alias("average_speed"),
    )


def label_distribution(drivers: DataFrame) -> DataFrame:
    return value_counts(drivers, "label")


def add_colour(drivers: DataFrame) -> DataFrame:
    colour = lookup(F.col("label"), fixed.LABEL_COLOURS, fixed.UNKNOWN_COLOUR)
    return drivers.withColumn("colour", colour)


def map_drivers(drivers: DataFrame, n: int | None = None) -> DataFrame:
    """All drivers, or the first ``n``, with the colour of their label."""
    return add_colour(top_n(drivers, n, *_slowest_first()))


def speed_scatter(labelled_drivers: DataFrame) -> DataFrame:
    return labelled_drivers.select("average_speed", "stuck_count", "label")


def map_markers(drivers: DataFrame, positions: DataFrame, insights: DataFrame) -> DataFrame:
    """What a map shows of each driver: place, colour, and the lines of the note at the marker.

    ``positions`` is (driver_id, latitude, longitude); a driver without one has no marker place.
    Drivers without advice in ``insights`` wait for it.
    """
    advised = insights.select("driver_id", "management_advice")
    place = positions.select("driver_id", "latitude", "longitude")
    joined = add_colour(drivers).join(place, "driver_id", "left").join(advised, "driver_id", "left")
    return joined.select(
        "driver_id",
        "latitude",
        "longitude",
        "label",
        "colour",
        F.when(F.col("average_speed").isNotNull(), F.format_string(fixed.MARKER_SPEED, "average_speed")).alias("speed"),
        F.format_string(fixed.MARKER_STOPS, F.coalesce("stuck_count", F.lit(0)).cast("long")).alias("stops"),
        F.coalesce("management_advice", F.lit(fixed.ADVICE_PENDING)).alias("advice"),
    )
