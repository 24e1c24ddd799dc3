"""Scores, verdicts, advice and texts as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayscore import fixed


def mobility_score(
    total_km: Column,
    stuck_count: Column,
    km_weight: float = fixed.KM_WEIGHT,
    stuck_weight: float = fixed.STUCK_WEIGHT,
) -> Column:
    return total_km * km_weight - stuck_count * stuck_weight


def verdict(
    avg_error_meters: Column,
    risk_rate: Column,
    safe_error: float = fixed.SAFE_ERROR_METERS,
    safe_rate: float = fixed.SAFE_RISK_RATE,
    risky_error: float = fixed.RISKY_ERROR_METERS,
    risky_rate: float = fixed.RISKY_RISK_RATE,
) -> Column:
    """RISKY, SAFE, or MONITOR for everything between the two."""
    risky = (avg_error_meters > risky_error) | (risk_rate > risky_rate)
    safe = (avg_error_meters < safe_error) & (risk_rate < safe_rate)
    return F.when(risky, "RISKY").when(safe, "SAFE").otherwise("MONITOR")


def go_decision(verdict_column: Column) -> Column:
    return (
        F.when(verdict_column == "SAFE", "Go")
        .when(verdict_column == "RISKY", "No-Go")
        .otherwise("Review")
    )


def risk_level(sentiment: Column) -> Column:
    """No sentiment means that no model could be loaded."""
    return (
        F.when(sentiment.isNull(), fixed.UNKNOWN_RISK)
        .when(sentiment == fixed.NEGATIVE, fixed.HIGH_RISK)
        .otherwise(fixed.SAFE_DRIVER)
    )


def advice(
    sentiment: Column,
    if_negative: str = fixed.INTERVIEW_ADVICE,
    otherwise: str = fixed.OBSERVE_ADVICE,
) -> Column:
    """No sentiment, no advice: NULL."""
    return F.when(sentiment == fixed.NEGATIVE, if_negative).when(
        sentiment.isNotNull(), otherwise
    )


def lookup(column: Column, mapping: dict[str, str], default: str) -> Column:
    """``mapping[column]``, or ``default`` for anything not in it."""
    pairs = [F.lit(part) for pair in mapping.items() for part in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), column), F.lit(default))


def matches(column: Column, pattern: str) -> Column:
    """Regular expression test; NULL is no match."""
    return F.coalesce(column.rlike(pattern), F.lit(False))


def has_word(column: Column, word: str) -> Column:
    """Case-sensitive substring test; NULL is no match."""
    return F.coalesce(column.contains(word), F.lit(False))


def _text(template: str, driver: str, speed: str, stuck: str) -> Column:
    known = F.col(speed).isNotNull() & F.col(stuck).isNotNull()
    return F.when(known, F.format_string(template, driver, speed, stuck))


def stops_text(driver="driver_id", speed="average_speed", stuck="stuck_count") -> Column:
    """NULL if the speed or the stops are missing."""
    return _text(fixed.STOPS_TEXT, driver, speed, stuck)


def congestion_text(driver="driver_id", speed="average_speed", stuck="stuck_count") -> Column:
    """NULL if the speed or the stops are missing."""
    return _text(fixed.CONGESTION_TEXT, driver, speed, stuck)


def request_text(driver="driver_id", speed="speed", stuck="stuck_count") -> Column:
    """NULL if the speed or the stops are missing."""
    start, at, stuck_at, end = fixed.REQUEST_TEXT.split("%s")
    return F.concat(
        F.lit(start),
        F.coalesce(F.col(driver), F.lit("None")),
        F.lit(at),
        F.col(speed).cast("string"),
        F.lit(stuck_at),
        F.col(stuck).cast("string"),
        F.lit(end),
    )


def speed_text(speed="average_speed") -> Column:
    """NULL if the speed is missing."""
    return F.when(F.col(speed).isNotNull(), F.format_string(fixed.SPEED_TEXT, speed))
