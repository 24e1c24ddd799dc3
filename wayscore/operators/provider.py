"""Comparison of two location providers, with a decision per city."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayscore.functions.decisions import go_decision, verdict
from wayscore.functions.geo import distance_km, located
from wayscore.session import store

PROMPT = (
    "Two map providers were compared on the same delivery records.\n"
    "Low risk: average error under 20 m and risk rate under 5 %%. "
    "High risk: average error over 50 m or risk rate over 20 %%. "
    "Anything between needs a manual review.\n"
    "Summary per city: %s\n"
    "Question: %s\n"
    "Give a Go or No-Go recommendation based on the summary."
)


def provider_error(a: DataFrame, b: DataFrame, record_id: str = "event_id") -> DataFrame:
    """Distance in metres between both providers' positions of a record of ``a``.

    NULL if either position is missing, NaN, or absent from ``b``: no distance is
    known then, which is not a distance of zero.
    """
    other = b.select(
        record_id, F.col("latitude").alias("b_lat"), F.col("longitude").alias("b_lon")
    )
    known = located("latitude", "longitude", "b_lat", "b_lon")
    meters = F.when(known, distance_km("latitude", "longitude", "b_lat", "b_lon") * 1000)
    return a.join(other, record_id, "left").select(record_id, "city", meters.alias("error_meters"))


def city_risk_summary(errors: DataFrame, record_limit_meters: float = 50.0) -> DataFrame:
    """Mean error, share of records above the limit, and verdict per city.

    Both are over the records with a known error; ``failed_records`` counts the rest.
    A city without any known error gets NULL figures and needs a review.
    """
    above = F.when(F.col("error_meters") > record_limit_meters, 1.0).otherwise(0.0)
    grouped = errors.groupBy("city").agg(
        F.avg("error_meters").alias("mean_error"),
        F.avg(F.when(F.col("error_meters").isNotNull(), above)).alias("rate"),
        F.count_if(F.col("error_meters").isNull()).alias("failed_records"),
    )
    return grouped.select(
        "city",
        F.round("mean_error", 2).alias("avg_error_meters"),
        F.round("rate", 4).alias("risk_rate"),
        "failed_records",
        verdict(F.col("mean_error"), F.col("rate")).alias("verdict"),
    )


def city_decision(summary: DataFrame) -> DataFrame:
    return summary.withColumn("decision", go_decision(F.col("verdict")))


def risk_context(summary: DataFrame, max_cities: int = 10_000) -> DataFrame:
    """The summary as one JSON text in one row, cities in order.

    One text must fit one row. A summary beyond ``max_cities`` is refused
    rather than cut; ``city_contexts`` has no such bound.
    """
    stored = store(summary, "city-risk")
    cities = stored.count()
    if cities > max_cities:
        raise ValueError(f"{cities} cities do not fit one text; use city_contexts")
    rows = F.array_sort(F.collect_list(F.struct(*summary.columns)))
    return stored.agg(F.to_json(rows).alias("risk_context"))


def city_contexts(summary: DataFrame) -> DataFrame:
    """One JSON text per city."""
    return summary.select("city", F.to_json(F.struct(*summary.columns)).alias("risk_context"))


def add_prompt(
    questions: DataFrame, context: DataFrame, question: Column | str = "question"
) -> DataFrame:
    """Fill the one-row ``context`` and each question into the prompt."""
    text = F.col(question) if isinstance(question, str) else question
    return questions.withColumn("prompt", F.format_string(PROMPT, context.scalar(), text))


def cities_named(questions: DataFrame, cities: DataFrame, question: str = "question") -> DataFrame:
    """The rows of ``questions`` with each ``city`` of ``cities`` whose name stands in the text, in any case.

    All pieces of a text that are as long as some name are looked up with an equi-join, so neither
    side needs to be small. A text that names no city keeps one row without one.
    """
    names = store(cities.select("city", F.lower("city").alias("_name")).where("length(city) > 0").distinct(), "city-names")
    # One number per length of a name, whatever the number of names.
    lengths = [r[0] for r in names.select(F.char_length("_name")).distinct().collect()]
    text = F.lower(F.col(question))

    def pieces(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.char_length(text) - n + 1)
        return F.when(F.char_length(text) >= n, F.transform(starts, lambda at: F.substr(text, at, F.lit(n))))

    every = F.array_compact(F.array(*(pieces(n) for n in lengths))) if lengths else F.lit(None).cast("array<array<string>>")
    marked = store(questions.withColumn("_row", F.monotonically_increasing_id()), "questions")
    looked_up = marked.select("_row", F.explode(F.array_distinct(F.flatten(every))).alias("_name"))
    found = looked_up.join(names, "_name").select("_row", "city")
    return marked.join(found, "_row", "left").select(*questions.columns, "city")


def question_decisions(questions: DataFrame, summary: DataFrame, question: str = "question") -> DataFrame:
    """Figures, verdict and decision for each city that a question names.

    A question that names no known city has no figures and needs a review.
    """
    decided = city_decision(store(summary, "city-risk"))
    answered = cities_named(questions, decided, question).join(decided, "city", "left")
    return answered.select(
        *questions.columns, "city", "avg_error_meters", "risk_rate", "verdict",
        F.coalesce("decision", go_decision(F.lit(None).cast("string"))).alias("decision"),
    )
