import json

import pytest
from pyspark.sql import functions as F

from wayscore.functions.decisions import go_decision, verdict
from wayscore.operators import provider
from wayscore.schemas import CITY_RISK


def test_verdicts(spark):
    cases = [
        (8.5, 0.02, "SAFE", "Go"),
        (145.2, 0.35, "RISKY", "No-Go"),
        (25.1, 0.12, "MONITOR", "Review"),
        (10.0, 0.12, "MONITOR", "Review"),
        (10.0, 0.21, "RISKY", "No-Go"),
        (50.1, 0.0, "RISKY", "No-Go"),
        (20.0, 0.01, "MONITOR", "Review"),
        (10.0, 0.05, "MONITOR", "Review"),
        (50.0, 0.2, "MONITOR", "Review"),
    ]
    df = spark.createDataFrame(cases, "a double, r double, v string, d string")
    found = df.withColumn("found", verdict(F.col("a"), F.col("r")))
    for row in found.withColumn("go", go_decision(F.col("found"))).collect():
        assert (row["found"], row["go"]) == (row["v"], row["d"]), row


def providers(spark):
    a = spark.createDataFrame(
        [(1, "T", 25.0, 121.0), (2, "T", 25.0, 121.0), (3, "H", 24.0, 120.0), (4, "H", 1.0, 1.0)],
        "event_id long, city string, latitude double, longitude double",
    )
    b = spark.createDataFrame(
        [(1, 25.0, 121.0), (2, 25.001, 121.0), (3, 24.0, 120.0), (9, 0.0, 0.0)],
        "event_id long, latitude double, longitude double",
    )
    return a, b


def test_error_and_summary(spark):
    errors = provider.provider_error(*providers(spark))
    meters = {r["event_id"]: r["error_meters"] for r in errors.collect()}
    assert set(meters) == {1, 2, 3, 4} and meters[4] is None  # not in the other provider
    assert meters[1] == 0.0 and meters[2] == pytest.approx(111.19, abs=0.01)
    summary = {r["city"]: r for r in provider.city_risk_summary(errors).collect()}
    assert summary["T"]["avg_error_meters"] == pytest.approx(55.6)
    assert summary["T"]["risk_rate"] == 0.5 and summary["T"]["verdict"] == "RISKY"
    assert summary["H"]["verdict"] == "SAFE"
    loose = provider.city_risk_summary(errors, record_limit_meters=200).collect()
    assert {r["risk_rate"] for r in loose} <= {0.0, None}
    assert sum(r["failed_records"] for r in loose) == 1


def test_context_and_prompt(spark):
    rows = [("新竹", 1.5, 0.0, "SAFE"), ("Taipei", 60.0, 0.3, "RISKY")]
    summary = spark.createDataFrame(rows, CITY_RISK)
    context = provider.risk_context(summary)
    text = context.first()["risk_context"]
    assert [r["city"] for r in json.loads(text)] == ["Taipei", "新竹"] and "新竹" in text
    questions = spark.createDataFrame([("q1?",), ("q2?",)], "question string")
    prompts = [r["prompt"] for r in provider.add_prompt(questions, context).collect()]
    assert len(prompts) == 2 and all(text in p and "5 %" in p for p in prompts)
    with pytest.raises(ValueError, match="2 cities"):
        provider.risk_context(summary, max_cities=1)
    parts = provider.city_contexts(summary).collect()
    assert {r["city"]: json.loads(r["risk_context"])["verdict"] for r in parts} == {
        "新竹": "SAFE", "Taipei": "RISKY"
    }
