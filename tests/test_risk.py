import pytest
from pyspark.sql import functions as F

from wayscore import fixed
from wayscore.functions.decisions import has_word, lookup, matches, request_text, stops_text
from wayscore.operators import risk, scoring

DRIVERS = "driver_id string, total_km double, average_speed double, stuck_count int, label string"


@pytest.fixture(scope="module")
def drivers(spark):
    rows = [
        ("d1", 9.0, 50.0, 1, fixed.LABEL_NORMAL),
        ("d2", 9.0, 10.0, 25, fixed.LABEL_RISK),
        ("d3", 9.0, 20.0, 2, fixed.LABEL_RISK),
        ("d4", 9.0, 70.0, 0, fixed.LABEL_GOOD),
        ("d5", 9.0, 30.0, 0, None),
    ]
    return spark.createDataFrame(rows, DRIVERS)


def ids(df):
    return [r["driver_id"] for r in df.collect()]


def test_label_patterns(spark):
    rows = [("risk: low",), ("Risk: Congested",), ("紅色警戒",), ("fine",), (None,)]
    df = spark.createDataFrame(rows, "label string")
    found = df.select(
        matches(F.col("label"), fixed.RISK_PATTERN),
        has_word(F.col("label"), fixed.RISK_WORD),
        has_word(F.col("label"), fixed.RED_ALERT_WORD),
    ).collect()
    assert [tuple(r) for r in found] == [
        (True, False, False), (True, True, False), (True, False, True), (False,) * 3, (False,) * 3
    ]


def test_risky_or_else_slowest(drivers):
    assert ids(risk.risky_drivers(drivers)) == ["d2", "d3"]
    assert ids(risk.risky_drivers(drivers, n=1)) == ["d2"]
    others = drivers.filter(F.coalesce(F.col("label") != fixed.LABEL_RISK, F.lit(True)))
    assert ids(risk.risky_drivers(others)) == ["d5", "d1", "d4"]
    assert ids(risk.risky_drivers(drivers, pattern="nothing")) == ["d2", "d3", "d5"]
    assert ids(risk.risky_drivers(drivers.limit(0))) == []


def test_insights_and_actions(drivers):
    first, second = risk.risk_insights(drivers).collect()
    assert first.asDict() == {
        "driver_id": "d2",
        "label": fixed.LABEL_RISK,
        "speed": "10.00 km/h",
        "ai_sentiment": "NEGATIVE",
        "management_advice": fixed.INTERVIEW_ADVICE,
    }
    assert second["ai_sentiment"] == "POSITIVE"
    assert second["management_advice"] == fixed.OBSERVE_ADVICE
    actions = risk.alert_actions(drivers, word="Risk").collect()
    assert [r["management_action"] for r in actions] == [
        fixed.INTERVIEW_ACTION, fixed.OBSERVE_ACTION
    ]
    assert risk.alert_actions(drivers).count() == 0


def test_kpis_distribution_and_colours(drivers):
    row = risk.fleet_kpis(drivers).first()
    assert tuple(row) == (5, 2, 36.0)
    shares = {r["label"]: r["share"] for r in risk.label_distribution(drivers).collect()}
    assert shares[fixed.LABEL_RISK] == pytest.approx(0.4) and shares[None] == pytest.approx(0.2)
    colours = {r["driver_id"]: r["colour"] for r in risk.add_colour(drivers).collect()}
    assert colours["d2"] == "#ff4d4d" and colours["d5"] == fixed.UNKNOWN_COLOUR
    assert ids(risk.map_drivers(drivers, 2)) == ["d2", "d3"]
    assert risk.speed_scatter(drivers).columns == ["average_speed", "stuck_count", "label"]


def test_lookup_default(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "k string")
    rows = df.select(lookup(F.col("k"), {"a": "1"}, "other")).collect()
    assert [r[0] for r in rows] == ["1", "other", "other"]


def test_texts(drivers):
    row = risk.status_texts(drivers).first()
    assert tuple(row)[1:] == (
        "Driver d1 is traveling at 50.0 km/h with 1 stops.",
        "Driver d1 is driving at 50.0 km/h with 1 congestion events.",
        "50.00 km/h",
    )


def test_request_text(spark):
    rows = [("x", 10.0, 25), (None, 1.5, 0), ("y", None, 1), ("z", 1.0, None)]
    df = spark.createDataFrame(rows, "driver_id string, speed double, stuck_count int")
    assert [r[0] for r in df.select(request_text()).collect()] == [
        "Driver x is driving at 10.0 km/h and got stuck 25 times.",
        "Driver None is driving at 1.5 km/h and got stuck 0 times.",
        None,
        None,
    ]


def test_rule_on_the_sample_request(spark):
    rows = [("x", 10.0, 25), ("tie", 10.0, 5), ("fast", 80.0, 0), ("none", None, 1)]
    df = spark.createDataFrame(rows, "driver_id string, speed double, stuck_count int")
    found = {r["driver_id"]: r for r in scoring.score_by_rule(df, "speed").collect()}
    assert (found["x"]["sentiment"], found["x"]["score"]) == ("NEGATIVE", 0.982)
    assert (found["tie"]["sentiment"], found["tie"]["score"]) == ("NEGATIVE", 0.5)
    assert found["fast"]["sentiment"] == "POSITIVE"
    assert found["none"]["sentiment"] is None and found["none"]["error"] == "missing input"
    levels = {r["driver_id"]: r["risk_level"] for r in risk.risk_scores(scoring.score_by_rule(df, "speed")).collect()}
    assert levels["x"] == "High Risk" and levels["fast"] == "Safe"


def test_text_model_agrees_with_the_rule(spark, given):
    from wayscore.sources import tables

    fleet = tables.drivers(tables.load(spark, given, "customer"))
    by_rule = scoring.score_by_rule(fleet, "average_speed").select("driver_id", "sentiment", "score")
    by_text = scoring.score_by_text(fleet, stops_text()).select("driver_id", "sentiment", "score")
    assert by_rule.exceptAll(by_text).count() == 0 == by_text.exceptAll(by_rule).count()


def test_one_bad_text_does_not_fail_the_others(drivers):
    def failing_model():
        def classify(texts):
            if any("d3" in t for t in texts):
                raise RuntimeError("cannot read d3")
            return [{"label": "POSITIVE", "score": 0.75}] * len(texts)

        return classify

    scored = scoring.score_by_text(drivers, stops_text(), failing_model)
    found = {r["driver_id"]: r for r in scored.collect()}
    assert found["d3"]["error"] == "cannot read d3" and found["d3"]["sentiment"] is None
    for driver in ("d1", "d2", "d4", "d5"):
        assert found[driver]["score"] == 0.75 and found[driver]["error"] is None


def test_without_a_model_the_risk_is_unknown(drivers):
    def no_model():
        raise OSError("no weights")

    scored = scoring.score_by_text(drivers, stops_text(), no_model)
    rows = risk.risk_scores(scored).collect()
    assert {(r["risk_level"], r["ai_confidence"]) for r in rows} == {("Unknown (Model Error)", 0.0)}


def test_partitions_are_mapped_whole(spark):
    rows = [(i, "d", float(i % 50) if i % 5 else None, i % 9) for i in range(400)]
    df = spark.createDataFrame(rows, "request_id long, driver_id string, speed double, stuck_count int")
    texts = df.withColumn("text", request_text())
    scored = scoring.score_partitions(texts, "text", "request_id", partitions=6)
    assert scored.rdd.getNumPartitions() == 6
    found = {r["request_id"]: r for r in scored.collect()}
    rule = {r["request_id"]: r for r in scoring.score_by_rule(df, "speed").collect()}
    assert len(found) == 400
    for key, row in found.items():
        assert (row["sentiment"], row["score"], row["error"]) == (
            rule[key]["sentiment"], rule[key]["score"], rule[key]["error"]
        )


def test_a_worker_loads_its_model_once(spark, tmp_path):
    folder = str(tmp_path)

    def counted_model():
        import os
        import uuid

        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda texts: [{"label": "POSITIVE", "score": 0.5}] * len(texts)

    df = spark.range(0, 4000, 1, 60).select(F.concat(F.lit("text "), "id").alias("text"))
    for _ in range(2):
        scored = scoring.score_by_text(df, F.col("text"), counted_model)
        assert scored.filter("sentiment = 'POSITIVE'").count() == 4000
    loads = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert len(loads) == len(set(loads)) < 60
