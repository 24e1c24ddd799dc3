import json

import pytest

from wayscore import schemas
from wayscore.operators import decision, tracks
from wayscore.plans import reports
from wayscore.sources import files, tables


@pytest.fixture(scope="module")
def gps(spark, given):
    return tables.gps_points(tables.events(spark, given)).drop("event_id")


def test_all_reports_from_csv(spark, gps, tmp_path):
    source, out = str(tmp_path / "gps.csv"), tmp_path / "results"
    files.write_csv(gps, source)
    points = reports.read_points(spark, source)
    reports.write_all(points, str(out))

    matrix = spark.read.parquet(str(out / "decision_result.parquet"))
    wanted = decision.decision_matrix(tracks.add_steps(gps))
    assert matrix.exceptAll(wanted).count() == 0 == wanted.exceptAll(matrix).count()
    parts = sorted(
        (out / "decision_result.json").rglob("part-*"),
        key=lambda p: int(p.parent.name.partition("=")[2] or 0),
    )
    listed = [row for p in parts for row in json.loads(p.read_text("utf-8"))]
    scores = [r["final_score"] for r in listed]
    assert len(listed) == matrix.count() and scores == sorted(scores, reverse=True)

    steps = spark.read.parquet(str(out / "cleaned_data.parquet"))
    assert {"prev_lat", "prev_lon", "step_distance_km", "is_stuck"} <= set(steps.columns)
    assert steps.count() == gps.count()

    drivers = files.read_json(spark, str(out / "clustered_result.json"), schemas.CLUSTERED_DRIVERS)
    assert drivers.count() == gps.select("user_id").distinct().count()
    assert drivers.filter("label is null or average_speed is null").count() == 0
    kpis = spark.read.json(str(out / "fleet_kpis.json")).first()
    assert kpis["total_drivers"] == drivers.count()
    shares = spark.read.json(str(out / "label_distribution.json")).collect()
    assert sum(r["n"] for r in shares) == drivers.count()
    insights = spark.read.json(str(out / "risk_insights.json"))
    assert 1 <= insights.count() <= 5 and "management_advice" in insights.columns


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_points_in_other_formats(spark, gps, tmp_path, fmt):
    path = str(tmp_path / "points")
    gps.write.format(fmt).save(path)
    found = reports.read_points(spark, path, fmt)
    assert found.exceptAll(gps).count() == 0 == gps.exceptAll(found).count()
