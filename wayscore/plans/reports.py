"""Jobs from points to written reports.

``python -m wayscore.plans.reports --points gps_tracks.csv --out results``
writes below ``--out``:

============================  ==============================================
``cleaned_data.parquet``      points with step distance and stuck flag
``decision_result.parquet``   decision matrix, best score first
``decision_result.json``      the same as JSON arrays, one per part folder
``clustered_result.parquet``  drivers with features, cluster and label
``clustered_result.json``     the same as JSON lines
``fleet_kpis.json``           drivers, drivers at risk, mean speed
``label_distribution.json``   drivers and share per label
``risk_insights.json``        advice for the risky or the slowest drivers
============================  ==============================================
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayscore import schemas
from wayscore.operators import clusters, decision, risk, tracks
from wayscore.session import build_session
from wayscore.sources import files


def read_points(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    readers = {"csv": files.read_csv, "parquet": files.read_parquet, "json": files.read_json}
    return readers[fmt](spark, path, schemas.GPS_POINTS)


def write_steps(points: DataFrame, out: str) -> DataFrame:
    """Write the cleaned table and return it as written."""
    path = f"{out}/cleaned_data.parquet"
    steps = tracks.add_steps(points).drop("point_no")
    files.write_parquet(steps, path)
    return files.read_parquet(points.sparkSession, path, steps.schema)


def write_matrix(steps: DataFrame, out: str) -> DataFrame:
    """Write the decision matrix, computed once, and return it as written."""
    path = f"{out}/decision_result.parquet"
    best_first = F.desc("final_score"), F.asc("user_id"), F.asc("city")
    files.write_parquet(decision.decision_matrix(steps).orderBy(*best_first), path)
    matrix = files.read_parquet(steps.sparkSession, path, schemas.DECISION_MATRIX)
    files.write_json_array(matrix, f"{out}/decision_result.json", *best_first)
    return matrix


def write_drivers(steps: DataFrame, out: str) -> DataFrame:
    """Write features, cluster and label of each driver and return them as written."""
    path = f"{out}/clustered_result.parquet"
    features = decision.driver_features(steps)
    files.write_parquet(clusters.label_clusters(clusters.cluster(features)), path)
    drivers = files.read_parquet(steps.sparkSession, path, schemas.CLUSTERED_DRIVERS)
    files.write_json(drivers, f"{out}/clustered_result.json")
    return drivers


def write_risk(drivers: DataFrame, out: str) -> None:
    files.write_json(risk.fleet_kpis(drivers), f"{out}/fleet_kpis.json")
    files.write_json(risk.label_distribution(drivers), f"{out}/label_distribution.json")
    files.write_json(risk.risk_insights(drivers), f"{out}/risk_insights.json")


def write_all(points: DataFrame, out: str) -> None:
    steps = write_steps(points, out)
    write_matrix(steps, out)
    write_risk(write_drivers(steps, out), out)


def main() -> None:
    parser = argparse.ArgumentParser(description="Write all reports for a table of GPS points.")
    parser.add_argument("--points", required=True)
    parser.add_argument("--format", default="csv", choices=["csv", "parquet", "json"])
    parser.add_argument("--out", required=True)
    options = parser.parse_args()
    spark = build_session("wayscore-reports")
    write_all(read_points(spark, options.points, options.format), options.out)
    spark.stop()


if __name__ == "__main__":
    main()
