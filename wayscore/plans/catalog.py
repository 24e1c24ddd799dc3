"""Every registered query: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayscore import fixed, schemas
from wayscore.functions.geo import distance_km_asin
from wayscore.operators import clusters, decision, lloyd, provider, quality, risk, scoring, tracks
from wayscore.functions.decisions import matches, request_text, stops_text
from wayscore.session import new_path
from wayscore.sources import files, tables
from wayscore.streaming import requests as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.gps_points(tables.events(spark, sf_dir))


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.add_steps(_points(spark, sf_dir))


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision.decision_matrix(_steps(spark, sf_dir))


def _drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.drivers(tables.load(spark, sf_dir, "customer"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.driver_requests(tables.events(spark, sf_dir))


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = tables.events(spark, sf_dir)
    return provider.provider_error(tables.provider_a(table), tables.provider_b(table))


# -- tracks -------------------------------------------------------------------


@query
def decision_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir)


@query
def decision_matrix_split(spark, sf_dir):
    """The same matrix with every longer track cut into runs."""
    steps = tracks.add_steps(_points(spark, sf_dir), hot_rows=50, run_rows=400)
    return decision.decision_matrix(steps)


@query
def decision_matrix_ranked(spark, sf_dir):
    return decision.ranked(_matrix(spark, sf_dir))


@query
def top_drivers(spark, sf_dir):
    return decision.top_drivers(_matrix(spark, sf_dir))


@query
def lag_points(spark, sf_dir):
    return tracks.add_previous_point(_points(spark, sf_dir)).drop("point_no")


@query
def step_distance(spark, sf_dir):
    km = F.round("step_distance_km", 6)
    return _steps(spark, sf_dir).select(
        "event_id", "user_id", "city", km.alias("step_distance_km"), "is_stuck"
    )


@query
def step_distance_split_tracks(spark, sf_dir):
    """The same steps, with the longest tracks cut into runs."""
    steps = tracks.add_steps(_points(spark, sf_dir), hot_rows=75, run_rows=2000)
    km = F.round("step_distance_km", 6)
    return steps.select("event_id", "user_id", "city", km.alias("step_distance_km"), "is_stuck")


@query
def haversine_asin(spark, sf_dir):
    """Both distance forms side by side."""
    other = distance_km_asin("prev_lat", "prev_lon", "latitude", "longitude")
    gap = F.abs(other - F.col("step_distance_km"))
    return _steps(spark, sf_dir).select(
        "event_id", F.round(other, 6).alias("asin_km"), (gap < 1e-9).alias("agrees")
    )


@query
def user_track(spark, sf_dir):
    track = tracks.user_track(_points(spark, sf_dir), "user_1")
    km = F.round("step_distance_km", 6)
    return track.select("event_id", "timestamp", "latitude", "longitude", km.alias("km"))


@query
def city_points(spark, sf_dir):
    normal = quality.normal_points(_points(spark, sf_dir))
    return tracks.city_points(normal, "Taipei")


@query
def track_preview(spark, sf_dir):
    preview = tracks.track_preview(_points(spark, sf_dir), "user_1", 15)
    return preview.withColumn("distance_km", F.round("distance_km", 6))


@query
def track_markers(spark, sf_dir):
    return tracks.track_markers(_points(spark, sf_dir)).select(
        "user_id", "point_no", "event_id", "latitude", "longitude"
    )


@query
def trajectory(spark, sf_dir):
    """Segments of 20 points, written as text."""
    parts = F.transform("path", lambda p: F.concat_ws(" ", p["latitude"], p["longitude"]))
    return tracks.trajectories(_points(spark, sf_dir), segment_points=20).select(
        "user_id", "segment", "n_points", F.array_join(parts, ";").alias("path")
    )


# -- data quality ---------------------------------------------------------------


@query
def anomaly_split(spark, sf_dir):
    return quality.flag_anomalies(_points(spark, sf_dir)).select(
        "event_id", "user_id", "city", "is_anomaly"
    )


@query
def geo_counts(spark, sf_dir):
    return quality.geo_counts(_points(spark, sf_dir))


@query
def nan_robustness(spark, sf_dir):
    return quality.nan_report(tracks.add_steps(tables.damaged_points(_points(spark, sf_dir))))


@query
def drift_points(spark, sf_dir):
    moved = quality.drift(_points(spark, sf_dir))
    return moved.select("event_id", "city", F.round("home_km", 6).alias("home_km"), "is_drift")


@query
def systematic_sample(spark, sf_dir):
    return quality.systematic_sample(_points(spark, sf_dir)).select(
        "city", "sample_no", "event_id", "latitude", "longitude"
    )


@query
def systematic_sample_all(spark, sf_dir):
    return quality.systematic_sample(_points(spark, sf_dir), per_city=None).select(
        "city", "sample_no", "event_id", "latitude", "longitude"
    )


@query
def grid_density(spark, sf_dir):
    grid = quality.grid_density(_steps(spark, sf_dir))
    return grid.withColumn("mean_step_km", F.round("mean_step_km", 6))


@query
def coverage_report(spark, sf_dir):
    report = quality.coverage(_points(spark, sf_dir))
    return report.withColumn("recall", F.round("recall", 6))


@query
def survivorship_report(spark, sf_dir):
    """Against a service that drops the longer half or so of the tracks."""
    report = quality.survivorship(_steps(spark, sf_dir), most_points=70)
    figures = [c for c in report.columns if c.endswith(("_share", "_km", "_rate"))]
    return report.withColumns({c: F.round(c, 6) for c in figures})


@query
def last_positions(spark, sf_dir):
    return tracks.last_positions(_points(spark, sf_dir))


# -- sources and sinks ----------------------------------------------------------


@query
def csv_roundtrip(spark, sf_dir):
    path = new_path(spark, "gps-csv")
    files.write_csv(_points(spark, sf_dir), path)
    return files.read_csv(spark, path, schemas.GPS_RECORDS)


@query
def parquet_roundtrip(spark, sf_dir):
    path = new_path(spark, "steps-parquet")
    files.write_parquet(step_distance(spark, sf_dir), path)
    return files.read_parquet(spark, path)


@query
def json_report_roundtrip(spark, sf_dir):
    path = new_path(spark, "matrix-json")
    files.write_json(_matrix(spark, sf_dir), path)
    return files.read_json(spark, path, schemas.DECISION_MATRIX)


@query
def json_array_roundtrip(spark, sf_dir):
    """Several part files, each one complete array, read back as records."""
    path = new_path(spark, "matrix-json-array")
    files.write_json_array(_matrix(spark, sf_dir), path, F.asc("user_id"), F.asc("city"))
    return files.read_json(spark, path, schemas.DECISION_MATRIX, records=True)


@query
def source_fallback(spark, sf_dir):
    """There is no Parquet report, so the JSON one is read."""
    path = new_path(spark, "report")
    files.write_json(_matrix(spark, sf_dir), f"{path}.json")
    choices = [("parquet", f"{path}.parquet"), ("json", f"{path}.json")]
    return files.read_first_available(spark, choices, schemas.DECISION_MATRIX)


@query
def report_status(spark, sf_dir):
    return files.report_status(spark, f"{sf_dir}/events.parquet")


@query
def partitioned_map(spark, sf_dir):
    texts = _requests(spark, sf_dir).withColumn("text", request_text())
    scored = scoring.score_partitions(texts, "text", "request_id")
    return scored.select("request_id", "driver_id", "sentiment", "score", "error")


# -- provider comparison --------------------------------------------------------


@query
def provider_error(spark, sf_dir):
    return _errors(spark, sf_dir).withColumn("error_meters", F.round("error_meters", 4))


@query
def city_risk_summary(spark, sf_dir):
    return provider.city_risk_summary(_errors(spark, sf_dir))


@query
def city_decision(spark, sf_dir):
    return provider.city_decision(provider.city_risk_summary(_errors(spark, sf_dir)))


@query
def risk_context(spark, sf_dir):
    """One question per city, put to the summary of all cities."""
    table = tables.events(spark, sf_dir)
    context = provider.risk_context(provider.city_risk_summary(_errors(spark, sf_dir)))
    asked = tables.provider_a(table).select("city").distinct()
    questions = asked.withColumn("question", F.concat(F.lit("Switch in "), "city", F.lit("?")))
    return provider.add_prompt(questions, context).select("city", "question", "prompt")


@query
def city_contexts(spark, sf_dir):
    return provider.city_contexts(provider.city_risk_summary(_errors(spark, sf_dir)))


@query
def question_decisions(spark, sf_dir):
    summary = provider.city_risk_summary(_errors(spark, sf_dir))
    return provider.question_decisions(tables.questions(tables.events(spark, sf_dir)), summary)


# -- features and clusters ------------------------------------------------------


@query
def driver_features(spark, sf_dir):
    features = decision.driver_features(_steps(spark, sf_dir))
    return features.withColumns(
        {c: F.round(c, 4) for c in ("total_km", "average_speed")}
    )


@query
def standardised_features(spark, sf_dir):
    columns = fixed.DRIVER_FEATURES
    scaled = clusters.standardise(_drivers(spark, sf_dir), columns)
    return scaled.select("driver_id", *(F.round(f"{c}_std", 6).alias(f"{c}_std") for c in columns))


@query
def group_argminmax(spark, sf_dir):
    means = clusters.cluster_means(tables.events(spark, sf_dir), "value", "event_type")
    return clusters.lowest_and_highest(means, "event_type")


@query
def driver_clusters(spark, sf_dir):
    return clusters.cluster(decision.driver_features(_steps(spark, sf_dir)))


@query
def driver_clusters_unscaled(spark, sf_dir):
    return clusters.cluster(decision.driver_features(_steps(spark, sf_dir)), scale=False)


@query
def step_clusters(spark, sf_dir):
    steps = _steps(spark, sf_dir).select("event_id", *fixed.STEP_FEATURES)
    return clusters.cluster(steps, fixed.STEP_FEATURES, collapse=True)


@query
def step_cluster_sizes(spark, sf_dir):
    return clusters.value_counts(step_clusters(spark, sf_dir), "cluster")


@query
def driver_labels(spark, sf_dir):
    return clusters.label_clusters(driver_clusters(spark, sf_dir))


def _resting_drivers(spark, sf_dir):
    """Drivers of the points with the clusters of fixed starting centres, labelled."""
    features = decision.driver_features(_steps(spark, sf_dir))
    return clusters.label_clusters(lloyd.lloyd(features).rows)


@query
def resting_clusters(spark, sf_dir):
    rows = lloyd.lloyd(_drivers(spark, sf_dir)).rows
    return clusters.label_clusters(rows.drop("label")).select("driver_id", "cluster", "label")


@query
def resting_clusters_unscaled(spark, sf_dir):
    return lloyd.lloyd(_drivers(spark, sf_dir), scale=False).rows.select("driver_id", "cluster")


@query
def resting_step_clusters(spark, sf_dir):
    steps = _steps(spark, sf_dir).select("event_id", *fixed.STEP_FEATURES)
    return lloyd.lloyd(steps, fixed.STEP_FEATURES).rows.select("event_id", "cluster")


@query
def resting_driver_labels(spark, sf_dir):
    return _resting_drivers(spark, sf_dir).select("driver_id", "cluster", "label")


@query
def cluster_report(spark, sf_dir):
    report = lloyd.cluster_report(_drivers(spark, sf_dir))
    figures = [c for c in report.columns if c not in ("cluster", "n")]
    return report.withColumns({c: F.round(c, 4) for c in figures})


@query
def map_markers(spark, sf_dir):
    drivers = _resting_drivers(spark, sf_dir)
    places = tracks.last_positions(_points(spark, sf_dir)).withColumnRenamed("user_id", "driver_id")
    return risk.map_markers(drivers, places, risk.risk_insights(drivers))


@query
def speed_scatter(spark, sf_dir):
    return risk.speed_scatter(_drivers(spark, sf_dir))


# -- risk -----------------------------------------------------------------------


@query
def driver_status_text(spark, sf_dir):
    return risk.status_texts(_drivers(spark, sf_dir))


@query
def driver_risk_scores(spark, sf_dir):
    return risk.risk_scores(scoring.score_by_rule(_drivers(spark, sf_dir), "average_speed"))


@query
def driver_risk_scores_batch(spark, sf_dir):
    """The same scores through a text model in Arrow batches."""
    return risk.risk_scores(scoring.score_by_text(_drivers(spark, sf_dir), stops_text()))


@query
def risk_advice(spark, sf_dir):
    return risk.risk_advice(scoring.score_by_rule(_drivers(spark, sf_dir), "average_speed"))


@query
def matched_labels(spark, sf_dir):
    return _drivers(spark, sf_dir).filter(matches(F.col("label"), fixed.RISK_PATTERN))


@query
def risky_drivers(spark, sf_dir):
    return risk.risky_drivers(_drivers(spark, sf_dir))


@query
def risky_drivers_fallback(spark, sf_dir):
    """A pattern that no label matches, so the slowest are taken."""
    return risk.risky_drivers(_drivers(spark, sf_dir), pattern="no such label")


@query
def risky_drivers_all(spark, sf_dir):
    return risk.risky_drivers(_drivers(spark, sf_dir), n=None)


@query
def labelled_groups(spark, sf_dir):
    """The labels' rule on groups that do not depend on K-means."""
    grouped = _drivers(spark, sf_dir).withColumn("cluster", F.col("stuck_count") % 5)
    return clusters.label_clusters(grouped).select("driver_id", "cluster", "label")


@query
def slowest_drivers(spark, sf_dir):
    return decision.slowest_drivers(_drivers(spark, sf_dir))


@query
def risk_insights(spark, sf_dir):
    return risk.risk_insights(_drivers(spark, sf_dir))


@query
def alert_actions(spark, sf_dir):
    return risk.alert_actions(_drivers(spark, sf_dir), word=fixed.RISK_WORD)


@query
def label_distribution(spark, sf_dir):
    counts = risk.label_distribution(_drivers(spark, sf_dir))
    return counts.withColumn("share", F.round("share", 6))


@query
def fleet_kpis(spark, sf_dir):
    kpis = risk.fleet_kpis(_drivers(spark, sf_dir))
    return kpis.withColumn("average_speed", F.round("average_speed", 4))


@query
def label_colours(spark, sf_dir):
    return risk.add_colour(_drivers(spark, sf_dir)).select("driver_id", "label", "colour")


@query
def map_drivers(spark, sf_dir):
    return risk.map_drivers(_drivers(spark, sf_dir)).select("driver_id", "label", "colour")


# -- requests -------------------------------------------------------------------


@query
def stream_risk_scores(spark, sf_dir):
    """All event files, scored by a stream that ends when they are done."""
    arriving = streaming.open_files(spark, f"{sf_dir}/events*.parquet", schemas.EVENTS)
    results = new_path(spark, "scores")
    running = streaming.start_scoring(
        tables.driver_requests(arriving), results, new_path(spark, "scores-checkpoint")
    )
    running.awaitTermination()
    return spark.read.parquet(results)


@query
def request_status(spark, sf_dir):
    """A stream has stored the results of all but the last day's requests."""
    asked = _requests(spark, sf_dir)
    last_day = asked.agg(F.max("requested_at") - 86400).first()[0]
    arriving = streaming.open_files(spark, f"{sf_dir}/events*.parquet", schemas.EVENTS)
    earlier = tables.driver_requests(arriving).filter(F.col("requested_at") < F.lit(last_day))
    results = new_path(spark, "scores")
    running = streaming.start_scoring(earlier, results, new_path(spark, "scores-checkpoint"))
    running.awaitTermination()
    return streaming.request_status(asked, spark.read.parquet(results))
