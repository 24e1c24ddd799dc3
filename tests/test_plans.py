"""The physical plans hold what the scale of the data needs."""

import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from wayscore.plans.catalog import QUERIES
from wayscore.operators import decision, provider, quality, tracks
from wayscore.schemas import GPS_RECORDS
from wayscore.sources import tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    return re.findall(r"Exchange (\w+)", text)


def build(spark, given, name):
    return plan(QUERIES[name](spark, given))


def test_decision_matrix_needs_one_exchange(spark, given):
    text = build(spark, given, "decision_matrix")
    assert exchanges(text) == ["hashpartitioning"]
    assert text.count("Sort [") == 1 and text.count("Window [") == 1


def test_driver_features_need_one_exchange(spark, given):
    assert exchanges(build(spark, given, "driver_features")) == ["hashpartitioning"]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"driver_risk_scores_batch", "partitioned_map"}))
def test_no_python_in_the_plan(spark, given, name):
    if name in ("stream_risk_scores", "risk_context") or "cluster" in name or name == "driver_labels":
        pytest.skip("reads a stored result")
    text = build(spark, given, name)
    assert not re.search(r"EvalPython|MapInPandas|FlatMapGroups|CartesianProduct", text)


def test_unused_point_numbers_are_not_computed(spark, given):
    assert "row_number" not in build(spark, given, "decision_matrix")


def test_only_needed_columns_are_read(spark, given):
    schema = re.search(r"ReadSchema: (\S+)", build(spark, given, "geo_counts")).group(1)
    assert "props" not in schema and "value" not in schema
    assert re.search(r"ReadSchema: struct<value:double>|event_type", build(spark, given, "group_argminmax"))


@pytest.fixture(scope="module")
def gps_path(spark, given, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("gps") / "points")
    tables.gps_points(tables.events(spark, given)).write.parquet(path)
    return path


def test_user_filter_reaches_the_scan(spark, gps_path):
    df = spark.read.schema(GPS_RECORDS).parquet(gps_path)
    text = plan(tracks.user_track(df, "user_1"))
    assert "EqualTo(user_id,user_1)" in text
    # Also when it is written after the window, because it filters on the key.
    assert "EqualTo(user_id,user_1)" in plan(tracks.add_steps(df).filter("user_id = 'user_1'"))


def test_city_filter_stays_above_the_window(spark, gps_path):
    df = spark.read.schema(GPS_RECORDS).parquet(gps_path)
    text = plan(tracks.add_steps(df).filter("city = 'Taipei'"))
    assert text.index("Filter") < text.index("Window [") and "EqualTo(city" not in text


def test_hot_track_check_reads_one_column(spark, gps_path):
    df = spark.read.schema(GPS_RECORDS).parquet(gps_path)
    text = plan(df.groupBy("user_id").count())
    assert "ReadSchema: struct<user_id:string>" in text
    assert tracks.hot_tracks(df).isEmpty()


def test_markers_and_samples_cut_before_the_exchange(spark, gps_path):
    df = spark.read.schema(GPS_RECORDS).parquet(gps_path)
    markers = plan(tracks.track_markers(df))
    assert re.search(r"WindowGroupLimit[^\n]*Partial", markers[markers.index("Exchange") :])
    sample = plan(quality.systematic_sample(df, task_rows=50))
    assert len(re.findall(r"WindowGroupLimit[^\n]*Partial", sample)) == 2


def test_top_n_keeps_n_per_task(spark, given):
    for name in ("top_drivers", "slowest_drivers"):
        assert "TakeOrderedAndProject" in build(spark, given, name)


def test_small_stored_tables_are_broadcast(spark, given):
    text = build(spark, given, "coverage_report")
    assert "BroadcastHashJoin" in text and "NestedLoop" not in text


def test_big_sides_are_not_broadcast(spark, given):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        events = tables.events(spark, given)
        errors = provider.provider_error(tables.provider_a(events), tables.provider_b(events))
        zones = quality.add_zones(tables.gps_points(events))
        for text in (plan(errors), plan(zones)):
            assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_ranking_gathers_only_partition_counts(spark, given):
    events = tables.events(spark, given)
    ranked = decision.ranked(decision.decision_matrix(tracks.add_steps(tables.gps_points(events))))
    text = plan(ranked)
    single = text[text.index("Exchange SinglePartition") :]
    assert "part_rows" in text and "keys=[part" in single


def test_entry_and_registry(spark):
    assert entry(spark).columns == [
        "city", "user_id", "total_km", "total_records", "stuck_count", "final_score"
    ]
    assert set(oracle_sql()) <= set(queries())
