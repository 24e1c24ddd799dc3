import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayscore import fixed
from wayscore.operators import clusters

FEATURES = "driver_id string, total_km double, average_speed double, stuck_count long"


def three_groups(spark, n=90):
    pick = random.Random(2)
    centres = [(10.0, 15.0, 9), (30.0, 45.0, 4), (50.0, 90.0, 0)]
    rows = []
    for i in range(n):
        km, speed, stuck = centres[i % 3]
        rows.append((f"d{i}", km + pick.random(), speed + pick.random(), stuck))
    return spark.createDataFrame(rows, FEATURES)


def test_standardise_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 7.0), (2.0, 7.0), (3.0, 7.0)], "x double, same double")
    rows = clusters.standardise(df, ["x", "same"]).orderBy("x").collect()
    assert [r["x_std"] for r in rows] == pytest.approx([-1.2247449, 0.0, 1.2247449])
    assert [r["same_std"] for r in rows] == [0.0, 0.0, 0.0]


def test_missing_column_is_an_error(spark):
    df = spark.createDataFrame([("a", 1.0)], "driver_id string, total_km double")
    with pytest.raises(ValueError, match="average_speed, stuck_count"):
        clusters.cluster(df)


@pytest.mark.parametrize("scale", [True, False])
def test_separate_groups_are_found_and_labelled(spark, scale):
    found = clusters.label_clusters(clusters.cluster(three_groups(spark), scale=scale)).collect()
    for row in found:
        wanted = {9: fixed.LABEL_RISK, 4: fixed.LABEL_NORMAL, 0: fixed.LABEL_GOOD}
        assert row["label"] == wanted[row["stuck_count"]]
    assert len({r["cluster"] for r in found}) == 3


def test_collapsed_rows_give_the_same_groups(spark):
    rows = [(i, 0.0, 1) for i in range(40)] + [(100 + i, 5.0, 0) for i in range(3)]
    rows += [(200 + i, 50.0, 0) for i in range(5)]
    df = spark.createDataFrame(rows, "event_id long, step_distance_km double, is_stuck int")
    for collapse in (False, True):
        found = clusters.cluster(df, fixed.STEP_FEATURES, collapse=collapse)
        sizes = {r["n"] for r in clusters.value_counts(found, "cluster").collect()}
        assert sizes == {40, 3, 5}


def test_fewer_rows_than_clusters(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0, 1), ("b", 9.0, 9.0, 9)], FEATURES)
    labels = [r["label"] for r in clusters.label_clusters(clusters.cluster(df)).collect()]
    assert sorted(labels) == [fixed.LABEL_GOOD, fixed.LABEL_RISK]


def test_a_lone_cluster_is_good(spark):
    df = spark.createDataFrame([(0, 5.0), (0, 6.0)], "cluster int, average_speed double")
    assert {r["label"] for r in clusters.label_clusters(df).collect()} == {fixed.LABEL_GOOD}


def test_lowest_and_highest_take_the_first_of_equals(spark):
    df = spark.createDataFrame(
        [("b", 1.0), ("a", 1.0), ("c", 3.0), ("d", 3.0), ("e", 2.0)], "g string, v double"
    )
    row = clusters.lowest_and_highest(clusters.cluster_means(df, "v", "g"), "g").first()
    assert (row["lowest"], row["highest"]) == ("a", "c")


def test_value_counts(spark):
    df = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "label string")
    rows = {r["label"]: (r["n"], r["share"]) for r in clusters.value_counts(df, "label").collect()}
    assert rows == {"x": (2, 0.5), "y": (1, 0.25), None: (1, 0.25)}


def test_one_risk_and_one_good_cluster(spark, given):
    from __spark_entry__ import queries

    labels = queries()["driver_labels"](spark, given)
    per_label = labels.groupBy("label").agg(F.countDistinct("cluster").alias("n")).collect()
    found = {r["label"]: r["n"] for r in per_label}
    assert found[fixed.LABEL_GOOD] == 1 and found.get(fixed.LABEL_RISK, 1) == 1


def lloyd_cost(x, k, start, rounds=100):
    """Within-cluster cost of plain K-means from ``k`` random rows."""
    means = x[start.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        nearest = ((x[:, None] - means) ** 2).sum(2).argmin(1)
        means = np.array([x[nearest == c].mean(0) if (nearest == c).any() else means[c] for c in range(k)])
    return ((x - means[nearest]) ** 2).sum()


@pytest.mark.parametrize("scale", [True, False])
def test_clusters_are_as_good_as_brute_force(spark, scale):
    from wayscore.operators import decision, tracks
    from wayscore.sources import tables

    points = tables.gps_points(tables.events(spark, "/root/testdata/sf0.01"))
    features = decision.driver_features(tracks.add_steps(points))
    found = clusters.cluster(features, scale=scale).toPandas()
    x = found[fixed.DRIVER_FEATURES].to_numpy(float)
    if scale:
        x = (x - x.mean(0)) / x.std(0)
    label = found["cluster"].to_numpy()
    means = np.array([x[label == c].mean(0) for c in range(3)])
    cost = ((x - means[label]) ** 2).sum()
    nearest = ((x[:, None] - means) ** 2).sum(2).argmin(1)
    assert (nearest == label).mean() > 0.98
    start = np.random.default_rng(1)
    costs = sorted(lloyd_cost(x, 3, start) for _ in range(30))
    assert cost <= costs[-1] * 1.001
