import math

import pytest
from hypothesis import given as any_of
from hypothesis import settings
from hypothesis import strategies as st

from wayscore.functions.geo import at_origin, distance_km, distance_km_asin, unit_clamp
from pyspark.sql import functions as F

COLUMNS = "a double, b double, c double, d double"


def distances(spark, rows):
    df = spark.createDataFrame(rows, COLUMNS)
    return [
        (r[0], r[1])
        for r in df.select(
            distance_km("a", "b", "c", "d"), distance_km_asin("a", "b", "c", "d")
        ).collect()
    ]


def test_known_distances(spark):
    half = math.pi * 6371
    rows = [
        (0.0, 0.0, 0.0, 180.0),
        (90.0, 0.0, -90.0, 0.0),
        (0.0, 0.0, 0.0, 90.0),
        (25.033, 121.5654, 25.033, 121.5654),
        (0.0, 0.0, 0.0, 0.0),
        (25.033, 121.5654, 24.8138, 120.9675),
    ]
    found = distances(spark, rows)
    wanted = [half, half, half / 2, 0.0, 0.0, 65.0]
    for (km, asin_km), value in zip(found, wanted):
        assert km == pytest.approx(value, abs=1.0 if value == 65.0 else 1e-6)
        assert asin_km == pytest.approx(km, abs=1e-4)
    assert found[3] == found[4] == (0.0, 0.0)


@pytest.mark.parametrize("bad", [None, float("nan")])
def test_missing_coordinates_give_zero(spark, bad):
    base = [25.0, 121.0, 24.0, 120.0]
    rows = [tuple(bad if i == at else v for i, v in enumerate(base)) for at in range(4)]
    assert distances(spark, rows) == [(0.0, 0.0)] * 4


def test_clamp(spark):
    values = [(-0.5,), (0.25,), (1.0000001,), (float("nan"),), (None,)]
    df = spark.createDataFrame(values, "v double").select(unit_clamp(F.col("v")))
    assert [r[0] for r in df.collect()] == [0.0, 0.25, 1.0, 0.0, 0.0]


def test_origin_flag_is_never_null(spark):
    rows = [(0.0, 0.0), (0.0, 1.0), (None, 0.0), (0.0, None), (None, None), (float("nan"), 0.0)]
    df = spark.createDataFrame(rows, "latitude double, longitude double")
    flags = [r[0] for r in df.select(at_origin()).collect()]
    assert flags == [True, False, False, False, False, False]
    assert df.filter(at_origin()).count() + df.filter(~at_origin()).count() == len(rows)


lat = st.floats(-90, 90)
lon = st.floats(-180, 180)


@settings(max_examples=5, deadline=None)
@any_of(st.lists(st.tuples(lat, lon, lat, lon), min_size=20, max_size=60))
def test_distance_properties(spark, rows):
    back = [(c, d, a, b) for a, b, c, d in rows]
    for (km, asin_km), (reverse, _) in zip(distances(spark, rows), distances(spark, back)):
        assert 0.0 <= km <= math.pi * 6371 + 1e-9
        assert km == pytest.approx(reverse, abs=1e-6)
        # Near antipodal points the arc sine loses digits.
        assert km == pytest.approx(asin_km, abs=1e-3)
    assert all(km == 0.0 for km, _ in distances(spark, [(a, b, a, b) for a, b, _, _ in rows]))
