import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from wayscore.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "wayscore-tests",
        "local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def points(spark):
    """``points(rows)`` with rows of (id, user, time, lat, lon, city)."""
    from wayscore.schemas import GPS_RECORDS

    return lambda rows: spark.createDataFrame(rows, GPS_RECORDS)


@pytest.fixture(scope="session")
def given():
    return "/root/testdata/sf0.001"
