"""Every registered query against its SQL twin."""

import pytest

import __spark_entry__ as driver
from tests.oracle import SF_ROOT, compare, connect
from tidewatch.plans.oracle import all_sql
from tidewatch.plans.queries import all_queries

SF_DIR = str(SF_ROOT / "sf0.01")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_sql())


def test_every_query_is_registered():
    assert set(all_queries()) <= set(driver.queries()) and set(all_sql()) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", list(all_queries()))
def test_query_agrees_with_sql(spark, duck, name):
    df = all_queries()[name](spark, SF_DIR)
    assert compare(df, duck, all_sql()[name]) == []


def test_entry(spark):
    assert driver.entry(spark).count() == 15


TIMED = [
    "latest_readings_ties",
    "latest_times_per_unit",
    "latest_documents",
    "sensor_history_24h",
    "trend_series",
    "new_dangers",
    "forecast_do",
    "generate_readings",
    "stream_latest",
    "stream_new_dangers",
]


@pytest.mark.parametrize("name", TIMED)
def test_session_time_zone_does_not_matter(spark, name):
    sf_dir = str(SF_ROOT / "sf0.001")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert compare(driver.queries()[name](spark, sf_dir), connect(sf_dir), driver.oracle_sql()[name]) == []
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
