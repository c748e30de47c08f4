"""The physical plans that the operators are meant to get."""

import re

import pytest

from tests.tables import NOW
from tidewatch.operators import alerts as alert_ops
from tidewatch.operators.forecast import forecast_do
from tidewatch.operators.joins import join_unit_names
from tidewatch.operators.readings import band_counts, latest_readings, sensor_history
from tidewatch.operators.recent import latest_one, latest_with_ties, since
from tidewatch.plans.queries import all_queries
from tidewatch.sources.generator import generate_readings, generate_units
from tidewatch.sources.tables import read_table, write_table
from tests.oracle import SF_ROOT


def plan(df, capsys) -> str:
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


@pytest.fixture(scope="module")
def fleet(spark):
    return generate_units(spark, 6)


@pytest.fixture(scope="module")
def stored(spark, fleet, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "readings")
    write_table(generate_readings(fleet, NOW), path, "readings")
    return read_table(spark, path, "readings")


def test_lookback_reaches_the_scan(stored, capsys):
    text = plan(since(stored, NOW, 24).select("unit_id", "ph"), capsys)
    assert "GreaterThanOrEqual(timestamp,2024-03-09T12:30:15)" in text
    assert re.search(r"PartitionFilters: \[.*date#\d+ >= 2024-03-09", text)
    assert "ReadSchema: struct<unit_id:int,timestamp:timestamp_ntz,ph:double>" in text


def test_alert_limits_reach_the_scan(stored, fleet, capsys):
    text = plan(alert_ops.alerts_of_all(fleet, stored), capsys)
    assert re.search(r"PushedFilters: \[.*LessThan\(ph,7.3\)", text)
    assert "light_intensity" not in re.search(r"ReadSchema: .*unit_id.*", text).group()


def test_latest_of_a_stored_table_reads_few_days(stored, fleet, capsys):
    text = plan(latest_with_ties(stored, fleet), capsys)
    assert "SortMergeJoin" not in text and text.count("WindowGroupLimit") >= 2
    scans = [p for p in text.split("\n\n") if "ReadSchema" in p]
    wide = [p for p in scans if "timestamp" in p.split("ReadSchema")[1]]
    assert len(wide) == 1 and "array_contains" in re.search(r"PartitionFilters: \[.*", wide[0]).group()
    assert all("ReadSchema: struct<unit_id:int>" in p for p in scans if p not in wide and "unit_id" in p)


def test_latest_reads_the_unit_ids_once(stored, fleet, spark):
    """The days are found in one job, though both the scan filter and the join need them."""
    latest = latest_with_ties(stored, fleet)
    latest.collect()
    assert "ReusedExchange" in latest._jdf.queryExecution().executedPlan().toString()


def test_latest_of_a_plain_table(spark, fleet, stored, capsys):
    """Neither sorts nor shuffles the readings."""
    text = plan(latest_with_ties(stored.drop("date"), fleet), capsys)
    assert "ReadSchema: struct<unit_id:int,timestamp:timestamp_ntz>" in text
    assert "SortMergeJoin" not in text and "Sort (" not in text and "Window" not in text
    assert text.count("BroadcastHashJoin Inner BuildRight (") >= 2 and "array_contains" not in text


def test_latest_without_broadcast_limits_groups_before_the_shuffle(stored, fleet, capsys):
    text = plan(latest_one(stored, fleet, limit=0), capsys)
    assert text.count("WindowGroupLimit") >= 2
    assert "array_contains" in re.search(r"PartitionFilters: \[.*", text).group()


def test_unit_names_join(stored, fleet, capsys, spark):
    assert "BroadcastHashJoin" in plan(join_unit_names(stored, fleet), capsys)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(join_unit_names(stored, fleet, limit=0), capsys)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" in text and "_salt" in text and "Broadcast" not in text


def test_feed_takes_the_top_without_a_full_sort(spark, stored, fleet, capsys):
    raised = alert_ops.alerts_of_all(fleet, stored)
    text = plan(alert_ops.alert_feed(raised, fleet), capsys)
    assert "TakeOrderedAndProject" in text


def test_feed_reads_alerts_on_the_newest_days_only(spark, stored, fleet, tmp_path, capsys):
    path = str(tmp_path / "alerts")
    write_table(alert_ops.alerts_of_all(fleet, stored), path, "alerts")
    text = plan(alert_ops.alert_feed(read_table(spark, path, "alerts"), fleet), capsys)
    scans = [p for p in text.split("\n\n") if "ReadSchema" in p and "message" in p]
    assert len(scans) == 1 and "array_contains" in re.search(r"PartitionFilters: \[.*", scans[0]).group()


def test_forecast_keeps_six_rows_per_unit_before_the_shuffle(stored, fleet, capsys):
    text = plan(forecast_do(fleet, stored, NOW), capsys)
    assert "WindowGroupLimit" in text and "PartitionFilters: [isnotnull(date" in text
    assert "ReadSchema: struct<id:bigint,unit_id:int,timestamp:timestamp_ntz,do_predicted:double>" in text


def test_counts_shuffle_one_row_per_task(stored, capsys):
    text = plan(band_counts(stored), capsys)
    assert text.count("Exchange") <= 2 * text.count("SinglePartition") + 1 and "hashpartitioning" not in text


QUIET = [name for name in all_queries() if not name.startswith(("stream_", "generated_alerts"))]


@pytest.mark.parametrize("name", QUIET)
def test_no_cross_join_and_no_python(spark, name, capsys):
    text = plan(all_queries()[name](spark, str(SF_ROOT / "sf0.001")), capsys)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name != "forecast_with_model":
        assert "Python" not in text and "InPandas" not in text
