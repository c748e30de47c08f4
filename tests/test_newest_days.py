"""Days far back are never opened: their files are spoilt first, so that reading one would fail."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.test_plans import plan
from tests.tables import NOW, ago, alert, alerts, ids, reading, readings, receipts, units
from tidewatch.operators import joins
from tidewatch.operators.alerts import alert_feed, apply_receipts, generate_alerts, unknown_receipts
from tidewatch.operators.recent import latest_one, latest_with_ties, stored_days
from tidewatch.sources.tables import read_table, write_table


def spoil(path, keep):
    """Overwrites the files of all but the ``keep`` newest days."""
    folders = sorted(Path(path).glob("date=*"))
    for folder in folders[:-keep]:
        for file in folder.glob("*.parquet"):
            file.write_bytes(b"not a table")
    return len(folders)


@pytest.fixture()
def forty_days(spark, tmp_path):
    path = str(tmp_path / "readings")
    rows = [reading(100 * day + unit, unit, ago(24 * day), ph=6.0) for day in range(40) for unit in (1, 2, 3, 9)]
    write_table(readings(spark, *rows), path, "readings")
    return path


def test_days_come_from_the_listing(spark, forty_days):
    days = stored_days(read_table(spark, forty_days, "readings"))
    assert len(days) == 40 and days[0] == NOW.date() and days == sorted(days, reverse=True)
    plain = readings(spark, reading(1, 1, NOW)).withColumn("date", F.to_date("timestamp"))
    assert stored_days(plain) == [] and ids(latest_one(plain, units(spark, 1))) == [1]


@pytest.mark.parametrize("limit", [None, 0])
def test_latest_opens_one_day_when_all_units_report(spark, forty_days, limit):
    spoil(forty_days, keep=1)
    stored, fleet = read_table(spark, forty_days, "readings"), units(spark, 1, 2, 3)
    assert sorted(ids(latest_with_ties(stored, fleet, limit))) == [1, 2, 3]
    assert sorted(ids(latest_one(stored, fleet, limit))) == [1, 2, 3]
    assert generate_alerts(fleet, stored).count() == 3


def test_latest_goes_back_as_far_as_a_silent_unit(spark, forty_days):
    write_table(readings(spark, reading(7, 5, ago(24 * 3))), forty_days, "readings")
    spoil(forty_days, keep=4)
    assert sorted(ids(latest_one(read_table(spark, forty_days, "readings"), units(spark, 1, 2, 3, 5)))) == [1, 2, 3, 7]


def test_a_unit_without_readings_hides_no_other(spark, forty_days):
    assert sorted(ids(latest_one(read_table(spark, forty_days, "readings"), units(spark, 1, 2, 3, 50)))) == [1, 2, 3]


def test_feed_stops_at_fifty(spark, tmp_path):
    path = str(tmp_path / "alerts")
    rows = [alert(100 * day + i, unit_id=1 + i % 2, timestamp=ago(24 * day)) for day in range(30) for i in range(26)]
    write_table(alerts(spark, *rows), path, "alerts")
    spoil(path, keep=4)
    found = alert_feed(read_table(spark, path, "alerts"), units(spark, 1, 2))
    assert sorted(ids(found)) == sorted([*range(26), *range(102, 126)])
    # Alerts of unknown units do not count towards the fifty: 13 a day are left, and four days hold 52.
    assert alert_feed(read_table(spark, path, "alerts"), units(spark, 1)).count() == 50


def test_a_short_history_is_read_whole(spark, tmp_path):
    path = str(tmp_path / "alerts")
    write_table(alerts(spark, *[alert(i, timestamp=ago(24 * i)) for i in range(9)]), path, "alerts")
    assert alert_feed(read_table(spark, path, "alerts"), units(spark, 1)).count() == 9


@pytest.fixture()
def no_automatic_broadcast(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_receipts_leave_the_alerts_where_they_are(spark, tmp_path, capsys, no_automatic_broadcast):
    path = str(tmp_path / "alerts")
    write_table(alerts(spark, *[alert(i) for i in range(9)]), path, "alerts")
    stored, sent = read_table(spark, path, "alerts"), receipts(spark, 3, 3, 8, 77)
    text = plan(apply_receipts(stored, sent), capsys)
    assert "BroadcastHashJoin LeftOuter BuildRight" in text and "SortMergeJoin" not in text
    text = plan(unknown_receipts(stored, sent), capsys)
    assert "BroadcastHashJoin LeftSemi BuildRight" in text
    assert sorted(r.id for r in apply_receipts(stored, sent).filter("is_read").collect()) == [3, 8]
    assert [tuple(r) for r in unknown_receipts(stored, sent).collect()] == [(77, 1)]


def test_many_receipts_are_shuffled(spark, capsys, no_automatic_broadcast):
    rows, sent = alerts(spark, *[alert(i) for i in range(9)]), receipts(spark, 3, 3, 8, 77)
    assert "Broadcast" not in plan(apply_receipts(rows, sent, limit=0), capsys)
    assert sorted(r.id for r in apply_receipts(rows, sent, limit=0).filter("is_read").collect()) == [3, 8]
    assert [tuple(r) for r in unknown_receipts(rows, sent, limit=0).collect()] == [(77, 1)]


def test_only_hot_units_are_repeated(spark):
    rows = readings(spark, *[reading(i, 1 if i % 2 else 2 + i % 900, NOW) for i in range(2000)])
    assert joins.hot_keys(rows, "unit_id") == [1]
    names = joins.unit_names(units(spark, 1, *range(2, 902)))
    joined = joins.salted_join(rows, names, "unit_id", F.col("id"))
    assert joined.count() == 2000 and set(joined.columns) == {*rows.columns, "unit_name"}
    is_hot = F.col("unit_id").isin(joins.hot_keys(rows, "unit_id"))
    repeated = names.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(63))).otherwise(F.array(F.lit(0)))))
    assert repeated.count() == 64 + 900


def test_no_hot_unit_and_no_rows(spark):
    names = joins.unit_names(units(spark, *range(1, 600)))
    cold = readings(spark, *[reading(i, i, NOW) for i in range(1, 600)])
    assert joins.hot_keys(cold, "unit_id") == [] and joins.salted_join(cold, names, "unit_id", F.col("id")).count() == 599
    assert joins.salted_join(readings(spark), names, "unit_id", F.col("id")).count() == 0
