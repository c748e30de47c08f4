import json

import pytest
from pyspark.sql import functions as F

from tests.tables import NOW, ago, alert, alerts, ids, reading, readings, receipts, units
from tidewatch.operators.alerts import generate_alerts
from tidewatch.operators.readings import latest_readings, sensor_history, unit_overview
from tidewatch.operators.recent import latest_one, latest_with_ties, since
from tidewatch.schemas import TABLES
from tidewatch.sources.generator import generate_readings, generate_units
from tidewatch.sources.tables import (
    create_tables,
    insert_new,
    insert_rows,
    json_documents,
    read_table,
    recreate_tables,
    write_json_lines,
    write_table,
)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables") / "readings")
    write_table(generate_readings(generate_units(spark, 6), NOW), path, "readings")
    return path


def test_round_trip(spark, stored):
    rows = read_table(spark, stored, "readings")
    generated = generate_readings(generate_units(spark, 6), NOW)
    assert rows.columns == [*generated.columns, "date"]
    assert rows.drop("date").exceptAll(generated).count() == 0 and rows.count() == generated.count()
    assert rows.filter("date <> to_date(timestamp)").count() == 0


def test_files_per_day(spark, stored):
    rows = read_table(spark, stored, "readings").select("date", F.input_file_name().alias("file")).distinct()
    assert rows.count() == rows.select("date").distinct().count() == 8


def test_stored_and_plain_readings_answer_alike(spark, stored):
    """The day column only prunes; results are those of the unpartitioned table."""
    fleet = generate_units(spark, 6)
    day = read_table(spark, stored, "readings")
    plain = generate_readings(fleet, NOW)
    for query in (
        lambda r: latest_readings(r, fleet),
        lambda r: sensor_history(r, fleet, NOW, 30),
        lambda r: generate_alerts(fleet, r),
        lambda r: unit_overview(fleet, r),
    ):
        assert sorted(map(str, query(day).collect())) == sorted(map(str, query(plain).collect()))


@pytest.mark.parametrize("limit", [None, 0])
def test_a_unit_silent_for_days_is_still_latest(spark, tmp_path, limit):
    fleet = units(spark, 1, 2)
    path = str(tmp_path / "readings")
    write_table(readings(spark, reading(1, 1, ago(0)), reading(2, 2, ago(90 * 24)), reading(3, 1, ago(48))), path, "readings")
    stored = read_table(spark, path, "readings")
    assert sorted(ids(latest_with_ties(stored, fleet, limit))) == sorted(ids(latest_one(stored, fleet, limit))) == [1, 2]


def test_append_and_overwrite(spark, tmp_path):
    path = str(tmp_path / "alerts")
    write_table(alerts(spark, alert(1)), path, "alerts")
    write_table(alerts(spark, alert(2, is_read=None)), path, "alerts")
    rows = read_table(spark, path, "alerts")
    assert {r.id: r.is_read for r in rows.collect()} == {1: False, 2: False}
    write_table(alerts(spark, alert(3)), path, "alerts", mode="overwrite")
    assert ids(read_table(spark, path, "alerts")) == [3]


def test_inserting_again_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "readings")
    fleet = generate_units(spark, 3)
    first, second = (generate_readings(fleet, moment, 30) for moment in (ago(24), NOW))
    for rows in (first, first, second, first.unionByName(second)):
        insert_new(rows, path, "readings")
    stored = read_table(spark, path, "readings")
    assert stored.count() == stored.select("id").distinct().count() == 3 * 54
    path = str(tmp_path / "alerts")
    odd = alerts(spark, alert(1), alert(1), alert(2)).withColumn("timestamp", F.expr("if(id = 2, NULL, timestamp)"))
    for _ in range(2):
        insert_new(odd, path, "alerts")
    assert sorted(ids(read_table(spark, path, "alerts"))) == [1, 2]
    for _ in range(2):
        insert_new(receipts(spark, 7, 7, 8), str(tmp_path / "receipts"), "receipts")
    assert sorted(ids(read_table(spark, str(tmp_path / "receipts"), "receipts"), "alert_id")) == [7, 8]


def test_catalog_tables(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS monitoring")
    create_tables(spark, "monitoring")
    insert_rows(units(spark, 1, 2), "units", "monitoring")
    insert_rows(readings(spark, reading(1, 1, NOW), reading(2, 2, ago(30), do_source=None)), "readings", "monitoring")
    insert_rows(alerts(spark, alert(1)), "alerts", "monitoring")
    insert_rows(receipts(spark, 1), "receipts", "monitoring")
    create_tables(spark, "monitoring")  # leaves existing tables alone
    assert {t: spark.table(f"monitoring.{t}").count() for t in TABLES} == {
        "units": 2, "readings": 2, "alerts": 1, "receipts": 1
    }
    assert spark.table("monitoring.readings").filter("do_source = 'tft'").count() == 2
    assert ids(since(spark.table("monitoring.readings"), NOW, 24)) == [1]
    recreate_tables(spark, "monitoring")
    assert {spark.table(f"monitoring.{t}").count() for t in TABLES} == {0}


def test_json_documents(spark, tmp_path):
    fleet = units(spark, 1, 2)
    overview = unit_overview(fleet, readings(spark, reading(1, 1, NOW, ph=6.5)))
    first, second = [json.loads(r.document) for r in json_documents(overview).collect()]
    assert first["latest_reading"]["timestamp"] == NOW.isoformat()
    assert first["latest_reading"]["status"] == {
        "ph": "kritis", "temperature": "normal", "salinity": "normal", "turbidity": "normal",
        "do_predicted": "normal", "light_intensity": "normal",
    }
    assert second == {
        "id": 2, "name": "U-02", "species": "snapper", "status": "active", "farmer_name": "Farmer 2", "latest_reading": None
    }
    write_json_lines(overview, str(tmp_path / "json"))
    lines = spark.read.json(str(tmp_path / "json"))
    assert lines.filter("latest_reading.ph = 6.5").count() == 1 and lines.count() == 2
