"""Streams give what the batch operators give on the same rows."""

from __future__ import annotations

import shutil

import pytest
from pyspark.sql import functions as F

from tests.tables import NOW, ago, alert, alerts, ids, reading, readings, units
from tidewatch.operators.alerts import alerts_of_all, unread_dangers
from tidewatch.operators.forecast import forecast_do
from tidewatch.operators.readings import reading_documents
from tidewatch.operators.recent import latest_one
from tidewatch.sources.generator import generate_readings, generate_units
from tidewatch.streaming import live
from tidewatch.streaming.snapshots import SnapshotTable


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def fleet(spark):
    return generate_units(spark, 5)


@pytest.fixture(scope="module")
def arriving(spark, fleet, tmp_path_factory):
    """Readings in several files; each file is a batch, in no order of time."""
    path = str(tmp_path_factory.mktemp("arriving") / "readings")
    rows = generate_readings(fleet, NOW, hours=60)
    unknown = rows.filter("unit_id = 1").selectExpr("id + 100000 AS id", "99 AS unit_id", *rows.columns[2:])
    rows.unionByName(unknown).repartition(5, "id").write.parquet(path)
    return path


def stream(spark, path):
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_alerts(spark, fleet, arriving, tmp_path):
    found = live.stream_alerts(stream(spark, arriving), fleet)
    writer = found.writeStream.format("parquet").option("path", str(tmp_path / "rows"))
    live.run_available(writer, str(tmp_path / "checkpoint"))
    batch = alerts_of_all(fleet, spark.read.parquet(arriving))
    assert rows_of(spark.read.schema(found.schema).parquet(str(tmp_path / "rows"))) == rows_of(batch)
    live.run_available(writer, str(tmp_path / "checkpoint"))  # nothing new has arrived
    assert spark.read.parquet(str(tmp_path / "rows")).count() == batch.count()


def test_new_dangers_once(spark, tmp_path):
    source = str(tmp_path / "alerts")
    first = alerts(
        spark, alert(1, severity="danger"), alert(1, severity="danger"), alert(2), alert(3, severity="danger", is_read=True)
    )
    second = alerts(spark, alert(1, severity="danger"), alert(4, severity="danger", timestamp=ago(0.5)))
    first.coalesce(1).write.parquet(source)
    second.coalesce(1).write.mode("append").parquet(source)
    found = live.stream_new_dangers(stream(spark, source), delay="1 hour")
    writer = found.writeStream.format("parquet").option("path", str(tmp_path / "rows"))
    live.run_available(writer, str(tmp_path / "checkpoint"))
    rows = spark.read.schema(found.schema).parquet(str(tmp_path / "rows"))
    assert sorted(ids(rows)) == [1, 4]
    assert rows.columns == first.columns and unread_dangers(rows).count() == 2


def test_latest(spark, fleet, arriving, tmp_path):
    path = str(tmp_path / "latest")
    live.run_available(live.latest_writer(stream(spark, arriving), fleet, path), str(tmp_path / "checkpoint"))
    batch = reading_documents(latest_one(spark.read.parquet(arriving), fleet))
    found = live.latest_table(path).current(spark)
    assert rows_of(found) == rows_of(batch.select(*found.columns)) and found.count() == 5
    assert live.latest_table(path).versions(spark) == [2, 3, 4]


def test_latest_breaks_ties_by_id(spark, tmp_path):
    source = str(tmp_path / "readings")
    rows = readings(spark, *[reading(i, 1, NOW) for i in (4, 9, 2)], reading(11, 1, ago(1)))
    rows.repartition(3, "id").write.parquet(source)
    path = str(tmp_path / "latest")
    live.run_available(live.latest_writer(stream(spark, source), units(spark, 1), path), str(tmp_path / "checkpoint"))
    assert ids(live.latest_table(path).current(spark)) == [9]


def arrive(spark, source, *rows):
    readings(spark, *rows).coalesce(1).write.mode("append").parquet(source)


def forecasts(spark, path):
    return {r.unit_id: r.do_now for r in live.forecast_table(path).current(spark).collect()}


def test_forecast(spark, fleet, arriving, tmp_path):
    path = str(tmp_path / "state")
    fleet = fleet.unionByName(units(spark, 50))
    rows = spark.read.parquet(arriving)
    now = rows.agg(F.max("timestamp")).first()[0]
    live.run_available(live.forecast_writer(stream(spark, arriving), fleet, path, as_of=now), str(tmp_path / "checkpoint"))
    assert rows_of(live.forecast_table(path).current(spark)) == rows_of(forecast_do(fleet, rows, now))
    assert len(live.forecast_table(path).versions(spark)) == 3


def test_values_age_out_by_the_clock_alone(spark, tmp_path):
    """No reading moves the clock, not even one of the future or of an unknown unit; a later clock renews silent units."""
    source, path = str(tmp_path / "readings"), str(tmp_path / "state")
    fleet, table = units(spark, 1, 2, 4), live.forecast_table(str(tmp_path / "state"))

    def run(as_of):
        live.run_available(live.forecast_writer(stream(spark, source), fleet, path, as_of=as_of), str(tmp_path / "checkpoint"))
        return forecasts(spark, path)

    arrive(spark, source, reading(1, 1, ago(20), do_predicted=7.0), reading(2, 1, ago(10), do_predicted=6.0), reading(3, 4, ago(30)))
    assert run(NOW) == {1: 6.5, 2: 5.5, 4: 5.5}
    arrive(spark, source, reading(4, 2, ago(-100), do_predicted=6.0), reading(5, 99, ago(-500)))
    assert run(NOW) == {1: 6.5, 2: 6.0, 4: 5.5}
    # Five hours on, the older value of unit 1 is out of the window; a reading of unit 4 comes in.
    arrive(spark, source, reading(6, 4, ago(-1), do_predicted=4.5))
    assert run(ago(-5)) == {1: 6.0, 2: 6.0, 4: 4.5}
    arrive(spark, source, reading(7, 4, ago(-15), do_predicted=5.5))
    assert run(ago(-15)) == {1: 5.5, 2: 6.0, 4: 5.0}
    later = forecast_do(fleet, spark.read.parquet(source), ago(-15))
    assert rows_of(table.current(spark)) == rows_of(later)


def test_only_touched_and_expired_units_are_written(spark, tmp_path):
    source, path = str(tmp_path / "readings"), str(tmp_path / "state")
    fleet = units(spark, *range(1, 40))
    arrive(spark, source, *[reading(i, i, ago(1)) for i in range(1, 40)])
    live.run_available(live.forecast_writer(stream(spark, source), fleet, path, as_of=NOW), str(tmp_path / "checkpoint"))
    before = live.forecast_table(path)._folders(spark, 0)
    arrive(spark, source, reading(100, 7, ago(0)))
    live.run_available(live.forecast_writer(stream(spark, source), fleet, path, as_of=NOW), str(tmp_path / "checkpoint"))
    table = live.forecast_table(path)
    after = table._folders(spark, table.versions(spark)[-1])
    assert sum(before[b] != after[b] for b in after) == 1 and before.keys() == after.keys()


def test_a_value_on_the_edge_of_the_window_counts(spark, tmp_path):
    source, path = str(tmp_path / "readings"), str(tmp_path / "state")
    arrive(spark, source, reading(1, 1, ago(24), do_predicted=7.0))
    for as_of, expected in ((NOW, 7.0), (ago(-0.001), 5.5)):
        arrive(spark, source, reading(2, 2, ago(0)))
        live.run_available(live.forecast_writer(stream(spark, source), units(spark, 1, 2), path, as_of=as_of), str(tmp_path / "checkpoint"))
        assert forecasts(spark, path)[1] == expected


def test_snapshot_versions(spark, tmp_path):
    table = SnapshotTable(str(tmp_path / "snapshot"), units(spark).schema, key="id", buckets=4)
    assert table.current(spark).count() == 0
    table.update(units(spark, 1), 0)
    table.update(units(spark, 2, status_2="warning"), 1)
    table.update(units(spark, 3), 1)  # the batch runs again: its version stands
    assert sorted(ids(table.current(spark))) == [1, 2]
    table.update(units(spark, 2, 4), 2)
    assert {r.id: r.status for r in table.current(spark).collect()} == {1: "active", 2: "active", 4: "active"}
    table.update(units(spark), 3)  # nothing touched
    assert sorted(ids(table.current(spark))) == [1, 2, 4]


def test_a_reader_during_the_next_write_sees_a_whole_version(spark, tmp_path):
    table = SnapshotTable(str(tmp_path / "snapshot"), units(spark).schema, key="id", buckets=2)
    table.update(units(spark, *range(9)), 0)
    reader = table.current(spark)
    table.update(units(spark, *range(9, 20)), 1)
    table.update(units(spark, *range(20, 30)), 2)
    assert sorted(ids(reader)) == list(range(9))
    # A write that died before its version: its folder is there, but nothing names it.
    units(spark, 77).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{table.path}/data/3-dead")
    assert sorted(ids(table.current(spark))) == list(range(30))
    table.update(units(spark, 30), 3)
    assert sorted(ids(table.current(spark))) == list(range(31))
    assert "3-dead" not in [p.name for p in (tmp_path / "snapshot" / "data").iterdir()]
    assert table.versions(spark) == [1, 2, 3]


def test_a_lost_checkpoint_entry_replays_the_batch(spark, fleet, arriving, tmp_path):
    """The last batch is run again after its commit was lost, with the same result."""
    path, checkpoint = str(tmp_path / "state"), tmp_path / "checkpoint"
    writer = live.latest_writer(stream(spark, arriving), fleet, path)
    live.run_available(writer, str(checkpoint))
    before = rows_of(live.latest_table(path).current(spark))
    commits = sorted((int(p.name), p) for p in (checkpoint / "commits").iterdir() if p.name.isdigit())
    assert len(commits) == 5
    copy = tmp_path / "copy"
    last = commits[-1][1]
    shutil.copytree(checkpoint, copy, ignore=lambda d, names: [n for n in names if d.endswith("commits") and last.name in n])
    live.run_available(writer, str(copy))
    assert rows_of(live.latest_table(path).current(spark)) == before
