"""The registered queries: each takes a session and a folder of benchmark tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.text import iso_text, level_text, parameter_label
from tidewatch.functions.thresholds import PARAMETERS, severity_of, status_label
from tidewatch.functions.times import moment_literal
from tidewatch.operators import alerts as alert_ops
from tidewatch.operators import forecast as forecast_ops
from tidewatch.operators import quality
from tidewatch.operators import readings as reading_ops
from tidewatch.operators.recent import latest_times
from tidewatch.schemas import MEASURES
from tidewatch.session import shared_folder
from tidewatch.sources import fixtures as fx
from tidewatch.sources import generator
from tidewatch.sources.tables import json_documents, read_table, write_table
from tidewatch.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def _query(function: Query) -> Query:
    _REGISTRY[function.__name__] = function
    return function


def all_queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def _run_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tidewatch-{uuid.uuid4().hex}"


# Newest readings and bands


@_query
def latest_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_ops.flatten_status(reading_ops.latest_readings(fx.readings(spark, sf_dir), fx.units(spark, sf_dir)))


@_query
def latest_readings_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = fx.readings_hourly(spark, sf_dir)
    return reading_ops.flatten_status(reading_ops.latest_readings(hourly, fx.units(spark, sf_dir)))


@_query
def latest_times_per_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_times(fx.readings(spark, sf_dir)).selectExpr("*", f"{iso_text('timestamp')} AS timestamp_text")


@_query
def latest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest readings as JSON text."""
    return json_documents(reading_ops.latest_readings(fx.readings(spark, sf_dir), fx.units(spark, sf_dir)))


@_query
def band_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_ops.band_readings(fx.readings(spark, sf_dir))


@_query
def band_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_ops.band_counts(fx.readings(spark, sf_dir))


@_query
def classify_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every measure of every reading with severity, status and labels, light included."""
    rows = reading_ops.classify_long(fx.readings(spark, sf_dir))
    return rows.selectExpr(
        "*",
        f"{status_label('severity')} AS status",
        f"{parameter_label('parameter')} AS label",
        f"{level_text('severity')} AS level",
    )


@_query
def severity_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity where the parameter is a column's value, unknown ones included."""
    rows = fx.readings(spark, sf_dir).unpivot(["id"], list(MEASURES), "parameter", "value")
    banded = rows.selectExpr("parameter", f"{severity_of('parameter', 'value')} AS severity")
    return banded.groupBy("parameter", "severity").agg(F.count("*").alias("readings"))


# History


def _history(spark: SparkSession, sf_dir: str, hours: int, unit_ids=None) -> DataFrame:
    history = reading_ops.sensor_history(
        fx.readings(spark, sf_dir), fx.units(spark, sf_dir), fx.as_of(spark, sf_dir), hours, unit_ids
    )
    return reading_ops.flatten_status(history)


@_query
def sensor_history_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero hours are raised to one."""
    return _history(spark, sf_dir, 0)


@_query
def sensor_history_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir, 24)


@_query
def sensor_history_168h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir, 168)


@_query
def sensor_history_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More than a week is cut to a week."""
    return _history(spark, sf_dir, 9999)


@_query
def sensor_history_of_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir, 168, [3])


@_query
def sensor_history_of_chosen_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units chosen by another query: those with a large purchase event."""
    chosen = fx.load(spark, sf_dir, "events").filter("event_type = 'purchase' AND value > 60")
    ids = chosen.selectExpr("CAST(user_id % 30 + 3 AS INT) AS unit_id")
    return _history(spark, sf_dir, 24, ids)


@_query
def unknown_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_ops.unknown_units(fx.readings(spark, sf_dir), fx.units(spark, sf_dir))


@_query
def trend_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = reading_ops.history_rows(
        fx.readings(spark, sf_dir), fx.units(spark, sf_dir), fx.as_of(spark, sf_dir)
    )
    return reading_ops.trend_series(history)


# Units


@_query
def unit_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    overview = reading_ops.unit_overview(fx.units(spark, sf_dir), fx.readings(spark, sf_dir))
    return overview.selectExpr(
        "id",
        "name",
        "species",
        "status",
        "farmer_name",
        "latest_reading.id AS reading_id",
        *[f"latest_reading.{c} AS {c}" for c in ("timestamp", *MEASURES, "do_source")],
        *[f"latest_reading.status.{p} AS status_{p}" for p in (*PARAMETERS, "light_intensity")],
    )


@_query
def unit_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_ops.unit_state(reading_ops.unit_overview(fx.units(spark, sf_dir), fx.readings(spark, sf_dir)))


# Alerts


@_query
def generate_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alert_ops.generate_alerts(fx.units(spark, sf_dir), fx.readings(spark, sf_dir))


@_query
def alerts_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alert_ops.alerts_of_all(fx.units(spark, sf_dir), fx.readings(spark, sf_dir))


@_query
def alert_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alert_ops.alert_feed(fx.alerts(spark, sf_dir), fx.units(spark, sf_dir))


@_query
def critical_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alert_ops.critical_alert(alert_ops.alert_feed(fx.alerts(spark, sf_dir), fx.units(spark, sf_dir)))


@_query
def apply_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alert_ops.apply_receipts(fx.alerts(spark, sf_dir), fx.receipts(spark, sf_dir))


@_query
def unknown_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alert_ops.unknown_receipts(fx.alerts(spark, sf_dir), fx.receipts(spark, sf_dir))


def _feed_at(spark: SparkSession, sf_dir: str, hours_ago: int) -> DataFrame:
    moment = fx.as_of(spark, sf_dir) - timedelta(hours=hours_ago)
    known = fx.alerts(spark, sf_dir).filter(f"timestamp <= {moment_literal(moment)}")
    return alert_ops.alert_feed(known, fx.units(spark, sf_dir))


@_query
def new_dangers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dangers in the feed of now that the feed of an hour ago did not have."""
    return alert_ops.new_dangers(_feed_at(spark, sf_dir, 0), _feed_at(spark, sf_dir, 1))


@_query
def first_dangers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a previous feed every danger is new."""
    return alert_ops.new_dangers(_feed_at(spark, sf_dir, 0))


# Forecast


def _forecast(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return forecast_ops.forecast_do(
        fx.units(spark, sf_dir), fx.readings(spark, sf_dir), fx.as_of(spark, sf_dir), **options
    )


@_query
def forecast_do(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forecast(spark, sf_dir)


@_query
def forecast_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast_ops.forecast_status(_forecast(spark, sf_dir))


@_query
def forecast_declining_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The falling profile for every snapper unit, given as a condition."""
    return _forecast(spark, sf_dir, declining=F.col("species") == "snapper")


@_query
def forecast_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast_ops.forecast_features(fx.readings(spark, sf_dir), fx.as_of(spark, sf_dir))


@_query
def forecast_missing_oxygen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings without oxygen count as the missing value."""
    return forecast_ops.forecast_do(fx.units(spark, sf_dir), fx.dirty_readings(spark, sf_dir), fx.as_of(spark, sf_dir))


def _persistence(units: pd.DataFrame) -> pd.DataFrame:
    """A model that expects the newest value of each unit to last."""
    last = [values[-1] if len(values) else 5.5 for values in units["do_predicted"]]
    return pd.DataFrame({"do_now": last, "do_2h": last, "do_4h": last, "do_6h": last, "confidence": 0.5})


@_query
def forecast_with_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forecast(spark, sf_dir, model=_persistence, model_rows=6)


# Quality and generated data


@_query
def check_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.check_constraints(fx.units(spark, sf_dir), fx.readings(spark, sf_dir), fx.alerts(spark, sf_dir))


@_query
def check_constraints_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = fx.dirty_readings(spark, sf_dir)
    return quality.check_constraints(fx.dirty_units(spark, sf_dir), dirty, fx.alerts_of(dirty))


@_query
def apply_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_defaults(fx.dirty_readings(spark, sf_dir), "readings")


@_query
def generate_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit for each customer."""
    return generator.units_of(fx.load(spark, sf_dir, "customer").selectExpr("c_custkey + 1 AS id"))


@_query
def generate_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A week of readings for a unit per customer, every 25th of them declining."""
    return generator.generate_readings(
        fx.fleet(spark, sf_dir), fx.as_of(spark, sf_dir), declining=F.col("id") % 25 == 3
    )


@_query
def generated_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated readings stored by day, then the alerts of each unit's newest one."""
    fleet = fx.fleet(spark, sf_dir)
    path = f"{_run_folder(spark)}/readings"
    generated = generator.generate_readings(fleet, fx.as_of(spark, sf_dir), declining=F.col("id") % 25 == 3)
    write_table(generated, path, "readings")
    return alert_ops.generate_alerts(fleet, read_table(spark, path, "readings"))


# Streams, run over everything that has arrived and read back from their output


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A stream takes a folder or a pattern; the pattern fits the table as file and as folder.
    schema = fx.load(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")


def _append_and_read(spark: SparkSession, stream: DataFrame) -> DataFrame:
    folder = _run_folder(spark)
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/rows")
    live.run_available(writer, f"{folder}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


@_query
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = fx.readings_of(_event_stream(spark, sf_dir))
    return _append_and_read(spark, live.stream_alerts(readings, fx.units(spark, sf_dir)))


@_query
def stream_new_dangers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every alert arrives twice."""
    alerts = fx.alerts_of(fx.readings_of(_event_stream(spark, sf_dir)))
    return _append_and_read(spark, live.stream_new_dangers(alerts.unionByName(alerts)))


@_query
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _run_folder(spark)
    readings = fx.readings_of(_event_stream(spark, sf_dir))
    writer = live.latest_writer(readings, fx.units(spark, sf_dir), f"{folder}/latest")
    live.run_available(writer, f"{folder}/checkpoint")
    return reading_ops.flatten_status(live.latest_table(f"{folder}/latest").current(spark))


@_query
def stream_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _run_folder(spark)
    readings = fx.readings_of(_event_stream(spark, sf_dir))
    units, now = fx.units(spark, sf_dir), fx.as_of(spark, sf_dir)
    writer = live.forecast_writer(readings, units, f"{folder}/forecast", as_of=now)
    live.run_available(writer, f"{folder}/checkpoint")
    return live.forecast_table(f"{folder}/forecast").current(spark)
