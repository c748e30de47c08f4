"""Queries over sensor readings."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.thresholds import KRITIS, PARAMETERS, STATUSES, severity, status, status_struct
from tidewatch.functions.times import DEFAULT_HOURS, SITE_ZONE, clamp_hours, local_time
from tidewatch.operators.joins import join_unit_names
from tidewatch.operators.recent import latest_one, latest_with_ties, since
from tidewatch.schemas import MEASURES


def reading_documents(named: DataFrame) -> DataFrame:
    """Readings with ``unit_name``, shaped for display, with their nested status."""
    return named.selectExpr(
        "id", "unit_id", "unit_name", "timestamp", *MEASURES, "do_source", f"{status_struct()} AS status"
    )


def flatten_status(documents: DataFrame) -> DataFrame:
    """The nested status as plain columns ``status_<parameter>``."""
    fields = documents.schema["status"].dataType.names
    plain = [c for c in documents.columns if c != "status"]
    return documents.selectExpr(*plain, *[f"status.{f} AS status_{f}" for f in fields])


def latest_readings(readings: DataFrame, units: DataFrame) -> DataFrame:
    """Newest reading(s) of each unit that has any, banded."""
    return reading_documents(latest_with_ties(readings, units))


def band_readings(readings: DataFrame) -> DataFrame:
    """Status of every reading."""
    return readings.selectExpr("id", "unit_id", "timestamp", *[f"{status(p)} AS status_{p}" for p in PARAMETERS])


def band_counts(readings: DataFrame) -> DataFrame:
    """Readings per parameter and status, from one pass without widening the rows."""
    bands = [(p, label) for p in PARAMETERS for label in STATUSES]
    banded = readings.selectExpr(*[f"{status(p)} AS {p}" for p in PARAMETERS])
    counts = banded.agg(*[F.expr(f"count_if({p} = '{label}') AS {p}_{label}") for p, label in bands])
    rows = ", ".join(f"'{p}', '{label}', {p}_{label}" for p, label in bands)
    return counts.selectExpr(f"stack({len(bands)}, {rows}) AS (parameter, status, readings)")


def history_rows(
    readings: DataFrame,
    units: DataFrame,
    as_of: datetime | str,
    hours: int | None = DEFAULT_HOURS,
    unit_ids: Iterable[int] | DataFrame | None = None,
) -> DataFrame:
    """The rows of ``sensor_history`` in no order.

    Ids in a list are looked up at the scan. Ids in a table select among the
    units, so the readings take part in one join either way.
    """
    recent = since(readings, as_of, clamp_hours(hours))
    chosen = units
    if isinstance(unit_ids, DataFrame):
        chosen = units.join(unit_ids.selectExpr("unit_id AS id").distinct(), "id", "left_semi")
    elif unit_ids is not None:
        recent = recent.filter(F.col("unit_id").isin(*unit_ids))
    return reading_documents(join_unit_names(recent, chosen, within=units))


def sensor_history(
    readings: DataFrame,
    units: DataFrame,
    as_of: datetime | str,
    hours: int | None = DEFAULT_HOURS,
    unit_ids: Iterable[int] | DataFrame | None = None,
) -> DataFrame:
    """Banded readings of the last ``hours`` (1 to 168) in time order, of all units or of some."""
    return history_rows(readings, units, as_of, hours, unit_ids).orderBy("timestamp", "id")


def unknown_units(requested: DataFrame, units: DataFrame) -> DataFrame:
    """Requested ``unit_id`` values that no unit has, as opposed to units without readings."""
    asked = requested.filter("unit_id IS NOT NULL").groupBy("unit_id").agg(F.count("*").alias("requests"))
    return asked.join(units.selectExpr("id AS unit_id"), "unit_id", "left_anti")


def trend_series(history: DataFrame, zone: str = SITE_ZONE) -> DataFrame:
    """Oxygen and temperature as one long series per unit, with the local time."""
    return history.selectExpr(
        "id",
        "unit_id",
        "unit_name",
        "timestamp",
        f"{local_time('timestamp', zone)} AS local_time",
        "stack(2, 'do_predicted', do_predicted, 'temperature', temperature) AS (series, value)",
    )


def unit_overview(units: DataFrame, readings: DataFrame) -> DataFrame:
    """Every unit with its newest reading nested, or NULL when it has none."""
    latest = reading_documents(latest_one(readings, units))
    nested = latest.selectExpr("unit_id AS id", f"struct({', '.join(latest.columns)}) AS latest_reading")
    return (
        units.join(nested, "id", "left")
        .select("id", "name", "species", "status", "farmer_name", "latest_reading")
        .orderBy("id")
    )


# The states of a unit on the map.
WARNING, CRITICAL, OK = "warning", "critical", "ok"


def unit_state(overview: DataFrame) -> DataFrame:
    """A unit set to warning stays so, whatever its newest oxygen reading says."""
    state = (
        f"CASE WHEN status = 'warning' THEN '{WARNING}'"
        f" WHEN latest_reading.status.do_predicted = '{KRITIS}' THEN '{CRITICAL}' ELSE '{OK}' END"
    )
    return overview.selectExpr("id", "name", "status", f"{state} AS state")


def classify_long(readings: DataFrame) -> DataFrame:
    """One row per reading and measure, with its severity (NULL for unchecked measures)."""
    rows = ", ".join(f"'{m}', {m}, {severity(m)}" for m in MEASURES)
    return readings.selectExpr("id", f"stack({len(MEASURES)}, {rows}) AS (parameter, value, severity)")
