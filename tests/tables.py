"""Small hand-written tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from tidewatch.schemas import ALERTS, READINGS, RECEIPTS, UNITS

NOW = datetime(2024, 3, 10, 12, 30, 15)

CALM = {
    "ph": 8.0,
    "temperature": 28.0,
    "salinity": 30.0,
    "turbidity": 10.0,
    "light_intensity": 20000.0,
    "do_predicted": 6.0,
}


def ago(hours: float) -> datetime:
    return NOW - timedelta(hours=hours)


def units(spark, *ids, **changes):
    rows = [
        (i, f"U-{i:02d}", "grouper" if i % 2 else "snapper", changes.get(f"status_{i}", "active"), f"Farmer {i}")
        for i in ids
    ]
    return spark.createDataFrame(rows, UNITS)


def nullable(schema):
    for field in schema.fields:
        field.nullable = True
    return schema


def reading(id, unit_id, timestamp, **values):
    row = {**CALM, **values}
    return (id, unit_id, timestamp, *[row[m] for m in CALM], values.get("do_source", "tft"))


def readings(spark, *rows):
    from copy import deepcopy

    return spark.createDataFrame(list(rows), nullable(deepcopy(READINGS)))


def alerts(spark, *rows):
    return spark.createDataFrame(list(rows), ALERTS)


def alert(id, unit_id=1, severity="warn", timestamp=NOW, is_read=False, parameter="ph"):
    return (id, unit_id, parameter, severity, f"message {id}", timestamp, is_read)


def receipts(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], RECEIPTS)


def ids(df, column="id"):
    return [row[column] for row in df.collect()]
