"""Lookback ranges and newest-rows-per-unit selection."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.times import hours_before
from tidewatch.operators.joins import join_unit_names, names_fit_broadcast, unit_names


def since(rows: DataFrame, as_of: datetime | str, hours: int) -> DataFrame:
    """Rows with ``timestamp >= as_of - hours``: inclusive, and open towards the future.

    The bound is a literal of the column's own type, so it reaches the Parquet
    scan; on a date-partitioned table the second predicate prunes whole days.
    """
    bound = hours_before(as_of, hours)
    kind = rows.schema["timestamp"].dataType.simpleString()
    kept = rows.filter(f"timestamp >= CAST('{bound.isoformat(sep=' ')}' AS {kind})")
    if stored_days(rows):
        kept = kept.filter(f"date >= DATE'{bound.date().isoformat()}'")
    return kept


def stored_days(rows: DataFrame) -> list[date]:
    """Days of a table that is stored by day, newest first; none for any other table.

    Taken from the listing of its files, none of which is opened. A column that is only
    called ``date`` does not make a table one stored by day.
    """
    if dict(rows.dtypes).get("date") != "date":
        return []
    found = {m[1] for f in rows.inputFiles() if (m := re.search(r"/date=(\d{4}-\d\d-\d\d)/", f))}
    return sorted(map(date.fromisoformat, found), reverse=True)


def from_newest_days(rows: DataFrame, days: list[date], enough: Callable[[DataFrame], bool]) -> DataFrame:
    """The rows of so many newest days that ``enough`` holds of them, or of all days.

    One day is tried, then 4, 16 and so on, so that days far back are opened only when the
    newer ones do not do, and all tries together read a third more than the last one.
    """
    n = 1
    while n < len(days):
        part = rows.filter(F.col("date") >= F.lit(days[n - 1]))
        if enough(part):
            return part
        n *= 4
    return rows.filter("date IS NOT NULL")


def last_rows(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest rows of each unit, the higher id winning a tie.

    Each task keeps at most ``n`` rows per unit before the shuffle, so a unit
    with a large share of the rows sends no more than any other.
    """
    numbered = rows.selectExpr(
        "*", "row_number() OVER (PARTITION BY unit_id ORDER BY timestamp DESC, id DESC) AS _position"
    )
    return numbered.filter(f"_position <= {n}").drop("_position")


def latest_times(readings: DataFrame) -> DataFrame:
    """Newest timestamp of each unit: a hash aggregate over two columns."""
    present = readings.filter("unit_id IS NOT NULL AND timestamp IS NOT NULL")
    return present.groupBy("unit_id").agg(F.max("timestamp").alias("timestamp"))


def on_days(rows: DataFrame, days: DataFrame) -> DataFrame:
    """Rows of a day-partitioned table on the days in column ``date`` of ``days``.

    The days become one value known before the scan starts, so other partitions
    are not listed for reading. It has at most one entry per day of the table.
    """
    wanted = days.agg(F.collect_set("date"))
    return rows.filter(F.array_contains(wanted.scalar(), F.col("date")))


def _latest_days(readings: DataFrame) -> DataFrame:
    """Newest day of each unit. Reads only the unit ids, as the day is known per file and every dated row has a time."""
    return readings.filter("unit_id IS NOT NULL").groupBy("unit_id").agg(F.max("date").alias("date"))


def _with_all_newest(readings: DataFrame, units: DataFrame, days: list[date], limit: int | None) -> DataFrame:
    """The newest days of a stored table that hold a reading of every known unit; of all its days if some unit has none."""
    names = unit_names(units).select("unit_id").distinct()
    known = names.count()
    names = F.broadcast(names) if names_fit_broadcast(units, limit) else names

    def enough(part: DataFrame) -> bool:
        return part.select("unit_id").distinct().join(names, "unit_id", "left_semi").count() == known

    return from_newest_days(readings, days, enough)


def _at_latest_times(readings: DataFrame, names: DataFrame) -> DataFrame:
    """Readings at their unit's newest time.

    Two passes instead of sorting the whole table: the first finds one time per
    unit, the second keeps the rows at those times by a broadcast join, which
    needs neither sort nor shuffle of the readings. The broadcast side has at
    most one row per known unit.
    """
    keys = latest_times(readings).join(F.broadcast(names), "unit_id")
    return readings.join(F.broadcast(keys), ["unit_id", "timestamp"])


def _on_latest_days(readings: DataFrame, names: DataFrame) -> DataFrame:
    """The same for a day-partitioned table, up to the day: a cheaper first pass, and few files in the second."""
    days = _latest_days(readings).join(F.broadcast(names), "unit_id")
    return on_days(readings, days).join(F.broadcast(days), ["unit_id", "date"])


def _newest(
    readings: DataFrame, units: DataFrame, limit: int | None, pick: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Applies ``pick`` to a part of the readings that has all newest ones, and adds ``unit_name``."""
    days = stored_days(readings)
    if days:
        readings = _with_all_newest(readings, units, days, limit)
    if names_fit_broadcast(units, limit):
        narrow = _on_latest_days if days else _at_latest_times
        return pick(narrow(readings, unit_names(units)).filter("timestamp IS NOT NULL"))
    rows = on_days(readings, _latest_days(readings)) if days else readings
    return join_unit_names(pick(rows.filter("timestamp IS NOT NULL")), units, limit)


def _newest_ties(rows: DataFrame) -> DataFrame:
    ranked = rows.selectExpr("*", "rank() OVER (PARTITION BY unit_id ORDER BY timestamp DESC) AS _rank")
    return ranked.filter("_rank = 1").drop("_rank")


def latest_with_ties(readings: DataFrame, units: DataFrame, limit: int | None = None) -> DataFrame:
    """All readings at the newest time of each known unit, plus ``unit_name``; readings without a time do not count."""
    if not stored_days(readings) and names_fit_broadcast(units, limit):
        return _at_latest_times(readings, unit_names(units))
    return _newest(readings, units, limit, _newest_ties)


def latest_one(readings: DataFrame, units: DataFrame, limit: int | None = None) -> DataFrame:
    """One newest reading of each known unit, the highest id among ties, plus ``unit_name``.

    Readings without a time do not count.
    """
    return _newest(readings, units, limit, lambda rows: last_rows(rows, 1))
