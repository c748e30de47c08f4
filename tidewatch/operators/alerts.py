"""Alerts: raising, listing, ranking, read receipts and change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import PARAMETER_LABELS, alert_message
from tidewatch.functions.thresholds import PARAMETERS, may_alert, severity
from tidewatch.operators.joins import fits_broadcast, join_unit_names, names_fit_broadcast, unit_names
from tidewatch.operators.recent import from_newest_days, latest_one, on_days, stored_days

# Fixed value: length of the alert list.
FEED_LENGTH = 50


def raise_alerts(named: DataFrame) -> DataFrame:
    """Alerts of readings that carry a ``unit_name``; works on batches and streams.

    The id follows from the reading and the parameter, so raising the same
    readings again gives the same alerts. One pass: rows without any breach are
    dropped at the scan, the rest are unfolded into one row per parameter.
    """
    checks = ", ".join(
        f"{position}L, '{p}', '{PARAMETER_LABELS[p]}', {p}, {severity(p)}" for position, p in enumerate(PARAMETERS)
    )
    unfolded = named.filter(may_alert()).selectExpr(
        "id AS reading_id",
        "unit_id",
        "unit_name",
        "timestamp",
        f"stack({len(PARAMETERS)}, {checks}) AS (position, parameter, label, value, severity)",
    )
    return unfolded.filter("severity IS NOT NULL").selectExpr(
        f"reading_id * {len(PARAMETERS)} + position AS id",
        "unit_id",
        "parameter",
        "severity",
        f"{alert_message('unit_name', 'label', 'value', 'severity')} AS message",
        "timestamp",
        "false AS is_read",
    )


def generate_alerts(units: DataFrame, readings: DataFrame) -> DataFrame:
    """Alerts of each unit's newest reading."""
    return raise_alerts(latest_one(readings, units))


def alerts_of_all(units: DataFrame, readings: DataFrame) -> DataFrame:
    """Alerts of every reading of a known unit."""
    return raise_alerts(join_unit_names(readings, units))


def _on_newest_days(alerts: DataFrame, units: DataFrame, n: int) -> DataFrame:
    """The days of a day-partitioned table that can hold the ``n`` newest alerts of known units.

    Days are taken newest first until they hold ``n`` such alerts; older folders are not
    opened. Within these days, alerts are counted per day and unit before units are
    joined; a day counts when fewer than ``n`` alerts are newer. The window sees one row per day.
    """
    names = unit_names(units)
    names = F.broadcast(names) if names_fit_broadcast(units) else names

    def enough(part: DataFrame) -> bool:
        return part.select("unit_id").join(names, "unit_id", "left_semi").limit(n).count() == n

    alerts = from_newest_days(alerts, stored_days(alerts), enough)
    per_unit = alerts.groupBy("date", "unit_id").agg(F.count("*").alias("n"))
    per_day = per_unit.join(names, "unit_id").groupBy("date").agg(F.sum("n").alias("n"))
    newer = per_day.selectExpr("date", "sum(n) OVER (ORDER BY date DESC) - n AS newer")
    return on_days(alerts, newer.filter(F.col("newer") < n))


def alert_feed(alerts: DataFrame, units: DataFrame, n: int = FEED_LENGTH) -> DataFrame:
    """The ``n`` newest alerts of known units, newest first; alerts without a time are in no feed."""
    if stored_days(alerts):
        alerts = _on_newest_days(alerts, units, n)
    named = join_unit_names(alerts.filter("timestamp IS NOT NULL"), units)
    return (
        named.select("id", "unit_id", "unit_name", "parameter", "severity", "message", "timestamp", "is_read")
        .orderBy(F.desc("timestamp"), F.desc("id"))
        .limit(n)
    )


def unread_dangers(alerts: DataFrame) -> DataFrame:
    return alerts.filter("severity = 'danger' AND NOT coalesce(is_read, false)")


def critical_alert(feed: DataFrame) -> DataFrame:
    """The unread alert of a feed to show first: danger, then warn, then any; at most one row."""
    urgency = F.expr("CASE severity WHEN 'danger' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END")
    return feed.filter("NOT coalesce(is_read, false)").orderBy(urgency, F.desc("timestamp"), F.desc("id")).limit(1)


def new_dangers(feed: DataFrame, previous_feed: DataFrame | None = None) -> DataFrame:
    """Unread dangers of a feed that the previous feed did not show as such.

    Without a previous feed all of them are new. An alert that left the list and
    came back is new again, because only the last feed is remembered.
    """
    current = unread_dangers(feed)
    if previous_feed is None:
        return current
    return current.join(unread_dangers(previous_feed).select("id"), "id", "left_anti").select(*feed.columns)


def apply_receipts(alerts: DataFrame, receipts: DataFrame, limit: int | None = None) -> DataFrame:
    """Alerts with ``is_read`` set where a receipt exists. Repeated receipts change nothing.

    Receipts are reduced to one row per alert before the join, so neither side
    repeats a key. Their size is measured: up to the bound they go to the alerts, which
    then stay where they are; beyond it both are shuffled.
    """
    read = receipts.filter("alert_id IS NOT NULL").selectExpr("alert_id AS id").distinct()
    fits = fits_broadcast(read, limit)
    read = read.selectExpr("id", "true AS _receipt")
    read = F.broadcast(read) if fits else read
    kept = [c if c != "is_read" else "is_read OR coalesce(_receipt, false) AS is_read" for c in alerts.columns]
    return alerts.join(read, "id", "left").selectExpr(*kept)


def unknown_receipts(alerts: DataFrame, receipts: DataFrame, limit: int | None = None) -> DataFrame:
    """Receipts for alerts that do not exist, with how often each was sent.

    The alerts are first reduced to those that have a receipt: by a broadcast of the
    measured receipts, or, beyond the bound, by a semi-join that Spark may prune with a
    Bloom filter at the scan. Only these ids meet the receipts.
    """
    sent = receipts.filter("alert_id IS NOT NULL").groupBy("alert_id").agg(F.count("*").alias("receipts"))
    asked = sent.select("alert_id")
    asked = F.broadcast(asked) if fits_broadcast(asked, limit) else asked
    hit = alerts.selectExpr("id AS alert_id").join(asked, "alert_id", "left_semi").distinct()
    return sent.join(hit, "alert_id", "left_anti")
