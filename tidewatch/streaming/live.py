"""The monitoring queries over arriving data.

Batch tables carry naive times; a watermark needs a zoned one, so the event time
is cast where a stream needs it and the stored column is left as it is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from tidewatch.functions.thresholds import PARAMETERS
from tidewatch.functions.times import naive_utc
from tidewatch.operators.alerts import raise_alerts, unread_dangers
from tidewatch.operators.forecast import DECLINING_IDS, FORECAST_FIELDS, WINDOW_HOURS, WINDOW_ROWS, forecast_from
from tidewatch.operators.joins import join_unit_names
from tidewatch.operators.readings import reading_documents
from tidewatch.schemas import MEASURES, READINGS
from tidewatch.session import SETTINGS
from tidewatch.streaming.snapshots import SnapshotTable


def stream_alerts(readings: DataFrame, units: DataFrame) -> DataFrame:
    """Alerts of every arriving reading of a known unit.

    Stateless. Ids follow from the readings, so a replayed batch gives the same
    alerts again.
    """
    return raise_alerts(join_unit_names(readings, units))


def stream_new_dangers(alerts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each unread danger once, however late it arrives.

    An id is remembered for ``delay`` after its arrival; the alert's own time plays
    no part, so that no danger is too late. A repeat that arrives after that is
    reported again, as a poll does with an alert that left the list and came back.
    """
    timed = unread_dangers(alerts).withColumn("_arrived", F.current_timestamp())
    return timed.withWatermark("_arrived", delay).dropDuplicatesWithinWatermark(["id"]).drop("_arrived")


def stream_latest(readings: DataFrame) -> DataFrame:
    """The newest reading per unit, for update mode; the highest id wins a tie.

    State is one row per unit, and every task reduces its part of a batch to one
    row per unit before the shuffle. Readings without a unit are left out.
    """
    readings = readings.filter("unit_id IS NOT NULL")
    newest = f"max_by(struct({', '.join(READINGS.names)}), struct(timestamp, id)) AS _newest"
    return readings.groupBy("unit_id").agg(F.expr(newest)).select("_newest.*")


def latest_writer(readings: DataFrame, units: DataFrame, path: str) -> DataStreamWriter:
    """Keeps a table of the newest reading per known unit in ``path``, with name and bands."""
    table = latest_table(path)

    def merge(updates: DataFrame, batch_id: int) -> None:
        # Used twice by the table; the state must run once per batch.
        updates = updates.persist()
        try:
            table.update(reading_documents(join_unit_names(updates, units)), batch_id)
        finally:
            updates.unpersist()

    return stream_latest(readings).writeStream.outputMode("update").foreachBatch(merge)


def latest_table(path: str) -> SnapshotTable:
    status = T.StructType([T.StructField(p, T.StringType()) for p in (*PARAMETERS, "light_intensity")])
    plain = {f.name: T.StructField(f.name, f.dataType) for f in READINGS.fields}
    first = [plain["id"], plain["unit_id"], T.StructField("unit_name", T.StringType()), plain["timestamp"]]
    rest = [plain[name] for name in (*MEASURES, "do_source")]
    return SnapshotTable(path, T.StructType([*first, *rest, T.StructField("status", status)]))


_FORECAST = T.StructType(
    [
        T.StructField("unit_id", T.IntegerType()),
        T.StructField("unit_name", T.StringType()),
        *[T.StructField(name, T.DoubleType()) for name in FORECAST_FIELDS],
    ]
)
_WINDOW_MICROS = WINDOW_HOURS * 3_600_000_000
_VALUE = "micros BIGINT, id BIGINT, do_predicted DOUBLE"


def forecast_table(path: str) -> SnapshotTable:
    return SnapshotTable(path, _FORECAST)


class RecentOxygen(StatefulProcessor):
    """The newest oxygen values of a unit within the window, and a timer for when the oldest of them leaves it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._kept = handle.getListState("kept", _VALUE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        values = [tuple(v) for v in self._kept.get()] if self._kept.exists() else []
        now = None
        for row in rows:
            now = row.now
            values.append((row.micros, row.id, row.do_predicted))
        yield self._settle(key, values, now, turn=0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        values = [tuple(v) for v in self._kept.get()] if self._kept.exists() else []
        yield self._settle(key, values, 1000 * timerValues.getCurrentWatermarkInMs(), turn=1)

    def _settle(self, key, values: list[tuple], now: int, turn: int) -> Row:
        inside = [v for v in values if v[0] >= now - _WINDOW_MICROS]
        kept = sorted(inside, key=lambda v: v[:2], reverse=True)[:WINDOW_ROWS]
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        if kept:
            self._kept.put(kept)
            # The first whole millisecond at which the oldest value is more than the window old.
            self._handle.registerTimer((kept[-1][0] + _WINDOW_MICROS) // 1000 + 1)
        else:
            self._kept.clear()
        return Row(unit_id=key[0], turn=turn, kept=kept)

    def close(self) -> None:
        pass


def stream_recent(readings: DataFrame, as_of: datetime | str | None = None) -> DataFrame:
    """unit_id, turn, kept: the values a forecast needs, of every unit that is touched or whose oldest value leaves.

    The clock is ``as_of``, or the time of each batch. It is the event time of all rows, so
    the watermark follows the clock alone: no reading, whatever its time, moves it. A
    later ``as_of`` is given by starting the query anew on the same checkpoint; units whose
    values have left the window by then are renewed though no reading of theirs arrives.
    A second of delay is added to the clock and taken back by the watermark, which
    drops rows that are not later than itself.
    """
    now = F.current_timestamp() if as_of is None else F.expr(f"timestamp_micros({_micros(naive_utc(as_of))})")
    # Times are naive: counted from 1970 without any zone.
    micros = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', timestamp)"
    rows = (
        readings.filter("unit_id IS NOT NULL AND timestamp IS NOT NULL")
        .select("unit_id", "id", "do_predicted", F.expr(f"{micros} AS micros"), now.alias("clock"))
        .selectExpr("unit_id", "id", "do_predicted", "micros", "unix_micros(clock) AS now", "clock + INTERVAL 1 SECOND AS clock")
    )
    return (
        rows.withWatermark("clock", "1 second")
        .groupBy("unit_id")
        .transformWithState(RecentOxygen(), f"unit_id INT, turn INT, kept ARRAY<STRUCT<{_VALUE}>>", "update", "EventTime")
    )


def _micros(moment: datetime) -> int:
    return (moment - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def forecast_writer(
    readings: DataFrame,
    units: DataFrame,
    path: str,
    declining: Column | Iterable[int] = DECLINING_IDS,
    as_of: datetime | str | None = None,
) -> DataStreamWriter:
    """Keeps the forecast of every unit in ``path``, as of ``as_of`` or of the time of each batch.

    At most six values per unit are kept between batches. The first batch writes all units;
    later ones only those whose readings arrived or whose oldest value left the 24 h
    window. A unit that is added to ``units`` later has a forecast from its first reading on.
    """
    # Timers and lists of values need this kind of state store.
    readings.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass", SETTINGS["spark.sql.streaming.stateStore.providerClass"]
    )
    table = forecast_table(path)

    def refresh(updates: DataFrame, batch_id: int) -> None:
        # A unit that is touched and whose timer fires in one batch comes twice; the timer's row is the later one.
        newest = updates.groupBy("unit_id").agg(F.max_by("kept", "turn").alias("kept")).persist()
        try:
            first = not table.versions(updates.sparkSession)
            chosen = units if first else units.join(newest.selectExpr("unit_id AS id"), "id", "left_semi")
            recent = newest.selectExpr("unit_id", "inline(kept)").select("unit_id", "do_predicted")
            table.update(forecast_from(chosen, recent, declining), batch_id)
        finally:
            newest.unpersist()

    return stream_recent(readings, as_of).writeStream.outputMode("update").foreachBatch(refresh)


def run_available(writer: DataStreamWriter, checkpoint: str) -> None:
    """Processes what has arrived, then stops."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
