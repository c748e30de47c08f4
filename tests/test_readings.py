import math

import pytest

from tests.tables import NOW, ago, ids, reading, readings, units
from tidewatch.operators.alerts import alerts_of_all, generate_alerts
from tidewatch.operators.joins import join_unit_names, measured_bytes, names_fit_broadcast
from tidewatch.operators.readings import (
    band_counts,
    band_readings,
    latest_readings,
    sensor_history,
    trend_series,
    unit_overview,
    unit_state,
    unknown_units,
)
from tidewatch.operators.recent import last_rows, latest_one, latest_with_ties, since

# None: the measured size decides, which broadcasts. 0: nothing may be broadcast.
PATHS = pytest.mark.parametrize("limit", [None, 0])


@pytest.fixture(scope="module")
def few(spark):
    """Unit 1 with a tie, unit 2 with a future row, unit 4 empty, unit 9 unknown."""
    return readings(
        spark,
        reading(1, 1, ago(3)),
        reading(2, 1, ago(1), ph=6.0),
        reading(3, 1, ago(1), do_predicted=4.5),
        reading(4, 2, ago(24)),
        reading(5, 2, ago(-2), temperature=40.0),
        reading(6, 9, ago(0)),
        reading(7, 3, ago(200)),
    )


@pytest.fixture(scope="module")
def four(spark):
    return units(spark, 1, 2, 3, 4)


@PATHS
def test_latest_keeps_ties(few, four, limit):
    assert sorted(ids(latest_with_ties(few, four, limit))) == [2, 3, 5, 7]


@PATHS
def test_latest_one_takes_highest_id(few, four, limit):
    rows = {r.unit_id: (r.id, r.unit_name) for r in latest_one(few, four, limit).collect()}
    assert rows == {1: (3, "U-01"), 2: (5, "U-02"), 3: (7, "U-03")}


def test_latest_documents_carry_status(few, four):
    rows = {r.id: r.status for r in latest_readings(few, four).collect()}
    assert rows[2].ph == "kritis" and rows[2].light_intensity == "normal"
    assert rows[3].do_predicted == "perhatian" and rows[3].ph == "normal"


@PATHS
def test_unknown_units_are_dropped_by_the_join(few, four, limit):
    named = join_unit_names(few, four, limit)
    assert sorted(ids(named)) == [1, 2, 3, 4, 5, 7]
    assert "_salt" not in named.columns


@PATHS
def test_hot_unit(spark, four, limit):
    """One unit holds most rows; both join paths give every row once."""
    many = spark.range(5000).selectExpr("id", "CAST(if(id % 3 = 0, id % 4 + 1, 1) AS INT) AS unit_id")
    named = join_unit_names(many, four, limit)
    assert named.count() == 5000 and named.select("id").distinct().count() == 5000


def test_size_is_measured(spark, four):
    assert 4 * 3 * 16 <= measured_bytes(four.select("id", "name")) < 1000
    assert measured_bytes(units(spark, *range(1, 101))) > 10 * measured_bytes(four)
    assert names_fit_broadcast(four) and not names_fit_broadcast(four, 10)


def test_since_is_inclusive_and_open_ended(spark):
    rows = readings(spark, reading(1, 1, ago(24)), reading(2, 1, ago(24.001)), reading(3, 1, ago(-50)))
    assert sorted(ids(since(rows, NOW, 24))) == [1, 3]
    zoned = rows.withColumn("timestamp", rows["timestamp"].cast("timestamp"))
    assert sorted(ids(since(zoned, NOW, 24))) == [1, 3]


def test_last_rows(few):
    assert sorted(ids(last_rows(few, 2).filter("unit_id = 1"))) == [2, 3]


def test_history(spark, few, four):
    day = sensor_history(few, four, NOW, 24)
    assert ids(day) == [4, 1, 2, 3, 5]  # time order, ties by id, a future row included
    assert ids(sensor_history(few, four, NOW, 0)) == [2, 3, 5]
    assert sorted(ids(sensor_history(few, four, NOW, 9999))) == [1, 2, 3, 4, 5]  # a week at most
    assert ids(sensor_history(few, four, NOW, 24, unit_ids=[2])) == [4, 5]
    assert ids(sensor_history(few, four, NOW, 24, unit_ids=[4])) == []
    asked = spark.createDataFrame([(2,), (2,), (9,)], "unit_id int")
    assert ids(sensor_history(few, four, NOW, 24, unit_ids=asked)) == [4, 5]


def test_unknown_is_not_the_same_as_empty(spark, four):
    asked = spark.createDataFrame([(4,), (9,), (9,), (None,)], "unit_id int")
    assert [tuple(r) for r in unknown_units(asked, four).collect()] == [(9, 2)]


def test_trend_series(few, four):
    rows = trend_series(sensor_history(few, four, NOW, 24, unit_ids=[1])).collect()
    assert len(rows) == 6
    assert {(r.id, r.series, r.value) for r in rows if r.id == 3} == {(3, "do_predicted", 4.5), (3, "temperature", 28.0)}


def test_overview_keeps_units_without_readings(few, four):
    rows = unit_overview(four, few).collect()
    assert [r.id for r in rows] == [1, 2, 3, 4]
    assert rows[3].latest_reading is None
    assert rows[0].latest_reading.id == 3 and rows[0].latest_reading.status.do_predicted == "perhatian"


def test_unit_state_prefers_warning(spark):
    fleet = units(spark, 1, 2, 3, 4, status_1="warning")
    rows = readings(
        spark, reading(1, 1, NOW, do_predicted=3.0), reading(2, 2, NOW, do_predicted=3.0), reading(3, 3, NOW)
    )
    states = {r.id: r.state for r in unit_state(unit_overview(fleet, rows)).collect()}
    assert states == {1: "warning", 2: "critical", 3: "ok", 4: "ok"}


def test_nan_and_null_are_normal_and_raise_nothing(spark, four):
    rows = readings(spark, reading(1, 1, NOW, ph=math.nan, temperature=None), reading(2, 2, NOW, ph=6.0, turbidity=math.nan))
    first, second = band_readings(rows).orderBy("id").collect()
    assert first.status_ph == first.status_temperature == "normal"
    assert second.status_ph == "kritis" and second.status_turbidity == "normal"
    assert ids(alerts_of_all(four, rows)) == [10]
    counts = {(r.parameter, r.status): r.readings for r in band_counts(rows).collect()}
    assert len(counts) == 15
    assert counts["ph", "kritis"] == 1 and counts["ph", "normal"] == 1 and counts["turbidity", "normal"] == 2


def test_no_readings_at_all(spark, four):
    nothing = readings(spark)
    assert latest_readings(nothing, four).count() == 0
    assert generate_alerts(four, nothing).count() == 0
    assert unit_overview(four, nothing).filter("latest_reading IS NULL").count() == 4
