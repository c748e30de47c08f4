from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.tables import NOW
from tidewatch.operators.alerts import generate_alerts
from tidewatch.operators.quality import check_constraints
from tidewatch.sources.generator import generate_readings, generate_units
from tidewatch.schemas import ALERTS, READINGS


@pytest.fixture(scope="module")
def seed(spark):
    fleet = generate_units(spark, 4)
    return fleet, generate_readings(fleet, NOW).cache()


def test_units(seed):
    fleet, _ = seed
    rows = [tuple(r) for r in fleet.orderBy("id").collect()]
    assert rows[0] == (1, "U-01", "grouper", "active", "Farmer 01")
    assert rows[2] == (3, "U-03", "grouper", "warning", "Farmer 03")
    assert rows[3][2] == "snapper"


def test_grid(seed):
    _, rows = seed
    assert [(f.name, f.dataType) for f in rows.schema] == [(f.name, f.dataType) for f in READINGS]
    assert rows.count() == 672 and rows.select("id").distinct().count() == 672
    per_unit = rows.groupBy("unit_id").agg(F.count("*"), F.min("timestamp"), F.max("timestamp"), F.countDistinct("timestamp"))
    for row in per_unit.collect():
        assert tuple(row)[1:] == (168, datetime(2024, 3, 3, 13), datetime(2024, 3, 10, 12), 168)


def test_ranges(seed):
    _, rows = seed
    bounds = {"salinity": (24, 27.5), "ph": (7.6, 8.4), "temperature": (26.5, 29.5), "light_intensity": (12000, 45000)}
    steady = {**bounds, "turbidity": (8, 14), "do_predicted": (5.2, 7.5)}
    for unit_filter, expected in (("unit_id <> 3", steady), ("unit_id = 3", bounds)):
        for column, (low, high) in expected.items():
            least, most = rows.filter(unit_filter).agg(F.min(column), F.max(column)).first()
            assert low <= least < most <= high
            # uniform draws reach close to both ends
            assert least - low < 0.1 * (high - low) and high - most < 0.1 * (high - low)
    assert rows.filter("ph <> round(ph, 2) OR light_intensity <> round(light_intensity)").count() == 0


def test_declining_unit(seed):
    _, rows = seed
    declining = rows.filter("unit_id = 3").orderBy("timestamp").collect()
    for hour, row in enumerate(declining):
        assert abs(row.do_predicted - (6.8 - 3.2 * hour / 167)) <= 0.1551
        low, high = (18, 32) if hour >= 162 else (8, 14)
        assert low <= row.turbidity <= high


def test_seeded_alerts(seed):
    fleet, rows = seed
    raised = [(r.unit_id, r.parameter, r.severity) for r in generate_alerts(fleet, rows).collect()]
    assert len(raised) == 6
    assert sorted(u for u, p, s in raised if (p, s) == ("salinity", "warn")) == [1, 2, 3, 4]
    assert (3, "do_predicted", "danger") in raised
    assert {(u, p) for u, p, _ in raised} >= {(3, "turbidity")}


def test_seed_keeps_the_constraints(spark, seed):
    fleet, rows = seed
    none = spark.createDataFrame([], ALERTS)
    assert check_constraints(fleet, rows, none).filter("violations > 0").count() == 0


def test_same_values_whatever_the_partitioning(spark, seed):
    _, rows = seed
    other = generate_readings(generate_units(spark, 4).repartition(7, "name"), NOW)
    assert rows.exceptAll(other).count() == 0 and other.exceptAll(rows).count() == 0


@pytest.mark.parametrize("hours", [1, 24, 25])
def test_short_histories(spark, hours):
    rows = generate_readings(generate_units(spark, 3), NOW, hours)
    assert rows.count() == 3 * hours
    assert rows.agg(F.max("timestamp")).first()[0] == datetime(2024, 3, 10, 12)


def test_days_share_no_id_and_overlapping_spans_agree(spark):
    fleet = generate_units(spark, 2)
    today, tomorrow = (generate_readings(fleet, moment, 24) for moment in (NOW, NOW + timedelta(days=1)))
    assert today.join(tomorrow, "id").count() == 0
    week = generate_readings(fleet, NOW + timedelta(days=1), 168)
    assert today.exceptAll(week).count() == 0
