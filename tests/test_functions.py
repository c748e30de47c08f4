import random
from datetime import datetime, timezone
from decimal import ROUND_FLOOR, Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidewatch.functions.rounding import mean_hundredths
from tidewatch.functions.text import alert_message, iso_text, level_text, number_text, parameter_label
from tidewatch.functions.times import clamp_hours, floor_hour, hours_before, local_time, naive_utc


@pytest.mark.parametrize("given_hours, used", [(None, 24), (-5, 1), (0, 1), (1, 1), (24, 24), (168, 168), (9999, 168)])
def test_clamp_hours(given_hours, used):
    assert clamp_hours(given_hours) == used


def test_moments_become_naive_utc():
    zoned = datetime(2024, 1, 1, 7, tzinfo=timezone.utc)
    assert naive_utc(zoned) == datetime(2024, 1, 1, 7)
    assert naive_utc("2024-01-01T07:00:00+07:00") == datetime(2024, 1, 1, 0)
    assert hours_before("2024-01-02", 24) == datetime(2024, 1, 1)


def test_times(spark):
    rows = spark.createDataFrame(
        [(datetime(2024, 2, 29, 23, 59, 59, 999999),), (datetime(2024, 1, 1),), (datetime(2024, 1, 1, 1, 2, 3, 500000),)],
        "ts timestamp_ntz",
    ).selectExpr("ts", f"{iso_text('ts')} AS iso", f"{floor_hour('ts')} AS hour", f"{local_time('ts')} AS local")
    assert dict(rows.dtypes) == {
        "ts": "timestamp_ntz", "iso": "string", "hour": "timestamp_ntz", "local": "timestamp_ntz"
    }
    for row in rows.collect():
        assert row.iso == row.ts.isoformat()
        assert row.hour == row.ts.replace(minute=0, second=0, microsecond=0)
        assert (row.local - row.ts).total_seconds() == 7 * 3600


def test_texts(spark):
    row = spark.sql(
        f"""SELECT {parameter_label("'do_predicted'")} AS known, {parameter_label("'other'")} AS unknown,
                   {level_text("'info'")} AS level, {level_text("CAST(NULL AS STRING)")} AS none,
                   {alert_message("'U-03'", "'Suhu'", "24.0D", "'danger'")} AS message"""
    ).first()
    assert row.known == "DO (prediksi)" and row.unknown == "other"
    assert row.level == "Info" and row.none is None
    assert row.message == "[Kritis] U-03: Suhu = 24.0"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-6 * 10**9, 6 * 10**9), st.integers(1, 6)), min_size=1, max_size=40))
def test_means_round_half_up(spark, pairs):
    """Totals are given in millionths."""
    total = "CAST(CAST(total AS DECIMAL(20, 0)) * 0.000001 AS DECIMAL(38, 6))"
    rows = spark.createDataFrame(pairs, "total bigint, n bigint").selectExpr("*", f"{mean_hundredths(total, 'n')} AS h")
    for row in rows.collect():
        exact = Decimal(row.total) / (row.n * 10_000)
        tie_free = (Decimal(2 * row.total + row.n * 10_000) / (2 * row.n * 10_000)).to_integral_value(ROUND_FLOOR)
        assert row.h == int(tie_free)
        assert abs(row.h - exact) <= Decimal("0.5")


def test_number_text_equals_python(spark):
    rng = random.Random(1)
    values = [0.0, 1.0, 0.5, -7.25, 5e-4, 1e-4, 9.999e-4, 1e7, 12345678.9, 123456789012345.6, 9.99e15, 1e15, 9007199254740991.0]
    values += [float(f"{rng.uniform(0, 10.0 ** rng.randint(-3, 15)):.{rng.randint(0, 8)}f}") for _ in range(500)]
    values = [v for v in values if v == 0 or 1e-4 <= abs(v) < 1e16]
    rows = spark.createDataFrame([(v,) for v in values + [-v for v in values if v]], "v double")
    assert all(r.text == str(r.v) for r in rows.selectExpr("v", f"{number_text('v')} AS text").collect())
