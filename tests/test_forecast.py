import math
import random
from fractions import Fraction

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.tables import NOW, ago, reading, readings, units
from tidewatch.operators.forecast import forecast_do, forecast_features, forecast_status

SIX = [5.20, 5.40, 5.60, 5.80, 6.00, 6.20]

# unit, oxygen values oldest first, the four values, confidence
CASES = [
    (7, SIX, (5.70, 5.80, 5.75, 5.65), 0.92),
    (7, [9.00, *SIX], (5.70, 5.80, 5.75, 5.65), 0.92),
    (7, [5.10, 5.30], (5.20, 5.30, 5.25, 5.15), 0.92),
    (7, [], (5.50, 5.60, 5.55, 5.45), 0.92),
    (7, [5.70] * 5 + [5.73], (5.71, 5.81, 5.76, 5.66), 0.92),
    (7, [None] + [6.0], (5.50, 5.60, 5.55, 5.45), 0.92),
    (3, SIX, (3.80, 3.50, 3.10, 2.70), 0.87),
    (3, [3.62] * 4, (3.62, 3.32, 2.92, 2.52), 0.87),
    (3, [], (3.80, 3.50, 3.10, 2.70), 0.87),
]


def table(spark, unit_id, values):
    rows = [reading(i, unit_id, ago(len(values) - i), do_predicted=v) for i, v in enumerate(values)]
    return readings(spark, *rows)


@pytest.mark.parametrize("unit_id, values, expected, confidence", CASES)
def test_profiles(spark, unit_id, values, expected, confidence):
    row = forecast_do(units(spark, unit_id), table(spark, unit_id, values), NOW).first()
    assert (row.do_now, row.do_2h, row.do_4h, row.do_6h) == expected
    assert row.confidence == confidence and row.unit_name == f"U-{unit_id:02d}"


@pytest.mark.parametrize("unit_id", [3, 7])
def test_nan_in_the_window(spark, unit_id):
    row = forecast_do(units(spark, unit_id), table(spark, unit_id, [5.0, math.nan]), NOW).first()
    assert all(math.isnan(v) for v in (row.do_now, row.do_2h, row.do_4h, row.do_6h))


def test_means_equal_fractions(spark):
    """From 1e-6 to 1e15, of either sign and on exact halves, there is no size at which the rounding changes."""
    rng = random.Random(3)
    values = {}
    for unit in range(1, 120):
        scale = 10.0 ** rng.randint(-6, 15)
        values[unit] = [float(f"{rng.uniform(-scale, scale):.{rng.randint(0, 6)}f}") for _ in range(rng.randint(1, 6))]
    values[120], values[121] = [999_999.995], [1_000_000.005, 1_000_000.0]
    rows = [reading(100 * u + i, u, ago(i), do_predicted=v) for u, vs in values.items() for i, v in enumerate(vs)]
    found = forecast_do(units(spark, *values), readings(spark, *rows), NOW, declining=[])
    for row in found.collect():
        exact = [Fraction(repr(v)) for v in values[row.unit_id]]
        hundredths = math.floor(100 * sum(exact) / len(exact) + Fraction(1, 2))
        assert row.do_now == float(hundredths) / 100, values[row.unit_id]


def test_infinite_values(spark):
    inf = math.inf
    rows = [reading(10 * u + i, u, ago(i), do_predicted=v) for u, vs in {1: [inf, 5.0], 2: [-inf], 4: [inf, -inf], 5: [1e300]}.items() for i, v in enumerate(vs)]
    found = {r.unit_id: r.do_now for r in forecast_do(units(spark, 1, 2, 4, 5), readings(spark, *rows), NOW, declining=[]).collect()}
    assert found[1] == inf and found[2] == -inf and math.isnan(found[4]) and found[5] == inf


def test_window_bounds_and_unknown_units(spark):
    rows = readings(
        spark,
        reading(1, 1, ago(24), do_predicted=5.0),
        reading(2, 1, ago(24.01), do_predicted=9.0),
        reading(3, 1, ago(-3), do_predicted=6.0),
        reading(4, 9, ago(1), do_predicted=9.0),
    )
    result = {r.unit_id: r.do_now for r in forecast_do(units(spark, 1, 2), rows, NOW).collect()}
    assert result == {1: 5.5, 2: 5.5}
    assert forecast_features(rows, NOW).count() == 3


def test_declining_is_a_choice(spark):
    fleet = units(spark, 1, 3, 4, status_4="warning")
    nothing = readings(spark)

    def falling(declining):
        rows = forecast_do(fleet, nothing, NOW, declining=declining).collect()
        return {r.unit_id for r in rows if r.confidence == 0.87}

    assert falling([]) == set()
    assert falling([1, 4]) == {1, 4}
    assert falling(F.col("status") == "warning") == {4}


def test_status_band(spark):
    rows = readings(
        spark,
        *[reading(i, i, NOW, do_predicted=v) for i, v in {1: 3.99, 2: 4.0, 4: 4.99, 5: 5.0}.items()],
    )
    result = {r.unit_id: r.do_status for r in forecast_status(forecast_do(units(spark, 1, 2, 4, 5), rows, NOW)).collect()}
    assert result == {1: "kritis", 2: "perhatian", 4: "perhatian", 5: "normal"}


def test_model_hook(spark):
    def spread(batch):
        assert list(batch.columns)[:2] == ["unit_id", "timestamp"] and "id" not in batch.columns
        assert all(list(times) == sorted(times) for times in batch["timestamp"])
        values = batch["do_predicted"]
        first = [v[0] if len(v) else -1.0 for v in values]
        return pd.DataFrame({"do_now": first, "do_2h": values.map(len), "do_4h": batch["unit_id"], "do_6h": len(batch), "confidence": 1})

    rows = readings(spark, *[reading(i, 1, ago(10 - i), do_predicted=float(i)) for i in range(9)])
    fleet = units(spark, 1, 2, *range(3, 60)).coalesce(1)
    result = forecast_do(fleet, rows, NOW, model=spread, model_rows=4).orderBy("unit_id").collect()
    assert [tuple(r)[:5] for r in result[:2]] == [(1, "U-01", 5.0, 4.0, 1.0), (2, "U-02", -1.0, 0.0, 2.0)]
    # A call for a batch of units, not for a unit.
    assert len(result) == 59 and min(r.do_6h for r in result) > 1
    with pytest.raises(ValueError):
        forecast_do(units(spark, 1), rows, NOW, model=spread)
