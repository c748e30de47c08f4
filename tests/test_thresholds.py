import math

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.thresholds import PARAMETERS, may_alert, severity, severity_of, status, status_label

D, W, N = "danger", "warn", None

# value -> severity: one step outside, on and inside of every limit
CASES = {
    "ph": {6.99: D, 7.0: W, 7.01: W, 7.29: W, 7.3: N, 7.31: N, 8.69: N, 8.7: N, 8.71: W, 8.99: W, 9.0: W, 9.01: D},
    "temperature": {
        21.99: D, 22.0: W, 22.01: W, 23.99: W, 24.0: N, 24.01: N, 30.99: N, 31.0: N, 31.01: W, 32.99: W, 33.0: W, 33.01: D
    },
    "salinity": {21.99: D, 22.0: W, 22.01: W, 27.99: W, 28.0: N, 28.01: N, 33.99: N, 34.0: N, 34.01: W, 99.0: W},
    "turbidity": {-1.0: N, 14.99: N, 15.0: N, 15.01: W, 29.99: W, 30.0: W, 30.01: D},
    "do_predicted": {3.99: D, 4.0: W, 4.01: W, 4.99: W, 5.0: N, 5.01: N, 99.0: N},
    "light_intensity": {-1e9: N, 0.0: N, 1e9: N},
    "unheard_of": {0.0: N, 1e9: N},
}
ROWS = [
    (parameter, value, expected)
    for parameter, values in CASES.items()
    for value, expected in {**values, math.nan: N, None: N}.items()
]
LABELS = {D: "kritis", W: "perhatian", N: "normal"}


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "parameter string, value double, expected string")


@pytest.mark.parametrize("parameter", list(CASES))
def test_limits_are_strict(table, parameter):
    rows = table.filter(F.col("parameter") == parameter).selectExpr(
        "value", "expected", f"{severity(parameter, 'value')} AS severity", f"{status(parameter, 'value')} AS status"
    )
    for row in rows.collect():
        assert row.severity == row.expected, row
        assert row.status == LABELS[row.expected], row


def test_parameter_in_a_column(table):
    rows = table.selectExpr("*", f"{severity_of('parameter', 'value')} AS severity")
    labelled = rows.selectExpr("*", f"{status_label('severity')} AS status").collect()
    assert len(labelled) == len(ROWS)
    for row in labelled:
        assert row.severity == row.expected, row
        assert row.status == LABELS[row.expected], row


def test_prefilter_keeps_every_alert(table):
    """Each case as a reading whose other measures are calm."""
    calm = {"ph": 8.0, "temperature": 28.0, "salinity": 30.0, "turbidity": 10.0, "do_predicted": 6.0}
    for parameter in PARAMETERS:
        others = [f"{v}D AS {p}" for p, v in calm.items() if p != parameter]
        rows = table.filter(F.col("parameter") == parameter).selectExpr("expected", f"value AS {parameter}", *others)
        kept = rows.filter(may_alert())
        assert kept.filter("expected IS NOT NULL").count() == rows.filter("expected IS NOT NULL").count()
        plain = rows.filter(f"NOT isnan({parameter})")
        assert plain.filter(may_alert()).filter("expected IS NULL").count() == 0
