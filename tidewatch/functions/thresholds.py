"""Threshold rules.

Every limit is strict: a value on a limit stays in the milder band. NaN and
NULL have no severity. Spark orders NaN above all numbers, hence the guard.
"""

from __future__ import annotations

from typing import NamedTuple


class Limits(NamedTuple):
    danger_below: float | None
    danger_above: float | None
    warn_below: float | None
    warn_above: float | None


# The limits of each checked parameter, in checking order. The
# position in this table is also the last digit (base 5) of an alert's id.
LIMITS = {
    "ph": Limits(danger_below=7.0, danger_above=9.0, warn_below=7.3, warn_above=8.7),
    "temperature": Limits(danger_below=22.0, danger_above=33.0, warn_below=24.0, warn_above=31.0),
    "salinity": Limits(danger_below=22.0, danger_above=None, warn_below=28.0, warn_above=34.0),
    "turbidity": Limits(danger_below=None, danger_above=30.0, warn_below=None, warn_above=15.0),
    "do_predicted": Limits(danger_below=4.0, danger_above=None, warn_below=5.0, warn_above=None),
}
PARAMETERS = tuple(LIMITS)


def _outside(value: str, below: float | None, above: float | None) -> str:
    tests = []
    if below is not None:
        tests.append(f"{value} < {below}D")
    if above is not None:
        tests.append(f"{value} > {above}D")
    return " OR ".join(tests) or "false"


def _banded(parameter: str, value: str | None, danger: str, warn: str, otherwise: str) -> str:
    limits = LIMITS.get(parameter)
    if limits is None:
        return otherwise
    value = value or parameter
    return (
        f"CASE WHEN isnan({value}) THEN {otherwise}"
        f" WHEN {_outside(value, limits.danger_below, limits.danger_above)} THEN {danger}"
        f" WHEN {_outside(value, limits.warn_below, limits.warn_above)} THEN {warn}"
        f" ELSE {otherwise} END"
    )


def severity(parameter: str, value: str | None = None) -> str:
    """``danger``, ``warn`` or NULL; always NULL for an unknown parameter.

    ``value`` is a column or expression, by default the column of that name.
    """
    return _banded(parameter, value, "'danger'", "'warn'", "CAST(NULL AS STRING)")


def severity_of(parameter: str, value: str) -> str:
    """The same for rows that hold the parameter's name in a column."""
    branches = " ".join(f"WHEN '{name}' THEN {severity(name, value)}" for name in PARAMETERS)
    return f"CASE {parameter} {branches} END"


# Status labels.
KRITIS, PERHATIAN, NORMAL = "kritis", "perhatian", "normal"
STATUSES = (KRITIS, PERHATIAN, NORMAL)


def status(parameter: str, value: str | None = None) -> str:
    return _banded(parameter, value, f"'{KRITIS}'", f"'{PERHATIAN}'", f"'{NORMAL}'")


def status_label(severity_value: str) -> str:
    return f"CASE {severity_value} WHEN 'danger' THEN '{KRITIS}' WHEN 'warn' THEN '{PERHATIAN}' ELSE '{NORMAL}' END"


def status_struct() -> str:
    """The nested status of a reading; light is not checked and always normal."""
    fields = [f"'{p}', {status(p)}" for p in (*PARAMETERS, "light_intensity")]
    return f"named_struct({', '.join(fields)})"


def may_alert() -> str:
    """True for every reading with at least one alert (and for some with NaN).

    Plain comparisons on stored columns, so that Parquet row groups holding
    only ordinary values are skipped at the scan.
    """
    return " OR ".join(_outside(p, limits.warn_below, limits.warn_above) for p, limits in LIMITS.items())
