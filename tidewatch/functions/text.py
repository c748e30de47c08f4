"""Texts shown to people: labels, alert messages, ISO times."""

from __future__ import annotations

# Display names of the parameters and of the severities.
PARAMETER_LABELS = {
    "ph": "pH",
    "temperature": "Suhu",
    "salinity": "Salinitas",
    "turbidity": "Turbiditas",
    "do_predicted": "DO (prediksi)",
}
LEVELS = {"info": "Info", "warn": "Perhatian", "danger": "Kritis"}


def _lookup(value: str, table: dict[str, str], otherwise: str) -> str:
    branches = " ".join(f"WHEN '{key}' THEN '{text}'" for key, text in table.items())
    return f"CASE {value} {branches} ELSE {otherwise} END"


def parameter_label(parameter: str) -> str:
    return _lookup(parameter, PARAMETER_LABELS, parameter)


def level_text(severity: str) -> str:
    return _lookup(severity, LEVELS, "NULL")


def number_text(value: str) -> str:
    """The digits of a double without exponent, from 1e-4 to below 1e16; outside, Spark's own text."""
    plain = f"CAST(CAST(CAST({value} AS STRING) AS DECIMAL(38, 20)) AS STRING)"
    trimmed = f"regexp_replace(regexp_replace({plain}, '0+$', ''), '[.]$', '.0')"
    size = f"abs({value})"
    return (
        f"CASE WHEN ({size} >= 1e7D AND {size} < 1e16D) OR ({size} >= 1e-4D AND {size} < 1e-3D)"
        f" THEN {trimmed} ELSE CAST({value} AS STRING) END"
    )


def alert_message(unit_name: str, label: str, value: str, severity: str) -> str:
    return f"concat('[', {level_text(severity)}, '] ', {unit_name}, ': ', {label}, ' = ', {number_text(value)})"


def iso_text(timestamp: str) -> str:
    """ISO-8601 without zone; six fraction digits, or none when the fraction is zero."""
    text = f"translate(CAST(CAST({timestamp} AS TIMESTAMP_NTZ) AS STRING), ' ', 'T')"
    return f"if(length({text}) > 19, rpad({text}, 26, '0'), {text})"
