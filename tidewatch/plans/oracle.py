"""The registered queries as plain SQL for DuckDB, written against the same tables."""

from __future__ import annotations

UNITS = """
units AS (
  SELECT n_nationkey + 1 AS id,
         'U-' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') AS name,
         CASE WHEN n_nationkey % 2 = 0 THEN 'grouper' ELSE 'snapper' END AS species,
         CASE WHEN n_nationkey = 2 THEN 'warning' ELSE 'active' END AS status,
         n_name AS farmer_name
  FROM nation
)"""

READINGS = """
readings AS (
  SELECT event_id AS id,
         CAST(user_id % 30 + 3 AS INTEGER) AS unit_id,
         ts AS "timestamp",
         (650 + (event_id * 11) % 301) / 100.0::DOUBLE AS ph,
         (2100 + (event_id * 13) % 1301) / 100.0::DOUBLE AS temperature,
         (2000 + (event_id * 17) % 1601) / 100.0::DOUBLE AS salinity,
         (500 + (event_id * 19) % 3001) / 100.0::DOUBLE AS turbidity,
         CAST(12000 + (event_id * 101) % 33001 AS DOUBLE) AS light_intensity,
         (300 + (event_id * 23) % 501) / 100.0::DOUBLE AS do_predicted,
         CASE WHEN event_id % 10 = 0 THEN 'manual' ELSE 'tft' END AS do_source
  FROM events
)"""

# Limits and display names.
SEVERITY = {
    "ph": "CASE WHEN ph < 7.0 OR ph > 9.0 THEN 'danger' WHEN ph < 7.3 OR ph > 8.7 THEN 'warn' END",
    "temperature": "CASE WHEN temperature < 22 OR temperature > 33 THEN 'danger'"
    " WHEN temperature < 24 OR temperature > 31 THEN 'warn' END",
    "salinity": "CASE WHEN salinity < 22 THEN 'danger' WHEN salinity < 28 OR salinity > 34 THEN 'warn' END",
    "turbidity": "CASE WHEN turbidity > 30 THEN 'danger' WHEN turbidity > 15 THEN 'warn' END",
    "do_predicted": "CASE WHEN do_predicted < 4.0 THEN 'danger' WHEN do_predicted < 5.0 THEN 'warn' END",
}
LABEL = {
    "ph": "pH",
    "temperature": "Suhu",
    "salinity": "Salinitas",
    "turbidity": "Turbiditas",
    "do_predicted": "DO (prediksi)",
}
MEASURES = ("ph", "temperature", "salinity", "turbidity", "light_intensity", "do_predicted")


def _status(severity: str) -> str:
    return f"CASE ({severity}) WHEN 'danger' THEN 'kritis' WHEN 'warn' THEN 'perhatian' ELSE 'normal' END"


STATUS_COLUMNS = ", ".join(f"{_status(s)} AS status_{p}" for p, s in SEVERITY.items())
LIGHT_STATUS = "'normal' AS status_light_intensity"
READING_COLUMNS = f'id, unit_id, unit_name, "timestamp", {", ".join(MEASURES)}, do_source'
AS_OF = "(SELECT max(ts) FROM events)"


def _raise(source: str, unit_name: str) -> str:
    """Alerts of the rows of ``source``, one branch per parameter."""
    branches = [
        f"""SELECT id * 5 + {position} AS id, unit_id, '{p}' AS parameter, {s} AS severity,
            '[' || CASE {s} WHEN 'danger' THEN 'Kritis' ELSE 'Perhatian' END || '] ' || {unit_name}
              || ': {LABEL[p]} = ' || CAST({p} AS VARCHAR) AS message,
            "timestamp"
     FROM {source} WHERE ({s}) IS NOT NULL"""
        for position, (p, s) in enumerate(SEVERITY.items())
    ]
    return " UNION ALL ".join(branches)


VIEW_UNIT_NAME = "'U-' || lpad(CAST(unit_id AS VARCHAR), 2, '0')"


def _alerts(source: str = "readings") -> str:
    raised = _raise(source, VIEW_UNIT_NAME)
    return f"alerts AS (SELECT *, id % 3 = 0 AS is_read FROM ({raised}))"


RECEIPTS = "receipts AS (SELECT event_id * 5 AS alert_id FROM events WHERE event_type = 'click')"

NAMED = """
named AS (
  SELECT r.*, u.name AS unit_name FROM readings r JOIN units u ON u.id = r.unit_id
)"""

# Ties resolved to the highest id.
LATEST = """
latest AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY "timestamp" DESC, id DESC) AS position FROM named
  ) WHERE position = 1
)"""


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts)


def _latest_with_ties(readings: str) -> str:
    return f"""{_with(UNITS, READINGS, readings)}
SELECT {READING_COLUMNS}, {STATUS_COLUMNS}, {LIGHT_STATUS}
FROM (
  SELECT r.*, u.name AS unit_name
  FROM chosen r
  JOIN units u ON u.id = r.unit_id
  JOIN (SELECT unit_id, max("timestamp") AS newest FROM chosen GROUP BY unit_id) m
    ON m.unit_id = r.unit_id AND m.newest = r."timestamp"
)"""


def _history(hours: int, condition: str = "TRUE") -> str:
    return f"""{_with(UNITS, READINGS, NAMED)}
SELECT {READING_COLUMNS}, {STATUS_COLUMNS}, {LIGHT_STATUS}
FROM named
WHERE "timestamp" >= {AS_OF} - INTERVAL {hours} HOUR AND {condition}
ORDER BY "timestamp", id"""


ISO = """strftime({0}, '%Y-%m-%dT%H:%M:%S') ||
  CASE WHEN microsecond({0}) % 1000000 = 0 THEN '' ELSE strftime({0}, '.%f') END"""

_JSON_FIELDS = ", ".join(
    ["'id': id, 'unit_id': unit_id, 'unit_name': unit_name", "'timestamp': " + ISO.format('"timestamp"')]
    + [f"'{m}': {m}" for m in (*MEASURES, "do_source")]
)
_JSON_STATUS = ", ".join([f"'{p}': {_status(s)}" for p, s in SEVERITY.items()] + ["'light_intensity': 'normal'"])


def _feed(alerts: str) -> str:
    return f"""
  SELECT a.id, a.unit_id, u.name AS unit_name, a.parameter, a.severity, a.message, a."timestamp", a.is_read
  FROM {alerts} a JOIN units u ON u.id = a.unit_id
  ORDER BY a."timestamp" DESC, a.id DESC LIMIT 50"""


def _forecast(falling: str, readings: str = READINGS) -> str:
    """Whole hundredths; every division has non-negative operands."""
    return f"""{_with(UNITS, readings)},
recent AS (
  SELECT unit_id, do_predicted FROM (
    SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY "timestamp" DESC, id DESC) AS position
    FROM readings WHERE "timestamp" >= {AS_OF} - INTERVAL 24 HOUR
  ) WHERE position <= 6
),
means AS (
  SELECT unit_id, (2 * sum(CAST(round(coalesce(do_predicted, 5.0) * 1e6) AS BIGINT)) + count(*) * 10000) // (2 * count(*) * 10000) AS h
  FROM recent GROUP BY unit_id
),
based AS (
  SELECT u.id, u.name, {falling} AS falling,
         CAST(CASE WHEN {falling} THEN least(coalesce(m.h, 550), 380) ELSE coalesce(m.h, 550) END AS BIGINT) AS h
  FROM units u LEFT JOIN means m ON m.unit_id = u.id
),
forecast AS (
  SELECT id AS unit_id, name AS unit_name,
         h / 100.0::DOUBLE AS do_now,
         (h + CASE WHEN falling THEN -30 ELSE 10 END) / 100.0::DOUBLE AS do_2h,
         (h + CASE WHEN falling THEN -70 ELSE 5 END) / 100.0::DOUBLE AS do_4h,
         (h + CASE WHEN falling THEN -110 ELSE -5 END) / 100.0::DOUBLE AS do_6h,
         CASE WHEN falling THEN 0.87::DOUBLE ELSE 0.92::DOUBLE END AS confidence
  FROM based
)"""


def _rule_rows(table: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{rule}' AS rule, CAST(({count}) AS BIGINT) AS violations"
        for rule, count in rules.items()
    )


def _rows_where(table: str, condition: str) -> str:
    return f"SELECT count(*) FROM {table} WHERE {condition}"


def _constraints() -> str:
    unit_rules = {f"not_null:{c}": _rows_where("units", f"{c} IS NULL") for c in ("id", "name", "species", "status", "farmer_name")}
    unit_rules["domain:species"] = _rows_where("units", "species NOT IN ('grouper', 'snapper')")
    for column, length in {"name": 32, "status": 32, "farmer_name": 128}.items():
        unit_rules[f"max_length:{column}"] = _rows_where("units", f"length({column}) > {length}")
    repeated = "SELECT count(*) FROM (SELECT id FROM {0} WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1)"
    unit_rules["unique:id"] = repeated.format("units")
    unit_rules["unique:name"] = (
        "SELECT count(*) FROM (SELECT name FROM units WHERE name IS NOT NULL GROUP BY name HAVING count(*) > 1)"
    )
    orphan = "unit_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM units u WHERE u.id = unit_id)"
    reading_rules = {
        f"not_null:{c}": _rows_where("readings", f'"{c}" IS NULL') for c in ("id", "unit_id", "timestamp", *MEASURES, "do_source")
    }
    reading_rules["unique:id"] = repeated.format("readings")
    reading_rules["domain:do_source"] = _rows_where("readings", "do_source NOT IN ('tft', 'manual')")
    reading_rules["foreign_key:unit_id"] = _rows_where("readings", orphan)
    alert_rules = {
        f"not_null:{c}": _rows_where("alerts", f'"{c}" IS NULL')
        for c in ("id", "unit_id", "parameter", "severity", "message", "timestamp", "is_read")
    }
    alert_rules["unique:id"] = repeated.format("alerts")
    alert_rules["domain:severity"] = _rows_where("alerts", "severity NOT IN ('info', 'warn', 'danger')")
    alert_rules["max_length:parameter"] = _rows_where("alerts", "length(parameter) > 64")
    alert_rules["max_length:message"] = _rows_where("alerts", "length(message) > 512")
    alert_rules["foreign_key:unit_id"] = _rows_where("alerts", orphan)
    return " UNION ALL ".join(
        [_rule_rows("units", unit_rules), _rule_rows("readings", reading_rules), _rule_rows("alerts", alert_rules)]
    )


DIRTY_UNITS = """
units AS (
  SELECT CAST(c_custkey + CASE WHEN c_custkey % 19 = 1 THEN 0 ELSE 1 END AS INTEGER) AS id,
         CASE WHEN c_custkey % 11 = 0 THEN 'U-' || CAST(c_custkey % 7 AS VARCHAR)
              WHEN c_custkey % 13 = 0 THEN 'U-' || lpad(CAST(c_custkey AS VARCHAR), 40, '0')
              WHEN c_custkey % 17 <> 0 THEN 'U-' || CAST(c_custkey AS VARCHAR) END AS name,
         CASE c_custkey % 5 WHEN 0 THEN 'carp' WHEN 1 THEN 'snapper' WHEN 2 THEN 'grouper' END AS species,
         CASE WHEN c_custkey % 3 = 0 THEN 'active' END AS status,
         c_name AS farmer_name
  FROM customer
)"""

DIRTY_READINGS = """
dirty AS (
  SELECT * REPLACE (
    CASE WHEN id % 101 = 1 THEN id - 1 ELSE id END AS id,
    CASE WHEN id % 23 <> 0 THEN unit_id END AS unit_id,
    CASE WHEN id % 97 <> 0 THEN ph END AS ph,
    CASE WHEN id % 89 <> 0 THEN do_predicted END AS do_predicted,
    CASE WHEN id % 7 = 0 THEN 'buoy' WHEN id % 7 <> 1 THEN do_source END AS do_source
  ) FROM readings
)"""


CLEAN = READINGS.replace("readings AS (", "clean AS (", 1)
DIRTY_IN_PLACE = DIRTY_READINGS.replace("dirty AS (", "readings AS (", 1).replace("FROM readings", "FROM clean")


def _dirty_constraints() -> str:
    return f"{_with(DIRTY_UNITS, CLEAN, DIRTY_IN_PLACE, _alerts())} {_constraints()}"


def _uniform(draw: str, low: int, high: int) -> str:
    return f"({low} + (2 * {draw} * {high - low} + 1048576) // 2097152)"


def _draw(position: int) -> str:
    return f"CAST('0x' || substr(digest, {position * 5 + 1}, 5) AS BIGINT)"


GENERATED = f"""
fleet AS (
  SELECT CAST(c_custkey + 1 AS INTEGER) AS id, printf('U-%02d', c_custkey + 1) AS name FROM customer
),
span AS (
  SELECT CAST(epoch(date_trunc('hour', {AS_OF})) AS BIGINT) // 3600 - 167 AS first_hour
),
grid AS (
  SELECT id, name, id % 25 = 3 AS falling, h, first_hour + h AS hour, md5(name || '-' || CAST(first_hour + h AS VARCHAR)) AS digest
  FROM fleet, range(168) hours(h), span
),
drawn AS (
  SELECT *, {", ".join(f"{_draw(k)} AS d{k}" for k in range(6))} FROM grid
),
generated AS (
  SELECT CAST(id AS BIGINT) * 8388608 + hour AS id,
         id AS unit_id,
         date_trunc('hour', {AS_OF}) - to_hours(CAST(167 - h AS BIGINT)) AS "timestamp",
         {_uniform("d1", 760, 840)} / 100.0::DOUBLE AS ph,
         {_uniform("d2", 2650, 2950)} / 100.0::DOUBLE AS temperature,
         {_uniform("d0", 2400, 2750)} / 100.0::DOUBLE AS salinity,
         CASE WHEN falling AND h >= 162 THEN {_uniform("d3", 1800, 3200)} ELSE {_uniform("d3", 800, 1400)} END
           / 100.0::DOUBLE AS turbidity,
         CAST({_uniform("d4", 12000, 45000)} AS DOUBLE) AS light_intensity,
         CASE WHEN falling
              THEN (2 * (665::BIGINT * 167 * 1048576 - 320::BIGINT * h * 1048576 + 30 * d5 * 167) + 167::BIGINT * 1048576)
                   // (2::BIGINT * 167 * 1048576)
              ELSE {_uniform("d5", 520, 750)} END / 100.0::DOUBLE AS do_predicted,
         'tft' AS do_source
  FROM drawn
)"""


def all_sql() -> dict[str, str]:
    base = _with(UNITS, READINGS, NAMED)
    latest = f"{base}, {LATEST}"
    plain_alerts = f"{_with(UNITS, READINGS, _alerts())}"
    overview = f"""
  SELECT u.id, u.name, u.species, u.status, u.farmer_name, l.id AS reading_id, l."timestamp",
         {", ".join(f"l.{m}" for m in MEASURES)}, l.do_source,
         {", ".join(f"CASE WHEN l.id IS NOT NULL THEN {_status(s)} END AS status_{p}" for p, s in SEVERITY.items())},
         CASE WHEN l.id IS NOT NULL THEN 'normal' END AS status_light_intensity
  FROM units u LEFT JOIN latest l ON l.unit_id = u.id"""
    long_rows = " UNION ALL ".join(
        f"SELECT id, '{m}' AS parameter, {m} AS value, CAST({SEVERITY.get(m, 'NULL')} AS VARCHAR) AS severity,"
        f" '{LABEL.get(m, m)}' AS label FROM readings"
        for m in MEASURES
    )
    seven_days = _history(168)
    forecast = _forecast("u.id = 3")
    feeds = f"""{plain_alerts},
feed AS ({_feed("alerts")}),
earlier AS ({_feed(f'(SELECT * FROM alerts WHERE "timestamp" <= {AS_OF} - INTERVAL 1 HOUR)')})"""
    return {
        "latest_readings": _latest_with_ties("chosen AS (SELECT * FROM readings)"),
        "latest_readings_ties": _latest_with_ties(
            """chosen AS (SELECT * REPLACE (date_trunc('hour', "timestamp") AS "timestamp") FROM readings)"""
        ),
        "latest_times_per_unit": f"""{_with(READINGS)}
SELECT unit_id, newest AS "timestamp", {ISO.format("newest")} AS timestamp_text
FROM (SELECT unit_id, max("timestamp") AS newest FROM readings GROUP BY unit_id)""",
        "latest_documents": f"""{base}
SELECT CAST(to_json({{{_JSON_FIELDS}, 'status': {{{_JSON_STATUS}}}}}) AS VARCHAR) AS document
FROM named n
WHERE "timestamp" = (SELECT max(r."timestamp") FROM readings r WHERE r.unit_id = n.unit_id)""",
        "band_readings": f'{_with(READINGS)} SELECT id, unit_id, "timestamp", {STATUS_COLUMNS} FROM readings',
        "band_counts": f"{_with(READINGS)} "
        + " UNION ALL ".join(
            f"SELECT '{p}' AS parameter, '{label}' AS status, count(*) FILTER (WHERE {_status(s)} = '{label}') AS readings"
            f" FROM readings"
            for p, s in SEVERITY.items()
            for label in ("kritis", "perhatian", "normal")
        ),
        "classify_long": f"""{_with(READINGS)}
SELECT id, parameter, value, severity, {_status("severity")} AS status, label,
       CASE severity WHEN 'danger' THEN 'Kritis' WHEN 'warn' THEN 'Perhatian' END AS level
FROM ({long_rows})""",
        "severity_by_name": f"""{_with(READINGS)}
SELECT parameter, severity, count(*) AS readings FROM ({long_rows}) GROUP BY parameter, severity""",
        "sensor_history_1h": _history(1),
        "sensor_history_24h": _history(24),
        "sensor_history_168h": seven_days,
        "sensor_history_clamped": seven_days,
        "sensor_history_of_unit": _history(168, "unit_id = 3"),
        "sensor_history_of_chosen_units": _history(
            24,
            "unit_id IN (SELECT user_id % 30 + 3 FROM events WHERE event_type = 'purchase' AND value > 60)",
        ),
        "unknown_units": f"""{_with(UNITS, READINGS)}
SELECT unit_id, count(*) AS requests FROM readings
WHERE unit_id NOT IN (SELECT id FROM units) GROUP BY unit_id""",
        "trend_series": f"""{base},
recent AS (SELECT * FROM named WHERE "timestamp" >= {AS_OF} - INTERVAL 24 HOUR)
SELECT id, unit_id, unit_name, "timestamp", "timestamp" + INTERVAL 7 HOUR AS local_time, series, value FROM (
  SELECT *, 'do_predicted' AS series, do_predicted AS value FROM recent
  UNION ALL
  SELECT *, 'temperature' AS series, temperature AS value FROM recent
)""",
        "unit_overview": f"{latest} {overview} ORDER BY u.id",
        "unit_state": f"""{latest}
SELECT id, name, status,
       CASE WHEN status = 'warning' THEN 'warning' WHEN status_do_predicted = 'kritis' THEN 'critical' ELSE 'ok' END AS state
FROM ({overview})""",
        "generate_alerts": f"{latest} SELECT *, FALSE AS is_read FROM ({_raise('latest', 'unit_name')})",
        "alerts_of_all": f"{base} SELECT *, FALSE AS is_read FROM ({_raise('named', 'unit_name')})",
        "alert_feed": f"{plain_alerts} {_feed('alerts')}",
        "critical_alert": f"""{plain_alerts}, feed AS ({_feed("alerts")})
SELECT * FROM feed WHERE NOT is_read
ORDER BY CASE severity WHEN 'danger' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END, "timestamp" DESC, id DESC LIMIT 1""",
        "apply_receipts": f"""{_with(READINGS, _alerts(), RECEIPTS)}
SELECT * REPLACE (is_read OR id IN (SELECT alert_id FROM receipts) AS is_read) FROM alerts""",
        "unknown_receipts": f"""{_with(READINGS, _alerts(), RECEIPTS)}
SELECT alert_id, count(*) AS receipts FROM receipts
WHERE alert_id NOT IN (SELECT id FROM alerts) GROUP BY alert_id""",
        "new_dangers": f"""{feeds}
SELECT * FROM feed WHERE severity = 'danger' AND NOT is_read
  AND id NOT IN (SELECT id FROM earlier WHERE severity = 'danger' AND NOT is_read)""",
        "first_dangers": f"{feeds} SELECT * FROM feed WHERE severity = 'danger' AND NOT is_read",
        "forecast_do": f"{forecast} SELECT * FROM forecast",
        "forecast_status": f"""{forecast}
SELECT unit_id, unit_name, do_now,
       CASE WHEN do_now < 4 THEN 'kritis' WHEN do_now < 5 THEN 'perhatian' ELSE 'normal' END AS do_status
FROM forecast""",
        "forecast_declining_by_status": f"""{_forecast("u.species = 'snapper'")} SELECT * FROM forecast""",
        "forecast_missing_oxygen": f"""{_forecast("u.id = 3", CLEAN + ", " + DIRTY_IN_PLACE)} SELECT * FROM forecast""",
        "forecast_features": f"""{_with(READINGS)}
SELECT unit_id, "timestamp", {", ".join(MEASURES)} FROM readings
WHERE "timestamp" >= {AS_OF} - INTERVAL 24 HOUR""",
        "forecast_with_model": f"""{_with(UNITS, READINGS)},
newest AS (
  SELECT unit_id, arg_max(do_predicted, row("timestamp", id)) AS last FROM readings
  WHERE "timestamp" >= {AS_OF} - INTERVAL 24 HOUR GROUP BY unit_id
)
SELECT u.id AS unit_id, u.name AS unit_name, d.v AS do_now, d.v AS do_2h, d.v AS do_4h, d.v AS do_6h,
       0.5::DOUBLE AS confidence
FROM units u LEFT JOIN newest n ON n.unit_id = u.id, LATERAL (SELECT coalesce(n.last, 5.5::DOUBLE) AS v) d""",
        "check_constraints": f"{plain_alerts} {_constraints()}",
        "check_constraints_dirty": _dirty_constraints(),
        "apply_defaults": f"""{_with(READINGS, DIRTY_READINGS)}
SELECT * REPLACE (coalesce(do_source, 'tft') AS do_source) FROM dirty""",
        "generate_units": """
SELECT CAST(i AS INTEGER) AS id, printf('U-%02d', CAST(i AS BIGINT)) AS name,
       CASE WHEN i % 2 = 1 THEN 'grouper' ELSE 'snapper' END AS species,
       CASE WHEN i = 3 THEN 'warning' ELSE 'active' END AS status,
       printf('Farmer %02d', i) AS farmer_name
FROM (SELECT c_custkey + 1 AS i FROM customer)""",
        "generate_readings": f"{_with(GENERATED)} SELECT * FROM generated",
        "generated_alerts": f"""{_with(GENERATED)},
latest AS (
  SELECT g.*, f.name AS unit_name FROM generated g JOIN fleet f ON f.id = g.unit_id
  WHERE g."timestamp" = (SELECT max("timestamp") FROM generated)
)
SELECT *, FALSE AS is_read FROM ({_raise("latest", "unit_name")})""",
        "stream_alerts": f"{base} SELECT *, FALSE AS is_read FROM ({_raise('named', 'unit_name')})",
        "stream_new_dangers": f"{plain_alerts} SELECT * FROM alerts WHERE severity = 'danger' AND NOT is_read",
        "stream_latest": f"{latest} SELECT {READING_COLUMNS}, {STATUS_COLUMNS}, {LIGHT_STATUS} FROM latest",
        "stream_forecast": f"{forecast} SELECT * FROM forecast",
    }
