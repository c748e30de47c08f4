"""Declared constraints as one data-quality job, and column defaults on ingest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.schemas import DEFAULTS, DOMAINS, MAX_LENGTHS, REQUIRED


def apply_defaults(rows: DataFrame, table: str) -> DataFrame:
    """Fills empty columns of ``table`` that declare a default."""
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS[table].items()})


def _row_rules(table: str) -> dict[str, str]:
    """Rules that one row can break, as conditions that are true for a violation."""
    rules = {f"not_null:{c}": f"{c} IS NULL" for c in REQUIRED[table]}
    for column, domain in DOMAINS[table].items():
        rules[f"domain:{column}"] = f"{column} NOT IN {domain}"
    for column, length in MAX_LENGTHS.get(table, {}).items():
        rules[f"max_length:{column}"] = f"length({column}) > {length}"
    return rules


def _counted(rows: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """Rows and violations per key; the heavy part, summed within each task first."""
    counts = [F.expr(f"count_if({broken}) AS `{rule}`") for rule, broken in rules.items()]
    return rows.groupBy(key).agg(F.count("*").alias("_rows"), *counts)


def _as_rows(table: str, per_key: DataFrame, rules: dict[str, str], key_rule: str, key_violations: str) -> DataFrame:
    sums = [F.expr(f"coalesce(sum(`{rule}`), 0L) AS `{rule}`") for rule in rules]
    totals = per_key.agg(*sums, F.expr(f"coalesce({key_violations}, 0L) AS `{key_rule}`"))
    entries = ", ".join(f"'{rule}', `{rule}`" for rule in (*rules, key_rule))
    stacked = totals.selectExpr(f"stack({len(rules) + 1}, {entries}) AS (rule, violations)")
    return stacked.selectExpr(f"'{table}' AS table_name", "rule", "violations")


def _check_units(units: DataFrame) -> DataFrame:
    """Names are counted first, so the unique check sees one row per name."""
    rules = _row_rules("units")
    repeated = "count_if(name IS NOT NULL AND _rows > 1)"
    return _as_rows("units", _counted(units, "name", rules), rules, "unique:name", repeated)


def _check_facts(table: str, facts: DataFrame, units: DataFrame) -> DataFrame:
    """One scan: counts per unit id first, then the few unit ids meet the units."""
    rules = _row_rules(table)
    known = units.selectExpr("id AS unit_id", "true AS _known").distinct()
    per_unit = _counted(facts, "unit_id", rules).join(known, "unit_id", "left")
    orphans = "sum(CASE WHEN unit_id IS NOT NULL AND _known IS NULL THEN _rows END)"
    return _as_rows(table, per_unit, rules, "foreign_key:unit_id", orphans)


def repeated_ids(table: str, rows: DataFrame) -> DataFrame:
    """How many ids are used more than once.

    Two steps. Ids are marked in bitmaps of 32,768 neighbouring ids each, in every task
    before the shuffle, and the rows of each block counted: a block with more rows than
    marks holds a repeated id. Only ids of such blocks are then shuffled one by one; where
    there is none, the second step reads nothing.
    """
    ids = rows.filter("id IS NOT NULL").selectExpr("CAST(id AS BIGINT) AS id", "bitmap_bucket_number(CAST(id AS BIGINT)) AS block")
    blocks = ids.groupBy("block").agg(
        F.count("*").alias("n"), F.expr("bitmap_count(bitmap_construct_agg(bitmap_bit_position(id)))").alias("marks")
    )
    crowded = blocks.filter("n > marks").select("block")
    per_id = ids.join(crowded, "block", "left_semi").groupBy("id").agg(F.count("*").alias("n"))
    return per_id.filter("n > 1").agg(F.count("*").alias("violations")).selectExpr(
        f"'{table}' AS table_name", "'unique:id' AS rule", "violations"
    )


def check_constraints(units: DataFrame, readings: DataFrame, alerts: DataFrame) -> DataFrame:
    """Violations per table and rule; ``unique`` rules count the values used more than once."""
    tables = {"units": units, "readings": readings, "alerts": alerts}
    parts = [_check_units(units), _check_facts("readings", readings, units), _check_facts("alerts", alerts, units)]
    parts += [repeated_ids(name, rows) for name, rows in tables.items()]
    return reduce(DataFrame.unionByName, parts)
