"""Stored tables: Parquet folders, catalog tables and JSON lines."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.text import iso_text
from tidewatch.operators.quality import apply_defaults
from tidewatch.schemas import DEFAULTS, TABLES

# Tables with a time are stored by day and, within a file, by unit and time, so
# that a lookback reads only its days and a unit filter skips row groups.
DATED = ("readings", "alerts")
#: What tells a row of a table from the others.
KEYS = {"units": "id", "readings": "id", "alerts": "id", "receipts": "alert_id"}


def stored_schema(table: str) -> T.StructType:
    fields = list(TABLES[table].fields)
    if table in DATED:
        fields.append(T.StructField("date", T.DateType()))
    return T.StructType(fields)


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.schema(stored_schema(table)).parquet(path)


def _arranged(rows: DataFrame, table: str) -> DataFrame:
    """Rows in stored order and types, spread so that files come out even.

    The rebalance joins the small pieces of a day into full files and splits a
    day that is too large for one task.
    """
    if table in DEFAULTS:
        rows = apply_defaults(rows, table)
    rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[table].fields])
    if table not in DATED:
        return rows
    dated = rows.withColumn("date", F.to_date("timestamp"))
    return dated.hint("rebalance", "date").sortWithinPartitions("date", "unit_id", "timestamp")


def write_table(rows: DataFrame, path: str, table: str, mode: str = "append") -> None:
    """Adds rows to a table's folder, or replaces it with ``mode="overwrite"``."""
    writer = _arranged(rows, table).write.mode(mode)
    if table in DATED:
        writer = writer.partitionBy("date")
    writer.parquet(path)


def insert_new(rows: DataFrame, path: str, table: str) -> None:
    """Adds the rows whose key the table does not hold yet; adding the same rows again adds nothing.

    A table stored by day is looked at on the days of the new rows only, and of it no more
    than the keys. Of new rows with one key, one is added.
    """
    key = KEYS[table]
    rows = _arranged(rows, table).dropDuplicates([key])
    try:
        held = read_table(rows.sparkSession, path, table)
    except AnalysisException:  # nothing is stored yet
        held = None
    if held is not None:
        same = [key]
        if table in DATED:
            days = [r[0] for r in rows.select("date").distinct().collect()]  # one value per day
            held = held.filter(F.col("date").isin([d for d in days if d]) | (F.col("date").isNull() if None in days else F.lit(False)))
            same.append("date")
        held = held.select(*[F.col(c).alias(f"_{c}") for c in same])
        rows = rows.join(held, [rows[c].eqNullSafe(held[f"_{c}"]) for c in same], "left_anti")
    write_table(rows, path, table)


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """Creates the catalog tables that do not exist yet."""
    for table in TABLES:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored_schema(table).fields)
        layout = "PARTITIONED BY (`date`)" if table in DATED else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{table} ({columns}) USING parquet {layout}")


def recreate_tables(spark: SparkSession, database: str = "default") -> None:
    """Drops the catalog tables with their rows, and creates them empty."""
    for table in TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {database}.{table}")
    create_tables(spark, database)


def insert_rows(rows: DataFrame, table: str, database: str = "default") -> None:
    _arranged(rows, table).write.mode("append").insertInto(f"{database}.{table}")


def _rendered(name: str, kind: T.DataType) -> str:
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return iso_text(name)
    if isinstance(kind, T.StructType):
        fields = ", ".join(f"'{f.name}', {_rendered(f'{name}.{f.name}', f.dataType)}" for f in kind.fields)
        return f"CASE WHEN {name} IS NOT NULL THEN named_struct({fields}) END"
    return name


def json_documents(rows: DataFrame) -> DataFrame:
    """One JSON text per row in column ``document``; times as ISO text, empty fields as null."""
    fields = ", ".join(f"'{f.name}', {_rendered(f.name, f.dataType)}" for f in rows.schema.fields)
    return rows.selectExpr(f"to_json(named_struct({fields}), map('ignoreNullFields', 'false')) AS document")


def write_json_lines(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    json_documents(rows).write.mode(mode).text(path)
