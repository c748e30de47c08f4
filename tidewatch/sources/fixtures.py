"""The monitoring tables as views over the benchmark's Parquet tables."""

from __future__ import annotations

from datetime import datetime
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.times import floor_hour
from tidewatch.operators.alerts import raise_alerts

# Declared, so that opening a table starts no job to look into its files.
SCHEMAS = {
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).parquet(f"{sf_dir}/{table}.parquet")


@lru_cache(maxsize=16)
def as_of(spark: SparkSession, sf_dir: str) -> datetime:
    """The newest time of the readings, looked up once and then passed on as a literal."""
    return load(spark, sf_dir, "events").agg(F.max("ts")).first()[0]


_UNIT_NAME = "concat('U-', lpad(CAST({0} AS STRING), 2, '0'))"


@lru_cache(maxsize=16)
def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One DataFrame per session and folder, so that its size is measured once."""
    return load(spark, sf_dir, "nation").selectExpr(
        "n_nationkey + 1 AS id",
        f"{_UNIT_NAME.format('n_nationkey + 1')} AS name",
        "if(n_nationkey % 2 = 0, 'grouper', 'snapper') AS species",
        "if(n_nationkey = 2, 'warning', 'active') AS status",
        "n_name AS farmer_name",
    )


def fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unit per customer: a dimension that grows with the data."""
    return load(spark, sf_dir, "customer").selectExpr(
        "CAST(c_custkey + 1 AS INT) AS id", "format_string('U-%02d', c_custkey + 1) AS name"
    )


def readings_of(events: DataFrame) -> DataFrame:
    """Readings made from event rows, batch or stream."""
    return events.selectExpr(
        "event_id AS id",
        "CAST(user_id % 30 + 3 AS INT) AS unit_id",
        "ts AS timestamp",
        "(650 + event_id * 11 % 301) / 100D AS ph",
        "(2100 + event_id * 13 % 1301) / 100D AS temperature",
        "(2000 + event_id * 17 % 1601) / 100D AS salinity",
        "(500 + event_id * 19 % 3001) / 100D AS turbidity",
        "CAST(12000 + event_id * 101 % 33001 AS DOUBLE) AS light_intensity",
        "(300 + event_id * 23 % 501) / 100D AS do_predicted",
        "if(event_id % 10 = 0, 'manual', 'tft') AS do_source",
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings_of(load(spark, sf_dir, "events"))


def readings_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with times cut to the hour, which makes ties."""
    return readings(spark, sf_dir).withColumn("timestamp", F.expr(floor_hour("timestamp")))


def alerts_of(readings_df: DataFrame) -> DataFrame:
    """Alerts of all readings, known unit or not, a third of them read."""
    named = readings_df.selectExpr("*", f"{_UNIT_NAME.format('unit_id')} AS unit_name")
    return raise_alerts(named).withColumn("is_read", F.expr("id % 3 = 0"))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts_of(readings(spark, sf_dir))


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").filter("event_type = 'click'").selectExpr("event_id * 5 AS alert_id")


# Tables with broken rows, for the constraint checks.


def dirty_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit per customer, with repeated ids and names, overlong names, empty and foreign values."""
    return load(spark, sf_dir, "customer").selectExpr(
        "CAST(c_custkey + if(c_custkey % 19 = 1, 0, 1) AS INT) AS id",
        "CASE WHEN c_custkey % 11 = 0 THEN concat('U-', c_custkey % 7)"
        " WHEN c_custkey % 13 = 0 THEN concat('U-', lpad(CAST(c_custkey AS STRING), 40, '0'))"
        " WHEN c_custkey % 17 <> 0 THEN concat('U-', c_custkey) END AS name",
        "CASE c_custkey % 5 WHEN 0 THEN 'carp' WHEN 1 THEN 'snapper' WHEN 2 THEN 'grouper' END AS species",
        "CASE WHEN c_custkey % 3 = 0 THEN 'active' END AS status",
        "c_name AS farmer_name",
    )


def dirty_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with repeated ids, empty measures, units and sources."""
    broken = {
        "id": "if(id % 101 = 1, id - 1, id)",
        "unit_id": "CASE WHEN id % 23 <> 0 THEN unit_id END",
        "ph": "CASE WHEN id % 97 <> 0 THEN ph END",
        "do_predicted": "CASE WHEN id % 89 <> 0 THEN do_predicted END",
        "do_source": "CASE WHEN id % 7 = 0 THEN 'buoy' WHEN id % 7 <> 1 THEN do_source END",
    }
    return readings(spark, sf_dir).withColumns({c: F.expr(e) for c, e in broken.items()})
