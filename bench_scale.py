"""Times the operators on generated readings with one unit holding a third of the rows.

    python bench_scale.py ROWS [FOLDER]

Writes the readings below FOLDER (a new temporary folder by default; an existing
table there is used again), then prints one JSON line with seconds, shuffle bytes
and the longest task of each operator, taken from Spark's event log.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import functions as F

from tidewatch.operators import alerts as alert_ops
from tidewatch.operators import readings as reading_ops
from tidewatch.operators.forecast import forecast_do
from tidewatch.operators.quality import check_constraints
from tidewatch.operators.recent import latest_one
from tidewatch.session import local_session
from tidewatch.sources.generator import generate_readings, generate_units
from tidewatch.sources.tables import read_table, write_table

AS_OF = "2024-06-30 12:00:00"
HOURS = 1000


def prepare(spark, folder: str, rows: int) -> None:
    """Two thirds of the rows spread over the units, one third added to unit 1."""
    fleet = generate_units(spark, max(rows * 2 // 3 // HOURS, 1))
    spread = generate_readings(fleet, AS_OF, HOURS)
    offset = rows * 10
    hot = spread.filter("id % 2 = 0").selectExpr(
        f"id + {offset} AS id",
        "1 AS unit_id",
        "timestamp + make_dt_interval(0, 0, 0, CAST(pmod(xxhash64(id), 3600) AS DECIMAL(18, 6))) AS timestamp",
        *spread.columns[3:],
    )
    fleet.write.mode("overwrite").parquet(f"{folder}/units")
    write_table(spread.unionByName(hot), f"{folder}/readings", "readings", mode="overwrite")
    readings = read_table(spark, f"{folder}/readings", "readings")
    write_table(alert_ops.alerts_of_all(fleet, readings), f"{folder}/alerts", "alerts", mode="overwrite")


def operators(units, readings, alerts):
    """Name and a function building the result; ``wide`` ones may not broadcast the units."""
    receipts = readings.filter("id % 7 = 0").selectExpr("if(id % 3 = 0, 35L, id * 5) AS alert_id")
    return {
        "latest_readings": lambda: reading_ops.latest_readings(readings, units),
        "latest_readings_wide": lambda: latest_one(readings, units, limit=0),
        "unit_overview": lambda: reading_ops.unit_overview(units, readings),
        "sensor_history_24h": lambda: reading_ops.sensor_history(readings, units, AS_OF, 24),
        "sensor_history_168h": lambda: reading_ops.sensor_history(readings, units, AS_OF, 168),
        "band_readings": lambda: reading_ops.band_readings(readings),
        "band_counts": lambda: reading_ops.band_counts(readings),
        "generate_alerts": lambda: alert_ops.generate_alerts(units, readings),
        "alerts_of_all": lambda: alert_ops.alerts_of_all(units, readings),
        "alert_feed": lambda: alert_ops.alert_feed(alerts, units),
        "apply_receipts": lambda: alert_ops.apply_receipts(alerts, receipts),
        "forecast_do": lambda: forecast_do(units, readings, AS_OF),
        "check_constraints": lambda: check_constraints(units, readings, alerts),
    }


def stage_metrics(log_dir: str) -> dict[str, dict]:
    """Shuffle bytes and longest task per job group."""
    groups: dict[int, str] = {}
    totals: dict[str, dict] = {}
    for file in Path(log_dir).rglob("*"):
        if not file.is_file():
            continue
        for line in file.read_text().splitlines():
            event = json.loads(line)
            kind = event.get("Event")
            if kind == "SparkListenerJobStart":
                group = (event.get("Properties") or {}).get("spark.jobGroup.id")
                for stage in event["Stage IDs"]:
                    groups.setdefault(stage, group)
            elif kind == "SparkListenerTaskEnd" and event.get("Task Metrics"):
                group = groups.get(event["Stage ID"])
                if group:
                    entry = totals.setdefault(group, {"shuffle_mb": 0.0, "spill_mb": 0.0, "longest_task": 0.0})
                    metrics = event["Task Metrics"]
                    entry["shuffle_mb"] += metrics["Shuffle Write Metrics"]["Shuffle Bytes Written"] / 1e6
                    entry["spill_mb"] += metrics["Disk Bytes Spilled"] / 1e6
                    info = event["Task Info"]
                    entry["longest_task"] = max(entry["longest_task"], (info["Finish Time"] - info["Launch Time"]) / 1000)
    return totals


def main() -> None:
    rows = int(float(sys.argv[1])) if len(sys.argv) > 1 else 1_000_000
    folder = sys.argv[2] if len(sys.argv) > 2 else tempfile.mkdtemp(prefix="run-", dir="/tmp")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    log_dir = tempfile.mkdtemp(prefix="log-", dir=folder)
    logging = {
        "spark.eventLog.enabled": "true",
        "spark.eventLog.dir": f"file://{log_dir}",
        "spark.eventLog.compress": "false",
        "spark.eventLog.rolling.enabled": "false",
        "spark.local.dir": folder,
    }
    spark = local_session(cpus=cpus, shuffle_partitions=4 * cpus, memory="20g", more=logging)
    if not Path(f"{folder}/alerts/_SUCCESS").exists():
        prepare(spark, folder, rows)
    units = spark.read.parquet(f"{folder}/units")
    readings = read_table(spark, f"{folder}/readings", "readings")
    alerts = read_table(spark, f"{folder}/alerts", "alerts")
    hot = readings.groupBy("unit_id").count().agg(F.max("count"), F.sum("count")).first()
    seconds = {}
    for name, build in operators(units, readings, alerts).items():
        for attempt in ("warm-up", "measured"):
            spark.sparkContext.setJobGroup(f"{name}/{attempt}", name)
            start = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 2)
    spark_version = spark.version
    spark.stop()
    metrics = stage_metrics(log_dir)
    report = {
        name: {"sec": s, **{k: round(v, 2) for k, v in metrics.get(f"{name}/measured", {}).items()}}
        for name, s in seconds.items()
    }
    print(json.dumps({"rows": hot[1], "hot_unit_rows": hot[0], "cpus": cpus, "spark": spark_version, "operators": report}))


if __name__ == "__main__":
    main()
