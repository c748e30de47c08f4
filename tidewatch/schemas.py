"""Table schemas and value domains."""

from __future__ import annotations

from pyspark.sql import types as T

# The domains of the enumerated columns.
SPECIES = ("grouper", "snapper")
DO_SOURCES = ("tft", "manual")
SEVERITIES = ("info", "warn", "danger")

# Defaults for columns left empty on ingest.
DEFAULTS = {
    "units": {"status": "active"},
    "readings": {"do_source": "tft"},
    "alerts": {"is_read": False},
}

# Declared text lengths.
MAX_LENGTHS = {
    "units": {"name": 32, "status": 32, "farmer_name": 128},
    "alerts": {"parameter": 64, "message": 512},
}

MEASURES = ("ph", "temperature", "salinity", "turbidity", "light_intensity", "do_predicted")

UNITS = T.StructType(
    [
        T.StructField("id", T.IntegerType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("species", T.StringType(), False),
        T.StructField("status", T.StringType()),
        T.StructField("farmer_name", T.StringType(), False),
    ]
)

READINGS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("unit_id", T.IntegerType(), False),
        T.StructField("timestamp", T.TimestampNTZType(), False),
        *[T.StructField(name, T.DoubleType(), False) for name in MEASURES],
        T.StructField("do_source", T.StringType()),
    ]
)

ALERTS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("unit_id", T.IntegerType(), False),
        T.StructField("parameter", T.StringType(), False),
        T.StructField("severity", T.StringType()),
        T.StructField("message", T.StringType(), False),
        T.StructField("timestamp", T.TimestampNTZType(), False),
        T.StructField("is_read", T.BooleanType()),
    ]
)

RECEIPTS = T.StructType([T.StructField("alert_id", T.LongType(), False)])

TABLES = {"units": UNITS, "readings": READINGS, "alerts": ALERTS, "receipts": RECEIPTS}

# Columns a row may not leave empty. Those with a default are filled on ingest, so only rows that went round it break them.
REQUIRED = {
    "units": ("id", "name", "species", "status", "farmer_name"),
    "readings": ("id", "unit_id", "timestamp", *MEASURES, "do_source"),
    "alerts": ("id", "unit_id", "parameter", "severity", "message", "timestamp", "is_read"),
}

DOMAINS = {
    "units": {"species": SPECIES},
    "readings": {"do_source": DO_SOURCES},
    "alerts": {"severity": SEVERITIES},
}
