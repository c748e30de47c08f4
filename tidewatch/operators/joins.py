"""Joins of large fact tables with the unit dimension.

A unit table is normally small enough to broadcast, but nothing guarantees it,
so its size is measured first. Beyond the bound the join shuffles; the units that
hold a large share of the rows are found by a count, and only their keys are salted,
so that each is spread over many tasks.
"""

from __future__ import annotations

import weakref

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 32 * 1024 * 1024
SALTS = 64
#: A key with this share of the rows is hot; there are at most so many of them as the share's inverse.
HOT_SHARE = 1 / 256

_FIELD_BYTES = 16  # one fixed-width field of a row, with its share of the row header
_sizes: weakref.WeakKeyDictionary[DataFrame, int] = weakref.WeakKeyDictionary()


def measured_bytes(df: DataFrame) -> int:
    """In-memory size of a table: rows, fixed-width fields and text lengths.

    One aggregate over ``df``; only the total reaches the driver.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    row = F.lit(_FIELD_BYTES * (len(df.columns) + 1)).cast("long")
    for name in texts:
        row = row + F.coalesce(F.octet_length(name), F.lit(0))
    return df.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0]


def fits_broadcast(df: DataFrame, limit: int | None = None) -> bool:
    """Whether a table's measured size is within the bound."""
    return measured_bytes(df) <= (BROADCAST_BYTES if limit is None else limit)


def unit_names(units: DataFrame) -> DataFrame:
    return units.select(F.col("id").alias("unit_id"), F.col("name").alias("unit_name"))


def names_fit_broadcast(units: DataFrame, limit: int | None = None) -> bool:
    """Whether ids and names of the units fit the bound; measured once per DataFrame."""
    if units not in _sizes:
        _sizes[units] = measured_bytes(unit_names(units))
    return _sizes[units] <= (BROADCAST_BYTES if limit is None else limit)


def hot_keys(fact: DataFrame, key: str, share: float = HOT_SHARE) -> list:
    """Keys that hold at least ``share`` of the rows; at most ``1 / share`` of them.

    One pass over the key column alone, counted within each task before the shuffle.
    """
    counts = fact.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    whole = fact.agg(F.count("*")).scalar()
    return [r[0] for r in counts.filter(F.col("n") >= F.lit(share) * whole).collect()]


def salted_join(fact: DataFrame, dimension: DataFrame, key: str, spread: Column, salts: int = SALTS) -> DataFrame:
    """Inner join in which the hot keys of ``fact`` are split over ``salts`` shuffle keys.

    ``spread`` is any column that differs between the rows of one key. Only hot keys are
    repeated in the dimension, once per salt; its keys may repeat as in any join. A
    stream's rows cannot be counted beforehand: there every key is salted.
    """
    is_hot = F.lit(True) if fact.isStreaming else F.col(key).isin(hot_keys(fact, key))
    salted = fact.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(F.lit(0)))
    places = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = dimension.withColumn("_salt", F.explode(places))
    return salted.join(repeated, [key, "_salt"]).drop("_salt")


def join_unit_names(
    fact: DataFrame, units: DataFrame, limit: int | None = None, within: DataFrame | None = None
) -> DataFrame:
    """Adds ``unit_name``; rows of unknown units are dropped.

    When ``units`` is a selection, ``within`` is the table it was taken from,
    which is measured in its place.
    """
    names = unit_names(units)
    if names_fit_broadcast(units if within is None else within, limit):
        return fact.join(F.broadcast(names), "unit_id")
    return salted_join(fact, names, "unit_id", F.col("id"))
