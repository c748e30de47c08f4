"""The corpus pipeline: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontaminate, mixing, quality, sharding, simhash
from tidewatch.llm.common import remove, stored, table, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality classifier, trained on the labelled documents, rejects."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take_copies(docs)


def to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str, old: str | None = None, path: str | None = None) -> DataFrame:
    """The documents with shard and slot.

    ``old`` names a column that holds the shard each row lies in now; with ``path`` as well, the
    files of the shards that change are written there. Without it no layout is given.
    """
    placed = sharding.place(docs, old=F.col(old) if old else None)
    if old and path:
        sharding.rewrite(placed, path)
    return placed.select("doc.*", "shard", "slot")


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", to_shards),
]

# Training, hashing by seed and the flow cannot be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage; of the folders written on the way only its own stays."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with written() as folders:
            docs = stored(stage(spark, docs, sf_dir))
        remove(spark, before + folders[:-1])
        before = folders[-1:]
    return docs
