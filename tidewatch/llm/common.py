"""Helpers shared by the operators: reading tables, cutting lineage, training samples."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import shared_folder

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WATCHED: list[list[str]] = []


@contextmanager
def written() -> Iterator[list[str]]:
    """The folders that ``stored`` writes meanwhile, in their order."""
    folders: list[str] = []
    _WATCHED.append(folders)
    try:
        yield folders
    finally:
        _WATCHED[:] = [f for f in _WATCHED if f is not folders]


def remove(spark: SparkSession, folders: list[str]) -> None:
    """Deletes folders of ``stored`` that nothing reads any more."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(rows: DataFrame) -> DataFrame:
    """The rows written to a new folder in the shared place and read again.

    Lineage is cut by files that outlive an executor.
    """
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    for folders in _WATCHED:
        folders.append(path)
    return spark.read.schema(rows.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def is_held_out(fold: int, folds: int) -> Column:
    """True where crc32 of the id as text falls into the fold; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(folds)) == fold


def training_sample(
    docs: DataFrame, labels: DataFrame, label: str, fold: int, folds: int, per_class: int, max_bytes: int
) -> list[tuple[int, str, int]]:
    """(doc_id, text, label) of at most ``per_class`` labelled rows of each class outside the held-out fold.

    The bound is ``2 * per_class`` rows of at most ``max_bytes`` bytes each, chosen by
    a hash of the id, so that what reaches the driver does not grow with the corpus.
    Null labels and ids are left out; an id with several labels has the largest.
    """
    marked = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(fold, folds))
        .groupBy("doc_id")
        .agg(F.max(label).alias("label"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    # Ids are chosen before texts are read; three times as many as needed, since
    # some have no text of a fitting length.
    chosen = [marked.where(F.col("label") == y).orderBy(*order).limit(3 * per_class) for y in (0, 1)]
    ids = chosen[0].unionByName(chosen[1])
    texts = docs.select("doc_id", "text").where(F.octet_length("text").between(1, max_bytes))
    found = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    parts = [found.where(F.col("label") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    rows = parts[0].unionByName(parts[1]).collect()
    return sorted((r["doc_id"], r["text"], int(r["label"])) for r in rows)
