"""Mixing sources to target weights by systematic sampling; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import WORD, text_or_empty

WEIGHTS = (5, 2, 1)
SHARE, LIMIT = 1.5, 2.0


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target for (source, size) rows; one row per source.

    Sources in code-point order, null last, weigh 5, 2, 1 repeating. No target passes
    ``LIMIT`` times its source: with the sources in order of limit per weight, the
    excess of the full ones is shared by the others, which is the level of the first
    source that does not reach its own limit. The windows see one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), F.pmod(place, F.lit(len(WEIGHTS))).cast("int") + 1))
    rise = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rise.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    per = per.select(
        "source",
        "source_size",
        "weight",
        (F.lit(SHARE) * F.sum("source_size").over(whole)).alias("total"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("full"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("rest"),
    )
    level = (F.col("total") - LIMIT * F.col("full")) / F.col("rest")
    fits = level * F.col("weight") <= LIMIT * F.col("source_size")
    per = per.withColumn("level", level).withColumn("line", F.max(F.when(fits, level)).over(whole))
    target = F.least(LIMIT * F.col("source_size"), F.coalesce(F.col("line") * F.col("weight"), LIMIT * F.col("source_size")))
    return per.select("source", F.col("source_size").cast("long").alias("source_size"), target.cast("double").alias("target"))


def with_copies(docs: DataFrame) -> DataFrame:
    """``doc`` (the whole row), size, source_size, target and copies of every row.

    Each document of a source is expected ``target / source_size`` times. Along the
    source's documents, ordered by size class, a hash of the id and size, these add up;
    one offset per source is added, and a document is taken once per whole number
    passed: 0, 1 or 2 times. A source with many rows is ordered in pieces of one size
    class and hash each, whose counts are summed first.

    Null texts have size 0, null sources are one source, null ids hash as the empty
    text; rows of size 0 take part like others. Repeated rows are counted each. An
    empty table gives no rows. Extra columns stay inside ``doc``.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.col("source").alias("source"),
        F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id_text"),
    )
    targets = source_targets(rows.select("source", "size"))
    # Four leading bits of the size, after its bit length: classes an eighth of an octave wide.
    bits = F.length(F.bin("size"))
    low = F.expr("shiftright(size, greatest(length(bin(size)) - 4, 0))")
    piece = ["source", "bits", "low", "part"]
    rows = rows.withColumns({"bits": bits, "low": low, "part": F.substring(F.md5("id_text"), 1, 2)})
    order = Window.partitionBy("source").orderBy("bits", "low", "part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = rows.groupBy(*piece).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    # Equal in all of these, two rows are interchangeable but for columns no rule names.
    within = Window.partitionBy(*piece).orderBy("size", "doc.doc_id", F.xxhash64("doc.text"))
    ranked = rows.withColumn("rank", F.row_number().over(within))
    counted = _join(_join(ranked, pieces.drop("n"), piece), targets, ["source"])
    offset = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("double") / 4294967296.0
    step = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    last = F.col("before") + F.col("rank")
    copies = F.floor(last * step + offset) - F.floor((last - 1) * step + offset)
    return counted.select("doc", "size", "source_size", "target", copies.cast("long").alias("copies"))


def _join(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the facts of each key; null keys are equal."""
    facts = facts.select(*[F.col(k).alias(f"k_{k}") for k in keys], *[c for c in facts.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys]
    return rows.join(facts, same).drop(*[f"k_{k}" for k in keys])


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    rows = with_copies(docs.select(F.col("doc_id").cast("long"), "text", "source"))
    return rows.select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def take_copies(docs: DataFrame) -> DataFrame:
    """The mix itself: every row as often as it is taken, with its columns."""
    return with_copies(docs).withColumn("copy", F.explode(F.expr("array_repeat(0, CAST(copies AS INT))"))).select("doc.*")
