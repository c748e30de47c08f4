"""Document fingerprints from closed syncmers; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import stored, text_or_empty

#: Words of a k-mer and of its inner strings: 7 inner strings, so two k-mers in seven are anchors.
K, S = 9, 3  # _of_words joins three words
INNER = K - S + 1
#: Ids are cut into this many ranges, each one piece of the order of documents.
RANGES = 512


def anchors(text: Column) -> Column:
    """Hashes of the closed syncmers of a text, in order.

    A k-mer of words is taken if the smallest hash among its inner strings is its
    first or last one. Whether it is taken depends on its own words alone, so that an
    edit changes only the anchors of the k-mers that it touches. Some k-mer is taken in
    every text of 14 words and more. A text without one, of fewer words than a k-mer or
    with no k-mer taken, has its whole word sequence as the one anchor.
    """
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.flatten(F.transform(F.array(hashed), _of_words))


def _of_words(words: Column) -> Column:
    twos = F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.xxhash64(a, b))
    inner = F.zip_with(twos, F.slice(words, 3, F.size(words)), lambda a, b: F.xxhash64(a, b))
    whole = F.array(F.xxhash64(words))
    chosen = F.transform(F.array(F.slice(inner, 1, F.size(words) - S + 1)), _edge_minima)
    return F.when(F.size(words) < K, whole).otherwise(
        F.flatten(F.transform(chosen, lambda a: F.when(F.size(a) > 0, a).otherwise(whole)))
    )


def _edge_minima(inner: Column) -> Column:
    count = F.size(inner) - INNER + 1
    spans = F.transform(F.sequence(F.lit(1), count), lambda i: F.slice(inner, i, INNER))
    chosen = F.filter(spans, lambda s: F.least(s[0], s[INNER - 1]) == F.array_min(s))
    # Inner strings at both ends and in the middle cover all words of the k-mer.
    return F.transform(chosen, lambda s: F.xxhash64(s[0], s[S], s[INNER - 1]))


def printed(hashes: Column) -> Column:
    """Eight hexadecimal digits of each distinct anchor, in the order of first place."""
    return F.array_join(F.transform(F.array_distinct(hashes), lambda h: F.right(F.lpad(F.hex(h), 16, F.lit("0")), F.lit(8))), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of anchors."""
    both = F.size(F.array_intersect(a, b))
    return both / F.greatest(F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both, F.lit(1))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and next_text, the text of the document with the next smaller id.

    After the smallest id comes the largest. Ids are cut into ranges by their
    quantiles, every range is ordered by itself, and the first row of the following
    range is added to each as a guest. Rows of one id are ordered by a hash of the
    text; rows without id come last.
    """
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    cuts = [i / RANGES for i in range(1, RANGES)]
    found = rows.agg(F.percentile_approx("doc_id", cuts, 100_000)).first()[0] or []
    bounds = F.array(*[F.lit(b).cast("long") for b in sorted(set(found))]) if found else F.array().cast("array<long>")
    # A range has the ids above its bound up to the next; the last one has the null ids.
    place = F.lit(len(found) + 1) - F.aggregate(bounds, F.lit(0), lambda n, b: n + (b < F.col("doc_id")).cast("int"))
    rows = rows.withColumn("range", F.coalesce(place, F.lit(len(found) + 2))).withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    keys = stored(rows.select("range", "doc_id", "tie"))
    first = keys.groupBy("range").agg(F.min(F.struct((-F.col("doc_id")).alias("low"), "tie")).alias("f"))
    first = first.select("range", (-F.col("f.low")).alias("head_id"), F.col("f.tie").alias("head_tie"))
    # At most RANGES + 2 rows from here on.
    ring = Window.orderBy("range")
    heads = first.withColumn("before", F.coalesce(F.lag("range").over(ring), F.max("range").over(Window.partitionBy())))
    same = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie")) & (rows["range"] == heads["range"])
    guests = rows.join(F.broadcast(heads), same).groupBy("before").agg(F.min("text").alias("text"))
    guests = guests.select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("before").alias("range"), F.lit(None).cast("long").alias("tie"), F.lit(1).alias("guest"))
    both = rows.withColumn("guest", F.lit(0)).unionByName(guests)
    step = Window.partitionBy("range").orderBy("guest", *order)
    return both.withColumn("next_text", F.lead("text").over(step)).where("guest = 0").select("doc_id", "text", "next_text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A null text is the empty one. The anchor of a text without words is that of no
    words, so empty texts are alike. Repeated rows come out each; a single document is
    its own next. Other columns are not read.
    """
    n = F.length("text")
    tail = F.floor(n / 3).cast("int")
    rows = with_next(docs).withColumn("n_chars", n.cast("long"))
    rows = rows.withColumn("edited", F.concat(F.expr("left(text, length(text) - CAST(floor(length(text) / 3) AS INT))"), F.substring(F.col("next_text"), F.lit(1), tail)))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *[anchors(F.col(c)).alias(a) for c, a in (("text", "a"), ("edited", "e"), ("next_text", "x"))])
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        printed(F.col("a")).alias("fingerprint"),
        printed(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("e")).alias("near_edited"),
        likeness(F.col("a"), F.col("x")).alias("near_next"),
    )
