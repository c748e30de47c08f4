"""Near duplicates by 64-bit SimHash and a Gray-ordered hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import stored, text_or_empty

SHINGLE, DISTANCE, SEED = 3, 2, 42
HASH_BLOCK = 1 << 16
#: A block with more fingerprints than this is divided by further masks.
BLOCK_ROWS = 4096
FANOUT = 8
#: Bit ranges of the first masks: two differing bits leave at least one range untouched.
RANGES = ((0, 22), (22, 43), (43, 64))
SALTS = 32


def fingerprint(text: str | None) -> int:
    """A bit is set where more than half of the shingle hashes have it; no words give zero."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: only A-Z change, only the six ASCII blanks part
    if not words:
        return 0
    n = max(len(words) - SHINGLE + 1, 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, n, HASH_BLOCK):
        part = words[start : min(start + HASH_BLOCK, n) + SHINGLE - 1]
        grams = zip(*(part[i:] for i in range(SHINGLE))) if len(words) >= SHINGLE else [words]
        hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(g), SEED) for g in grams), np.uint64)
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def with_fingerprint(docs: DataFrame, name: str) -> DataFrame:
    run = F.pandas_udf(lambda texts: pd.Series([_signed(fingerprint(t)) for t in texts], dtype="int64"), "long")
    return docs.withColumn(name, run(text_or_empty()))


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Position of each code in the Gray sequence."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Fingerprints sorted by Gray rank under a tree of shared masked bit patterns.

    A node holds the bits that all fingerprints below it share and no node above
    holds. A search adds up, on its way down, the differing bits of these patterns,
    and drops every group whose sum passes the distance.
    """

    def __init__(self, values: np.ndarray):
        self.values = values[np.argsort(gray_rank(values), kind="stable")]
        all_and, all_or, levels = self.values, self.values, []
        while True:
            levels.append((all_and, ~(all_and ^ all_or)))
            if len(all_and) == 1:
                break
            starts = np.arange(0, len(all_and), FANOUT)
            all_and, all_or = np.bitwise_and.reduceat(all_and, starts), np.bitwise_or.reduceat(all_or, starts)
        self.levels = []
        above = np.zeros(1, np.uint64)
        for pattern, shared in reversed(levels):
            mask = shared & ~above[np.arange(len(shared)) // FANOUT] if len(shared) > 1 else shared
            self.levels.append((pattern, mask))
            above = shared

    def pairs(self, queries: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions (query, fingerprint) within the distance."""
        q, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        total = np.zeros(len(queries), np.int64)
        for depth, (pattern, mask) in enumerate(self.levels):
            if depth:
                q, total = np.repeat(q, FANOUT), np.repeat(total, FANOUT)
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                inside = node < len(pattern)
                q, node, total = q[inside], node[inside], total[inside]
            total = total + np.bitwise_count((queries[q] ^ pattern[node]) & mask[node])
            near = total <= distance
            q, node, total = q[near], node[near], total[near]
        return q, node


def block_links(values: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """A spanning forest of the links of one block: (fingerprint, smallest linked one)."""
    index = GrayIndex(values)
    own = index.values
    root = np.arange(len(own))
    found = [index.pairs(own[i : i + 512], distance) for i in range(0, len(own), 512)]
    a = np.concatenate([q + 512 * i for i, (q, _) in enumerate(found)])
    b = np.concatenate([v for _, v in found])
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        low = low[low]
        if (low == root).all():
            break
        root = low
    return [(int(own[i]), int(own[r])) for i, r in enumerate(root) if r != i]


def _links_of_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walks over rows sorted by block; a block may reach over several batches."""
    rest = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        last = rows["block"].iloc[-1] if len(rows) else None
        open_ = (rows["block"] == last).to_numpy()
        rest = rows[open_]
        yield from _emit(rows[~open_])
    if rest is not None:
        yield from _emit(rest)


def _emit(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    values = rows["fp"].to_numpy(np.int64).view(np.uint64)
    cuts = np.flatnonzero(np.r_[True, (rows["block"].to_numpy()[1:] != rows["block"].to_numpy()[:-1])]) if len(rows) else []
    out = []
    for start, end in zip(cuts, list(cuts[1:]) + [len(rows)]):
        if end - start > 1:
            out += block_links(values[start:end])
    if out:
        yield pd.DataFrame({"a": [_signed(x) for x, _ in out], "b": [_signed(y) for _, y in out]})


def _masked(blocks: DataFrame, free: str) -> DataFrame:
    """Three blocks from each: the block's fixed bits and one third of its free ones.

    ``free`` lists bit positions; two differing bits leave one third untouched, so
    every pair in reach of the distance stays together in at least one block.
    """
    third = F.expr(f"CAST(ceil(size({free}) / 3.0) AS INT)")
    parts = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.slice(free, i * third + 1, third))
    return (
        blocks.withColumn("part", F.explode(parts))
        .where(F.size("part") > 0)
        .withColumn("mask", F.aggregate("part", F.col("mask"), lambda m, p: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), p))))
        .withColumn("free", F.array_except(free, "part"))
        .drop("part")
        .withColumn("block", F.concat_ws(":", "mask", F.col("mask").bitwiseAND(F.col("fp"))))
    )


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that join all fingerprints within the distance, from distinct column ``fp``.

    Blocks are the upper nodes of the index: masked bit patterns shared by their
    fingerprints. A block too large for one task is divided by wider masks until it
    fits; after four divisions at most a few thousand codes can share a block.
    """
    start = fps.select("fp", F.lit(0).cast("long").alias("mask"), F.sequence(F.lit(0), F.lit(63)).alias("free"))
    blocks, done = _masked(start, "free"), None
    for depth in range(4):
        sized = blocks.join(blocks.groupBy("block").agg(F.count("*").alias("members")), "block").where("members > 1")
        sized = stored(sized)
        small = sized.where(F.col("members") <= BLOCK_ROWS) if depth < 3 else sized
        small = small.select("block", "fp")
        done = small if done is None else done.unionByName(small)
        large = sized.where(F.col("members") > BLOCK_ROWS)
        if depth == 3 or large.isEmpty():
            break
        blocks = _masked(large.select("fp", "mask", "free"), "free").dropDuplicates(["block", "fp"])
    rows = done.repartition("block").sortWithinPartitions("block")
    return rows.mapInPandas(_links_of_sorted, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges, by alternating large and small stars."""
    edges = stored(edges)
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a != b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(down, "a")
        edges = stored(
            small.select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
            .select("e.*")
            .where("a != b")
            .distinct()
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now


def classes(prints: DataFrame) -> DataFrame:
    """(fp, salt, root, component_id) for the (doc_id, fp) rows; few rows share a (fp, salt)."""
    salted = prints.groupBy("fp", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")).agg(F.min("doc_id").alias("low"))
    salted = stored(salted)
    per_fp = salted.groupBy("fp").agg(F.min("low").alias("low"))
    roots = components(links(per_fp.select("fp")))
    rooted = per_fp.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    known = rooted.join(least, "root").select("fp", "root", "component_id")
    return salted.select("fp", "salt").join(known, "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of every row.

    Null and empty texts have fingerprint zero and are linked like any other. A row
    without id takes part; a class of such rows alone has a null component_id.
    Repeated rows come out repeated. Other columns are not read.
    """
    prints = stored(with_fingerprint(docs.select(F.col("doc_id").cast("long"), "text"), "fp").select("doc_id", "fp"))
    return (
        prints.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        .join(classes(prints), ["fp", "salt"])
        .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, with its columns: that of the smallest id, ties by a hash of the row.

    Of identical rows one stays. Rows without id stay only where no row of their class has one.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # Two hashes name the row, so that texts are fingerprinted once and only rows of one class are compared by them.
    tagged = docs.select(
        F.struct(*columns).alias("doc"), F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(0), *columns).alias("b")).alias("row"), F.col("doc_id").alias("id"), "text"
    )
    prints = stored(with_fingerprint(tagged, "fp").select("fp", "row", F.col("id").alias("doc_id")))
    groups = classes(prints).select("fp", "salt", "root")
    best = (
        prints.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        .join(groups, ["fp", "salt"])
        .groupBy("root")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best"))
        .select(F.col("best.row").alias("row"), F.col("best.doc_id").alias("best_id"))
    )
    kept = tagged.drop("text").join(best, "row").where(F.col("id").eqNullSafe(F.col("best_id")))
    return kept.dropDuplicates(["row"]).select("doc.*")
