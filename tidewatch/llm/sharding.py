"""Resharding that moves the fewest bytes, by minimum-cost flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import stored, text_or_empty

OLD_SHARDS, NEW_SHARDS = 12, 16
BLOCKS, PARTS = 4096, 64
#: A text larger than a shard is cut into so many parts that each has about these many rows, PARTS at least.
PART_ROWS = 1_000_000


def text_block() -> Column:
    """Equal texts share a block."""
    return F.pmod(F.xxhash64(text_or_empty()), F.lit(BLOCKS)).cast("int")


def min_cost_flow(supply: list[int], room: list[int]) -> dict[tuple[int, int], int]:
    """Bytes sent from old shard i to new shard j; a byte that stays costs 0, one that moves 1.

    Successive shortest paths on the bipartite network: with these costs the cheapest
    path of a supply is to stay while its own shard has room, then any shard with room;
    an augmenting path that turns a stayer out would pay as much as it saves.
    """
    flow: dict[tuple[int, int], int] = {}
    left, free = list(supply), list(room)
    arcs = sorted(((0 if i == j else 1, i, j) for i in range(len(supply)) for j in range(len(room))))
    for _, i, j in arcs:
        sent = min(left[i], free[j])
        if sent > 0:
            flow[i, j] = sent
            left[i] -= sent
            free[j] -= sent
    return flow


def plan_blocks(blocks: list[tuple[int, int | None, int]], capacities: list[int]) -> dict[int, int]:
    """New shard of each (block, old shard, bytes): the flow, realised in whole blocks.

    The rooms are in proportion to the capacities and sum up to all bytes. Bytes without
    an old shard are sent like those of a shard that is given up. The largest blocks are placed first,
    each on the outgoing arc of its old shard with the most bytes still to send; a
    block that fits on none goes to the shard with the most room.
    """
    total, new_shards = sum(b for _, _, b in blocks), len(capacities)
    nowhere = max([new_shards, *[o + 1 for _, o, _ in blocks if o is not None]])
    blocks = [(n, nowhere if o is None else o, b) for n, o, b in blocks]
    room = [total * c // sum(capacities) for c in capacities]
    for i in [j for j, c in enumerate(capacities) if c][: total - sum(room)]:
        room[i] += 1
    supply = [0] * (nowhere + 1)
    for _, old, size in blocks:
        supply[old] += size
    flow = min_cost_flow(supply, room)
    placed: dict[int, int] = {}
    for block, old, size in sorted(blocks, key=lambda b: (-b[2], b[0])):
        arcs = [(left, -j) for (i, j), left in flow.items() if i == old and left >= size and room[j] >= size]
        target = -max(arcs)[1] if arcs else max(range(new_shards), key=lambda j: (room[j], -j))
        placed[block] = target
        room[target] -= size
        if (old, target) in flow:
            flow[old, target] -= size
    return placed


def _in_parts(rows: DataFrame, share: float) -> tuple[DataFrame, list[int], int]:
    """The rows with ``part``, the keys of texts that outgrow a shard, and the number of parts these are cut into.

    Parts follow the id, so that a text's rows of different ids spread evenly. An id that
    is repeated, or missing, so often that it would make a part of such a text too large
    is dealt out by draw instead; as a draw is not the same twice, the rows are written
    down once it is made.
    """
    sizes = rows.groupBy("text_key").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    total = sizes.agg(F.sum("b")).first()[0] or 0
    large = sizes.where(F.col("b") > total * share).collect()  # no more rows than shards
    keys = sorted(r["text_key"] for r in large)
    parts = max([PARTS, *[-(-r["n"] // PART_ROWS) for r in large]])
    if not keys:
        return rows.withColumn("part", F.pmod("id_key", F.lit(parts)).cast("int")), keys, parts
    mine = rows.where(F.col("text_key").isin(keys)).groupBy("text_key", "id_key").agg(F.sum("size").alias("b"))
    # More than a part's even share of one shard's bytes; at most as many as there are such shares.
    often = mine.where(F.col("b") > total * share / PARTS).select("text_key", "id_key").collect()
    if not often:
        return rows.withColumn("part", F.pmod("id_key", F.lit(parts)).cast("int")), keys, parts
    names = F.broadcast(rows.sparkSession.createDataFrame(often, "text_key long, id_key long").withColumn("often", F.lit(True)))
    drawn = F.floor(F.rand(7) * parts).cast("int")
    dealt = rows.join(names, ["text_key", "id_key"], "left")
    dealt = dealt.withColumn("part", F.when(F.col("often"), drawn).otherwise(F.pmod("id_key", F.lit(parts)).cast("int")))
    return stored(dealt.drop("often")), keys, parts


def place(
    docs: DataFrame,
    old_shards: int = OLD_SHARDS,
    new_shards: int = NEW_SHARDS,
    old: Column | None = None,
    capacities: list[int] | None = None,
) -> DataFrame:
    """``doc`` (the whole row), size, old_shard, shard, slot of every row.

    ``old`` is the old shard of a row, a number from 0 or null for a new row. Without it
    the old layout puts a block of texts on shard ``block mod old_shards``. Rows of one
    text go where the old shard with most of its bytes goes. ``capacities`` are those of
    the new shards, relative to each other, 0 for none; without them ``new_shards`` equal ones. Equal texts
    have one block and stay together, unless they alone outgrow the largest new shard's share of
    the bytes: such a text (there are at most as many as shards) is cut into parts by id,
    and an id repeated very often in it by draw. The driver sees only the sizes of the
    blocks: ``BLOCKS`` and the parts of large texts, for each old shard where these are given.

    A null text has size 1 and lies with the empty ones, null ids count as one id,
    repeated rows are placed each; an empty table gives no rows. Columns ``shard`` and
    ``slot`` of the given rows give way to the new ones.
    """
    capacities = capacities or [1] * new_shards
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    own = F.pmod(text_block(), F.lit(old_shards)) if old is None else old
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.xxhash64(text_or_empty()).alias("text_key"),
        text_block().alias("text_block"),
        F.xxhash64("doc_id").alias("id_key"),
        own.cast("int").alias("old"),
    )
    rows, keys, parts = _in_parts(rows, max(capacities) / sum(capacities))
    facts = stored(rows.groupBy("text_key", "text_block", "part", "old").agg(F.sum("size").alias("size"), F.count("*").alias("n")))
    home, most = F.col("old"), 0
    if old is not None:
        most = (facts.agg(F.max("old")).first()[0] or 0) + 1
        per_text = facts.groupBy("text_key", "old").agg(F.sum("size").alias("b"))
        homes = per_text.groupBy("text_key").agg(F.max_by("old", F.struct("b", -F.col("old"))).alias("home"))
        facts, rows, home = facts.join(homes, "text_key"), rows.join(homes, "text_key"), F.col("home")
    # Blocks of a given layout are those of one old shard, 0 for none; a large text is cut by old shard, too.
    block = F.col("text_block") if old is None else F.col("text_block") + F.coalesce(home + 1, F.lit(0)) * BLOCKS
    for number, key in enumerate(keys):
        cut = F.lit(0) if old is None else F.coalesce(F.col("old") + 1, F.lit(0))
        start = F.lit(BLOCKS * (most + 1)) + (F.lit(number * (most + 1)) + cut) * parts
        block = F.when(F.col("text_key") == key, start + F.col("part")).otherwise(block)
    facts, rows = facts.withColumn("block", block), rows.withColumn("block", block)
    sizes = facts.groupBy("block", "old").agg(F.sum("size").alias("b")).groupBy("block")
    sizes = sizes.agg(F.max_by("old", F.struct("b", -F.col("old"))).alias("old"), F.sum("b").alias("b")).collect()
    plan = plan_blocks([(r["block"], r["old"], r["b"]) for r in sizes], capacities)
    spark = docs.sparkSession
    shards = F.broadcast(spark.createDataFrame(sorted(plan.items()), "block int, shard int"))
    pieces = facts.groupBy("block", "part").agg(F.sum("n").alias("n")).join(shards, "block")
    before = Window.partitionBy("shard").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("block", "part", "shard", "before")
    within = Window.partitionBy("block", "part").orderBy("doc.doc_id", "text_key", "size")
    numbered = rows.withColumn("rank", F.row_number().over(within)).join(pieces, ["block", "part"])
    return numbered.select("doc", "size", F.col("old").alias("old_shard"), "shard", (F.col("before") + F.col("rank") - 1).alias("slot"))


def reshard(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    rows = place(docs.select(F.col("doc_id").cast("long"), "text"))
    return rows.select(
        "doc.doc_id",
        "size",
        F.crc32(F.coalesce("doc.text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def rewrite(placed: DataFrame, path: str) -> list[int]:
    """Writes the files that the plan changes, by new shard, and returns the shards whose old files they replace.

    A shard that loses and gains nothing keeps its files. A shard that ends up empty has no new ones.
    """
    moved = placed.where(~F.col("old_shard").eqNullSafe(F.col("shard")))
    changed = moved.select(F.explode(F.array("old_shard", "shard")).alias("s")).where("s IS NOT NULL").distinct()
    numbers = sorted(r["s"] for r in changed.collect())  # as many as shards
    rows = placed.where(F.col("shard").isin(numbers))
    kept = [F.col(f"doc.`{c}`") for c in placed.schema["doc"].dataType.names]
    rows.select(*kept, "shard", "slot").write.mode("error").partitionBy("shard").parquet(path)
    return numbers
