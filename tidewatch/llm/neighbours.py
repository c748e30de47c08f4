"""Nearest neighbours by multi-index hashing of learned binary codes, reranked by the vectors themselves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import stored

TOP = 20
#: Every vector whose id is divisible by this is a query of the registered search.
EVERY = 20
#: Bits of a code, and of each indexed part of it.
BITS, PART = 128, 8
PARTS = BITS // PART
#: Vectors that the rotation is learned from: a bound, whatever the table's size.
SAMPLE, TURNS = 4096, 30
#: Vectors of one shard of the index, at most, shards at least, and queries sent there at once.
SHARD_ROWS, LEAST_SHARDS, QUERY_ROWS = 65_536, 12, 65_536
#: The radius of a query grows until so many codes of a shard, or this share of them, are within it.
WANTED, WANTED_SHARE = 64, 0.06
_CHUNK = 128
_WEIGHT = np.bitwise_count(np.arange(256, dtype=np.uint8))
#: By reach, all patterns with so many bits at most: the buckets to probe are these, away from the query's own.
_MASKS = [np.flatnonzero(_WEIGHT <= reach).astype(np.uint8) for reach in range(PART + 1)]


def learn_rotation(sample: np.ndarray, bits: int = BITS, seed: int = 5) -> np.ndarray:
    """Directions (one column a bit) whose signs keep the sample's angles best.

    The sample is reduced to its main directions where it has more than bits; then
    rotations are learned one after another, each from a random start, by turning the
    codes' corners onto the vectors, until there are enough columns.
    """
    rng = np.random.default_rng(seed)
    base = np.eye(sample.shape[1])
    if sample.shape[1] > bits:
        values, directions = np.linalg.eigh(sample.T @ sample)
        base = directions[:, np.argsort(values)[::-1][:bits]]
    vectors, columns = sample @ base, []
    while sum(c.shape[1] for c in columns) < bits:
        turn, _ = np.linalg.qr(rng.normal(size=(vectors.shape[1],) * 2))
        for _ in range(TURNS):
            left, _, right = np.linalg.svd(vectors.T @ np.where(vectors @ turn >= 0, 1.0, -1.0))
            turn = left @ right
        columns.append(base @ turn)
    return np.hstack(columns)[:, :bits]


def with_height(vectors: np.ndarray, most: float | None) -> np.ndarray:
    """Vectors of one length with one more component, so that the largest inner product is the smallest angle.

    ``most`` is the largest squared length of all; a query (None) has height zero.
    """
    if most is None:
        return np.c_[vectors, np.zeros(len(vectors))]
    return np.c_[vectors, np.sqrt(np.maximum(most - (vectors**2).sum(1), 0))]


def codes_of(vectors: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    return np.packbits(vectors @ rotation >= 0, axis=1)


class MultiIndex:
    """The codes of a shard, sorted once by each of their parts."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.wide = codes, codes.view(np.uint64)
        self.order = [np.argsort(codes[:, j], kind="stable") for j in range(PARTS)]
        self.starts = [np.searchsorted(codes[o, j], np.arange(257)) for j, o in enumerate(self.order)]
        # Each part's table holds the whole codes in its own order, so that a bucket is read in one piece.
        self.tables = [[np.ascontiguousarray(w[o]) for w in self.wide.T] for o in self.order]

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, code) places of every code within the radius, each once.

        Pigeonhole: with radius = PARTS * a + t, a code that differs by more than a in each
        of the parts 0 to t, and by a or more in all others, is out of reach.
        """
        a, t = divmod(radius, PARTS)
        reach = np.array([a if j <= t else a - 1 for j in range(PARTS)])
        wide, found = queries.view(np.uint64), []
        for j in np.flatnonzero(reach >= 0):
            buckets = (queries[:, j, None] ^ _MASKS[min(int(reach[j]), PART)]).astype(np.int64)
            low = self.starts[j][buckets].ravel()
            sizes = self.starts[j][buckets + 1].ravel() - low
            each = sizes.reshape(buckets.shape).sum(1)
            ends = sizes.cumsum()
            at = np.repeat(low - ends + sizes, sizes)
            at += np.arange(len(at))
            apart = np.zeros(len(at), np.uint8)
            for table, own in zip(self.tables[j], wide.T):
                apart += np.bitwise_count(table[at] ^ np.repeat(own, each))
            near = np.flatnonzero(apart <= radius)
            q, rows = np.searchsorted(each.cumsum(), near, "right"), self.order[j][at[near]]
            # Those that an earlier part has brought already are left out.
            fresh = ~(_WEIGHT[self.codes[rows, :j] ^ queries[q, :j]] <= reach[:j]).any(1)
            found.append((q[fresh], rows[fresh]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([q for q, _ in found]), np.concatenate([r for _, r in found])

    def nearest(self, queries: np.ndarray, wanted: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The codes within each query's own radius, the smallest tried that holds ``wanted`` of them.

        The first radius is read off a few codes of the shard; a query that finds too little goes on
        with a larger one, in the end with one that takes in all codes.
        """
        probe = self.wide[:: max(1, len(self.wide) // 512)]
        share = np.bitwise_count(queries.view(np.uint64)[:, None] ^ probe[None]).sum(2)
        share.sort(axis=1)
        at = min(share.shape[1] - 1, -(-wanted * share.shape[1] // max(1, len(self.wide))))
        radius = share[:, at].astype(np.int64)
        todo = np.arange(len(queries))
        while len(todo):
            left = []
            for r in np.unique(radius[todo]):
                mine = todo[radius[todo] == r]
                q, rows = self.within(queries[mine], min(int(r), BITS))
                few = (np.bincount(q, minlength=len(mine)) < min(wanted, len(self.codes))) & (r < BITS)
                left.append(mine[few])
                yield mine[q[~few[q]]], rows[~few[q]]
            todo = np.concatenate(left)
            radius[todo] += 3


def search_shard(
    ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, rotation: np.ndarray, most: float, top: int = TOP
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vector id, inner product) of the ``top`` nearest found of each query in one shard."""
    index = MultiIndex(codes_of(with_height(vectors, most), rotation))
    wanted = max(WANTED, int(WANTED_SHARE * len(ids)), 2 * top)
    out = []
    for at in range(0, len(queries), _CHUNK):
        part = queries[at : at + _CHUNK]
        for q, rows in index.nearest(codes_of(with_height(part, None), rotation), wanted):
            other = ids[rows] != query_ids[at + q]
            q, rows = q[other], rows[other]
            scores = np.empty(len(q))
            for i in range(0, len(q), 1 << 16):
                scores[i : i + (1 << 16)] = np.einsum("ij,ij->i", part[q[i : i + (1 << 16)]], vectors[rows[i : i + (1 << 16)]])
            order = np.lexsort((ids[rows], -scores, q))
            q, rows, scores = q[order], rows[order], scores[order]
            first = np.searchsorted(q, q)
            best = np.arange(len(q)) - first < top
            out.append((query_ids[at + q[best]], ids[rows[best]], scores[best]))
    return tuple(np.concatenate([o[i] for o in out]) if out else np.zeros(0, kind) for i, kind in enumerate((np.int64, np.int64, float)))


def _matrix(column: pa.ChunkedArray, dimensions: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)


def sound_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, vector (doubles), length2: one row per id, of the rows that take part.

    Null ids, null, empty and zero vectors and those with null or non-finite components
    take no part. Of several vectors of one id the smallest in array order stays.
    """
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = "vec_id IS NOT NULL AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    length2 = "aggregate(vector, 0D, (s, x) -> s + x * x)"
    one = given.where(finite).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    return one.withColumn("length2", F.expr(length2)).where("length2 > 0")


def nearest(vectors: DataFrame, is_query: str, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` vectors of largest inner product found for each query.

    ``is_query`` is a condition on ``vec_id``; a query's own id is no candidate. Where ids
    have vectors of several dimensions, only those of the commonest (of equals the smallest)
    take part. Ties go to the smaller id. An empty table gives no rows.

    The index is cut into shards by a hash of the id, so that equal vectors are spread; the
    queries go to each of them in blocks, and every shard hands back its best ``top``. Fewer
    candidates than ``top`` all come out, as a radius grows until enough codes are within.
    """
    sound = stored(sound_vectors(vectors))
    sizes = sound.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"), F.max("length2").alias("most"))
    facts = sizes.orderBy(F.desc("n"), "d").first()
    schema = "query_id long, vec_id long, score double"
    if facts is None:
        return vectors.sparkSession.createDataFrame([], schema).selectExpr("query_id", "CAST(1 AS INT) AS rank", "vec_id", "score")
    d, n, most = facts
    rows = sound.where(F.size("vector") == d).select("vec_id", "vector")
    # At most SAMPLE rows reach the driver.
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow().column(0)
    rotation = learn_rotation(with_height(_matrix(sample, d), most))

    shards = max(LEAST_SHARDS, -(-n // SHARD_ROWS))
    queries = rows.where(is_query)
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    block = F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).cast("int")
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    index = rows.select(shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "vector")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), block.alias("block"), "vec_id", "vector")

    def search(index: pa.Table, asked: pa.Table) -> pa.Table:
        found = ([], [], [])
        if index.num_rows and asked.num_rows:
            ids = [t.column("vec_id").to_numpy() for t in (index, asked)]
            vectors = [_matrix(t.column("vector"), d) for t in (index, asked)]
            found = search_shard(ids[0], vectors[0], ids[1], vectors[1], rotation, most, top)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    found = index.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(search, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(vectors: DataFrame) -> DataFrame:
    """The registered search: every vector whose id is divisible by 20 against all others."""
    return nearest(vectors, f"vec_id % {EVERY} = 0")
