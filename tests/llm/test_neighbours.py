"""Multi-index hashing: exact retrieval within a radius, recall against brute force, odd tables."""

from __future__ import annotations

import numpy as np
import pyarrow.parquet as pq
import pytest

from tests.oracle import SF_ROOT
from tidewatch.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score double, shard int"


def brute(ids, vectors, every, top=20):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        scores = vectors @ vectors[i]
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[i]][:top]
        out[int(ids[i])] = [(int(ids[j]), scores[j]) for j in order]
    return out


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("radius", [0, 1, 7, 15, 16, 17, 31, 40, 57, 128])
def test_probing_retrieves_every_code_within_the_radius_once(radius):
    rng = np.random.default_rng(radius)
    codes = rng.integers(0, 256, (600, 16), np.uint8)
    codes[300:] = codes[:300] ^ np.packbits(rng.random((300, 128)) < 0.1, axis=1)
    index = neighbours.MultiIndex(codes)
    q, rows = index.within(codes[::20].copy(), radius)
    distance = np.bitwise_count(codes[::20, None] ^ codes[None]).sum(2)
    assert sorted(zip(q.tolist(), rows.tolist())) == list(zip(*(a.tolist() for a in np.nonzero(distance <= radius))))


def test_recall_on_the_given_vectors(spark):
    path = str(SF_ROOT / "sf0.1" / "embeddings.parquet")
    found = by_query(neighbours.nearest_neighbours(spark.read.parquet(path)).collect())
    given = pq.read_table(path)
    want = brute(given["vec_id"].to_numpy(), np.array(given["embedding"].to_pylist(), np.float64), neighbours.EVERY)
    assert found.keys() == want.keys() and all(len(f) == 20 for f in found.values())
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in w}) for q, w in want.items())
    assert hits >= 0.95 * sum(map(len, want.values()))
    exact = {(q, i): s for q, w in want.items() for i, s in w}
    assert all(abs(exact[q, i] - s) < 1e-12 for q, f in found.items() for i, s in f if (q, i) in exact)


@pytest.mark.parametrize("dimensions", [1, 2, 5, 200])
def test_small_tables_with_lengths_and_ties_equal_brute_force(spark, dimensions):
    rng = np.random.default_rng(dimensions)
    vectors = rng.integers(-3, 4, (70, dimensions)).astype(float) * rng.choice([1, 4], (70, 1))
    vectors[(vectors == 0).all(1)] = 1
    vectors[40:60] = vectors[0]
    rows = [(i, v.tolist(), 1, 1, 1.0, 1) for i, v in enumerate(vectors)]
    found = by_query(neighbours.nearest(spark.createDataFrame(rows, SCHEMA), "vec_id % 5 = 0").collect())
    assert found == brute(np.arange(70), vectors, 5)


def test_odd_rows_take_no_part(spark):
    sound = [(i, [float(i % 3), 1.0]) for i in range(10)]
    odd = [(20, None), (40, []), (60, [0.0, 0.0]), (80, [None, 1.0]), (100, [float("nan"), 1.0]), (120, [float("inf"), 1.0]), (140, [1.0]), (None, [1.0, 1.0])]
    rows = [(i, v, 1, 1, 1.0, 1) for i, v in sound + odd + sound[:1]]
    found = by_query(neighbours.nearest_neighbours(spark.createDataFrame(rows, SCHEMA)).collect())
    assert list(found) == [0]
    assert [i for i, _ in found[0]] == list(range(1, 10))  # fewer than 20: all candidates; all score 1, so by id


def test_no_vectors_and_no_queries(spark):
    assert neighbours.nearest_neighbours(spark.createDataFrame([], SCHEMA)).count() == 0
    assert neighbours.nearest_neighbours(spark.createDataFrame([(1, [1.0], 1, 1, 1.0, 1)], SCHEMA)).count() == 0
