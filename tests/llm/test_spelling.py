"""Spelling variants against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long, block string, size long"


def near(u, v):
    if len(u) < len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return len(u) == len(v) + 1 and any(u[:i] + u[i + 1 :] == v for i in range(len(u)))


def brute(counts):
    forms, out = {}, {}
    for w, n in counts.items():
        others = [v for v in counts if v != w and near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= 2 * n else None
        out[w] = len(others)
    rows = set()
    for w, n in counts.items():
        root = w
        while forms[root]:
            root = forms[root]
        rows.add((w, forms[w], root, n, out[w], counts[forms[w]] if forms[w] else None))
    return rows


def brute_words(docs):
    counts = Counter()
    for doc_id, text in docs:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


@pytest.mark.parametrize("letters", ["ab", "abcé"])
def test_composition_gives_each_pair_of_one_edit_once(letters):
    rng = random.Random(4)
    for _ in range(200):
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 40))})
        pairs = [frozenset(p) for p in spelling.Acceptor(words).one_edit_pairs()]
        assert len(pairs) == len(set(pairs))
        assert set(pairs) == {frozenset((u, v)) for u in words for v in words if u < v and near(u, v)}


def test_acceptor_is_minimal():
    endings = spelling.Acceptor(sorted(a + b for a in "abcdefgh" for b in ("ing", "ed")))
    assert len(endings.arcs) == 6  # start, one state for what follows any first letter, and the shared endings


@pytest.mark.parametrize("block_words", [20_000, 3])
def test_forms_and_roots_equal_brute_force(spark, block_words):
    """Also with blocks so small that they are divided down to one letter."""
    rng = random.Random(block_words)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(5, 9))) for _ in range(150)}
    words |= {"prefix" + "".join(rng.choice("abcdefghij") for _ in range(3)) for _ in range(200)}
    words |= {"ééééé", "éééé" + "à", "ababa" * 300, "ababa" * 300 + "a", "b" + "ababa" * 300}
    counts = {w: rng.choice([3, 4, 7, 9, 20, 41, 90, 90]) for w in words}
    table = spark.createDataFrame(list(counts.items()) + [(None, 9), ("abcd", 9)], "word string, n long").repartition(3)
    found = [tuple(r) for r in spelling.variants(table, block_words).collect()]
    assert len(found) == len(counts) and set(found) == brute(counts)


def test_long_chain_of_forms(spark):
    counts = {"a" * i: 3 << (i - 5) for i in range(5, 40)}
    found = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert {r["root"] for r in found} == {"a" * 39}


def test_query_equals_brute_force_on_odd_tables(spark):
    rng = random.Random(2)
    base = ["harbour", "harbor", "colour", "colours", "ÉTÉÉÉ", "weather", "whether", "Straße"]
    docs = [(i, " ".join(rng.choice(base) + rng.choice(["", "", "s", "1", "'s"]) for _ in range(400))) for i in range(30)]
    docs += [(7, docs[7][1]), (None, "colour " * 5), (40, None), (41, ""), (42, "éàü ×÷ " * 9), (43, "longword" * 9_000 + " x"), (44, "a" * 50_000)]
    table = spark.createDataFrame([(i, t, "w", 1, "b", 2) for i, t in docs], SCHEMA)
    assert {tuple(r) for r in spelling.spelling_variants(table).collect()} == brute(brute_words(docs))
    assert any(zlib.crc32(f"{i}:{w.lower()}".encode()) % 97 == 0 for i, _ in docs for w in base)


def test_empty_table(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_words_are_added_up_before_the_shuffle(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("common word " * 50).alias("text"))
    found = {r["word"]: r["n"] for r in spelling.vocabulary(docs).collect()}
    assert found == {"common": 100_000}
