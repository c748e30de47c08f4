"""Periodic runs against brute force, and the registered query's digests."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidewatch.llm import runs

SCHEMA = "doc_id long, text string, start long, runs string, collapsed string"


def brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                w = words[i : j + q]
                if all(any(w[x] != w[x + r] for x in range(len(w) - r)) for r in range(1, q)):
                    out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_digests(doc_id, text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    first = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(found), *first, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(kept))


@pytest.mark.parametrize("letters", [1, 2, 3, 40])
def test_runs_equal_brute_force(letters):
    rng = random.Random(letters)
    total = 0
    for _ in range(250):
        n = rng.randint(0, 300)
        words = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randint(0, 3) if n > 8 else 0):
            p, s = rng.randint(1, n // 4), rng.randrange(n)
            for i in range(s + p, min(n, s + rng.randint(p, 6 * p))):
                words[i] = words[i - p]
        found = runs.find_runs(np.array(words, np.int64))
        assert found == brute_runs(words)
        total += len(found)
    assert total > 50


@pytest.mark.parametrize("period", [1, 4, 8, 9, 16, 17, 33, 64, 65, 500, 2049])
def test_every_period_is_found_at_four_repeats_and_not_below(period):
    core = list(range(1000, 1000 + period))
    fits = [1] + (core * 4 if period > 1 else core * 6) + [2]
    assert runs.find_runs(np.array(fits)) == [(1, max(6, 4 * period), period)]
    assert runs.find_runs(np.array([1] + (core * 4)[:-1] + [2])) == [] if period > 1 else True


def test_query_equals_brute_force_on_odd_tables(spark):
    rng = random.Random(9)
    texts = [None, "", " \t\n", "a", "a b " * 3, "x " * 30_000, "w w " * 9, "é\x1cé \x0b" * 8, "p q r s t " * 4]
    texts += [" ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 90))) for _ in range(120)]
    given = [(i, t, 1, "r", "c") for i, t in enumerate(texts)]
    given += [given[4], (None, "a b " * 5, None, None, None), (10**12, "no run here", 1, "", "")]
    found = sorted(map(repr, map(tuple, runs.run_digests(spark.createDataFrame(given, SCHEMA)).collect())))
    assert found == sorted(repr(brute_digests(i, t)) for i, t, *_ in given)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and t for i, t, *_ in given)


def test_operator_returns_spans_and_the_collapsed_text(spark):
    rows = spark.createDataFrame([(1, "so " * 7 + "it goes on and " + "on and " * 3), (1, None)], "doc_id long, text string")
    done = sorted(runs.periodic_runs(rows).collect(), key=lambda r: r["n_words"])
    assert tuple(done[0]) == (1, 0, [], "")
    assert [tuple(r) for r in done[1]["runs"]] == [(0, 7, 1), (9, 8, 2)]
    assert done[1]["collapsed"] == "so it goes on and"


def test_empty_table(spark):
    assert runs.run_digests(spark.createDataFrame([], SCHEMA)).count() == 0
