"""Fingerprints, token counts and training samples against plain versions of themselves."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from tidewatch.llm import syncmers, tokens
from tidewatch.llm.common import training_sample


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def chained(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little"), seed)
    return seed


def brute_anchors(text):
    """Every k-mer is looked at by itself: all its inner strings are hashed and compared."""
    words = [chained([w]) for w in re.split("[\x20\x09-\x0d]+", text) if w]
    found = []
    for at in range(len(words) - syncmers.K + 1):
        kmer = words[at : at + syncmers.K]
        inner = [chained([chained(kmer[i : i + 2]), kmer[i + 2]]) for i in range(syncmers.INNER)]
        if min(map(signed, inner)) in (signed(inner[0]), signed(inner[-1])):
            found.append(chained([inner[0], inner[syncmers.S], inner[-1]]))
    return found or [chained(words)]


def brute_rows(docs):
    """The contract's rows, from the documents in one list."""
    docs = [(i, t or "") for i, t in docs]
    docs.sort(key=lambda d: (d[0] is None, -(d[0] or 0), signed(chained([d[1]]))))
    rows = []
    for (doc_id, text), (_, after) in zip(docs, docs[1:] + docs[:1]):
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        a, e, x = (list(dict.fromkeys(brute_anchors(t))) for t in (text, edited, after))
        prints = ["".join(f"{h:016X}"[8:] for h in s) for s in (a, e)]
        near = [len(set(a) & set(b)) / len(set(a) | set(b)) for b in (e, x)]
        rows.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), *prints, *near))
    return sorted(rows, key=repr)


def spark_rows(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("range", F.lit(1)).withColumn("tie", F.lit("t"))
    return sorted(map(tuple, syncmers.fingerprints(frame).collect()), key=repr)


def test_fingerprints_equal_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ünï", "çode", "\U0001f600"]
    docs = [(i * 3 - 50, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    docs += [(1000, None), (1001, ""), (1002, " \t\n "), (1003, "a b c"), (1004, "word " * 3000), (1005, "word " * 3000)]
    assert spark_rows(spark, docs) == brute_rows(docs)


@pytest.mark.parametrize("docs", [[(1, "one two three")], [(None, "a b c d"), (None, "x y"), (4, "a b c d")], [(2, "b a"), (2, "a b"), (2, "a b"), (1, "z")]])
def test_fingerprints_of_odd_ids(spark, docs):
    assert spark_rows(spark, docs) == brute_rows(docs)


def brute_tokens(text, scores):
    """Each pre-token alone, without a trie: the best segmentation of every prefix."""
    total, unknown = 0, min(scores.values()) - 10.0
    for word in ("▁" + w for w in (text or "").split()):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            size = len(word[end - 1].encode())
            ways = [(best[end - 1][0] + unknown * size, best[end - 1][1] - size)]
            ways += [(best[s][0] + scores[word[s:end]], best[s][1] - 1) for s in range(max(0, end - 40), end) if word[s:end] in scores]
            best.append(max(ways))
        total -= best[-1][1]
    return total


def test_token_counts_of_rows_equal_brute_force(spark):
    scores = tokens.load_scores()
    texts = ["the quick brown fox", "the quick brown fox", None, "", " \n", "Ünï çode \U0001f600 unbelievably", "ab" * 4000, "the theory of therefore " * 50]
    docs = [(i, t, "x", 5) for i, t in enumerate(texts)] + [(0, texts[0], "x", 5), (None, "no id", "x", 5)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, n_tokens string, counts long")
    found = sorted(map(tuple, tokens.count_tokens(frame).collect()), key=repr)
    assert found == sorted(((d[0], brute_tokens(d[1], scores)) for d in docs), key=repr)
    assert tokens.count_tokens(frame.limit(0)).count() == 0


def test_training_sample_is_bounded_and_never_held_out(spark):
    docs = [(i, f"text {i}") for i in range(400)] + [(None, "no id"), (400, None), (401, ""), (402, "long " * 100)]
    labels = [(i, i % 2) for i in range(400)] + [(7, 0), (8, None), (None, 1), (401, 1), (402, 1), (9999, 1), (400, 0), (12, 5)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    free = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    everything = training_sample(*frames, "toxic", 0, 5, 1000, 100)
    assert everything == [(i, f"text {i}", i % 2) for i in free]
    few = training_sample(*frames, "toxic", 0, 5, 30, 100)
    assert set(few) <= set(everything) and [sum(r[2] == y for r in few) for y in (0, 1)] == [30, 30]
    assert few == training_sample(frames[0].repartition(7), frames[1].repartition(5), "toxic", 0, 5, 30, 100)
