"""Each operator on small tables with nulls, empty and long texts, repeats, ties and clashing column names."""

from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewatch.llm import decontaminate, licenses, mixing, quality, sharding, simhash, surrogates, syncmers, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, fp string, shard int, rank int, copies int"
STORY = "the quick brown fox jumps over the lazy dog while seven small birds sing about the long warm summer evening"
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma"


def rows(*texts):
    return [(i, t, "en", "a" if i % 3 else None, len(t or ""), 9, "x", 1, 1, 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    given = rows(STORY, STORY, None, "", "a  b", "word " * 30_000, STORY.replace("seven", "eight"), "Ünï çode\ttext")
    given += [given[0], (None, STORY, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(given, SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_classes_equal_brute_force(spark, odd, none):
    found = simhash.near_duplicates(odd).collect()
    texts = {(r["doc_id"], r["text"]) for r in odd.collect()}
    prints = {i: brute_fingerprint(t) for i, t in texts}
    assert all(int(r["fingerprint"], 16) == prints[r["doc_id"]] for r in found) and len(found) == odd.count()
    for r in found:
        reach = {r["doc_id"]}
        while True:
            more = {j for j in prints for i in reach if (prints[i] ^ prints[j]).bit_count() <= 2}
            if more <= reach:
                break
            reach |= more
        assert r["component_id"] == min(i for i in reach if i is not None)
    kept = simhash.keep_one(odd)
    assert kept.count() == len({r["component_id"] for r in found}) and kept.columns == odd.columns
    assert simhash.keep_one(none).count() == 0


def test_links_hold_all_near_pairs_in_large_blocks(spark):
    draw = random.Random(3)
    base = [draw.getrandbits(64) for _ in range(40)]
    codes = sorted({b ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) for b in base for _ in range(30)})
    found = simhash.block_links(np.array(codes, np.uint64))
    root = {c: c for c in codes} | dict(found)
    for a in codes:
        for b in codes:
            if (a ^ b).bit_count() <= 2:
                assert root[a] == root[b]


def test_decontamination_finds_substitutions(spark, odd, none):
    words = ITEM.split()
    words[4] = words[11] = "other"
    docs = spark.createDataFrame(rows("x y z " + ITEM + " end", "so " + " ".join(words), STORY, None, " ".join(words[:6])), SCHEMA)
    bench = spark.createDataFrame([(7, ITEM), (8, None), (9, "too short")], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.benchmark_overlaps(docs, bench).collect()) == [(0, 7), (1, 7)]
    assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()) == [2, 3, 4]
    assert decontaminate.benchmark_overlaps(odd, bench.limit(0)).count() == 0
    assert decontaminate.benchmark_overlaps(none, bench).count() == 0


@pytest.mark.parametrize("size", [5, 6, 8, 10, 11, 12, 13, 18])
def test_masks_miss_no_substitutions(size):
    item = [f"w{i}" for i in range(size)]
    masks = (*decontaminate.MASKS, *(decontaminate.SHORT_MASKS if size < decontaminate.SHORT_ITEM else ()))
    (sought,) = decontaminate.pieces(decontaminate.token_hashes(" ".join(item)), masks)
    need = min(size, decontaminate.OVERLAP)
    for changed in combinations(range(need), need // 5):
        words = ["other" if i in changed else w for i, w in enumerate(item[:need])]
        (own,) = decontaminate.pieces(decontaminate.token_hashes(f"x y {' '.join(words)} z"), masks)
        assert decontaminate.best_overlap(own, sought, size) == (2, need, (need - need // 5) / need)


def test_mix_nears_targets(spark, odd, none):
    assert mixing.mix(none).count() == 0 and mixing.mix(odd).count() == odd.count()
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', int(id % 90) + 1) AS text", "if(id % 3 = 0, 'a', if(id % 3 = 1, 'b', NULL)) AS source")
    per = mixing.mix(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("t"), F.max(F.col("taken") / F.col("size")).alias("most"))
    for r in per.collect():
        assert abs(r["t"] - r["target"]) < 0.02 * r["target"] and r["most"] <= 2
    assert mixing.take_copies(odd).columns == odd.columns


def test_shards_are_gapless_and_even(spark, odd, none):
    assert sharding.reshard(none).count() == 0
    assert sharding.reshard(odd).count() == odd.count()
    docs = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'the same text', concat('t ', id)) AS text")
    per = sharding.reshard(docs).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("m"), F.countDistinct("slot").alias("d")).collect()
    assert len(per) == 16 and all(r["n"] == r["m"] + 1 == r["d"] for r in per)
    assert max(r["b"] for r in per) < 1.1 * min(r["b"] for r in per)


def test_stored_layout_is_resharded_to_capacities(spark, tmp_path):
    docs = spark.range(1200).selectExpr("id AS doc_id", "concat('text ', 1000 + id) AS text", "int(id % 3) AS shard")
    docs.write.partitionBy("shard").parquet(str(tmp_path / "old"))
    stored = spark.read.parquet(str(tmp_path / "old"))
    placed = sharding.place(stored, old=F.col("shard"), capacities=[2, 1, 2, 1]).cache()
    sizes = {r["shard"]: r["sum(size)"] for r in placed.groupBy("shard").sum("size").collect()}
    total = sum(sizes.values())
    assert all(abs(sizes[j] - total * c / 6) < 0.02 * total for j, c in enumerate([2, 1, 2, 1]))
    moved = placed.where("old_shard != shard").agg(F.sum("size")).first()[0]
    assert moved <= total / 6 * 1.05
    changed = sharding.rewrite(placed, str(tmp_path / "new"))
    assert changed == [1, 3]
    new = spark.read.parquet(str(tmp_path / "new"))
    whole = stored.where(~F.col("shard").isin(changed)).select("doc_id", "text").unionByName(new.select("doc_id", "text"))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, stored.select("doc_id", "text").collect()))
    assert {r["shard"] for r in new.select("shard").distinct().collect()} == {1, 3}
    fresh = sharding.place(stored, old=F.when(F.col("shard") > 0, F.col("shard")), capacities=[0, 1, 1])
    assert {r["shard"] for r in fresh.select("shard").distinct().collect()} == {1, 2} and fresh.count() == 1200


def test_classifiers_learn_and_take_any_text(spark, odd, none):
    data = [(i, f"{STORY} {'you idiot' if i % 2 else ''} {i}", i % 2) for i in range(60)]
    machine = toxicity.FactorizationMachine().fit(data)
    assert all((machine.score(t) >= 0.5) == bool(y) for _, t, y in data)
    net = quality.ByteNet().fit([(i, STORY.upper() + "!!" if i % 2 else STORY + str(i), 1 - i % 2) for i in range(40)], epochs=4)
    assert net.score(STORY) > 0.5 > net.score(STORY.upper() + "!!")
    for score, model in ((toxicity.score_toxicity, machine), (quality.score_quality, net), (quality.score_quality, quality.ByteNet().fit([]))):
        assert score(odd, model).where("score BETWEEN 0 AND 1").count() == odd.count() and score(none, model).count() == 0


def test_net_sees_every_window_of_long_texts():
    net = quality.ByteNet()
    data = bytes(range(97, 123)) * 2000
    whole, _ = net.pooled(data)
    parts = [net.pooled(data[i : i + 5005])[0] for i in range(0, len(data) - 5, 5000)]
    assert abs(whole - np.max(parts, axis=0)).max() < 1e-4


def test_syncmer_rows(spark, odd, none):
    found = syncmers.fingerprints(odd.select("doc_id", "text", "size")).collect()
    assert len(found) == odd.count() and syncmers.fingerprints(none).count() == 0
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[0]["fingerprint"] == by_id[1]["fingerprint"] != by_id[5]["fingerprint"]
    ordered = syncmers.with_next(odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).collect()
    texts = {r["doc_id"]: r["text"] for r in ordered}
    assert all(r["next_text"] == texts[(r["doc_id"] - 1) % 8] for r in ordered)


def test_short_texts_have_anchors(spark):
    texts = [(n, turn, " ".join(f"w{n}x{turn}x{i}" for i in range(n))) for n in range(1, 15) for turn in range(20)]
    given = spark.createDataFrame([(i, text) for i, (_, _, text) in enumerate(texts)], "doc_id long, text string")
    found = given.select("text", syncmers.anchors(F.col("text")).alias("a")).select(
        "text", syncmers.printed(F.col("a")).alias("print"), syncmers.likeness(F.col("a"), F.col("a")).alias("like")
    )
    got = found.collect()
    assert all(r["print"] and r["like"] == 1 for r in got) and len({r["print"] for r in got}) == len(texts)
    copies = syncmers.fingerprints(given.where("doc_id % 20 = 0").select((F.col("doc_id") * 2).alias("doc_id"), "text").unionByName(
        given.where("doc_id % 20 = 0").select((F.col("doc_id") * 2 + 1).alias("doc_id"), "text")
    ))
    assert [r["near_next"] for r in copies.where("doc_id % 2 = 1").collect()] == [1.0] * 14


def test_token_counts_equal_plain_dynamic_programming():
    scores = {"a": -1.0, "b": -2.0, "ab": -2.5, "abc": -9.0, "▁a": -1.5, "▁": -3.0}

    def plain(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            n = len(word[end - 1].encode())
            options = [(best[end - 1][0] + (-9.0 - 10.0) * n, best[end - 1][1] - n)]
            options += [(best[s][0] + scores[word[s:end]], best[s][1] - 1) for s in range(end) if word[s:end] in scores]
            best.append(max(options))
        return -best[-1][1]

    words = ["▁ab", "▁abab", "▁abc", "▁x", "", "▁éa", "▁ab"]
    assert tokens.terminal_counts(words, scores) == {w: plain(w) for w in words}


def test_surrogates_are_distinct_and_consistent():
    key = b"k"
    values = [f"4{i:015d}" for i in range(300)]
    made = {surrogates.surrogate(v, "card", key) for v in values}
    assert len(made) == 300 and all(len(m) == 16 for m in made)
    text = "Mrs. Anna Smith, ann.b@mail5.example.com or 10.0.0.1; again ann.b@mail5.example.com"
    new, spans = surrogates.replace(text, key)
    assert [s[2] for s in spans] == ["name", "email", "ip", "email"] and spans[1][3] == spans[3][3] and "ann.b" not in new
    assert surrogates.replace(None, key) == (None, []) and surrogates.replace("", key) == ("", [])


@pytest.mark.parametrize("name", ["Dr. Иванов", "Frau Öz", "Mr. Al", "Herr Ñandú", "Mrs. Παπαδοπούλου", "Señora Żółć", "Dr. 王伟", "Dr. Ёж"])
def test_names_of_any_script_are_replaced(name):
    for n in range(40):
        new, spans = surrogates.replace(f"by {name} today", str(n).encode())
        title, old = name.split(" ")
        now = new.removeprefix(f"by {title} ").removesuffix(" today")
        assert len(spans) == 1 and spans[0][3] == f"{title} {now}" and now != old and len(now) == len(old)
        assert [c.isupper() for c in now] == [c.isupper() for c in old]


def test_surrogates_differ_from_their_values_and_each_other():
    octets = ("0", "1", "9", "10", "255", "00", "01", "09", "001", "010")
    for key in (b"a", b"b", b"c"):
        for kind, values in {
            "name": [f"Mr. {a}{b}l" for a in "AEIOUÄÖÜИЖ" for b in ("", "a", "ß", "ñ", "ç", "å", "ж")],
            "ip": [f"{a}.{b}.0.1" for a in octets for b in octets],
            "card": [f"٤{i:013d}{c}" for i in range(20) for c in "0123456789٠١٢٣٤٥٦٧٨٩"],
        }.items():
            made = {v: surrogates.surrogate(v, kind, key) for v in values}
            assert len(set(made.values())) == len(values) and all(v != m for v, m in made.items())
    new, spans = surrogates.replace("10.0.0.1 and 10.0.0.01 and 010.000.000.001", b"k")
    assert [s[2] for s in spans] == ["ip"] * 3 and len({s[3] for s in spans}) == 3


def test_license_scan(spark, odd, none):
    docs = spark.createDataFrame(rows(STORY + ". Released under the MIT License. More.", STORY, None, "under the MIT License"), SCHEMA)
    assert [(r["doc_id"], r["license"]) for r in licenses.scan_licenses(docs).collect()] == [(0, "MIT")]
    assert licenses.scan_licenses(odd).count() == 0 and licenses.scan_licenses(none).count() == 0


def test_license_counts_equal_brute_force(spark):
    def grams(text):
        words = re.findall(r"[^\W_]+", text.lower())
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    notices = [(f"L{n}", " ".join(f"n{n}t{t}w{w}" for w in range(n + 4))) for n in range(1, 8) for t in range(30)]
    texts = [" ".join([f"a{k}x{i}" for i in range(k % 7)] + [t] + [f"z{k}x{i}" for i in range(k % 4)]) for k, (_, t) in enumerate(notices)]
    texts += [t.rsplit(" ", 1)[0] + f" other {k}" for k, (_, t) in enumerate(notices)]
    found = licenses.scan_licenses(spark.createDataFrame(rows(*texts), SCHEMA), tuple(notices)).collect()
    wanted = {}
    for d, t in enumerate(texts):
        mine = grams(t)
        of = grams(notices[d % len(notices)][1])
        if len(mine & of) >= 0.8 * len(of):
            wanted[d, d % len(notices)] = (len(mine & of), len(of))
    assert {(r["doc_id"], r["template"]): (r["matched"], r["shingles"]) for r in found} == wanted and len(wanted) > len(notices)
