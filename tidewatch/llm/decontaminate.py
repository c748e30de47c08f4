"""Benchmark passages in training text, found by spaced seeds and verified with substitutions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import stored, text_or_empty
from tidewatch.operators.joins import fits_broadcast, salted_join

#: Token positions a seed reads (1) and ignores (0). With one token in five substituted,
#: wherever it is, an overlap of 12 or more tokens leaves the read positions of some mask whole.
MASKS = ("11101101", "11011011", "1010110011", "110100010111", "11111")
#: Items with fewer tokens than this are sought by short masks as well, which do the same from SHORTEST on.
SHORT_ITEM = 12
SHORT_MASKS = ("111", "1011")
#: An overlap counts from this many tokens on (or the whole item, if shorter), with this share of equal tokens.
OVERLAP, SHARE = 13, 0.8
#: Items with fewer tokens are sought as exact sequences; they are reported, but no ground for dropping a document.
SHORTEST = 5
WHOLE_MASKS = tuple("1" * n for n in range(1, SHORTEST))
#: Token positions of a piece; texts and items of any length are joined and compared piece by piece.
PIECE = 128
#: The filter of seed hashes has at most two to this power bits.
SIEVE_BITS = 27
#: Texts are hashed together up to about this many tokens: few calls, and arrays that stay in the processor's cache.
GROUP = 1 << 15
EDGES = ".,;:!?\"'()[]|*#$%&"


def token_hashes(text: str | None) -> np.ndarray:
    """One hash per token of letters: case and edge punctuation do not count."""
    words = (text or "").lower().split()
    digests = map(xxhash.xxh64_digest, map(str.strip, words, repeat(EDGES)))
    tokens = np.empty(len(words), np.uint64)
    for i in range(0, len(words), GROUP):
        tokens[i : i + GROUP] = np.frombuffer(b"".join(islice(digests, GROUP)), ">u8")
    return tokens


def seed_hashes(tokens: np.ndarray, mask: str) -> np.ndarray:
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, int(mask, 2), np.uint64)
    for i, bit in enumerate(mask):
        if bit == "1":
            total ^= tokens[i : i + n]
            total *= np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(29)
    return total


def _masks_of(tokens: int) -> tuple[str, ...]:
    """The masks by which an item of so many tokens is sought."""
    if tokens < SHORTEST:
        return WHOLE_MASKS[tokens - 1 : tokens]
    return (*MASKS, *SHORT_MASKS) if tokens < SHORT_ITEM else MASKS


def pieces(tokens: np.ndarray, masks: Iterable[str], keep: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[dict]:
    """The pieces of one token sequence."""
    return (p for _, p in pieces_of_all([tokens], masks, keep))


def pieces_of_all(
    texts: list[np.ndarray], masks: Iterable[str], keep: Callable[[np.ndarray], np.ndarray] | None = None
) -> Iterator[tuple[int, dict]]:
    """The seeds of token sequences, in pieces of ``PIECE`` positions, each with the index of its sequence.

    A piece has the hashes of the seeds that start in it, their places, and the tokens
    from ``OVERLAP`` before it to ``OVERLAP`` after it: every overlap around one of its
    seeds lies among them. ``keep`` picks seeds; pieces without a seed are left out.
    The sequences are hashed as one; seeds that reach from one into the next are dropped.
    """
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    tokens = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
    found, spots = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for mask in masks:
        own = seed_hashes(tokens, mask)
        at = np.arange(len(own)) if keep is None else keep(own)
        at = at[at + len(mask) <= ends[np.searchsorted(ends, at, "right")]]
        found.append(own[at])
        spots.append(at)
    found, spots = np.concatenate(found), np.concatenate(spots)
    if not len(found):
        return
    order = np.argsort(spots, kind="stable")
    found, spots = found[order], spots[order]
    owners = np.searchsorted(ends, spots, "right")
    places = spots - np.r_[0, ends][owners]
    cuts = np.flatnonzero((np.diff(owners) != 0) | (np.diff(places // PIECE) != 0)) + 1
    for owner, h, p in zip(owners[np.r_[0, cuts]], np.split(found, cuts), np.split(places, cuts)):
        first = int(p[0]) // PIECE * PIECE
        start = max(0, first - OVERLAP)
        around = texts[owner][start : first + PIECE + OVERLAP]
        yield int(owner), {"start": start, "around": around.view(np.int64), "hashes": h.view(np.int64), "places": p.astype(np.int32)}


def _groups(texts: Iterable[str]) -> Iterator[list[np.ndarray]]:
    """The token hashes of texts in their order, in lists of ``GROUP`` tokens or little more than a text beyond."""
    group, size = [], 0
    for text in texts:
        group.append(token_hashes(text))
        size += len(group[-1])
        if size >= GROUP:
            yield group
            group, size = [], 0
    yield group


def best_overlap(text: dict, item: dict, item_tokens: int) -> tuple[int, int, float] | None:
    """(first token, tokens, share of equal tokens) of the best overlap of two pieces on a diagonal that a common seed gives."""
    order = np.argsort(item["hashes"], kind="stable")
    hashes, at = np.asarray(item["hashes"])[order], np.asarray(item["places"])[order]
    low, high = np.searchsorted(hashes, text["hashes"], "left"), np.searchsorted(hashes, text["hashes"], "right")
    shifts: set[int] = set()
    for place, first, end in zip(text["places"], low, high):
        shifts.update((int(place) - at[first:end]).tolist())
    a, b = np.asarray(text["around"]), np.asarray(item["around"])
    need, best = min(OVERLAP, item_tokens), None
    for shift in shifts:
        # Both pieces along the diagonal, by the tokens of the text.
        start = max(text["start"], item["start"] + shift)
        end = min(text["start"] + len(a), item["start"] + shift + len(b))
        if end - start < need:
            continue
        equal = a[start - text["start"] : end - text["start"]] == b[start - shift - item["start"] : end - shift - item["start"]]
        sums = np.r_[0, np.cumsum(equal)]
        window = sums[need:] - sums[:-need]
        top = int(window.argmax())
        found = (start + top, need, float(window[top] / need))
        if window[top] >= SHARE * need and (best is None or (found[2], -found[0]) > (best[2], -best[0])):
            best = found
    return best


PIECE_COLUMNS = "start int, around array<long>, hashes array<long>, places array<int>"


def _item_pieces(benchmark: DataFrame, shortest: int) -> DataFrame:
    """item_id, item_text (a hash), item_tokens, mask_tokens and a piece: the benchmark's side, one row per piece."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for item, key, text in zip(b["item_id"], b["item_text"], b["text"]):
                tokens = token_hashes(text)
                if len(tokens) >= max(shortest, 1):
                    masks = _masks_of(len(tokens))
                    out += [(item, key, len(tokens), *p.values()) for p in pieces(tokens, masks)]
            yield pd.DataFrame(out, columns=["item_id", "item_text", "item_tokens", "start", "around", "hashes", "places"])

    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), "text").distinct()
    items = items.select("item_id", F.xxhash64("text").alias("item_text"), "text")
    return items.mapInPandas(run, "item_id long, item_text long, item_tokens int, " + PIECE_COLUMNS)


def _sieve(items: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter of the seed hashes: words of 64 bits, and the number of bits as a power of two.

    It has 256 bits for each seed, at most ``SIEVE_BITS`` (16 MB) however large the
    benchmark is; beyond that it lets more through, and the join decides as before.
    """
    count = items.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()[0]
    bits = min(SIEVE_BITS, max(16, (256 * int(count)).bit_length()))
    seeds = items.select(F.explode("hashes").alias("h"))
    spots = seeds.select(F.explode(F.array(*[F.shiftrightunsigned("h", s).bitwiseAND(F.lit((1 << bits) - 1)) for s in _fields(bits)])).alias("spot"))
    bit = F.expr("shiftleft(1L, CAST(spot & 63 AS INT))")
    words = spots.groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
    sieve = np.zeros(1 << (bits - 6), np.int64)
    sieve[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return sieve.view(np.uint64), bits


def _fields(bits: int) -> tuple[int, ...]:
    """How far a hash is shifted for each of the places it marks."""
    return (64 - bits, (64 - bits) // 2, 0)


def _passing(hashes: np.ndarray, sieve: np.ndarray, bits: int) -> np.ndarray:
    """Positions of the hashes that the sieve lets through."""
    kept = None
    for shift in _fields(bits):
        spot = (hashes if kept is None else hashes[kept]) >> np.uint64(shift)
        spot &= np.uint64((1 << bits) - 1)
        word = sieve[(spot >> np.uint64(6)).view(np.int64)]
        spot &= np.uint64(63)
        word >>= spot
        word &= np.uint64(1)
        passed = np.flatnonzero(word)
        kept = passed if kept is None else kept[passed]
    return kept


def _text_pieces(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, text_key, leads and a piece: the corpus's side, one row per piece with a seed of some item.

    ``leads`` marks the first piece of each document.
    """
    spark = docs.sparkSession
    lengths = [r[0] for r in items.select(F.least("item_tokens", F.lit(SHORT_ITEM)).alias("n")).distinct().collect()]
    masks = tuple(dict.fromkeys(m for n in sorted(lengths) for m in _masks_of(n)))
    words, bits = _sieve(items)
    sieve = spark.sparkContext.broadcast(words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep = lambda hashes: _passing(hashes, sieve.value, bits)
        for b in batches:
            out, first = [], 0
            ids, keys = b["doc_id"].astype("Int64").array, b["text_key"].array
            for group in _groups(b["text"]):
                last = -1
                for i, p in pieces_of_all(group, masks, keep):
                    out.append((ids[first + i], keys[first + i], i != last, *p.values()))
                    last = i
                first += len(group)
            frame = pd.DataFrame(out, columns=["doc_id", "text_key", "leads", "start", "around", "hashes", "places"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    rows = rows.select("doc_id", F.md5("text").alias("text_key"), "text")
    return rows.mapInPandas(run, "doc_id long, text_key string, leads boolean, " + PIECE_COLUMNS)


def _overlaps(docs: DataFrame, benchmark: DataFrame, shortest: int = 1) -> tuple[DataFrame, DataFrame]:
    """The owners (doc_id, text_key) of texts with seeds, and the verified overlaps of the distinct texts (by text_key)."""
    items = stored(_item_pieces(benchmark, shortest))
    found = stored(_text_pieces(docs, items))
    texts = found.drop("doc_id", "leads").distinct().withColumn("piece", F.xxhash64("text_key", "start"))
    seeds = items.select("item_id", "item_text", F.col("start").alias("item_start"), F.explode(F.array_distinct("hashes")).alias("hash"))
    hits = texts.select("piece", "text_key", "start", F.explode(F.array_distinct("hashes")).alias("hash"))
    pairs = salted_join(hits, seeds, "hash", F.col("piece")).select("piece", "text_key", "start", "item_id", "item_text", "item_start").distinct()
    item_side = [F.col(c).alias(f"item_{c}") for c in ("around", "hashes", "places")]
    item_key = F.xxhash64("item_id", "item_text", "item_start")
    wide = items.select(F.xxhash64("item_id", "item_text", "start").alias("item_key"), "item_tokens", *item_side)
    pairs = salted_join(pairs.withColumn("item_key", item_key), wide, "item_key", F.col("piece"))
    pairs = pairs.join(texts.select("text_key", "start", "around", "hashes", "places"), ["text_key", "start"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                item = {c: row[f"item_{c}"] for c in ("start", "around", "hashes", "places")}
                best = best_overlap(row, item, row["item_tokens"])
                if best:
                    out.append((row["text_key"], row["item_id"], row["item_text"], *best))
            yield pd.DataFrame(out, columns=["text_key", "item_id", "item_text", "start_token", "tokens", "share"])

    verified = pairs.drop("piece", "item_key").mapInPandas(run, "text_key string, item_id long, item_text long, start_token int, tokens int, share double")
    order = F.struct("share", -F.col("start_token"))
    best = verified.groupBy("text_key", "item_id", "item_text").agg(F.max_by(F.struct("start_token", "tokens", "share"), order).alias("best"))
    return found.where("leads").select("doc_id", "text_key"), best.select("text_key", "item_id", "best.*")


def benchmark_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start_token, tokens, share: one row per document and item that overlap.

    An overlap has at least ``OVERLAP`` tokens, or the whole of a shorter item, ``SHARE``
    of them equal; items of under ``SHORTEST`` tokens are found where all tokens are equal.
    The best one is given, the first of equally good ones. Null and empty texts and an
    empty benchmark match nothing. Repeated documents are listed each, equal benchmark
    rows count once, and an id with several texts has a row for each that overlaps.

    Both sides are cut into pieces with their seed hashes and joined on these; neither
    is collected. A filter of bounded size keeps seeds of no item from the shuffle.
    """
    owners, overlaps = _overlaps(docs, benchmark)
    result = salted_join(owners, overlaps, "text_key", F.xxhash64("doc_id"))
    return result.select("doc_id", "item_id", "start_token", "tokens", "share")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without a verified overlap, with their columns; null and empty texts stay.

    Items of under ``SHORTEST`` tokens occur in any text and drop nothing. The keys of
    the texts to drop are broadcast if their measured size allows it.
    """
    _, overlaps = _overlaps(docs, benchmark, SHORTEST)
    tainted = stored(overlaps.select(F.col("text_key").alias("tainted")).distinct())
    tainted = F.broadcast(tainted) if fits_broadcast(tainted) else tainted.hint("merge")
    rows = docs.select(F.struct("*").alias("doc"), F.md5(text_or_empty()).alias("text_key"))
    return rows.join(tainted, F.col("text_key") == F.col("tainted"), "left_anti").select("doc.*")
