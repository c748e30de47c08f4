"""Periodic runs of words, by multi-scale minimizers."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import text_or_empty

#: A run has so many words at least, and so many periods.
LEAST, POWER = 6, 4
#: Periods up to here are too short for minimizers and are scanned lag by lag.
SHORT = 8
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the smallest hash (the first of equal ones) of some window of ``width`` hashes."""
    ranked = (hashes & _HIGH) | np.arange(len(hashes), dtype=np.uint64)
    padded = np.full(-(-len(ranked) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(ranked)] = ranked
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(ranked) - width + 1
    places = (np.minimum(back[:windows], ahead[width - 1 : width - 1 + windows]) & _LOW).astype(np.int64)
    return places[np.r_[True, places[1:] != places[:-1]]]


def _equal_ahead(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading elements are equal; looks at growing pieces, so that a short match costs little."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        end = min(at + step, n)
        differ = a[at:end] != b[at:end]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, step * 2
    return n


def _is_smallest(codes: np.ndarray, start: int, end: int, period: int) -> bool:
    """Whether no divisor of the period is a period as well; with four periods at hand no other can be."""
    rest, factor = period, 2
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor == 0:
            part = period // factor
            if (codes[start : end - part] == codes[start + part : end]).all():
                return False
            while rest % factor == 0:
                rest //= factor
        factor += 1
    return True


def find_runs(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period.

    At the scale of length k = 16, 32, ... the strings of k words are reduced to the
    minima of windows of k/2 of them. Inside a run of period q, k/2 < q <= k, a window
    and the one q further on hold the same strings, so their minima are q apart; strings
    of k >= q words are equal within a run only at multiples of q, so these two are
    neighbours among the equal minima. Four periods always hold two such windows. Each
    pair of neighbours at a fitting distance is a seed, extended to both sides.
    """
    n, found = len(codes), []
    for q in range(1, min(SHORT, n // POWER) + 1):
        equal = np.r_[False, codes[q:] == codes[:-q], False]
        edges = np.flatnonzero(equal[1:] != equal[:-1])
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts + q >= max(LEAST, POWER * q)
        found += [(int(s), int(e - s + q), q) for s, e in zip(starts[long], ends[long]) if _is_smallest(codes, s, e + q, q)]
    k, hashes = 1, _mixed(codes.astype(np.uint64) + np.uint64(1))
    while POWER * (max(k, SHORT) + 1) <= n:
        # From strings of k words to those of 2k.
        hashes = _mixed(hashes[:-k] * np.uint64(0x9E3779B97F4A7C15) + hashes[k:])
        k *= 2
        if k > SHORT:
            found += _runs_at(codes, hashes, k)
    return sorted(found, key=lambda r: (r[0], r[2]))


def _runs_at(codes: np.ndarray, hashes: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    places = _minimizers(hashes, k // 2)
    keys = hashes[places]
    order = np.argsort(keys, kind="stable")
    places, keys = places[order], keys[order]
    lags = places[1:] - places[:-1]
    seeds = np.flatnonzero((keys[1:] == keys[:-1]) & (lags > k // 2) & (lags <= k))
    found: list[tuple[int, int, int]] = []
    reached: dict[int, int] = {}  # by lag, where the last stretch looked at ends
    for at, lag in sorted(zip(places[seeds].tolist(), lags[seeds].tolist())):
        if at < reached.get(lag, 0):
            continue
        back = _equal_ahead(codes[:at][::-1], codes[: at + lag][::-1])
        end = at + _equal_ahead(codes[at:], codes[at + lag :]) + lag
        start = at - back
        reached[lag] = end - lag
        if end - start >= POWER * lag and _is_smallest(codes, start, end, lag):
            found.append((start, end - start, lag))
    return found


def runs_of(text: str | None) -> tuple[int, list[tuple[int, int, int]], str]:
    """Number of words, runs, and the words with every run cut to its first period, joined by one space."""
    words = (text or "").encode("utf-8", "surrogatepass").split()  # bytes part at the six ASCII blanks only
    seen: dict[bytes, int] = {}
    codes = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    found = find_runs(codes)
    if found:
        kept = np.ones(len(words), np.bool_)
        for start, length, period in found:
            kept[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(kept)]
    return len(codes), found, b" ".join(words).decode("utf-8", "surrogatepass")


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; words count from 0), collapsed, of every row.

    A null text is the empty one: no words, no runs, an empty collapsed text. Repeated
    rows come out each, other columns are not read, an empty table gives no rows. A
    text is one task's work: time and memory follow its own length.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [runs_of(t) for t in b["text"]]
            rows = [[{"start": s, "length": n, "period": q} for s, n, q in found] for _, found, _ in done]
            yield pd.DataFrame(
                {"doc_id": b["doc_id"].astype("Int64").array, "n_words": [n for n, _, _ in done], "runs": rows, "collapsed": [c for _, _, c in done]}
            )

    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInPandas(run, schema)


def repeated(doc_id: int | None, text: str | None) -> str | None:
    """The text with a stretch made periodic, for one id in ten: the input of the registered query.

    A row without id keeps its text.
    """
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    words = (text or "").encode("utf-8", "surrogatepass").split() if h is not None and h % 10 == 0 else []
    if not words:
        return text
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    rest = words[a : a + p]
    edited = words[:a] + (rest * (-(-(n - a) // p)))[: n - a]
    return b" ".join(edited).decode("utf-8", "surrogatepass")


def run_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the greatest run and the digests of all runs and of the collapsed text, after ``repeated``."""
    edit = F.pandas_udf(lambda ids, texts: pd.Series([repeated(None if pd.isna(i) else int(i), t) for i, t in zip(ids, texts)], dtype="object"), "string")
    rows = periodic_runs(docs.select(F.col("doc_id").cast("long"), "text").withColumn("text", edit("doc_id", "text")))
    greatest = "array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))"
    lines = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')"
    return rows.selectExpr("*", f"{greatest} AS best", f"{lines} AS listed").selectExpr(
        "doc_id",
        "CAST(size(runs) AS BIGINT) AS n_runs",
        "-best.start AS start",
        "best.length AS length",
        "-best.period AS period",
        "1000 * best.length DIV -best.period AS exponent_milli",
        "sha2(listed, 256) AS runs_sha256",
        "sha2(collapsed, 256) AS collapsed_sha256",
    )
