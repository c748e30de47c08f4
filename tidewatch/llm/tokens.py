"""Token counts under a unigram vocabulary, by dynamic programming shared along a trie."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import text_or_empty

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Pre-tokens held at once in a task; their counts are then added up and the trie starts anew.
HELD = 200_000


def load_scores(path: str = VOCABULARY) -> dict[str, float]:
    """Log score of each piece. The file gives an order, not frequencies; by Zipf's law rank r has 1/r."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return {model.id_to_piece(i): -math.log(rank + 1) for rank, i in enumerate(plain)}


def terminal_counts(words: Iterable[str], scores: dict[str, float]) -> dict[str, int]:
    """Tokens of the best segmentation of each distinct pre-token.

    The words are walked in sorted order, which is a depth-first walk of their trie:
    the forward states of the prefix shared with the word before are kept, and only
    new trie nodes are computed. A character that no piece covers costs its UTF-8
    bytes. Equal scores go to the fewer tokens.
    """
    longest = max(map(len, scores), default=1)
    unknown = min(scores.values(), default=0.0) - 10.0
    counts: dict[str, int] = {}
    before, states = "", [(0.0, 0)]
    for word in sorted(set(words)):
        shared = 0
        for a, b in zip(before, word):
            if a != b:
                break
            shared += 1
        del states[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            score, used = states[end - 1]
            size = len(word[end - 1].encode("utf-8", "surrogatepass"))
            best = (score + unknown * size, -used - size)
            for start in range(max(0, end - longest), end):
                piece = scores.get(word[start:end])
                if piece is not None:
                    score, used = states[start]
                    best = max(best, (score + piece, -used - 1))
            states.append((best[0], -best[1]))
        counts[word] = states[len(word)][1]
        before = word
    return counts


def _tokens_of(texts: list[str], scores: dict[str, float]) -> list[int]:
    totals = [0] * len(texts)
    held: list[tuple[int, Counter]] = []
    distinct: set[str] = set()

    def settle() -> None:
        counts = terminal_counts(distinct, scores)
        for i, words in held:
            totals[i] += sum(counts[w] * n for w, n in words.items())
        held.clear()
        distinct.clear()

    for i, text in enumerate(texts):
        words = Counter(MARK + w for w in text.split())
        held.append((i, words))
        distinct.update(words)
        if len(distinct) > HELD:
            settle()
    settle()
    return totals


def count_tokens(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens of every row.

    Null and empty texts have 0 tokens; repeated rows are counted each; other columns are not read.
    The vocabulary is read on the driver and sent along: its size does not depend on the corpus.
    """
    scores = load_scores(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n_tokens": pd.Series(_tokens_of(list(b["text"]), scores), index=b.index, dtype="int64")})

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInPandas(run, "doc_id long, n_tokens long")
