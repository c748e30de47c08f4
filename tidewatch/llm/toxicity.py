"""Toxicity score by a factorization machine over hashed terms."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import is_held_out, text_or_empty, training_sample

FOLD, FOLDS = 0, 5
PER_CLASS = 3000
MAX_TRAIN_BYTES = 65_536
BUCKETS = 1 << 20
#: Every term of so many documents of the sample takes part.
MIN_DOCS = 4
FACTORS = 8
#: What a term without evidence for either label counts, so that it can still tell together with others.
FLOOR = 0.05
EDGES = b".,;:!?\"'()[]{}|*#$%&-_"


def hashed_terms(text: str | None) -> set[int]:
    """Buckets of the distinct words of a whole text, without case and edge punctuation."""
    words = set((text or "").lower().encode("utf-8").split())
    return {zlib.crc32(w.strip(EDGES)) % BUCKETS for w in words}


class FactorizationMachine:
    """Linear weights plus, for each pair of present terms, the product of their factors.

    A present term counts by its evidence in the sample (how far it is from even between
    the labels, plus ``FLOOR``), and each text's terms are scaled to length 1. So a long
    text weighs no more than a short one, neither in the linear nor in the pair part,
    and the many rare terms, which would be learned by heart, count little without being left out.
    """

    #: The pair part is summed over terms of length 1, whose products are small.
    PAIR_SCALE = 4.0

    def __init__(self):
        self.place: dict[int, int] = {}
        self.prior: float | None = None

    def _present(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and values of the known terms of a text."""
        at = np.array(sorted(self.place[t] for t in hashed_terms(text) if t in self.place), np.int64)
        x = self.value[at]
        return at, x / max(1e-9, float(np.sqrt((x**2).sum())))

    def _margin(self, at: np.ndarray, x: np.ndarray) -> float:
        v = self.v[at] * x[:, None]
        pairs = 0.5 * float((v.sum(0) ** 2).sum() - (v**2).sum())
        return float(self.bias + self.w[at] @ x + self.PAIR_SCALE * pairs)

    def score(self, text: str | None) -> float:
        if self.prior is not None:
            return self.prior
        return float(1 / (1 + np.exp(-np.clip(self._margin(*self._present(text)), -30, 30))))

    def _learn_terms(self, rows: list[tuple[int, str, int]], ones: int) -> None:
        with_term = (Counter(), Counter())
        for _, text, y in rows:
            with_term[y].update(hashed_terms(text))
        terms = sorted(t for t in with_term[0].keys() | with_term[1].keys() if with_term[0][t] + with_term[1][t] >= MIN_DOCS)
        self.place = {t: i for i, t in enumerate(terms)}
        toxic = np.array([with_term[1][t] for t in terms], np.float64)
        expected = (toxic + np.array([with_term[0][t] for t in terms], np.float64)) * ones / len(rows)
        evidence = np.abs(toxic - expected) / np.sqrt(expected * (1 - ones / len(rows)) + 1e-9)
        self.value = evidence / max(1e-9, float(np.sqrt(np.mean(evidence**2)) if len(terms) else 0)) + FLOOR

    def fit(
        self, rows: list[tuple[int, str, int]], epochs: int = 14, linear: int = 8, rate: float = 0.5, pair_rate: float = 0.1, seed: int = 11
    ) -> FactorizationMachine:
        """Gradient steps on the logistic loss, both classes weighing the same; after ``linear`` epochs pairs join in.

        With no labels, or labels of one class only, every score is the smoothed share of label 1.
        """
        ones = sum(y for _, _, y in rows)
        if not 0 < ones < len(rows):
            self.prior = (ones + 1) / (len(rows) + 2)
            return self
        self._learn_terms(rows, ones)
        rng = np.random.default_rng(seed)
        n = len(self.place)
        start = rng.normal(0, 0.05, (n, FACTORS))
        self.bias, self.w, self.v = 0.0, np.zeros(n), np.zeros((n, FACTORS))
        data = [(*self._present(text), y, len(rows) / (2 * (ones if y else len(rows) - ones))) for _, text, y in rows]
        for epoch in range(epochs):
            if epoch == linear:
                self.v = start
            left = 1 - epoch / epochs
            for i in rng.permutation(len(data)):
                at, x, y, weight = data[i]
                error = weight * (1 / (1 + np.exp(-np.clip(self._margin(at, x), -30, 30))) - y)
                self.bias -= 0.1 * rate * left * error
                if not len(at):
                    continue
                self.w[at] -= rate * left * (error * x + 1e-4 * self.w[at])
                if epoch >= linear:
                    v = self.v[at] * x[:, None]
                    self.v[at] -= pair_rate * left * (error * self.PAIR_SCALE * x[:, None] * (v.sum(0) - v) + 1e-3 * self.v[at])
        return self


def train(docs: DataFrame, labels: DataFrame) -> FactorizationMachine:
    return FactorizationMachine().fit(training_sample(docs, labels, "toxic", FOLD, FOLDS, PER_CLASS, MAX_TRAIN_BYTES))


def score_toxicity(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, by its whole text.

    A null text is scored like the empty one; repeated rows are scored each; other
    columns are not read, whatever their names.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "held_out": b["held_out"], "score": b["text"].map(model.score).astype("float64")})

    rows = docs.select(F.col("doc_id").cast("long"), is_held_out(FOLD, FOLDS).alias("held_out"), text_or_empty().alias("text"))
    scored = rows.mapInPandas(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
