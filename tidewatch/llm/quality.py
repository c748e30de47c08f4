"""Quality score by a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import is_held_out, text_or_empty, training_sample

FOLD, FOLDS = 1, 3
PER_CLASS = 900
MAX_TRAIN_BYTES = 32_768
WIDTH, CHANNELS, FILTERS = 6, 6, 24
CHUNK = 16_384


class ByteNet:
    """Byte embedding, one bank of filters, maximum over all positions, one logistic unit.

    A text is read in chunks that overlap by ``WIDTH - 1`` bytes, so every window of
    the whole text is seen exactly once and memory does not grow with its length.
    """

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.emb = rng.normal(0, 0.5, (256, CHANNELS)).astype(np.float32)
        self.filters = rng.normal(0, (WIDTH * CHANNELS) ** -0.5, (WIDTH * CHANNELS, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = np.zeros(FILTERS, np.float32)
        self.out_bias = np.zeros(1, np.float32)
        self.prior: float | None = None

    def pooled(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter over the text, and where it starts."""
        codes = np.frombuffer(data.ljust(WIDTH, b"\0"), np.uint8)
        best = np.full(FILTERS, -np.inf, np.float32)
        where = np.zeros(FILTERS, np.int64)
        for start in range(0, len(codes) - WIDTH + 1, CHUNK):
            part = self.emb[codes[start : start + CHUNK + WIDTH - 1]]
            windows = np.lib.stride_tricks.sliding_window_view(part.ravel(), WIDTH * CHANNELS)[::CHANNELS]
            response = windows @ self.filters
            top = response.argmax(0)
            value = response[top, np.arange(FILTERS)]
            where = np.where(value > best, start + top, where)
            best = np.maximum(best, value)
        return best + self.bias, where

    def score(self, text: str | None) -> float:
        if self.prior is not None:
            return self.prior
        pooled, _ = self.pooled((text or "").encode("utf-8"))
        return float(1 / (1 + np.exp(-np.clip(np.maximum(pooled, 0) @ self.out + self.out_bias[0], -30, 30))))

    def fit(self, rows: list[tuple[int, str, int]], epochs: int = 10, rate: float = 0.02, seed: int = 7) -> ByteNet:
        """Adam on the logistic loss, both classes weighing the same.

        With no labels, or labels of one class only, every score is the smoothed share of label 1.
        """
        ones = sum(y for _, _, y in rows)
        if not 0 < ones < len(rows):
            self.prior = (ones + 1) / (len(rows) + 2)
            return self
        rng = np.random.default_rng(seed)
        self.out = rng.normal(0, 0.3, FILTERS).astype(np.float32)
        data = [(text.encode("utf-8"), y, len(rows) / (2 * (ones if y else len(rows) - ones))) for _, text, y in rows]
        names = ("emb", "filters", "bias", "out", "out_bias")
        first = {n: np.zeros_like(getattr(self, n)) for n in names}
        second = {n: np.zeros_like(getattr(self, n)) for n in names}
        step, batch = 0, 16
        for epoch in range(epochs):
            order = rng.permutation(len(data))
            for at in range(0, len(order), batch):
                grads = {n: np.zeros_like(getattr(self, n)) for n in names}
                for i in order[at : at + batch]:
                    self._add_gradient(*data[i], grads)
                step += 1
                for n in names:
                    g = grads[n] / batch
                    first[n] = 0.9 * first[n] + 0.1 * g
                    second[n] = 0.999 * second[n] + 0.001 * g * g
                    speed = rate * (1 - epoch / epochs) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
                    setattr(self, n, (getattr(self, n) - speed * first[n] / (1 - 0.9**step)).astype(np.float32))
        return self

    def _add_gradient(self, data: bytes, y: int, weight: float, grads: dict[str, np.ndarray]) -> None:
        pooled, where = self.pooled(data)
        active = np.maximum(pooled, 0)
        p = 1 / (1 + np.exp(-np.clip(active @ self.out + self.out_bias[0], -30, 30)))
        error = np.float32((p - y) * weight)
        grads["out"] += error * active
        grads["out_bias"] += error
        back = error * self.out * (pooled > 0)
        grads["bias"] += back
        codes = np.frombuffer(data.ljust(WIDTH, b"\0"), np.uint8)[where[:, None] + np.arange(WIDTH)]
        grads["filters"] += self.emb[codes].reshape(FILTERS, -1).T * back
        np.add.at(grads["emb"], codes, (self.filters * back).T.reshape(FILTERS, WIDTH, CHANNELS))


def train(docs: DataFrame, labels: DataFrame) -> ByteNet:
    return ByteNet().fit(training_sample(docs, labels, "quality", FOLD, FOLDS, PER_CLASS, MAX_TRAIN_BYTES))


def score_quality(docs: DataFrame, model: ByteNet) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, by its whole text.

    A null text is scored like the empty one; repeated rows are scored each; other
    columns are not read, whatever their names.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["score"] = [model.score(t) for t in b.pop("text")]
            yield b

    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())]
    )
    rows = docs.select(F.col("doc_id").cast("long"), is_held_out(FOLD, FOLDS).alias("held_out"), text_or_empty().alias("text"))
    return (
        rows.withColumn("doc_id", F.col("doc_id"))
        .mapInPandas(_keep_ids(run), schema)
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    )


def _keep_ids(run):
    """Nullable ids stay whole numbers on the way through pandas."""

    def wrapped(batches):
        for b in run(batches):
            b["doc_id"] = b["doc_id"].astype("Int64")
            yield b

    return wrapped


def keep_good(docs: DataFrame, model: ByteNet) -> DataFrame:
    """The rows that the classifier does not reject, with their columns; repeated rows are judged alike."""
    score = F.pandas_udf(lambda texts: texts.map(model.score).astype("float64"), "double")
    return docs.where(score(text_or_empty()) >= 0.5)
