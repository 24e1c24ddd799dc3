"""Quality by naive-Bayes support vectors.

A text becomes a set of n-gram indicators: its words, word shapes (case, digits, signs), pairs and
triples of shapes, and marks for words repeated in a row. Each indicator is scaled by its log-count
ratio between the classes, and a linear hinge-loss model is fitted on the scaled indicators by dual
coordinate descent.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .common import held_out, id_and_text, labelled_sample, remainder, table

BITS = 20
CACHE = 400_000
_SHAPE = bytes(
    97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c
    for c in range(256)
)
_RUN = re.compile(rb"(.)\1+", re.S)


def indicators(text: str) -> set:
    """The distinct n-grams of a whole text; an empty text has the mark of emptiness only."""
    raw = text.encode()
    words = raw.split()
    if not words:
        return {b"\x00empty"}
    shapes = _RUN.sub(rb"\1", raw.translate(_SHAPE)).split()
    found = set(words)
    found.update(zip(shapes))
    found.update(zip(shapes, shapes[1:]))
    found.update(zip(shapes, shapes[1:], shapes[2:]))
    repeated = sum(map(eq, words, words[1:]))
    if repeated:
        found.add(b"\x00repeated %d" % min(3, math.floor(10 * repeated / len(words))))
    if len(words) >= 20:
        found.add(b"\x00distinct %d" % math.floor(4 * len(set(words)) / len(words)))
    found.add(b"\x00length %d" % min(6, len(words).bit_length() // 2))
    return found


def slot(gram) -> int:
    raw = gram if isinstance(gram, bytes) else b"\x01" + b"\x02".join(gram)
    return zlib.crc32(raw) & ((1 << BITS) - 1)


class _Weights(dict):
    """Weight of an n-gram, remembered; emptied when it holds ``CACHE`` entries."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, gram) -> float:
        if len(self) >= CACHE:
            self.clear()
        weight = self[gram] = float(self.weights[slot(gram)])
        return weight


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    scale: float = 1.0
    _seen: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "_seen": None}

    def score(self, text: str) -> float:
        if self._seen is None:
            self._seen = _Weights(self.weights)
        grams = indicators(text)
        margin = self.bias + math.fsum(map(self._seen.__getitem__, grams)) / math.sqrt(len(grams))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.scale * margin))))


def dual_coordinate_descent(
    rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: np.ndarray, epochs: int = 12
) -> np.ndarray:
    """Weights of the hinge-loss machine, the last one being the bias (a constant feature of 1)."""
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    norms = np.array([float(v @ v) + 1.0 for v in values])
    order = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            index, value = rows[i], values[i]
            gradient = y[i] * (float(w[index] @ value) + w[size]) - 1.0
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost[i])
            change = (new - alpha[i]) * y[i]
            if change:
                w[index] += change * value
                w[size] += change
                alpha[i] = new
                moved = max(moved, abs(change))
        if moved < 1e-4:
            break
    return w


def fit(rows: list[np.ndarray], y: np.ndarray, least: int = 4, cost: float = 1.0) -> Model:
    """``rows``: distinct slots of each document; ``y``: its class, 1 or -1."""
    size = 1 << BITS
    sums = {c: np.zeros(size) for c in (1, -1)}
    for row, c in zip(rows, y, strict=True):
        sums[int(c)][row] += 1
    common = sums[1] + sums[-1] >= least
    p, q = sums[1] + 1.0, sums[-1] + 1.0
    ratio = np.where(common, np.log(p / p.sum()) - np.log(q / q.sum()), 0.0)
    kept = [r[common[r]] for r in rows]
    values = [ratio[k] / math.sqrt(len(r)) for k, r in zip(kept, rows, strict=True)]
    share = max(1e-6, float((y == 1).mean()))
    w = dual_coordinate_descent(kept, values, y, size, np.full(len(y), cost))
    margins = np.array([float(w[k] @ v) + w[size] for k, v in zip(kept, values, strict=True)])
    spread = float(np.median(abs(margins))) or 1.0
    return Model((w[:size] * ratio).astype("float32"), float(w[size]), 2.0 / spread if share < 1 else 1.0)


def _slots(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([np.unique([slot(g) for g in indicators(t)]).astype("<i4").tobytes() for t in texts])


def train_on(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000) -> Model:
    """Learn from at most ``max_rows`` labelled rows of each class outside the hold-out (crc32 of the
    id modulo 3 is 1). With one class only, every text gets that class; with none, quality 1."""
    ship_package(docs.sparkSession)
    learnable = lambda doc_id: remainder(doc_id, 3) != 1
    sample = labelled_sample(docs, labels, "quality", learnable, max_rows, max_rows)
    found = sample.select("doc_id", "label", F.pandas_udf(_slots, "binary")(F.col("text")).alias("slots")).collect()
    found.sort(key=lambda r: (r["doc_id"], r["slots"]))
    y = np.array([1 if r["label"] else -1 for r in found])
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(1 << BITS, "float32"), float(y[0]) if len(y) else 1.0)
    return fit([np.frombuffer(r["slots"], "<i4") for r in found], y)


def score_column(model: Model, text: Column) -> Column:
    spark = SparkSession.active()
    shared = spark.sparkContext.broadcast(model)  # 4 MB: 2 ** BITS weights, whatever the input

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return F.pandas_udf(score, "double")(F.coalesce(text, F.lit("")))


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, also repeated ones; NULL texts are empty."""
    ship_package(docs.sparkSession)
    rows = id_and_text(docs).select(
        "doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), score_column(model, F.col("text")).alias("score")
    )
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train_on(docs, table(spark, sf_dir, "labels")))
