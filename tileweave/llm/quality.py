"""Quality classifier (operator 3): hashed word n-grams, FTRL-proximal logistic regression.

Features are word unigrams and bigrams, and bigrams of word shapes (case, digits,
edge punctuation, length, whether a word repeats the one before), each hashed into
one table of weights.  A text's value for a feature is the feature's share of its
group, so a score is a bias plus sparse dot products that don't depend on length.

The model is fitted by follow-the-regularised-leader updates in one task, over a
bounded sample of labelled rows (``max_rows`` of smallest hash; the bound is a
parameter) from which held-out rows are left out; everything is scored.

Defined results: a null text counts as empty; the empty text has only the bias, which
is fitted as well.  Whole texts are read.  Rows with a null label, or whose document
has no text row, teach nothing; without any labelled row every score is 0.5.
Repeated rows get equal scores and, where one doc_id repeats, teach within the bound;
doc_ids may be of any type.  Extra columns pass through unless they carry the result's
name, in which case the result replaces them; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, text_or_empty, without_cycles

BITS = 18
#: Labelled rows that the model is fitted on, at most.
MAX_ROWS = 6000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.8, 1.0, 1e-4, 1e-3
HELD_OUT_OF = 5
_MASK = (1 << BITS) - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _shape(word: str) -> int:
    """A small number for case, digits, edge punctuation and length of a word."""
    core = word.strip(".,;:!?")
    case = 0 if core.islower() else 1 if core.istitle() else 2 if core.isupper() else 3
    kind = 0 if core.isalpha() else 1 if core.isdigit() else 2 if core.isalnum() else 3
    if not core:
        case = kind = 3
    edge = 0 if word == core else 1 if len(word) - len(core) == 1 else 2
    return ((case * 4 + kind) * 3 + edge) * 4 + min(len(core) // 4, 3)


class Featurizer:
    """Indexes and values of a text's features."""

    def __init__(self) -> None:
        self.words = Memo(lambda w: zlib.crc32(w.encode()) | _shape(w) << 32, 150_000)

    def groups(self, text: str) -> list[np.ndarray]:
        codes = self.words
        coded = np.array([codes[w] for w in text.split()], dtype=np.uint64)
        if not len(coded):
            return []
        word, shape = coded & np.uint64(0xFFFFFFFF), coded >> np.uint64(32)
        found = [self._slot(word * np.uint64(3))]
        if len(coded) > 1:
            same = (word[1:] == word[:-1]).astype(np.uint64)
            found.append(self._slot((word[:-1] * _MIX + word[1:]) * np.uint64(3) + np.uint64(1)))
            found.append(self._slot(((shape[:-1] * np.uint64(1024) + shape[1:]) * np.uint64(2) + same) * np.uint64(3) + np.uint64(2)))
        return found

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        key = (key ^ (key >> np.uint64(31))) * _MIX
        return ((key >> np.uint64(40)) & np.uint64(_MASK)).astype(np.int64)

    def sparse(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        groups = self.groups(text)
        if not groups:
            return np.empty(0, np.int64), np.empty(0)
        every = np.concatenate(groups)
        share = np.concatenate([np.full(len(g), 1.0 / len(g)) for g in groups])
        index, where = np.unique(every, return_inverse=True)
        return index, np.bincount(where, share)


def _sigmoid(x: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(x, -35, 35))))


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last one is the bias) after FTRL-proximal passes over sparse rows."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weight(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    bias = np.array([1 << BITS])
    for _ in range(epochs):
        for index, value, label in rows:
            i, x = np.concatenate([index, bias]), np.concatenate([value * 4.0, [0.25]])
            w = weight(z[i], n[i])
            g = (_sigmoid(float(w @ x)) - label) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    w = weight(z, n)
    w[:-1] *= 4.0
    w[-1] *= 0.25
    return w


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> np.ndarray:
    """Weights learned from labelled documents that aren't held out; only they reach the driver."""
    ids = F.col(doc_id).cast("string")
    usable = labels.where((F.crc32(ids.cast("binary")) % HELD_OUT_OF != 0) & F.col(label).isin(0, 1)).select(ids.alias("id"), F.col(label).cast("int").alias("label"))
    sample = usable.orderBy(F.xxhash64("id"), "id", "label").limit(max_rows)  # its size is bounded by max_rows
    rows = docs.select(F.col(doc_id).cast("string").alias("id"), text_or_empty(text).alias("text")).join(F.broadcast(sample), "id")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sparse = Featurizer().sparse
        for batch in batches:
            made = [sparse(t) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "label": batch["label"], "index": [i.astype(np.int32) for i, _ in made], "value": [v.astype(np.float32) for _, v in made]})

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(np.asarray(i, np.int64), np.asarray(v, np.float64), int(y)) for batch in batches for i, v, y in zip(batch["index"], batch["value"], batch["label"])]
        w = fit_ftrl(rows)
        at = np.flatnonzero(w)
        yield pd.DataFrame({"slot": at, "weight": w[at]})

    made = rows.mapInPandas(features, "id string, label int, index array<int>, value array<float>")
    # Repeated doc_ids make more rows than the sample has; the limit holds for them, too.
    ordered = made.orderBy(F.xxhash64("id"), "label", F.xxhash64("index")).limit(max_rows).coalesce(1)
    weights = np.zeros((1 << BITS) + 1)
    for slot, value in ordered.select("label", "index", "value").mapInPandas(fitted, "slot long, weight double").collect():
        weights[slot] = value
    return weights


def with_quality(docs: DataFrame, weights: np.ndarray, text: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text: near 1 where label 1 is likelier."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # 2**BITS + 1 numbers

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, groups = shared.value, Featurizer().groups

        def score(text: str) -> float:
            return _sigmoid(float(w[-1]) + sum(float(w[g].mean(dtype=np.float64)) for g in groups(text)))

        yield from without_cycles(batches, lambda batch: pd.Series([score(t) for t in batch], dtype="float64"))

    return docs.withColumn(to, scored(text_or_empty(text)))
