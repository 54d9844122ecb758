"""Toxicity by FTRL-proximal logistic regression over hashed words, word pairs and skip-grams.

Method. Features are the different words, neighbouring pairs and pairs with one word between them of a
text, hashed into 2**BITS places. FTRL-proximal keeps a learning rate for each place and sets
weights whose evidence stays under L1 to exactly zero, so that what is sent to the executors is a short
list. Labelled texts become lists of places where they are read. Training runs over those of SAMPLE documents
of each label at most, EPOCHS times, as one stream through one task, which holds three arrays of 2**BITS
numbers whatever the texts' sizes.

Words are runs of letters, digits and characters beyond ASCII, A-Z in lower case. Defined cases: null
and empty texts get the score of the bias alone; without labelled rows all scores are 0.5; repeated
rows are scored row by row, and of labelled rows with one key the text that sorts first is learned; texts are
read whole, whatever their length, and need about twenty times their size; only key and text are read, so
other columns cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm import textkernel as tk
from tidegrid.llm.labelled import fold, sample

BITS = 18
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.1
SAMPLE = 12_000
EPOCHS = 3
FOLDS, HELD_OUT = 5, 0


def features(s: tk.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Place and row of every feature occurrence."""
    a, b, row = tk.word_spans(s, tk.PUNCTUATION)
    h = tk.span_hash(tk.lower(s.data), a, b)
    out, rows = [h], [row]
    for gap, salt in ((1, 0x51ED270B), (2, 0x2545F491)):
        same = row[gap:] == row[:-gap]
        out.append(tk.mix(h[:-gap][same] * tk.U64(salt) + h[gap:][same]))
        rows.append(row[gap:][same])
    return (np.concatenate(out) & tk.U64((1 << BITS) - 1)).astype(np.int64), np.concatenate(rows)


class Ftrl:
    """Per-coordinate FTRL-proximal; place 2**BITS is the bias, which L1 spares."""

    def __init__(self):
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == 1 << BITS, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        """at: the different places of one document."""
        at = np.append(at, 1 << BITS)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] += g * g

    def model(self) -> tuple[np.ndarray, np.ndarray, float]:
        w = self.weights(np.arange((1 << BITS) + 1))
        at = np.flatnonzero(w[:-1])
        return at, w[at], float(w[-1])


def train(labelled: DataFrame, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Places, weights and bias, from rows (order, label, _text)."""

    def hashed(batches):
        for s in tk.slices(batches, "_text"):
            at, row = features(s)
            key = np.unique((row << BITS) | at)
            cut = np.searchsorted(key >> BITS, np.arange(len(s) + 1))
            at = (key & ((1 << BITS) - 1)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([s.rows.column(0), s.rows.column(1), pa.array([at[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["order", "label", "places"])

    def run(batches):
        m = Ftrl()
        for batch in batches:
            for label, places in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                m.learn(np.frombuffer(places.as_buffer(), np.uint32).astype(np.int64), label)
        at, w, bias = m.model()
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w, bias))], names=["place", "weight"])

    every = labelled.select("order", "label", "_text").mapInArrow(hashed, "order bigint, label int, places binary")
    every = every.withColumn("epoch", F.explode(F.array(*map(F.lit, range(epochs)))))
    every = every.withColumn("turn", F.xxhash64("order", "epoch")).repartition(1).sortWithinPartitions("epoch", "turn")
    rows = every.select("label", "places").mapInArrow(run, "place bigint, weight double").collect()
    got = dict((r[0], r[1]) for r in rows)
    bias = got.pop(-1, 0.0)
    at = np.array(sorted(got), np.int64)
    return at, np.array([got[k] for k in at.tolist()]), bias


def score_slice(s: tk.Slice, dense: np.ndarray, bias: float) -> np.ndarray:
    at, row = features(s)
    some = dense[at] != 0
    key = np.unique((row[some] << BITS) | at[some])
    total = np.bincount(key >> BITS, weights=dense[key & ((1 << BITS) - 1)], minlength=len(s)) if len(key) else np.zeros(len(s))
    return 1 / (1 + np.exp(-np.clip(total + bias, -35, 35)))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score: the probability of label 1, a row per input row."""
    at, w, bias = model

    def run(batches):
        dense = np.zeros(1 << BITS)
        dense[at] = w
        for s in tk.slices(batches, "_text"):
            yield pa.RecordBatch.from_arrays([s.rows.column(0), pa.array(score_slice(s, dense, bias))], names=["_key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, f"_key {kind}, score double").withColumnRenamed("_key", key)


def op7_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = train(sample(docs, labels, "toxic", FOLDS, HELD_OUT, SAMPLE))
    return score(docs, model).select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
