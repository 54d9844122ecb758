"""Document quality by nearest-neighbour voting over latent-semantic vectors.

Method. The terms of a text are pairs of neighbouring character classes (letters by case, digits, blanks,
every ASCII sign by itself) and the words in repeated 3-word runs; a term's value is the square root of
its share times its inverse document frequency. A singular value decomposition of a bounded sample
(SAMPLE documents per label) gives DIMENSIONS latent directions. The sample's latent vectors and labels, at
most 2 * SAMPLE rows, are broadcast; the cosine of every document with every one of them is computed
exactly, in blocks, and the NEIGHBOURS nearest vote with their similarity as weight; so do all that are as near
as the last of these.

Defined cases: a null or empty text has no direction and gets the share of label 1 in the sample (0.5
without labelled rows); repeated rows are scored row by row, and of labelled rows with one key the text that
sorts first is learned; texts are read whole, whatever their length, and need about twenty times their size; only
key and text are read, so other columns cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm import textkernel as tk
from tidegrid.llm.labelled import fold, sample

SAMPLE = 2_000
DIMENSIONS = 32
NEIGHBOURS = 15
BLOCK = 512
#: Rows whose dense term vectors (6 kB each) are held at once.
SLICE_ROWS = 2_000
FOLDS, HELD_OUT = 4, 2
#: The weight of a similarity is its power: near-equal vectors outvote merely similar ones.
POWER = 4


def _classes() -> np.ndarray:
    c = np.zeros(256, np.int64)
    c[97:123], c[65:91], c[48:58], c[128:256] = 1, 2, 3, 4
    c[[32, 9, 11, 12, 13]], c[10] = 5, 6
    signs = [k for k in range(33, 127) if not c[k]]
    c[signs] = 7 + np.arange(len(signs))
    return c


CLASS = _classes()
SIDE = int(CLASS.max()) + 1
TERMS = SIDE * SIDE + 1


def term_shares(s: tk.Slice) -> np.ndarray:
    """rows x TERMS: square roots of the terms' shares; the last term is the share of words in repeated runs."""
    n = len(s)
    out = np.zeros((n, TERMS), np.float32)
    if len(s.data) > 1:
        size = s.ends - s.starts
        row = np.repeat(np.arange(n), size)
        c = CLASS[s.data]
        pair = c[:-1] * SIDE + c[1:]
        same = row[1:] == row[:-1]
        flat = np.bincount((row[:-1] * TERMS + pair)[same], minlength=n * TERMS).reshape(n, TERMS)
        out[:] = np.sqrt(flat / np.maximum(1, size - 1)[:, None])
    a, b, row = tk.word_spans(s)
    h = tk.span_hash(s.data, a, b)
    g = tk.grams(h, 3)
    if len(g):
        inside = row[: len(g)] == row[2:]
        key = (g ^ tk.mix(row[: len(g)].astype(np.uint64) + tk.U64(1)))[inside]
        order = np.sort(key)
        again = np.unique(order[1:][order[1:] == order[:-1]])
        if len(again):
            at = np.minimum(np.searchsorted(again, key), len(again) - 1)
            first = np.flatnonzero(inside)[again[at] == key]
            covered = np.zeros(len(row), bool)
            for k in range(3):
                covered[first + k] = True
            share = np.bincount(row[covered], minlength=n) / np.maximum(1, np.bincount(row, minlength=n))
            out[:, -1] = np.sqrt(share)
    return out


@dataclass
class Model:
    """projection: TERMS x DIMENSIONS; vectors: unit rows of the sample; labels; share of label 1."""

    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    share: float


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(x: np.ndarray, labels: np.ndarray) -> Model:
    """Latent directions by the eigenvectors of the terms' Gram matrix."""
    if not len(x):
        return Model(np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels, 0.5)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1
    weighted = x * idf
    _, v = np.linalg.eigh((weighted.T @ weighted).astype(np.float64))
    v = v[:, ::-1][:, :DIMENSIONS]
    v *= np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1, 1)  # one sign for every run
    p = (idf[:, None] * v).astype(np.float32)
    return Model(p, unit(x.astype(np.float64) @ p.astype(np.float64)).astype(np.float32), labels.astype(np.float32), float(labels.mean()))


def vote(m: Model, x: np.ndarray) -> np.ndarray:
    """Scores of term vectors, block by block."""
    out = np.full(len(x), m.share)
    if not len(m.vectors):
        return out
    k = min(NEIGHBOURS, len(m.vectors))
    projection, vectors = m.projection.astype(np.float64), m.vectors.astype(np.float64).T
    for a in range(0, len(x), BLOCK):
        # The last bits of a product follow the place in its block: rounded off, so that equal texts score alike.
        latent = x[a : a + BLOCK].astype(np.float64) @ projection
        some = np.flatnonzero(np.linalg.norm(latent, axis=1) > 1e-9)
        sim = np.round(unit(latent[some]) @ vectors, 9)
        last = np.partition(sim, len(m.vectors) - k, axis=1)[:, len(m.vectors) - k]
        row, near = np.nonzero(sim >= last[:, None])
        w = np.maximum(sim[row, near], 0) ** POWER + 1e-9
        out[a + some] = np.bincount(row, w * m.labels[near], len(some)) / np.bincount(row, w, len(some))
    return np.clip(out, 0, 1)


def train(labelled: DataFrame) -> Model:
    """From rows (order, label, _text), at most 2 * SAMPLE: their term vectors come to the driver."""

    def run(batches):
        for s in tk.slices(batches, "_text", most=SLICE_ROWS):
            x = term_shares(s)
            yield pa.RecordBatch.from_arrays([s.rows.column(0), s.rows.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["order", "label", "x"])

    rows = sorted(map(tuple, labelled.select("order", "label", "_text").mapInArrow(run, "order bigint, label int, x binary").collect()))
    x = np.frombuffer(b"".join(bytes(r[2]) for r in rows), np.float32).reshape(len(rows), TERMS)
    return fit(x, np.array([r[1] for r in rows], np.float32))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score: weight of label 1 among the neighbours, a row per input row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for s in tk.slices(batches, "_text", most=SLICE_ROWS):
            out = vote(m, term_shares(s))
            yield pa.RecordBatch.from_arrays([s.rows.column(0), pa.array(out)], names=["_key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, f"_key {kind}, score double").withColumnRenamed("_key", key)


def op2_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = train(sample(docs, labels, "quality", FOLDS, HELD_OUT, SAMPLE))
    return score(docs, model).select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
