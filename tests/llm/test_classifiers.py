"""Operators 2 and 7: folds, held-out accuracy and defined cases."""

import collections
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from tidegrid.llm import quality_classifier, toxicity
from tidegrid.llm import textkernel as tk
from tidegrid.llm.labelled import sample

DATA = "/root/testdata/sf0.1"


@pytest.mark.parametrize(("op", "label", "of", "out", "at", "least"), [(quality_classifier.op2_query, "quality", 4, 2, 0.7, 0.98), (toxicity.op7_query, "toxic", 5, 0, 0.5, 0.96)])
def test_held_out_accuracy(spark, op, label, of, out, at, least):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in op(docs, labels).collect()}
    assert len(got) == docs.count()
    right, clean = [], []
    for i, y in duckdb.connect().execute(f"SELECT doc_id, {label} FROM '{DATA}/labels.parquet'").fetchall():
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % of == out)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= at)
        if r.held_out:
            right.append(r.predicted == y)
            clean += [r.predicted == 0] if label == "toxic" and not y else []
    assert np.mean(right) >= least
    assert not clean or np.mean(clean) >= 0.995


@pytest.mark.parametrize(("op", "label"), [(quality_classifier.op2_query, "quality"), (toxicity.op7_query, "toxic")])
def test_defined_cases(spark, hard, nothing, nameless, op, label):
    labels = spark.createDataFrame([(r.doc_id, k % 2, "x") for k, r in enumerate(hard.select("doc_id").distinct().collect())] + [(None, 1, "x"), (1, None, "x"), (4, 0, "x"), (4, 1, "x")], f"doc_id long, {label} int, text string")
    got = op(hard, labels).collect()
    assert len(got) == hard.count() and all(0 <= r.score <= 1 for r in got)
    assert len({(r.doc_id, r.score) for r in got}) == hard.select("doc_id").distinct().count()  # repeated rows alike
    assert op(nothing, labels).count() == 0
    assert op(nameless, labels).count() == nameless.count()
    assert {r.score for r in op(hard, labels.limit(0)).collect()} == {0.5}


def test_held_out_labels_are_never_learned(spark, hard):
    """Turning all held-out labels over changes no score."""
    ids = [r[0] for r in hard.select("doc_id").distinct().collect()]
    for op, label, of, out in ((quality_classifier.op2_query, "quality", 4, 2), (toxicity.op7_query, "toxic", 5, 0)):
        scores = []
        for flip in (0, 1):
            rows = [(i, (k % 2) ^ (flip and zlib.crc32(str(i).encode()) % of == out)) for k, i in enumerate(sorted(ids))]
            scores.append(sorted((r.doc_id, r.score) for r in op(hard, spark.createDataFrame(rows, f"doc_id long, {label} int")).collect()))
        assert scores[0] == scores[1]


def test_sample_is_bounded_and_repeatable(spark, hard):
    labels = spark.createDataFrame([(r.doc_id, k % 2) for k, r in enumerate(hard.select("doc_id").distinct().collect())], "doc_id long, toxic int")
    a, b = (sorted(map(tuple, sample(hard, labels, "toxic", 5, 0, 5).collect())) for _ in range(2))
    assert a == b and len(a) == 10
    many = spark.createDataFrame([(k % 2 + 1, f"text {k:03}") for k in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    assert sorted(r._text for r in sample(many, labels, "toxic", 50, 0, 5).collect()) == ["text 000", "text 001"]


def test_training_is_that_of_a_plain_ftrl(spark):
    """Features as tuples of words, dictionaries for weights, one document after another."""
    r = random.Random(2)
    words = [f"w{k}" for k in range(30)]
    rows = [(k, k % 2, " ".join(r.choice(words) for _ in range(r.randint(0, 25))) + (" BAD, thing" if k % 2 else "")) for k in range(60)]
    labelled = spark.createDataFrame([(o, y, t) for o, y, t in rows], "order long, label int, _text string")
    at, w, bias = toxicity.train(labelled, 2)
    turn = labelled.selectExpr("order", "label", "_text", "explode(array(0, 1)) AS epoch").selectExpr("*", "xxhash64(order, epoch) AS turn").orderBy("epoch", "turn").collect()

    def places(text):
        ws = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())
        name = lambda x: int(tk.span_hash(np.frombuffer(x.encode(), np.uint8), np.array([0]), np.array([len(x.encode())]))[0])
        two = lambda a, b, salt: int(tk.mix(np.array([(name(a) * salt + name(b)) % 2**64], np.uint64))[0])
        found = {("1", a): name(a) for a in ws} | {("2", a, b): two(a, b, 0x51ED270B) for a, b in zip(ws, ws[1:], strict=False)} | {("3", a, b): two(a, b, 0x2545F491) for a, b in zip(ws, ws[2:], strict=False)}
        return {h % (1 << toxicity.BITS) for h in found.values()}

    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        l1 = 0 if i == "bias" else toxicity.L1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for x in turn:
        on = [*places(x._text), "bias"]
        ws = {i: weight(i) for i in on}
        g = 1 / (1 + math.exp(-sum(ws.values()))) - x.label
        for i in on:
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * ws[i]
            n[i] += g * g
    want = {i: weight(i) for i in z if weight(i)}
    assert bias == pytest.approx(want.pop("bias"))
    assert dict(zip(at.tolist(), w.tolist(), strict=True)) == pytest.approx(want) and len(want) > 1
    docs = spark.createDataFrame([(o, t) for o, _, t in rows], "doc_id long, text string")
    for x in toxicity.score(docs, (at, w, bias)).collect():
        total = bias + sum(want.get(i, 0.0) for i in places(rows[x.doc_id][2]))
        assert x.score == pytest.approx(1 / (1 + math.exp(-total)))


def test_neighbours_as_near_as_the_last_all_vote():
    r = np.random.default_rng(4)
    x = r.random((10, quality_classifier.TERMS)).astype(np.float32)
    x = np.concatenate([x, np.repeat(x[:1], 40, axis=0)])  # 41 equal ones, more than vote otherwise
    y = np.append(r.random(10) < 0.5, np.arange(40) % 4 == 0).astype(np.float32)
    m = quality_classifier.fit(x, y)
    got = quality_classifier.vote(m, x[:1])[0]
    assert got == pytest.approx(y[[0, *range(10, 50)]].mean(), abs=1e-6)
    turned = quality_classifier.Model(m.projection, m.vectors[::-1].copy(), m.labels[::-1].copy(), m.share)
    assert quality_classifier.vote(turned, x[:1])[0] == pytest.approx(got, abs=1e-6)


def test_ftrl_is_sparse_and_learns():
    m, r = toxicity.Ftrl(), np.random.default_rng(0)
    for _ in range(600):
        y = int(r.random() < 0.3)
        noise = r.integers(100, 1 << toxicity.BITS, 30)
        m.learn(np.unique(np.append(noise, 7) if y else noise), y)
    at, w, bias = m.model()
    assert 7 in at and w[list(at).index(7)] > 1 and bias < 0 and len(at) < 50


def test_neighbours_are_exact():
    r = np.random.default_rng(1)
    x = r.random((300, quality_classifier.TERMS)).astype(np.float32)
    y = (r.random(300) < 0.5).astype(np.float32)
    m = quality_classifier.fit(x, y)
    got = quality_classifier.vote(m, x[:40] + 0.01)
    z = quality_classifier.unit((x[:40] + np.float32(0.01)) @ m.projection)
    sim = z @ m.vectors.T
    for k in range(40):
        near = np.argsort(-sim[k])[: quality_classifier.NEIGHBOURS]
        w = np.maximum(sim[k][near].astype(float), 0) ** quality_classifier.POWER + 1e-9
        assert got[k] == pytest.approx((w * y[near]).sum() / w.sum(), abs=1e-4)


def test_features_do_not_cross_texts():
    s = tk.one_slice(["a b", "c", "", "d e f"])
    _, row = toxicity.features(s)
    assert np.bincount(row, minlength=4).tolist() == [3, 1, 0, 6]
