"""Language-model scores of whole documents: counts over the corpus and a gated recurrent network.

Method. Tokens are words (runs of other than blanks, A-Z in lower case) and one end per document, named by
64-bit hash. Of every token the corpus is counted in full: how often the training documents have it,
and how often all documents do.
1. Counts by token, combined per task before they are exchanged. Tokens frequent in all documents, at most
   TOP of them, are broadcast with their training counts; the VOCABULARY most frequent of those in training
   have a place of their own in the network, in classes of about equal weight.
2. The network (`gru`) is trained by truncated backpropagation on every training document, once. Workers start
   alike, train on their own documents and are averaged, weighted by their tokens, in rounds whose number grows
   with the logarithm of the corpus, ROUNDS at least.
3. One pass scores all documents: the network runs over whole documents, its state carried from window to
   window, and frequent tokens add their counts. All other tokens are sent by bucket of their hash, ten bytes
   each, to be counted there, and their sums come back to their documents.

The network's last class stands for all tokens without a place; within it a token has its share of the
smoothed counts, unseen tokens sharing one more. So the probabilities of all tokens add up to 1.

Defined cases: null and empty texts are an end alone; a null key counts as an empty text in the fold;
without training documents the score is the base score; repeated rows are scored row by row; an empty table
gives an empty result. Two tokens with one hash would be counted as one (chance under 1e-5 for 1e7 tokens).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm import gru
from tidegrid.llm import textkernel as tk
from tidegrid.llm.labelled import fold
from tidegrid.session import materialize

FOLDS, HELD_OUT = 7, 2
TOP = 1 << 18
VOCABULARY, CLASSES = 4096, 48
ROUNDS = 2
DOCS_PER_WORKER, MOST_WORKERS, SUMS = 3000, 4096, 32
TOKENS_PER_BUCKET = 1_500_000
#: Texts of so many bytes run through the network together.
TOGETHER = 16 << 20
END = np.uint64(1)
FLUSH = 1_500_000


@dataclass
class Tokens:
    """hashes and last bytes of a slice's tokens, row after row; sizes: tokens of each row."""

    hashes: np.ndarray
    tails: np.ndarray
    sizes: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)


def tokens(s: tk.Slice) -> Tokens:
    data = tk.lower(s.data)
    a, b, row = tk.word_spans(s)
    h = tk.span_hash(data, a, b)
    n = np.bincount(row, minlength=len(s))
    at = np.cumsum(n)
    return Tokens(np.insert(h, at, END), np.insert((data[b - 1] & (gru.RARE_INPUTS - 1)).astype(np.int32), at, 0), n + 1)


def token_counts(docs: DataFrame) -> DataFrame:
    """h, train, every: occurrences of each token. docs: learn (boolean), _text."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def combined():
            h, t, e = (np.concatenate(x) for x in zip(*held, strict=True))
            u, at = np.unique(h, return_inverse=True)
            return u, np.bincount(at, weights=t, minlength=len(u)), np.bincount(at, weights=e, minlength=len(u))

        def out():
            u, t, e = combined()
            for x in range(0, len(u), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(u[x : x + 200_000].view(np.int64)), pa.array(t[x : x + 200_000].astype(np.int64)), pa.array(e[x : x + 200_000].astype(np.int64))], names=["h", "train", "every"])

        for s in tk.slices(batches, "_text"):
            k = tokens(s)
            learn = s.rows.column(0).to_numpy(zero_copy_only=False).astype(np.float64)
            u, at = np.unique(k.hashes, return_inverse=True)
            held.append((u, np.bincount(at, weights=learn[k.rows], minlength=len(u)), np.bincount(at, minlength=len(u)).astype(np.float64)))
            size += len(u)
            if size > FLUSH:
                u, t, e = combined()
                held, size = [(u, t, e)], len(u)
                if size > FLUSH // 2:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    rows = docs.select("learn", "_text").mapInArrow(run, "h bigint, train bigint, every bigint")
    return rows.groupBy("h").agg(F.sum("train").alias("train"), F.sum("every").alias("every"))


@dataclass
class Corpus:
    """n, v: tokens and different tokens in training; top: sorted hashes with their training counts."""

    n: int
    v: int
    every: int
    top: np.ndarray
    counts: np.ndarray

    @property
    def norm(self) -> float:
        return float(self.n + self.v + 1)


def corpus(counts: DataFrame, top: int = TOP) -> Corpus:
    """What all tasks need to know. The histogram of counts gives the least count with at most `top` tokens above."""
    n, v, every = counts.agg(F.sum("train"), F.count_if(F.col("train") > 0), F.sum("every")).first()
    least, have = 1, 0
    # Each count has one token at least, so the first `top` counts are enough.
    for c, k in map(tuple, counts.groupBy("every").count().filter("every > 1").orderBy(F.desc("every")).limit(top + 1).collect()):
        if have + k > top:
            least = c + 1
            break
        have, least = have + k, c
    got = counts.filter(F.col("every") >= max(2, least)).select("h", "train").toArrow()
    h, c = got.column("h").to_numpy().view(np.uint64), got.column("train").to_numpy()
    order = np.argsort(h)
    return Corpus(int(n or 0), int(v or 0), int(every or 0), h[order], c[order])


@dataclass
class Model:
    """net; words: sorted hashes with their places; rest: probability mass of tokens without a place under the base."""

    net: gru.Gru
    words: np.ndarray
    places: np.ndarray
    rest: float

    def ids(self, k: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Inputs and targets of tokens."""
        if not len(self.words):
            return k.tails.astype(np.int32), np.full(len(k.hashes), -1, np.int32)
        at = np.minimum(np.searchsorted(self.words, k.hashes), len(self.words) - 1)
        own = self.words[at] == k.hashes
        target = np.where(own, self.places[at], -1).astype(np.int32)
        return np.where(own, target, len(self.words) + k.tails).astype(np.int32), target


def untrained(c: Corpus) -> Model:
    """The network before training: exactly the smoothed counts."""
    best = np.lexsort((c.top, -c.counts))[:VOCABULARY]
    best = best[c.counts[best] > 0]
    words, counts = c.top[best], c.counts[best] + 1.0
    part = np.cumsum(np.sqrt(counts))
    cls = np.unique(np.minimum((part / part[-1] * CLASSES).astype(np.int64), CLASSES - 1), return_inverse=True)[1] if len(words) else np.empty(0, np.int64)
    rest = max(c.norm - counts.sum(), 1.0)
    mass = np.append(np.bincount(cls, weights=counts), rest) if len(words) else np.array([rest])
    order = np.argsort(words)
    return Model(gru.Gru(cls, np.log(mass / mass.sum()), np.log(counts / mass[cls]) if len(words) else np.empty(0)), words[order], order.astype(np.int32), rest / c.norm)


def train(docs: DataFrame, m: Model) -> Model:
    """docs: pick (a hash of the key), _text; training documents only, all of which are learned from."""
    n = docs.count()
    rounds = max(ROUNDS, math.ceil(math.log2(1 + n / DOCS_PER_WORKER)))
    workers = min(MOST_WORKERS, max(1, n // (DOCS_PER_WORKER * rounds)))
    some = docs.withColumn("turn", F.pmod(F.shiftright("pick", 16), F.lit(rounds)))
    for turn in range(rounds):

        def run(batches, m=m):
            memory: dict = {}
            total = size = 0
            net = m.net
            held: list = []

            def learned():
                inputs, targets, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
                net.learn(inputs, targets, sizes, memory)
                held.clear()
                return len(inputs)

            for s in tk.slices(batches, "_text"):
                k = tokens(s)
                held.append((*m.ids(k), k.sizes))
                size += len(s.data)
                if size >= TOGETHER:
                    total, size = total + learned(), 0
            if held:
                total += learned()
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([float(total)]), pa.array([np.concatenate([p.ravel() for p in net.p.values()]).astype(np.float32).tobytes()], pa.binary())], names=["worker", "weight", "net"])

        def mean(t: pa.Table) -> pa.Table:
            w, total = 0.0, None
            for x, p in zip(t.column("weight").to_pylist(), t.column("net"), strict=True):
                v = np.frombuffer(p.as_buffer(), np.float32).astype(np.float64) * x
                w, total = w + x, v if total is None else total + v
            return pa.table({"weight": [w], "net": pa.array([(total / w).astype(np.float32).tobytes()], pa.binary())})

        # Equal rows keep their order: a lost worker learns the same again.
        mine = some.filter(F.col("turn") == turn).repartition(workers, "pick").sortWithinPartitions("pick", "_text").select("_text")
        nets = mine.mapInArrow(run, "worker int, weight double, net binary")
        nets = nets.groupBy(F.col("worker") % SUMS).applyInArrow(lambda t: mean(t), "weight double, net binary").collect()
        if nets:
            got = mean(pa.table({"weight": [r[0] for r in nets], "net": pa.array([bytes(r[1]) for r in nets], pa.binary())}))
            flat, x = np.frombuffer(got.column("net")[0].as_buffer(), np.float32), 0
            for name, p in m.net.p.items():
                m.net.p[name] = flat[x : x + p.size].reshape(p.shape).copy()
                x += p.size
    return m


_PASS = "sid bigint, idx int, key {}, held_out boolean, n_tokens bigint, n_known bigint, logs double, own double, net double, n_rest bigint, bucket bigint, hashes binary, docs binary"
_LEARN = np.uint16(1 << 15)


def _first_pass(docs: DataFrame, c: Corpus, m: Model, buckets: int, key: str) -> DataFrame:
    """A row per document, and per slice and bucket one with the tokens that are not in `top`."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((c, m))
    kind = docs.schema["key"].dataType.simpleString()
    schema = _PASS.format(kind)

    def run(batches):
        c, m = shared.value
        # A hash's upper bits say where in `top` it would be.
        shift = tk.U64(64 - 16)
        guess = np.searchsorted(c.top, np.arange(1 << 16, dtype=np.uint64) << shift)
        reach = int(np.diff(np.append(guess, len(c.top))).max()) if len(c.top) else 0
        logs = np.log10(c.counts + 1.0)
        turn, pid = 0, TaskContext.get().partitionId()
        held: list = []

        def place(h):
            at = np.full(len(h), -1, np.int64)
            x, todo = guess[h >> shift], np.arange(len(h))
            for k in range(reach):
                y = np.minimum(x[todo] + k, len(c.top) - 1)
                v = c.top[y]
                hit = v == h[todo]
                at[todo[hit]] = y[hit]
                todo = todo[v < h[todo]]
                if not len(todo):
                    break
            return at

        def scored():
            if not held:
                return
            inputs, targets, sizes = (np.concatenate([x[k] for x in held]) for k in (1, 2, 3))
            net = m.net.score(inputs, targets, sizes) if c.n else np.zeros(len(sizes))
            x = 0
            for sid, _, _, sizes, rows, known, sums, rest in held:
                n = len(sizes)
                yield batch({"sid": np.full(n, sid), "idx": np.arange(n, dtype=np.int32), "key": rows.column(0), "held_out": rows.column(1), "n_tokens": sizes.astype(np.int64), "n_known": known, "logs": sums[:, 0], "own": sums[:, 1], "net": net[x : x + n], "n_rest": rest}, n)
                x += n
            held.clear()

        def batch(cols, n):
            whole = lambda f: cols[f.name] if isinstance(cols[f.name], pa.Array) else pa.array(cols[f.name], f.type)
            return pa.RecordBatch.from_arrays([whole(f) if f.name in cols else pa.nulls(n, f.type) for f in fields], names=[f.name for f in fields])

        fields = None
        size = 0
        for s in tk.slices(batches, "_text"):
            if fields is None:
                types = [pa.int64(), pa.int32(), s.rows.column(0).type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                fields = [pa.field(x.split()[0], t) for x, t in zip(schema.split(", "), types, strict=True)]
            sid, turn = (pid << 32) | turn, turn + 1
            k = tokens(s)
            rows = k.rows
            inputs, targets = m.ids(k)
            at = place(k.hashes)
            found = at >= 0
            n = len(s)
            sums = np.bincount(rows[found], weights=logs[at[found]], minlength=n)
            known = np.bincount(rows[found][c.counts[at[found]] > 0], minlength=n)
            # Of tokens without a place of their own: how many there are, and their logs under `top`.
            no_place = targets < 0
            rest = np.bincount(rows[no_place], minlength=n)
            placed = found & ~no_place
            own = np.bincount(rows[placed], weights=logs[at[placed]], minlength=n)
            held.append((sid, inputs, targets, k.sizes, s.rows, known.astype(np.int64), np.stack([sums, own], 1), rest.astype(np.int64)))
            far = np.flatnonzero(~found)
            h = k.hashes[far]
            learn = ~s.rows.column(1).to_numpy(zero_copy_only=False)
            d = rows[far].astype(np.uint16) | np.where(learn[rows[far]], _LEARN, np.uint16(0))
            b = (((h >> tk.U64(32)) * tk.U64(buckets)) >> tk.U64(32)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            h, d, b = h[order], d[order], b[order]
            first, m_ = tk.runs(b)
            if len(first):
                cut = [(x, x + y) for x, y in zip(first.tolist(), m_.tolist(), strict=True)]
                yield batch({"sid": np.full(len(cut), sid), "bucket": b[first], "hashes": [h[x:y].tobytes() for x, y in cut], "docs": [d[x:y].tobytes() for x, y in cut]}, len(cut))
            size += len(s.data)
            if size >= TOGETHER:
                yield from scored()
                size = 0
        yield from scored()

    return docs.select("key", "held_out", "_text").mapInArrow(run, schema)


def _count_bucket(t: pa.Table) -> pa.Table:
    """sid, docs, sums, known: per slice, what the bucket's tokens add to each document."""
    h = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("hashes")]
    d = [np.frombuffer(x.as_buffer(), np.uint16) for x in t.column("docs")]
    size = np.array([len(x) for x in h])
    _, at = np.unique(np.concatenate(h), return_inverse=True)
    doc = np.concatenate(d)
    c = np.bincount(at, weights=(doc & _LEARN) > 0)[at]
    slot = np.repeat(np.arange(len(h)), size)
    key = slot * (1 << 15) + (doc & ~_LEARN).astype(np.int64)
    u, to = np.unique(key, return_inverse=True)
    sums, known = np.bincount(to, weights=np.log10(c + 1)), np.bincount(to, weights=c > 0).astype(np.uint32)
    cut = np.searchsorted(u, np.arange(len(h) + 1) << 15)
    part = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
    return pa.table({"sid": t.column("sid"), "docs": part((u & ((1 << 15) - 1)).astype(np.uint16)), "sums": part(sums), "known": part(known)})


def _sum_slice(t: pa.Table) -> pa.Table:
    """sid, idx, more, more_known."""
    j = lambda n, k: np.concatenate([np.frombuffer(x.as_buffer(), k) for x in t.column(n)])
    d = j("docs", np.uint16)
    u, to = np.unique(d, return_inverse=True)
    return pa.table({"sid": pa.array(np.full(len(u), t.column("sid")[0].as_py(), np.int64)), "idx": pa.array(u.astype(np.int32)), "more": pa.array(np.bincount(to, weights=j("sums", np.float64))), "more_known": pa.array(np.bincount(to, weights=j("known", np.uint32)).astype(np.int64))})


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", of: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score: a row per input row."""
    out = fold(F.col(key), of) == held_out
    d = docs.select(F.col(key).alias("key"), out.alias("held_out"), (~out).alias("learn"), F.xxhash64(F.col(key)).alias("pick"), F.col(text).alias("_text"))
    counts = materialize(token_counts(d), "token-counts")
    c = corpus(counts)
    m = untrained(c)
    if c.n:
        m = train(d.filter("learn"), m)
    buckets = max(1, c.every // TOKENS_PER_BUCKET)
    rows = materialize(_first_pass(d, c, m, buckets, key), "lm-pass")
    more = rows.filter(F.col("bucket").isNotNull()).select("bucket", "sid", "hashes", "docs")
    more = more.groupBy("bucket").applyInArrow(_count_bucket, "sid bigint, docs binary, sums binary, known binary")
    more = more.groupBy("sid").applyInArrow(_sum_slice, "sid bigint, idx int, more double, more_known bigint")
    r = rows.filter(F.col("bucket").isNull()).drop("bucket", "hashes", "docs").join(more, ["sid", "idx"], "left")
    extra, known = F.coalesce("more", F.lit(0.0)), F.coalesce("more_known", F.lit(0))
    norm = float(np.log10(c.norm))
    base = F.col("logs") + extra - F.col("n_tokens") * norm
    # Of the last class: each token's share of the counts of tokens without a place.
    net = F.col("net") / float(np.log(10)) + (F.col("logs") - F.col("own") + extra) - F.col("n_rest") * (norm + float(np.log10(m.rest)))
    return r.select(F.col("key").alias(key), "held_out", "n_tokens", (F.col("n_known") + known).alias("n_known"), F.lit(c.n).cast("bigint").alias("train_tokens"), base.alias("base_score"), (net if c.n else base).alias("score"))


def op4_query(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return score(docs)
