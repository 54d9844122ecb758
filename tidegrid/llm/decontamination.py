"""Benchmark decontamination: training passages that hold test items.

Method. Test items are indexed by BM25 with postings in item order and a maximum per block of
BLOCK items. An item's share is the least part of its score against itself that a passage can have which holds
OVERLAP of its shingles: a shingle that is missing costs a term at most (SHINGLE, where shingles repeat), and
the heaviest are assumed to go. Impacts are divided by that, so that 1 is the threshold of every item and what
verification would accept is always retrieved. Every document is read as overlapping passages, long enough for
any item to lie in one, and each passage is a query. A first look applies the pivot test of WAND to all passages
of a slice at once: frequent terms, chosen so that in no item they reach more than FREQUENT of the threshold
together, are bounded per block, the rest add their block maxima, and a passage without a block that can reach
the threshold needs no query. The others run block-max WAND, which returns all items at or above the threshold.
Those are verified: of the item's question (all but its last sentence) and of its answer (the last) at least
OVERLAP of the different five-word shingles (or the whole, if shorter) must occur in the passage, of each.

Words are runs of letters, digits and characters beyond ASCII, all in lower case by one rule (`lowered`).
Defined cases: null and empty texts hold nothing; items without words are left out; an item of one sentence has
a question alone; repeated rows and items are reported each; texts are read whole, whatever their length, and
need about twenty times their size; other columns are not looked at, and pass unchanged where rows do; an empty
table on either side gives no leaks. Items go to the executors in parts of at most PART_BYTES of text: a larger
benchmark is applied in several passes, with term statistics of the whole.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm import textkernel as tk
from tidegrid.session import materialize

K1, B = 1.2, 0.75
THRESHOLD = 1.0
OVERLAP = 0.8
SHINGLE = 5
FREQUENT = 0.6
BLOCK = 2
STRIDE = 64
PART_BYTES = 8 << 20
#: So many digests of texts that hold an item are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000


def lowered(texts: pa.Array) -> pa.Array:
    """In lower case, characters one by one; the only rule here, for items and documents alike."""
    return pc.utf8_lower(texts)


def words_of(texts: list[str]) -> list[np.ndarray]:
    """Word hashes of each text."""
    s = tk.one_slice(texts)
    a, b, row = tk.word_spans(s, tk.PUNCTUATION)
    h = tk.span_hash(s.data, a, b)
    cut = np.searchsorted(row, np.arange(len(texts) + 1))
    return [h[cut[i] : cut[i + 1]] for i in range(len(texts))]


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: all but the last sentence, and the last; one sentence alone is a question."""
    parts = [m for m in re.finditer(r"[^.!?\n]+[.!?\n]*", text) if re.search(r"\w", m[0])]
    if len(parts) < 2:
        return text, ""
    return text[: parts[-1].start()], text[parts[-1].start() :]


@dataclass
class Index:
    """terms: sorted hashes; lists: by term, item positions and impacts; frequent: bounded rather than added in the first look."""

    ids: list
    terms: np.ndarray
    lists: list[tuple[list[int], list[float]]]
    top: np.ndarray
    block_start: np.ndarray
    block_count: np.ndarray
    block_no: np.ndarray
    block_max: np.ndarray
    frequent: np.ndarray
    bound: np.ndarray
    questions: list[np.ndarray]
    answers: list[np.ndarray]
    shares: list[float]
    stride: int


def may_lack(part: np.ndarray, weight: dict[int, float]) -> float:
    """The most weight that a passage can lack which holds OVERLAP of the part's shingles."""
    n = min(SHINGLE, len(part))
    if not n:
        return 0.0
    g = tk.grams(part, n)
    different = len(np.unique(g))
    lost = different - math.ceil(OVERLAP * different - 1e-9)
    if different < len(g):
        lost *= SHINGLE
    return sum(sorted((weight[t] for t in set(part.tolist())), reverse=True)[:lost])


def build(items: list[tuple[object, str]], df: Counter, n: int, mean: float, longest: int) -> Index:
    """The index of a part of the items, with document frequencies, number and mean length of all."""
    split = [split_item(t) for _, t in items]
    q, a = words_of([x[0] for x in split]), words_of([x[1] for x in split])
    tf = [Counter(np.concatenate([x, y]).tolist()) for x, y in zip(q, a, strict=True)]
    terms = np.array(sorted({t for c in tf for t in c}), np.uint64)
    place = {int(t): k for k, t in enumerate(terms)}
    lists: list[tuple[list[int], list[float]]] = [([], []) for _ in terms]
    shares = []
    for i, c in enumerate(tf):
        size = sum(c.values())
        imp = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * size / mean)) for t, f in c.items()}
        total = sum(imp.values())
        weight = {t: x / total for t, x in imp.items()}
        shares.append(max(1 - may_lack(q[i], weight) - may_lack(a[i], weight) - 1e-9, min(weight.values())))
        for t, x in weight.items():
            lists[place[t]][0].append(i)
            lists[place[t]][1].append(x / shares[i])
    frequent, bound = np.zeros(len(terms), bool), np.zeros(len(items))
    for k in sorted(range(len(terms)), key=lambda k: (-len(lists[k][0]), k)):
        i, x = lists[k]
        if len(i) < 2 or (bound[i] + x).max() > FREQUENT * THRESHOLD:
            break
        bound[i] += x
        frequent[k] = True
    nos, maxima, counts = [], [], []
    for i, x in lists:
        by: dict[int, float] = {}
        for j, y in zip(i, x, strict=True):
            by[j // BLOCK] = max(by.get(j // BLOCK, 0.0), y)
        nos += by.keys()
        maxima += by.values()
        counts.append(len(by))
    blocks = -(-len(items) // BLOCK)
    block_bound = np.array([bound[k * BLOCK : (k + 1) * BLOCK].max() for k in range(blocks)]) if blocks else np.zeros(0)
    counts_ = np.array(counts, np.int64)
    return Index([k for k, _ in items], terms, lists, np.array([max(x) for _, x in lists]), np.cumsum(counts_) - counts_, counts_, np.array(nos, np.int64), np.array(maxima), frequent, block_bound, q, a, shares, max(STRIDE, longest + 8))


def parts_of(benchmark: DataFrame, item: str = "item_id", text: str = "text", part_bytes: int = PART_BYTES) -> Iterator[Index]:
    """Indexes of the items, part by part. Two streams over the items: one counts terms, one builds."""
    rows = benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).filter(F.col("t").isNotNull()).orderBy("i", "t")
    df: Counter = Counter()
    n, total, longest = 0, 0, 0

    def chunks() -> Iterator[list]:
        have, size = [], 0
        for r in rows.toLocalIterator():
            have.append((r[0], lowered(pa.array([r[1]]))[0].as_py()))
            size += len(r[1]) + 64
            if size >= part_bytes:
                yield have
                have, size = [], 0
        if have:
            yield have

    for chunk in chunks():
        for w in words_of([t for _, t in chunk]):
            if len(w):
                n, total, longest = n + 1, total + len(w), max(longest, len(w))
                df.update(np.unique(w).tolist())
    if not n:
        return
    for chunk in chunks():
        some = [x for x, w in zip(chunk, words_of([t for _, t in chunk]), strict=True) if len(w)]
        if some:
            yield build(some, df, n, total / n, longest)


def block_max_wand(ix: Index, terms: list[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
    """All items that score at or above the threshold for a passage with these terms."""
    out = []
    cur = [[ix.lists[t][0][0], t, 0] for t in terms]  # item under the cursor, term, position
    end = 1 << 60

    def move(c: list, to: int) -> None:
        items = ix.lists[c[1]][0]
        while c[2] < len(items) and items[c[2]] < to:
            c[2] += 1
        c[0] = items[c[2]] if c[2] < len(items) else end

    def in_block(t: int, block: int) -> float:
        a, m = int(ix.block_start[t]), int(ix.block_count[t])
        for k in range(a, a + m):
            if ix.block_no[k] >= block:
                return float(ix.block_max[k]) if ix.block_no[k] == block else 0.0
        return 0.0

    while True:
        cur.sort()
        cur = [c for c in cur if c[0] < end]
        bound, pivot = 0.0, -1
        for k, c in enumerate(cur):
            bound += ix.top[c[1]]
            if bound >= threshold - 1e-9:
                pivot = k
                break
        if pivot < 0:
            return out
        item = cur[pivot][0]
        while pivot + 1 < len(cur) and cur[pivot + 1][0] == item:
            pivot += 1
        head = cur[: pivot + 1]
        if sum(in_block(c[1], item // BLOCK) for c in head) >= threshold - 1e-9:
            if cur[0][0] == item:
                score = sum(ix.lists[c[1]][1][c[2]] for c in head)
                if score >= threshold:
                    out.append((item, score))
                for c in head:
                    move(c, item + 1)
            else:
                for c in head:
                    move(c, item)
        else:  # nothing in this block: on to the next, or to the next cursor
            to = (item // BLOCK + 1) * BLOCK
            if pivot + 1 < len(cur):
                to = min(to, cur[pivot + 1][0])
            for c in head:
                move(c, max(to, item + 1))


def overlap(part: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """How many different shingles of the part occur in the passage, and of how many."""
    if not len(part):
        return 0, 0
    n = min(SHINGLE, len(part))
    g = np.unique(tk.grams(part, n))
    return int(np.isin(g, tk.grams(passage, n)).sum()), len(g)


def leaks(ix: Index, s: tk.Slice) -> list[tuple[int, int, float, float, float]]:
    """(row, item position, score, question overlap, answer overlap) for every verified pair of the slice."""
    a, b, row = tk.word_spans(s, tk.PUNCTUATION)
    if not len(a) or not len(ix.terms):
        return []
    h = tk.span_hash(s.data, a, b)
    term = np.searchsorted(ix.terms, h)
    term[term == len(ix.terms)] = 0
    known = ix.terms[term] == h
    first = np.searchsorted(row, np.arange(len(s)))  # of each row's words
    n_words = np.diff(np.append(first, len(row)))
    n_pass = np.maximum(1, -(-n_words // ix.stride) - 1)
    pass_0 = np.cumsum(n_pass) - n_pass
    at = np.flatnonzero(known & ~ix.frequent[term])
    k = (at - first[row[at]]) // ix.stride
    r, t = row[at], term[at]
    own, before = k < n_pass[r], k > 0
    p = np.concatenate([(pass_0[r] + k)[own], (pass_0[r] + k - 1)[before]])
    t = np.concatenate([t[own], t[before]])
    key = np.unique(p * len(ix.terms) + t)
    p, t = key // len(ix.terms), key % len(ix.terms)
    m = ix.block_count[t]
    posting = tk.ragged(ix.block_start[t], m)
    blocks = len(ix.bound)
    key = np.repeat(p, m) * blocks + ix.block_no[posting]
    order = np.argsort(key, kind="stable")
    key = key[order]
    start, _ = tk.runs(key)
    if not len(start):
        return []
    sums = np.add.reduceat(ix.block_max[posting][order], start)
    key = key[start]
    may = np.unique((key // blocks)[sums + ix.bound[key % blocks] >= THRESHOLD - 1e-9])
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    for p_ in may.tolist():
        r_ = int(np.searchsorted(pass_0, p_, side="right")) - 1
        lo = first[r_] + (p_ - pass_0[r_]) * ix.stride
        hi = min(lo + 2 * ix.stride, first[r_] + n_words[r_])
        passage = h[lo:hi]
        for i, score in block_max_wand(ix, np.unique(term[lo:hi][known[lo:hi]]).tolist()):
            (qh, qn), (ah, an) = overlap(ix.questions[i], passage), overlap(ix.answers[i], passage)
            if qh >= OVERLAP * qn and ah >= OVERLAP * an:
                found = (round(score * ix.shares[i], 6), qh / qn if qn else 1.0, ah / an if an else 1.0)
                best[r_, i] = max(best.get((r_, i), found), found)
    return [(r_, i, *x) for (r_, i), x in sorted(best.items())]


def _lower_slices(batches, column: int):
    """Slices of the batches with the text in the given column lower-cased."""
    for batch in batches:
        cols = [lowered(c) if k == column else c for k, c in enumerate(batch.columns)]
        yield from tk.slices(iter([pa.RecordBatch.from_arrays(cols, names=batch.schema.names)]), batch.schema.names[column])


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", part_bytes: int = PART_BYTES) -> DataFrame:
    """key, item, score, question_overlap, answer_overlap: a row per document and test item found in it.

    The score is the passage's, as a share of the item's against itself, to six places; of several passages the best counts.
    """
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    schema = f"_key {kind}, _item {item_kind}, score double, question_overlap double, answer_overlap double"
    found = []

    def runner(ix: Index):
        item_type = pa.array(ix.ids).type

        def run(batches):
            for s in _lower_slices(batches, 1):
                got = leaks(ix, s)
                if got:
                    rows, items, *rest = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays([s.rows.column(0).take(pa.array(rows)), pa.array([ix.ids[i] for i in items], item_type), *[pa.array(x, pa.float64()) for x in rest]], names=["_key", "_item", "score", "question_overlap", "answer_overlap"])

        return run

    for ix in parts_of(benchmark, item, text, part_bytes):
        found.append(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(runner(ix), schema))
    out = functools.reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)
    return out.withColumnsRenamed({"_key": key, "_item": item})


def without(docs: DataFrame, benchmark: DataFrame, text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of docs that hold no test item.

    Only texts go through Python; those with an item come back as digests, and rows that have such a text go.
    """
    mine = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.unhex(F.md5(F.col(text))).alias("id"))

    def runner(ix: Index):
        def run(batches):
            for s in _lower_slices(batches, 1):
                rows = sorted({r for r, *_ in leaks(ix, s)})
                if rows:
                    yield pa.RecordBatch.from_arrays([s.rows.column(0).take(pa.array(rows))], names=["id"])

        return run

    found = [mine.select("id", F.col(f"doc.`{text}`").alias("_text")).mapInArrow(runner(ix), "id binary") for ix in parts_of(benchmark, part_bytes=part_bytes)]
    if not found:
        return docs
    gone = materialize(functools.reduce(DataFrame.unionByName, found).distinct(), "leaks")
    few = gone.count() <= BROADCAST_ROWS
    return mine.join(F.broadcast(gone) if few else gone, "id", "left_anti").select("doc.*")


def op9_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap."""
    return find(docs, benchmark)


def _sql() -> str:
    words = "list_filter(string_split_regex({}, '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x <> '')"
    gram = "array_to_string(w[p + 1 : p + n], ' ')"
    return f"""
    WITH i0 AS (SELECT row_number() OVER () AS i, item_id, lower(text) AS t FROM benchmark WHERE text IS NOT NULL),
    i1 AS (SELECT *, regexp_extract(t, '^[.!?\n]*') AS lead, regexp_extract_all(t, '[^.!?\n]+[.!?\n]*') AS parts FROM i0),
    i2 AS (SELECT *, list_filter(range(1, len(parts) + 1), lambda k: regexp_matches(parts[k], '[\\pL\\pN_]')) AS wordy FROM i1),
    i3 AS (SELECT i, item_id, len(wordy) < 2 AS one, t, lead || array_to_string(parts[1 : wordy[-1] - 1], '') AS q, array_to_string(parts[wordy[-1] :], '') AS a FROM i2),
    part AS (SELECT i, 0 AS side, {words.format("CASE WHEN one THEN t ELSE q END")} AS w FROM i3 UNION ALL SELECT i, 1, {words.format("CASE WHEN one THEN '' ELSE a END")} FROM i3),
    size AS (SELECT i, sum(len(w)) AS size FROM part GROUP BY i HAVING sum(len(w)) > 0),
    tf AS (SELECT i, t, count(*) AS f FROM (SELECT i, unnest(w) AS t FROM part) GROUP BY ALL),
    df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
    st AS (SELECT count(*) AS n, avg(size) AS mean, greatest({STRIDE}, max(size) + 8) AS stride FROM size),
    imp AS (SELECT i, t, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * f * ({K1 + 1}::DOUBLE) / (f + {K1}::DOUBLE * ({1 - B}::DOUBLE + {B}::DOUBLE * size / mean)) AS x FROM tf JOIN df USING (t) JOIN size USING (i), st),
    weight AS (SELECT i, t, x / sum(x) OVER (PARTITION BY i) AS x FROM imp),
    g AS (SELECT DISTINCT i, side, n, {gram} AS g FROM (SELECT i, side, w, least({SHINGLE}, len(w)) AS n, unnest(range(0, len(w) - least({SHINGLE}, len(w)) + 1)) AS p FROM part WHERE len(w) > 0)),
    gs AS (SELECT i, side, count(*) AS total FROM g GROUP BY ALL),
    d AS (SELECT row_number() OVER () AS r, doc_id, {words.format("lower(coalesce(text, ''))")} AS w FROM documents),
    dn AS (SELECT r, doc_id, w, len(w) AS nw, greatest(1, CAST(ceil(len(w) / stride) AS BIGINT) - 1) AS n_pass, stride FROM d, st WHERE len(w) > 0),
    pos AS (SELECT r, n, p, nw, n_pass, stride, {gram} AS g FROM (SELECT *, unnest(range(0, nw - n + 1)) AS p FROM dn, (SELECT DISTINCT n FROM g))),
    hit AS (SELECT r, i, side, n, p, nw, n_pass, stride, g FROM pos JOIN g USING (g, n)),
    inside AS (SELECT r, i, side, g, k FROM (SELECT *, p // stride - back AS k FROM hit, (SELECT unnest([0, 1]) AS back)) WHERE k >= 0 AND k < n_pass AND p + n <= least(nw, k * stride + 2 * stride)),
    hits AS (SELECT r, k, i, count(DISTINCT g) FILTER (side = 0) AS qh, count(DISTINCT g) FILTER (side = 1) AS ah FROM inside GROUP BY ALL),
    ok AS (SELECT r, k, h.i, qh, ah, coalesce(q.total, 0) AS qn, coalesce(a.total, 0) AS an FROM hits h LEFT JOIN gs q ON q.i = h.i AND q.side = 0 LEFT JOIN gs a ON a.i = h.i AND a.side = 1
           WHERE qh >= {OVERLAP}::DOUBLE * coalesce(q.total, 0) AND ah >= {OVERLAP}::DOUBLE * coalesce(a.total, 0)),
    terms AS (SELECT DISTINCT r, k, i, qh, ah, qn, an, unnest(w[k * stride + 1 : k * stride + 2 * stride]) AS t FROM ok JOIN dn USING (r)),
    scored AS (SELECT r, k, i, qh, ah, qn, an, round(sum(x), 6) AS score FROM terms JOIN weight USING (i, t) GROUP BY ALL),
    best AS (SELECT r, i, max({{'score': score, 'q': CASE WHEN qn > 0 THEN qh::DOUBLE / qn ELSE 1 END, 'a': CASE WHEN an > 0 THEN ah::DOUBLE / an ELSE 1 END}}) AS b FROM scored GROUP BY ALL)
    SELECT d.doc_id, i3.item_id, b.score AS score, b.q AS question_overlap, b.a AS answer_overlap FROM best JOIN d USING (r) JOIN i3 USING (i)"""


SQL = _sql()
