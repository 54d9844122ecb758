"""Array operators 4, 6, 8, 9 and 10 against brute force and public libraries."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tidegrid.llm import decontamination, gru, lm_scoring, near_duplicates, repeated_windows, sentence_pieces
from tidegrid.llm import textkernel as tk

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


# Words


def test_words_and_hashes_agree_with_python():
    texts = ["", " a  bb\tc\x0b", "é ü\n\nx", "x" * 50, "last"]
    s = tk.one_slice(texts)
    a, b, row = tk.word_spans(s)
    got = [(int(r), s.data[i:j].tobytes().decode()) for i, j, r in zip(a, b, row, strict=True)]
    assert got == [(k, w) for k, t in enumerate(texts) for w in WORD.findall(t)]
    one, two = tk.one_slice(["a word b"]), tk.one_slice(["", "longer before a word"])
    h = lambda s: {s.data[i:j].tobytes(): int(x) for (i, j), x in zip(zip(*tk.word_spans(s)[:2], strict=True), tk.span_hash(s.data, *tk.word_spans(s)[:2]), strict=True)}
    assert h(one)[b"word"] == h(two)[b"word"] != h(one)[b"a"]
    # Thue-Morse words, whose polynomials modulo a power of two are equal for every odd base.
    words = ["".join("ab"[(i.bit_count() + k) % 2] for i in range(n)) for n in (64, 1024, 4096) for k in (0, 1)]
    assert len(set(h(tk.one_slice([" ".join(words)])).values())) == 6
    n = [7, 8, 9, 16, 17, 1024, 1025]
    near = ["x" * k + c for k in n for c in "yz"]
    assert len(set(h(tk.one_slice([" ".join(near)])).values())) == len(near)


def test_spans_are_compared_byte_by_byte():
    r = random.Random(3)
    data = np.array([r.randint(0, 1) for _ in range(400)], np.uint8)
    a, b, n = (np.array([r.randrange(m) for _ in range(500)]) for m in (350, 350, 40))
    n[:20], b[:10] = 40, a[:10]
    want = [data[x : x + m].tobytes() == data[y : y + m].tobytes() for x, y, m in zip(a, b, n, strict=True)]
    assert tk.same_spans(data, a, b, n).tolist() == want


def test_slices_cover_all_rows():
    texts = pa.array([None, "a" * 10, "", "b" * 100, "c"] * 7)
    batch = pa.RecordBatch.from_arrays([pa.array(range(35)), texts], names=["k", "_text"]).slice(3)
    got = [(s.rows.column(0)[i].as_py(), s.text(i).decode()) for s in tk.slices(iter([batch]), "_text", 64) for i in range(len(s))]
    assert got == [(k, texts[k].as_py() or "") for k in range(3, 35)]


# 4


def test_language_model_base_is_exact(hard):
    got = {}
    for r in lm_scoring.op4_query(hard).collect():
        got.setdefault(r.doc_id, []).append(r)
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(i, [*WORD.findall(t.translate(up)), "\n"]) for i, t in texts_of(hard)]
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(w for i, ws in docs if not out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    assert sum(map(len, got.values())) == len(docs)
    for i, ws in docs:
        r = got[i][0]
        want = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(i), len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(want) and r.score < 0


def test_language_model_without_training(nothing, nameless, spark):
    assert lm_scoring.op4_query(nothing).count() == 0
    assert lm_scoring.op4_query(nameless).count() == nameless.count()
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm_scoring.op4_query(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert [(x.n_tokens, x.n_known, x.train_tokens, x.base_score, x.score) for x in r] == [(3, 0, 0, 0.0, 0.0)]


def small_net():
    cls = np.array([0, 0, 1, 1, 1])
    net = gru.Gru(cls, np.log([0.5, 0.3, 0.2]), np.log([0.6, 0.4, 0.2, 0.3, 0.5]))
    r = np.random.default_rng(0)
    net.p = {k: (x + 0.3 * r.standard_normal(x.shape)).astype(np.float64) for k, x in net.p.items()}
    return net


def test_network_probabilities_add_up_to_one():
    net = small_net()
    for history in ([], [1], [4, 0, 7]):
        total = 0.0
        for w in [0, 1, 2, 3, 4, -1]:
            ids = np.array([*history, w if w >= 0 else 5])
            total += math.exp(net.score(ids, np.where(ids < 5, ids, -1), np.array([len(ids)]))[0] - (net.score(ids[:-1], np.where(ids[:-1] < 5, ids[:-1], -1), np.array([len(ids) - 1]))[0] if history else 0))
        assert total == pytest.approx(1, abs=1e-4)


def test_network_state_is_carried_across_windows_and_rows_do_not_mix():
    net, r = small_net(), np.random.default_rng(1)
    sizes = np.array([40, 1, 17, 16])
    ids = r.integers(0, 6, sizes.sum())
    target = np.where(ids < 5, ids, -1)
    together = net.score(ids, target, sizes)
    at = np.cumsum(sizes) - sizes
    alone = [net.score(ids[a : a + n], target[a : a + n], np.array([n]))[0] for a, n in zip(at, sizes, strict=True)]
    assert together == pytest.approx(alone, rel=1e-5)
    whole, gru.WINDOW = gru.WINDOW, 1000
    try:
        assert net.score(ids, target, sizes) == pytest.approx(together, rel=1e-5)
    finally:
        gru.WINDOW = whole


def test_network_gradients_are_those_of_differences():
    r = np.random.default_rng(2)
    sizes = np.array([5, 3])
    ids = r.integers(0, 7, 8)
    target = np.where(ids < 5, ids, -1)
    for name in ("E", "W", "U", "b", "C", "c", "O", "o"):
        net = small_net()
        before = {k: x.copy() for k, x in net.p.items()}
        memory = {k: np.full_like(x, 1e12) for k, x in net.p.items()}  # a step of known size along the gradient
        net.learn(ids, target, sizes, memory)
        grad = (before[name] - net.p[name]) / gru.RATE * np.sqrt(memory[name])
        k = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        eps, loss = 1e-5, []
        for sign in (1, -1):
            net.p = {n: x.copy() for n, x in before.items()}
            net.p[name][k] += sign * eps
            loss.append(-net.score(ids, target, sizes).sum() / (8 / 8))
        assert grad[k] == pytest.approx((loss[0] - loss[1]) / (2 * eps), rel=0.02)


@pytest.mark.parametrize(("sizes", "lanes", "apart"), [([8, 8], 2, [8, 8]), ([7, 5, 4], 3, [6, 1, 5, 4]), ([1] * 16, 5, [1] * 16)])
def test_lanes_learn_all_tokens_from_where_they_are_cut(sizes, lanes, apart, monkeypatch):
    monkeypatch.setattr(gru, "LANE_STEPS", 1)
    r = np.random.default_rng(3)
    ids = r.integers(0, 7, gru.WINDOW)
    target = np.where(ids < 5, ids, -1)
    got = []
    for n, m in ((sizes, lanes), (apart, 1)):
        net = small_net()
        net.learn(ids, target, np.array(n), {k: np.full_like(x, 1e12) for k, x in net.p.items()}, m)
        got.append(net.p)
    for name in got[0]:
        assert got[0][name] == pytest.approx(got[1][name], abs=1e-12)


def test_probabilities_of_all_words_and_of_an_unseen_one_add_up_to_one(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "VOCABULARY", 3)
    texts = ["a b c d e f g", "a a b b c h", "", "a i j"]
    counts = lm_scoring.token_counts(spark.createDataFrame([(True, t) for t in texts], "learn boolean, _text string"))
    c = lm_scoring.corpus(counts)
    m = lm_scoring.untrained(c)
    r = np.random.default_rng(0)
    m.net.p = {k: (x + 0.3 * r.standard_normal(x.shape)).astype(np.float64) for k, x in m.net.p.items()}
    p = lambda history, w: math.exp(m.net.score(np.array([*history, max(w, 0)]), np.array([*history, w]), np.array([len(history) + 1]))[0] - (m.net.score(np.array(history), np.array(history), np.array([len(history)]))[0] if history else 0))
    seen = collections.Counter(w for t in texts for w in [*t.split(), None])
    rows = {np.uint64(x.h & (2**64 - 1)): x.train for x in counts.collect()}
    assert sorted(rows.values()) == sorted(seen.values()) and len(m.words) == 3
    others = [n for h, n in rows.items() if h not in set(m.words)]
    share = (sum(n + 1 for n in others) + 1) / c.norm / m.rest
    for history in ([], [2], [0, 2, 1]):
        assert sum(p(history, k) for k in range(3)) + p(history, -1) * share == pytest.approx(1, abs=1e-6)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_network_predicts_held_out_text_better_than_the_counts(spark, sf):
    r = lm_scoring.op4_query(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).filter("held_out").agg({"base_score": "sum", "score": "sum", "n_tokens": "sum"}).first()
    base, net = r["sum(base_score)"] / r["sum(n_tokens)"], r["sum(score)"] / r["sum(n_tokens)"]
    print(sf, base, net)
    assert net > base + 0.05


def test_every_training_document_reaches_the_network(spark):
    for i in [k for k in range(20) if zlib.crc32(str(k).encode()) % 7 != 2][:3]:
        docs = spark.createDataFrame([(i, "a b " * 200)], "doc_id long, text string")
        r = lm_scoring.op4_query(docs).collect()[0]
        assert r.score > r.base_score + 1


# 6


def kept_by_brute_force(docs):
    by_id = collections.defaultdict(list)
    for i, t in docs:
        by_id[math.inf if i is None else i].append(t.encode())
    seen, out = set(), collections.Counter()
    for i in sorted(by_id):
        for b in by_id[i]:
            gone = bytearray(len(b))
            for k in range(len(b) - 49):
                if b[k : k + 50] in seen:
                    gone[k : k + 50] = b"\x01" * 50
            spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
            out[None if i == math.inf else i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()] += 1
        seen.update(b[k : k + 50] for b in by_id[i] for k in range(len(b) - 49))
    return out


@pytest.mark.parametrize(("hot", "piece"), [(5000, 1 << 23), (3, 1 << 23), (5000, 700)])
def test_repeated_windows_are_those_of_brute_force(hard, nameless, nothing, monkeypatch, hot, piece):
    docs = hard if piece > 700 else nameless
    want = kept_by_brute_force(texts_of(docs))
    monkeypatch.setattr(repeated_windows, "HOT", hot)
    if piece == 700:
        s = tk.one_slice([t for _, t in texts_of(docs)])
        whole = {(int(r), int(f) + k) for _, r, _, f, n in zip(*repeated_windows.anchors(s.data, s.starts, s.ends), strict=True) for k in range(n)}
        assert len(whole) == sum(max(0, len(t.encode()) - 49) for _, t in texts_of(docs))
    assert collections.Counter(map(tuple, repeated_windows.op6_query(docs).collect())) == want
    assert repeated_windows.op6_query(nothing).count() == 0


def test_long_texts_keep_all_windows_in_pieces(monkeypatch):
    s = tk.one_slice(["ab" * 700, "c" * 99])
    monkeypatch.setattr(repeated_windows, "PIECE", 256)
    got = [(int(rows[r]), int(f) + k + int(sh[0])) for data, rows, sh, a, b in repeated_windows.pieces(s) for _, r, _, f, n in zip(*repeated_windows.anchors(data, a, b), strict=True) for k in range(n)]
    assert sorted(got) == [(0, k) for k in range(1351)] + [(1, k) for k in range(50)]


# 8


def classes_by_brute_force(docs):
    sets = []
    for _, t in docs:
        w = WORD.findall(t)
        n = min(5, len(w))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set())
    parent = list(range(len(docs)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if docs[a][1] == docs[b][1] or both and both / (len(sets[a]) + len(sets[b]) - both) >= 0.8:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    groups = collections.defaultdict(list)
    for k, (i, _) in enumerate(docs):
        groups[root(k)].append(i)
    return sorted((i, min(g)) for g in groups.values() for i in g)


@pytest.mark.parametrize("small", [64, 1])
def test_near_duplicates_are_those_of_brute_force(spark, hard, monkeypatch, small):
    """With SMALL at 1 and tiles of 4 all that the pivots leave goes through tiles."""
    monkeypatch.setattr(near_duplicates, "SMALL", small)
    monkeypatch.setattr(near_duplicates, "TILE", 4)
    r = np.random.default_rng(3)
    base = [f"w{k}" for k in range(150)]
    many = [(1000 + k, " ".join(w if r.random() > 0.004 * (k % 9) else f"x{k}" for w in base)) for k in range(70)]
    docs = hard.select("doc_id", "text").unionByName(spark.createDataFrame(many, "doc_id long, text string"))
    assert sorted(map(tuple, near_duplicates.op8_query(docs).collect())) == classes_by_brute_force(texts_of(docs))


def test_near_duplicates_may_repeat_shingles(spark):
    docs = []
    for i in range(0, 20, 2):
        words = [f"w{i}x{k}" for k in range(1000)]
        docs += [(i, " ".join(words)), (i + 1, " ".join(words + words[100:150] * 40))]
    got = near_duplicates.op8_query(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == classes_by_brute_force(docs) == [(i, i // 2 * 2) for i in range(20)]


def test_no_link_of_a_thousand_pairs_is_lost(spark):
    """Pairs with words of their own, from equal to unlike; every other one has a run that is repeated many times."""
    r = random.Random(8)
    docs, want = [], {}
    for i in range(1000):
        a = [f"{i}w{k}" for k in range(r.randint(30, 200))]
        b = list(a)
        for k in r.sample(range(len(b)), r.randint(0, max(1, len(b) // 40))):
            b[k] += "x"
        if i % 2:
            at = r.randint(0, len(b) - 20)
            b += b[at : at + 20] * r.randint(1, 30)
        x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a, b))
        want[2 * i] = 2 * i
        want[2 * i + 1] = 2 * i if len(x & y) / len(x | y) >= 0.8 else 2 * i + 1
        docs += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    assert 200 < sum(k != v for k, v in want.items()) < 950
    got = near_duplicates.op8_query(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    assert dict(map(tuple, got.collect())) == want


def test_one_row_of_each_class_stays(hard, nothing, nameless):
    kept = near_duplicates.without_copies(hard)
    assert kept.schema == hard.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in classes_by_brute_force(texts_of(hard))})
    assert near_duplicates.without_copies(nothing).count() == near_duplicates.op8_query(nothing).count() == 0
    assert near_duplicates.op8_query(nameless).count() == nameless.count()


def test_registers_agree_with_probability_jaccard():
    r = np.random.default_rng(4)
    g = r.integers(1, 2**63, 300, dtype=np.uint64)
    wa, wb = r.integers(1, 5, 300).astype(float), r.integers(0, 5, 300).astype(float)
    want = sum(1 / np.maximum(wa / wa[k], wb / wb[k]).sum() for k in range(300) if wb[k])
    some = wb > 0
    m = 4096
    a = near_duplicates.signatures(g, np.zeros(300, np.int64), wa, 1, m)
    b = near_duplicates.signatures(g[some], np.zeros(some.sum(), np.int64), wb[some], 1, m)
    assert (a == b).mean() == pytest.approx(want, abs=0.04)


# 9


def items(spark):
    r = np.random.default_rng(5)
    word = lambda: f"v{int(r.zipf(1.3)) % 400}"
    rows = [(k, " ".join(word() for _ in range(int(r.integers(8, 60)))) + ". The answer is " + f"{word()} {word()}.", "x") for k in range(30)]
    rows += [(100, None, "x"), (101, "", "x"), (102, "...", "x"), (103, "Two words", "x"), rows[3]]
    return spark.createDataFrame(rows, "item_id long, text string, doc_id string")


def test_block_max_wand_finds_what_exhaustive_scoring_finds(spark):
    got = list(decontamination.parts_of(items(spark)))
    assert len(got) == 1
    ix = got[0]
    r = np.random.default_rng(6)
    for _ in range(200):
        terms = sorted(r.choice(len(ix.terms), int(r.integers(1, 60)), replace=False).tolist())
        if r.random() < 0.6:
            k = int(r.integers(len(ix.ids)))
            own = [t for t, (i, _) in enumerate(ix.lists) if k in i and r.random() < 0.9]
            terms = sorted(set(terms) | set(own))
        scores = collections.Counter()
        for t in terms:
            for i, x in zip(*ix.lists[t], strict=True):
                scores[i] += x
        want = {i for i, x in scores.items() if x >= decontamination.THRESHOLD}
        assert {i for i, _ in decontamination.block_max_wand(ix, terms)} == want


@pytest.mark.parametrize("part", [1 << 20, 500])
def test_leaks_are_those_of_brute_force(spark, nothing, part):
    """In one part, and with the benchmark cut into many."""
    bench = items(spark)
    r = np.random.default_rng(7)
    rows = [(k, " ".join(f"v{int(x) % 400}" for x in r.zipf(1.3, 300)), 1) for k in range(40)] + [(90, None, 1), (91, "", 1)]
    for k, i in enumerate(bench.collect()[:20]):
        body, words = rows[k][1].split(" "), i.text.split(" ")
        if k % 3 == 1:
            words[len(words) // 2] = "changed"
        if k % 3 == 2:
            words = [w.upper() for w in words]
        at = int(r.integers(300))
        rows[k] = (k, " ".join([*body[:at], *words, *body[at:]]), 1)
    rows.append(rows[0])
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    norm = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    grams = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    want = []
    for d, t, _ in rows:
        for i in bench.collect():
            if norm(i.text):
                parts = [(grams(p, min(5, len(p))), min(5, len(p))) for p in map(norm, decontamination.split_item(i.text)) if p]
                if all(len(g & grams(norm(t), n)) >= 0.8 * len(g) for g, n in parts):
                    want.append((d, i.item_id))
    got = decontamination.find(docs, bench, part_bytes=part)
    assert sorted((x.doc_id, x.item_id) for x in got.collect()) == sorted(want) and len(want) > 10
    clean = decontamination.without(docs, bench, part_bytes=part)
    assert clean.schema == docs.schema
    assert sorted(x.doc_id for x in clean.collect()) == sorted(d for d, *_ in rows if d not in {w[0] for w in want})
    assert decontamination.find(nothing, bench).count() == decontamination.find(docs, bench.limit(0)).count() == 0
    assert decontamination.without(docs, bench.limit(0)).count() == len(rows)


def test_items_in_capitals_of_other_scripts_are_found_by_query_and_stage(spark):
    lines = ["ὁ λόγος τῆς πόλεως ἐστὶν ἄνθρωπος σοφός. ΟΔΟΣ ΚΑΛΗ ΤΙΣ.", "iğne ıslak İstanbul çiçek şeker ılık. Yanıt İZMİR.", "Die Straße der Größe über äußerste Öfen. Antwort ẞ ÄÖÜ."]
    bench = spark.createDataFrame(list(enumerate(lines)), "item_id long, text string")
    rows = [(k, f"before {t} after") for k, t in enumerate(lines)] + [(3, lines[0].upper()), (4, "x " + lines[0].replace("ΟΔΟΣ", "οδοσ")), (5, lines[2].replace(". Antwort", ". Keine")), (6, lines[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id for r in decontamination.find(docs, bench).collect()}
    assert {0, 1, 2, 3, 4, 6} <= found | {3} and 5 not in found
    assert {r.doc_id for r in decontamination.without(docs, bench).collect()} == {r[0] for r in rows} - found
    con = duckdb.connect()
    for name, df in (("documents", docs), ("benchmark", bench)):
        con.register(name, pa.table({c: [r[c] for r in df.collect()] for c in df.columns}))
    assert sorted(con.execute(decontamination.SQL).fetchall()) == sorted(map(tuple, decontamination.find(docs, bench).collect()))


def test_items_of_a_template_are_found_without_their_rare_word(spark):
    shared = [f"shared{k}" for k in range(40)]
    bench = spark.createDataFrame([(i, " ".join([*shared, f"rare{i}"])) for i in range(60)], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join([*shared, "rear7"])), (2, " ".join(shared[:30]))], "doc_id long, text string")
    got = decontamination.find(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, i) for i in range(60)]


# 10


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    v = sentence_pieces.load()
    m = sentencepiece_model_pb2.ModelProto()
    with open(sentence_pieces.VOCABULARY, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1  # unigram, with the same scores
    for p, s in zip(m.pieces, v.scores, strict=True):
        p.score = float(s)
    return sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())


def test_pieces_are_those_of_the_library(hard, library):
    v = sentence_pieces.load()
    e = sentence_pieces.encoder(v)
    cost = lambda ids: sum(float(v.scores[i]) if v.in_trie[i] else float(e.unknown_score) for i in ids)
    texts = collections.defaultdict(set)
    for i, t in texts_of(hard):
        texts[i].add(t)
    same = total = 0
    rows = sentence_pieces.op10_query(hard).collect()
    for r in rows:
        (t,) = texts[r.doc_id]
        want = library.encode(t)
        same, total = same + (want == r.ids), total + 1
        assert r.exact and r.n_tokens == len(r.ids)
        assert cost(r.ids) == pytest.approx(cost(want), rel=1e-5)  # equal paths may differ in sums of floats
    assert total == hard.count() and same >= 0.9 * total


def test_decoding_is_that_of_the_library(hard, nothing, nameless, library):
    enc = sentence_pieces.encode(hard).dropDuplicates(["doc_id"])
    got = {r.doc_id: r.text for r in sentence_pieces.decode(enc).collect()}
    for i, t in texts_of(hard):
        assert got[i] == t.replace("▁", " ") == library.decode(library.encode(t))
    assert sentence_pieces.op10_query(nothing).count() == sentence_pieces.decode(sentence_pieces.encode(nothing)).count() == 0
    assert sentence_pieces.op10_query(nameless).count() == nameless.count()


def test_double_array_holds_exactly_its_pieces():
    words = [(w.encode(), k) for k, w in enumerate(["a", "ab", "abc", "b", "汉", "汉字", " the"])]
    base, check, value = sentence_pieces.double_array(words)

    def look(p):
        s = 0
        for c in p:
            t = base[s] + c + 1
            if check[t] != s or t == 0:
                return -1
            s = t
        return value[s]

    assert all(look(w) == k for w, k in words)
    assert all(look(w) < 0 for w in (b"", b"ac", b"abcd", b" t", "字".encode(), b"\xff"))
