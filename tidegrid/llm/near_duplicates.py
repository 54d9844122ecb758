"""Near-duplicate documents by ProbMinHash.

Method. A document is the set of its shingles of SHINGLE words; each different shingle has weight 1, however
often it occurs. Each shingle sends a Poisson process of arrivals, at the rate of its weight, to registers
drawn at random; a register keeps the shingle that came first, and a shingle is done once its next arrival is
later than all registers of the document. With these weights registers agree with the Jaccard similarity of two
sets, by which pairs are verified too. BANDS bands of ROWS registers give buckets. Exact copies are one text
throughout, named by its digest.

Within a bucket each text is compared with the bucket's pivot first, not with every member, and pairs
that are in one class by then add nothing. Members still apart in a bucket of at most SMALL are compared
pair by pair. Larger buckets that share members form a group, which is dealt into hashed blocks of about
TILE; a task compares two blocks by one matrix product over their shared shingles and returns only links
that join classes, so that neither a group nor its pairs are ever in one place. Pairs whose one-bit
registers (`bits`) put them far below the threshold are left out before texts are fetched; all others are
verified by the exact Jaccard similarity of their sets of shingles, at least SIMILARITY. Connected
components of the verified links are the classes.

Words are runs of other than blanks. Defined cases: a null text counts as empty; texts without words are
copies of each other only if equal; a text of under SHINGLE words has one shingle, all of it;
null and repeated keys are rows like others; texts are read whole, whatever their length, and need about twenty
times their size; only key and text are read, and other columns pass unchanged where rows do; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm import textkernel as tk
from tidegrid.llm.components import connected_components
from tidegrid.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 30, 6
#: Least share of equal one-bit registers: 0.9 is expected at the similarity, 0.5 for unlike texts. Of 180 bits a
#: pair at the similarity has fewer with a probability under 1e-8, far below that of sharing no bucket (1e-4).
LEAST_BITS = 0.75
SMALL, TILE = 64, 384
#: Rows whose registers (3 kB each while they are filled) are held at once.
SLICE_ROWS = 8_000
#: So many digests (a few MB) are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000
_STEP = tk.U64(0xD1342543DE82EF95)


def shingles(s: tk.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every shingle of a slice, repeats included."""
    a, b, row = tk.word_spans(s)
    h = tk.span_hash(s.data, a, b)
    g = tk.grams(h, SHINGLE)
    inside = row[: len(g)] == row[SHINGLE - 1 :] if len(g) else np.empty(0, bool)
    out, rows = [g[inside]], [row[: len(g)][inside]]
    n = np.bincount(row, minlength=len(s))
    first = np.cumsum(n) - n
    for k in np.flatnonzero((n > 0) & (n < SHINGLE)).tolist():
        out.append(tk.grams(h[first[k] : first[k] + n[k]], int(n[k])))
        rows.append(np.array([k]))
    return np.concatenate(out), np.concatenate(rows)


def weighted(g: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different shingles, their rows and counts."""
    key = g ^ tk.mix(row.astype(np.uint64) + tk.U64(1))
    s = np.sort(key)
    again = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(again):
        return g, row, np.ones(len(g))
    at = np.minimum(np.searchsorted(again, key), len(again) - 1)
    many = again[at] == key
    _, first, count = np.unique(key[many], return_index=True, return_counts=True)
    some = np.flatnonzero(many)[first]
    one = ~many
    return np.concatenate([g[one], g[some]]), np.concatenate([row[one], row[some]]), np.concatenate([np.ones(int(one.sum())), count])


def signatures(g: np.ndarray, row: np.ndarray, weight: np.ndarray, rows: int, m: int = BANDS * ROWS) -> np.ndarray:
    """rows x m registers; a row without shingles has zeros."""
    q = np.full(rows * m, np.inf)
    sig = np.zeros(rows * m, np.uint64)
    x, arrival = np.zeros(len(g)), 0
    while len(g):
        many = max(1, min(64, 40_000 // len(g)))
        for _ in range(many if len(g) > 2000 else 1):
            steps = 1 if len(g) > 2000 else many
            k = (np.arange(steps, dtype=np.uint64) + tk.U64(arrival + 1)) * _STEP
            r = tk.mix(g[:, None] + k[None, :])
            times = x[:, None] + np.cumsum(-np.log((r >> tk.U64(32)).astype(np.float64) * 2.0**-32 + 2.0**-33), axis=1) / weight[:, None]
            flat = (((r & tk.U64(0xFFFFFFFF)) * tk.U64(m)) >> tk.U64(32)).astype(np.int64) + row[:, None] * m
            up = times < q[flat]
            f, t = flat[up], times[up]
            np.minimum.at(q, f, t)
            win = q[f] == t
            sig[f[win]] = np.broadcast_to(g[:, None], times.shape)[up][win]
            x = times[:, -1]
            arrival += steps
        last = q.reshape(rows, m).max(axis=1)
        on = x < last[row]
        g, row, weight, x = g[on], row[on], weight[on], x[on]
    return sig.reshape(rows, m)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """rows x BANDS bucket hashes."""
    s = sig.reshape(len(sig), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), BANDS)).copy()
    for k in range(ROWS):
        out = tk.mix(out * _STEP + s[:, :, k])
    return out


def bits(sig: np.ndarray) -> np.ndarray:
    """One bit of each register, in words of 64; words beyond the registers are zero."""
    b = np.zeros((len(sig), 192), np.uint8)
    b[:, : sig.shape[1]] = (tk.mix(sig) & tk.U64(1)).astype(np.uint8)
    return np.packbits(b, axis=1).view(np.int64)


def digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _signed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, id (digest), buckets, b0, b1, b2: a row per input row; texts without words have no buckets."""

    def run(batches):
        for s in tk.slices(batches, "_text", most=SLICE_ROWS):
            g, row, _ = weighted(*shingles(s))
            sig = signatures(g, row, np.ones(len(g)), len(s))
            some = np.bincount(row, minlength=len(s)) > 0
            keys = band_keys(sig).view(np.int64)[some]
            offs = np.cumsum(np.append(0, np.where(some, BANDS, 0))).astype(np.int32)
            b = bits(sig)
            yield pa.RecordBatch.from_arrays([s.rows.column(0), s.rows.column(1), pa.ListArray.from_arrays(pa.array(offs), pa.array(keys.ravel())), *[pa.array(np.ascontiguousarray(b[:, k])) for k in range(3)]], names=["key", "id", "buckets", "b0", "b1", "b2"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), digest(F.col(text)).alias("id"), F.col(text).alias("_text")).mapInArrow(run, f"key {kind}, id binary, buckets array<bigint>, b0 bigint, b1 bigint, b2 bigint")


def exact_similarity(pairs: DataFrame) -> DataFrame:
    """a, b, similarity: the Jaccard similarity of the shingle sets of text_a and text_b."""

    def run(batches):
        for batch in batches:
            both = [pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column(k)], names=["row", "_text"]) for k in (2, 3)]
            got = []
            for one in both:
                parts = [(g, s.rows.column(0).to_numpy()[row]) for s in tk.slices(iter([one]), "_text") for g, row in [shingles(s)]]
                g, row = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
                order = np.argsort(row, kind="stable")
                got.append((g[order], np.searchsorted(row[order], np.arange(batch.num_rows + 1))))
            (ga, ca), (gb, cb) = got
            out = np.zeros(batch.num_rows)
            for i in range(batch.num_rows):
                x, y = np.unique(ga[ca[i] : ca[i + 1]]), np.unique(gb[cb[i] : cb[i + 1]])
                both_ = len(np.intersect1d(x, y, assume_unique=True))
                out[i] = both_ / max(1, len(x) + len(y) - both_)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=["a", "b", "similarity"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary, similarity double")


def _alike(x: str, y: str) -> Column:
    """Whether two rows' one-bit registers may belong to similar texts."""
    m = BANDS * ROWS
    apart = sum((F.bit_count(F.col(f"{x}.b{k}").bitwiseXOR(F.col(f"{y}.b{k}"))) for k in range(3)), F.lit(0))
    return apart <= int((1 - LEAST_BITS) * m)


class _Texts:
    """Texts by digest, read again from the documents for those that are to be verified."""

    def __init__(self, docs: DataFrame, key: str, text: str, first: DataFrame):
        self.docs = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
        self.first = first

    def of(self, ids: DataFrame) -> DataFrame:
        """i (digest) and t (text) for the digests in ids."""
        need = materialize(ids.join(self.first, "id").select("id", F.col("key").alias("k2")), "wanted")
        small = need.count() <= BROADCAST_ROWS
        docs = self.docs.withColumn("i", digest(F.col("t")))
        found = docs.join(F.broadcast(need) if small else need, (F.col("i") == F.col("id")) & F.col("k").eqNullSafe(F.col("k2")), "left_semi")
        return materialize(found.dropDuplicates(["i"]).select("i", "t"), "texts")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those pairs (a, b) that are similar."""
        pairs = materialize(pairs.distinct(), "candidates")
        found = self.of(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
        p = pairs.join(found.select(F.col("i").alias("a"), F.col("t").alias("text_a")), "a").join(found.select(F.col("i").alias("b"), F.col("t").alias("text_b")), "b")
        return materialize(exact_similarity(p).filter(F.col("similarity") >= SIMILARITY).select("a", "b"), "links")


def _sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles of every text with their rows."""
    rb = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), texts], names=["row", "_text"])
    parts = []
    for s in tk.slices(iter([rb]), "_text"):
        g, row, _ = weighted(*shingles(s))
        parts.append((g, s.rows.column(0).to_numpy()[row]))
    return np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])


def _tile(table: pa.Table) -> pa.Table:
    """a, b: links within one tile that join different classes, as few as join them."""
    table = table.combine_chunks()
    ids, c, side = table.column("id").to_pylist(), table.column("c").to_pylist(), table.column("side").to_numpy()
    g, row = _sets(table.column("t").combine_chunks() if isinstance(table.column("t"), pa.ChunkedArray) else table.column("t"))
    size = np.bincount(row, minlength=len(ids))
    _, at, many = np.unique(g, return_inverse=True, return_counts=True)
    keep = many[at] > 1
    at, row = np.unique(at[keep], return_inverse=True)[1], row[keep]
    m = np.zeros((len(ids), int(at.max()) + 1 if len(at) else 1), np.float32)
    m[row, at] = 1
    left = np.flatnonzero(side <= 0)
    right = np.flatnonzero(side >= 0) if (side != 0).any() else left
    both = m[left] @ m[right].T
    x, y = np.nonzero(both >= SIMILARITY * (size[left][:, None] + size[right][None, :] - both) - 1e-3)
    shared = both[x, y]
    x, y = left[x], right[y]
    ok = (x != y) & (shared.astype(np.float64) / np.maximum(1, size[x] + size[y] - shared.astype(np.float64)) >= SIMILARITY)
    parent: dict = {k: k for k in c}

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    out = []
    for i, j in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
        p, q = root(c[i]), root(c[j])
        if p != q:
            parent[p] = q
            out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return pa.table({"a": pa.array([k[0] for k in out], pa.binary()), "b": pa.array([k[1] for k in out], pa.binary())})


def _tiled(group: DataFrame, classes_: DataFrame, texts: _Texts) -> DataFrame:
    """Links between classes within each group (id, g), block against block."""
    blocks = group.groupBy("g").agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks"))
    k = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    rows = group.join(blocks, "g").withColumn("k", k).join(classes_, "id")
    rows = rows.join(texts.of(group.select("id")), F.col("id") == F.col("i"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("k", "o"), F.greatest("k", "o")
    side = F.when(F.col("k") == F.col("o"), 0).when(F.col("k") < F.col("o"), -1).otherwise(1)
    rows = rows.select("g", lo.alias("lo"), hi.alias("hi"), "id", "c", side.alias("side"), "t")
    return materialize(rows.groupBy("g", "lo", "hi").applyInArrow(lambda t: _tile(t), "a binary, b binary"), "links")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, id (digest of the text), class_id (least key of the class), kept_id (digest of that row): a row per input row."""
    rows = materialize(_signed(docs, key, text), "signatures")
    first = rows.groupBy("id").agg(F.min("key").alias("key"))
    sig = rows.groupBy("id").agg(*[F.first(c).alias(c) for c in ("b0", "b1", "b2")])
    member = rows.select(F.explode("buckets").alias("h"), "id").distinct()
    pivot = member.groupBy("h").agg(F.min("id").alias("p"), F.max("id").alias("last")).filter(F.col("p") != F.col("last")).select("h", "p")
    pivot = materialize(pivot, "pivots")  # read back, so that AQE can split the join's hot buckets
    shared = materialize(member.join(pivot, "h"), "buckets")
    keys = shared.select("id").distinct()
    bit = materialize(keys.join(sig, "id"), "bits")
    texts = _Texts(docs, key, text, first)

    def candidates(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose bits allow a link."""
        x = pairs.distinct().alias("p").join(bit.alias("x"), F.col("p.a") == F.col("x.id"))
        return x.join(bit.alias("y"), (F.col("p.b") == F.col("y.id")) & _alike("x", "y")).select("p.a", "p.b")

    links = texts.verified(candidates(shared.filter(F.col("id") != F.col("p")).select(F.col("p").alias("a"), F.col("id").alias("b"))))
    cc = materialize(connected_components(links, "a", "b"), "components")
    now = shared.select("h", "id").join(cc.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id"))
    torn = now.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n"), F.min("id").alias("p")).filter(F.col("lo") != F.col("hi"))
    torn = materialize(torn.select("h", "n", "p"), "torn-buckets")
    torn = materialize(now.join(torn, "h").select("h", "id", "c", "n", "p"), "torn")
    more = []
    large = torn.filter(F.col("n") > SMALL)
    group = materialize(connected_components(large.select("id", "p"), "id", "p").toDF("id", "g"), "groups")
    if not group.isEmpty():
        more.append(_tiled(group, torn.select("id", "c").distinct(), texts))
    wide = torn.filter(F.col("n") <= SMALL).select("h", "id", "c").join(bit, "id").join(group, "id", "left")
    apart = (F.col("x.h") == F.col("y.h")) & (F.col("x.c") < F.col("y.c")) & ~F.coalesce(F.col("x.g") == F.col("y.g"), F.lit(False)) & _alike("x", "y")
    wide = materialize(wide, "small-buckets")
    pairs = wide.alias("x").join(wide.alias("y"), apart).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    more.append(texts.verified(pairs))
    links = cc.filter(F.col("node") != F.col("component")).toDF("a", "b")  # what the first links join, as stars: few rounds are left
    for found in more:
        links = links.unionByName(found)
    cc = materialize(connected_components(links, "a", "b"), "components")
    by_text = first.join(cc.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id"))
    by_text = materialize(by_text.select("id", "key", "c"), "texts-classes")
    least = by_text.groupBy("c").agg(F.min(F.struct(F.col("key").isNull().alias("n"), "key", "id")).alias("least"))
    named = by_text.join(materialize(least, "least"), "c").select("id", F.col("least.key").alias("class_id"), F.col("least.id").alias("kept_id"))
    return rows.select(F.col("key").alias(key), "id").join(named, "id")


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each class: that of the least key. Rows that repeat it in full go as well."""
    got = materialize(classes(docs, key, text).select(F.col(key).alias("k2"), "id", (F.col("id") == F.col("kept_id")) & F.col(key).eqNullSafe(F.col("class_id"))).toDF("k2", "id", "stays"), "classes")
    gone = materialize(got.filter(~F.col("stays")).select("k2", "id").distinct(), "gone")
    repeated = not got.filter("stays").groupBy("k2", "id").count().filter("count > 1").isEmpty()
    mine = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(key).alias("k"), digest(F.col(text)).alias("i"))
    left = mine.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, (F.col("i") == F.col("id")) & F.col("k").eqNullSafe(F.col("k2")), "left_anti")
    return (left.dropDuplicates(["k", "i"]) if repeated else left).select("doc.*")


def op8_query(docs: DataFrame) -> DataFrame:
    """doc_id, class_id."""
    return classes(docs).select("doc_id", "class_id")


SQL = f"""
    WITH RECURSIVE tx AS (SELECT coalesce(text, '') AS t, min(doc_id) AS k FROM documents GROUP BY ALL),
    w AS (SELECT k, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM tx),
    s AS (SELECT DISTINCT k, ws[p : p + {SHINGLE - 1}] AS g FROM (SELECT k, ws, unnest(range(1, greatest(len(ws) - {SHINGLE - 1}, 1) + 1)) AS p FROM w WHERE len(ws) > 0)),
    n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
    p AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.k < b.k GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN n x ON a = x.k JOIN n y ON b = y.k WHERE c / (x.n + y.n - c) >= CAST({SIMILARITY} AS DOUBLE)),
    e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
    c AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
    SELECT d.doc_id, least(tx.k, coalesce(c.least, tx.k)) AS class_id
    FROM documents d JOIN tx ON coalesce(d.text, '') = tx.t LEFT JOIN c ON c.a = tx.k"""
