"""Removal of long byte strings that an earlier document holds already.

A byte of a document goes if a string of WINDOW bytes that covers it also starts in a document with a
smaller id; strings are judged on the texts as they came. Suffixes are ordered only as far as the window
reaches, by radix passes from the most significant digit; groups equal after the last pass are
exactly the repeated windows.

Plan. Each window is named by its anchor, the run of GRAM bytes in it with the least hash (leftmost of
equals): equal windows have equal anchors at equal offsets, and neighbours mostly share one, so a text has
an anchor per 14 bytes or so.
1. Whole copies of a text with a smaller id go at once (digest, least id).
2. Anchors of the other texts are packed by bucket, six bytes each; an anchor that several documents of a
   slice have is sent once. Per bucket those that occur in more than one document are told to their
   documents. The number of buckets follows the bytes of all texts.
3. Those documents' texts are read again; an anchor that is told is sent with the bytes its windows cover. Of
   equal contexts in a slice only the least id's is sent: the others lose all their bytes at once.
4. Per bucket of anchors all windows are sorted by eight-byte digits, group by group, until WINDOW bytes
   are equal; a window whose group holds a smaller id is removed. An anchor with over HOT such contexts is
   not collected: its equal contexts are combined before they are exchanged, and only the first of each
   goes on. If over HOT are left, their windows are grouped one by one by a digest, combined likewise.
5. A document's ranges meet by its id.

Defined cases: a null text counts as empty; texts under WINDOW bytes stay whole; a null id counts as the
largest; rows with equal ids are not earlier than each other; an empty table gives an empty result. Texts
longer than PIECE are cut into pieces that overlap by WINDOW - 1 bytes, which leaves all windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm import textkernel as tk
from tidegrid.session import materialize

WINDOW = 50
GRAM = 24
#: Larger slices send fewer anchors that several documents share.
SLICE = 2 << 20
PIECE = 1 << 23
ANCHORS_PER_BUCKET = 400_000
CONTEXTS_PER_BUCKET = 20_000
HOT = 5_000
BROADCAST_ROWS = 200_000
#: Partitions follow the buckets, whose number follows the bytes; beyond so many, a task has several.
MOST_PARTITIONS = 20_000
_POS = tk.U64((1 << 24) - 1)
_MULT = 0xD6E8FEB86659FD93


def _gram_hash(data: np.ndarray) -> np.ndarray:
    """Polynomials of all runs of GRAM bytes, put together from runs of 1, 2, 4, ... bytes."""
    h, step, out, have = tk._BYTES[data], 1, None, 0
    while True:
        if GRAM & step:
            out = h if out is None else out[: len(data) - have - step + 1] * tk.U64(pow(_MULT, step, 1 << 64)) + h[have : len(data) - step + 1]
            have += step
        if have == GRAM:
            return out
        h = h[:-step] * tk.U64(pow(_MULT, step, 1 << 64)) + h[step:]
        step *= 2


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By anchor, in order: its hash, its row, its place, and the first and number of the windows it names. At most 2**24 bytes."""
    n = len(data)
    none = np.empty(0, np.int64)
    long = np.flatnonzero(ends - starts >= WINDOW)
    if not len(long):
        return none.astype(np.uint64), none, none, none, none
    h = tk.mix(_gram_hash(data))
    m = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
    reach, want = 1, WINDOW - GRAM + 1
    while reach * 2 <= want:
        m = np.minimum(m[:-reach], m[reach:])
        reach *= 2
    if want > reach:
        m = np.minimum(m[: len(m) - (want - reach)], m[want - reach :])
    count = ends[long] - starts[long] - WINDOW + 1
    at = tk.ragged(starts[long], count)
    place = (m[at] & _POS).astype(np.int64)
    first, size = tk.runs(place)
    place = place[first]
    row = long[np.searchsorted(np.cumsum(count), first, side="right")]
    assert n <= 1 << 24
    return h[place], row, place, at[first], size


def pieces(s: tk.Slice):
    """(data, rows, shifts, starts, ends) with at most PIECE + WINDOW bytes of a text in each; a piece starts at `shift` of its row."""
    if len(s.data) <= PIECE:
        yield s.data, np.arange(len(s)), np.zeros(len(s), np.int64), s.starts, s.ends
        return
    for i in range(len(s)):
        for shift in range(0, max(1, int(s.ends[i] - s.starts[i])), PIECE):
            data = s.data[s.starts[i] + shift : min(s.ends[i], s.starts[i] + shift + PIECE + WINDOW - 1)]
            yield data, np.array([i]), np.array([shift]), np.array([0]), np.array([len(data)])


def code(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the upper 32 bits, the lower 32 bits of the hash in the lower."""
    return (((h >> tk.U64(32)) * tk.U64(buckets)) & ~tk.U64(0xFFFFFFFF)) | (h & tk.U64(0xFFFFFFFF))


MANY = 0xFFFF
#: Anchors in a row of those that a slice knows to be shared.
KNOWN = 1 << 15
_SENT = "bucket bigint, known boolean, hashes binary, docs binary, keys binary, dids binary"


def _send(docs: DataFrame, buckets: int) -> DataFrame:
    """Anchors packed by bucket. known: codes already seen in two documents, with key and did of each."""

    def run(batches):
        turn = 0
        for s in tk.slices(batches, "_text", SLICE):
            key, did = s.rows.column(0).to_numpy(), s.rows.column(1).to_numpy()
            got = [(code(h, buckets), rows[row]) for data, rows, _, a, b in pieces(s) for h, row, *_ in [anchors(data, a, b)]]
            c, row = np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])
            order = np.lexsort((row, c)) if len(c) else row
            c, row = c[order], row[order]
            fresh = np.ones(len(c), bool)
            fresh[1:] = (c[1:] != c[:-1]) | (row[1:] != row[:-1])
            c, row = c[fresh], row[fresh]
            first, size = tk.runs(c)
            many = np.repeat(size > 1, size)
            out = []
            shared = np.flatnonzero(many)
            for x in range(0, len(shared), KNOWN):
                turn += 1
                k = shared[x : x + KNOWN]
                bucket = tk.mix(np.array([did[0]], np.int64).view(np.uint64) + tk.U64(turn))[0] % tk.U64(buckets)
                out.append((int(bucket), True, c[k].tobytes(), b"", key[row[k]].astype(np.int64).tobytes(), did[row[k]].astype(np.int64).tobytes()))
            c, low = c[first], np.where(size > 1, MANY, row[first])
            ids, local = np.unique(low, return_inverse=True)
            # Row numbers of a slice fit into two bytes, or the slice is sent in parts.
            for part in range(0, len(ids), MANY):
                mine = (local >= part) & (local < part + MANY) if len(ids) > MANY else slice(None)
                cc, ll = c[mine], low[mine]
                use, at = np.unique(ll[ll != MANY] if len(ids) <= MANY else ll, return_inverse=True)
                d = np.full(len(cc), MANY, np.uint16)
                d[ll != MANY if len(ids) <= MANY else slice(None)] = at
                b = (cc >> tk.U64(32)).astype(np.int64)
                f, m = tk.runs(b)
                for x, y in zip(f.tolist(), m.tolist(), strict=True):
                    dd = d[x : x + y]
                    mine_, to = np.unique(dd[dd != MANY], return_inverse=True)
                    packed = np.full(y, MANY, np.uint16)
                    packed[dd != MANY] = to
                    out.append((int(b[x]), False, (cc[x : x + y] & tk.U64(0xFFFFFFFF)).astype(np.uint32).tobytes(), packed.tobytes(), key[use[mine_]].astype(np.int64).tobytes(), did[use[mine_]].astype(np.int64).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.bool_(), *[pa.binary()] * 4), strict=True)], names=["bucket", "known", "hashes", "docs", "keys", "dids"])

    return docs.select("key", "did", "_text").mapInArrow(run, _SENT)


def _tell(table: pa.Table) -> pa.Table:
    """key, did, anchor for the anchors of a bucket that more than one document has."""
    known = table.column("known").to_numpy()
    cols = {n: [x.as_buffer() for x in table.column(n)] for n in ("hashes", "docs", "keys", "dids")}
    u = lambda n, i, t: np.frombuffer(cols[n][i], t)
    told = [(u("keys", i, np.int64), u("dids", i, np.int64), u("hashes", i, np.uint64)) for i in np.flatnonzero(known)]
    rest = np.flatnonzero(~known)
    if len(rest):
        h = np.concatenate([u("hashes", i, np.uint32) for i in rest])
        d = [u("docs", i, np.uint16).astype(np.int64) for i in rest]
        size = np.array([len(u("keys", i, np.int64)) for i in rest])
        base = np.cumsum(size) - size
        doc = np.concatenate([np.where(x == MANY, -1, x + o) for x, o in zip(d, base, strict=True)])
        key, did = np.concatenate([u("keys", i, np.int64) for i in rest]), np.concatenate([u("dids", i, np.int64) for i in rest])
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        _, m = tk.runs(h)
        multi = np.repeat(np.maximum.reduceat(doc < 0, np.cumsum(m) - m) | (m > 1), m) & (doc >= 0)
        bucket = np.uint64(table.column("bucket")[0].as_py()) << tk.U64(32)
        told.append((key[doc[multi]], did[doc[multi]], bucket | h[multi].astype(np.uint64)))
    out = [np.concatenate(x) for x in zip(*told, strict=True)]
    return pa.table({"key": out[0], "did": out[1], "anchor": out[2].view(np.int64)})


def equal_contexts(data: np.ndarray, h: np.ndarray, lead: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place for each set of equal contexts, and for each context its number among those. Hashes find them, bytes decide."""
    name = tk.mix(tk.span_hash(data, first, first + size) ^ tk.mix(h.view(np.uint64) + lead.astype(np.uint64) * tk.U64(_MULT)))
    _, one, inverse = np.unique(name, return_index=True, return_inverse=True)
    to = one[inverse]
    same = (h == h[to]) & (lead == lead[to]) & (size == size[to])
    same[same] = tk.same_spans(data, first[same], first[to[same]], size[same])
    odd = np.flatnonzero(~same)  # by a collision of names; each stands for itself
    inverse[odd] = len(one) + np.arange(len(odd))
    return np.concatenate([one, odd]), inverse


def least_of(inverse: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, inverse, key)
    return least


def _contexts(docs: DataFrame, buckets: int) -> DataFrame:
    """h, key, did, at, lead, ctx: by anchor that is told, where its first window starts, how far the anchor is from there, and the bytes of its windows.

    Rows with `until` have no context: a smaller key in the same slice has it, and the range from `at` goes.
    """

    def run(batches):
        for s in tk.slices(batches, "_text", SLICE):
            key, did, lists = s.rows.column(0), s.rows.column(1), s.rows.column(2)
            keys = key.to_numpy()
            of = np.repeat(np.arange(len(s)), [len(x) for x in lists])
            tag = lambda c, row: tk.mix(c ^ tk.mix(row.astype(np.uint64) + tk.U64(1)))
            told = np.sort(tag(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), of))
            for data, rows, shifts, a, b in pieces(s):
                h, row, place, first, size = anchors(data, a, b)
                t = tag(code(h, buckets), rows[row])
                at = np.minimum(np.searchsorted(told, t), len(told) - 1)
                on = np.flatnonzero(told[at] == t)
                if not len(on):
                    continue
                h, row, first, n, lead = h[on], row[on], first[on], size[on] + WINDOW - 1, (place - first)[on]
                one, inverse = equal_contexts(data, h, lead, first, n)
                mine = keys[rows[row]]
                late = mine > least_of(inverse, mine, len(one))[inverse]
                k = np.flatnonzero(late)
                if len(k):  # in order of place, so that ranges which meet are neighbours
                    begin = np.ones(len(k), bool)
                    begin[1:] = (row[k[1:]] != row[k[:-1]]) | (first[k[1:]] > (first + n)[k[:-1]])
                    f = np.flatnonzero(begin)
                    e = np.append(f[1:], len(k)) - 1
                    r, shift = pa.array(rows[row[k[f]]]), (shifts - a)[row[k[f]]]
                    none = [pa.nulls(len(f), x) for x in (pa.int64(), pa.int32(), pa.binary())]
                    yield pa.RecordBatch.from_arrays([none[0], key.take(r), did.take(r), pa.array(first[k[f]] + shift), none[1], none[2], pa.array((first + n)[k[e]] + shift)], names=_CONTEXT_NAMES)
                keep = np.flatnonzero(~late)
                for x in range(0, len(keep), 100_000):
                    k = keep[x : x + 100_000]
                    offs = np.cumsum(np.append(0, n[k])).astype(np.int32)
                    body = data[tk.ragged(first[k], n[k])]
                    ctx = pa.BinaryArray.from_buffers(pa.binary(), len(k), [None, pa.py_buffer(offs), pa.py_buffer(body)])
                    r = pa.array(rows[row[k]])
                    yield pa.RecordBatch.from_arrays([pa.array(h[k].view(np.int64)), key.take(r), did.take(r), pa.array(first[k] + (shifts - a)[row[k]]), pa.array(lead[k].astype(np.int32)), ctx, pa.nulls(len(k), pa.int64())], names=_CONTEXT_NAMES)

    return docs.mapInArrow(run, "h bigint, key bigint, did bigint, at bigint, lead int, ctx binary, until bigint")


_CONTEXT_NAMES = ["h", "key", "did", "at", "lead", "ctx", "until"]


def radix_groups(data: np.ndarray, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order and group number of the suffixes at `at`, sorted by WINDOW bytes within the given groups; those alone in a group are left out."""
    padded = np.append(data, np.zeros(8, np.uint8))
    order = np.argsort(group, kind="stable")
    g = group[order]
    for depth in range(0, WINDOW, 8):
        _, m = tk.runs(g)
        keep = np.repeat(m > 1, m)
        order, g = order[keep], g[keep]
        if not len(order):
            return order, g
        digit = np.zeros(len(order), np.uint64)
        for k in range(min(8, WINDOW - depth)):
            digit = digit << tk.U64(8) | padded[at[order] + depth + k]
        first, m = tk.runs(g)
        same = np.ones(len(g), bool)
        same[1:] = (digit[1:] == digit[:-1]) | (g[1:] != g[:-1])
        split = np.repeat(~np.logical_and.reduceat(same, first), m)
        if split.any():  # only groups that this digit divides are sorted
            part = np.flatnonzero(split)
            by = part[np.lexsort((digit[part], g[part]))]
            order[part], digit[part] = order[by], digit[by]
        new = np.ones(len(g), bool)
        new[1:] = (digit[1:] != digit[:-1]) | (g[1:] != g[:-1])
        g = np.cumsum(new)
    _, m = tk.runs(g)
    keep = np.repeat(m > 1, m)
    return order[keep], g[keep]


def _sorted_bucket(table: pa.Table) -> pa.Table:
    """key, did, start, end: ranges of windows that a smaller key has, for one bucket of anchors."""
    table = table.combine_chunks()
    h, key, did, at, lead = (table.column(c).to_numpy() for c in ("h", "key", "did", "at", "lead"))
    ctx = table.column("ctx").combine_chunks() if isinstance(table.column("ctx"), pa.ChunkedArray) else table.column("ctx")
    ctx = ctx.chunk(0) if isinstance(ctx, pa.ChunkedArray) else ctx
    width = np.int64 if pa.types.is_large_binary(ctx.type) else np.int32
    offs = np.frombuffer(ctx.buffers()[1], width, len(ctx) + 1, ctx.offset * np.dtype(width).itemsize).astype(np.int64)
    data = np.frombuffer(ctx.buffers()[2], np.uint8)[offs[0] : offs[-1]]
    a, b = offs[:-1] - offs[0], offs[1:] - offs[0]
    # Equal contexts once each, for the least key that has them.
    first, inverse = equal_contexts(data, h, lead, a, b - a)
    least = least_of(inverse, key, len(first))
    n = (b - a - WINDOW + 1)[first]
    win = tk.ragged(a[first], n)
    owner = np.repeat(np.arange(len(first)), n)
    offset = lead[first][owner] - (win - a[first][owner])
    tag = tk.mix(h[first].view(np.uint64)[owner] + (offset.astype(np.uint64) + tk.U64(1)) * tk.U64(_MULT))
    order, g = radix_groups(data, win, tag)
    gone = np.zeros(len(win), bool)
    if len(order):
        start, m = tk.runs(g)
        low = np.minimum.reduceat(least[owner[order]], start)
        gone[order] = least[owner[order]] > np.repeat(low, m)
    # Rows with a larger key than another row with the same context lose all its windows.
    every = key > least[inverse]
    w0 = np.cumsum(n) - n
    some = np.flatnonzero(~every & (np.add.reduceat(gone.astype(np.int64), w0)[inverse] > 0))
    x = tk.ragged(w0[inverse[some]], n[inverse[some]])
    r = np.repeat(some, n[inverse[some]])
    j = x - w0[inverse[r]]
    on = gone[x]
    r, j = r[on], j[on]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (j[1:] != j[:-1] + 1)
    f = np.flatnonzero(new)
    e = np.append(f[1:], len(r)) - 1 if len(f) else f
    all_ = np.flatnonzero(every)
    rows = np.concatenate([r[f], all_])
    start = np.concatenate([at[r[f]] + j[f], at[all_]])
    end = np.concatenate([at[r[f]] + j[e] + WINDOW, at[all_] + (b - a)[all_]])
    return pa.table({"key": key[rows], "did": did[rows], "start": start, "end": end})


_RANGE = "key bigint, did bigint, start bigint, end bigint"


def _hot_ranges(contexts: DataFrame) -> DataFrame:
    """The same for anchors that too many documents have to be collected: windows meet by digest, combined first."""
    w = contexts.select("key", "did", "at", "ctx", F.explode(F.sequence(F.lit(0), F.length("ctx") - WINDOW)).alias("j"))
    w = materialize(w.select("key", "did", (F.col("at") + F.col("j")).alias("start"), F.unhex(F.md5(F.substring(F.col("ctx"), F.col("j") + 1, F.lit(WINDOW)))).alias("w")), "hot-windows")
    low = materialize(w.groupBy("w").agg(F.min("key").alias("low")), "hot-windows-least")  # read back, so that AQE can split hot windows
    return w.join(low, "w").filter(F.col("key") > F.col("low")).select("key", "did", "start", (F.col("start") + WINDOW).alias("end"))


def _frequent(contexts: DataFrame) -> DataFrame:
    """h of anchors with over HOT contexts."""
    return materialize(contexts.groupBy("h").count().filter(F.col("count") > HOT).select("h"), "hot-anchors")


def _split(contexts: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Contexts of other anchors, and of hot ones if there are any."""
    many = hot.count()
    if not many:
        return contexts, None
    hot = F.broadcast(hot) if many <= BROADCAST_ROWS else hot
    return contexts.join(hot, "h", "left_anti").select(*contexts.columns), contexts.join(hot, "h", "left_semi").select(*contexts.columns)


class Rows:
    """What the plan needs of the input: key, did (hash of the text), n_bytes and sha of every row, and which rows are whole copies."""

    def __init__(self, docs: DataFrame, key: str, text: str):
        t = F.coalesce(F.col(text), F.lit(""))
        k = F.coalesce(F.col(key).cast("bigint"), F.lit(2**63 - 1))
        self.docs = docs.select(k.alias("key"), F.xxhash64(t).alias("did"), F.unhex(F.md5(t)).alias("id"), t.alias("_text"))
        self.rows = materialize(docs.select(F.col(key).alias("own"), k.alias("key"), F.xxhash64(t).alias("did"), F.unhex(F.md5(t)).alias("id"), F.octet_length(t).cast("bigint").alias("n_bytes"), F.sha2(t, 256).alias("sha")), "rows")
        first = materialize(self.rows.groupBy("id").agg(F.min("key").alias("first")), "first")  # read back, so that AQE can split hot copies
        self.rows_first = self.rows.join(first, "id").withColumn("copy", F.col("key") > F.col("first")).drop("first")
        self.copies = materialize(self.rows_first.filter("copy").select("key", "did").distinct(), "copies")
        few = self.copies.count() <= BROADCAST_ROWS
        self.single = self.docs.join(F.broadcast(self.copies) if few else self.copies, ["key", "did"], "left_anti").select("key", "did", "_text")

    def texts_of(self, some: DataFrame, extra: list[str]) -> DataFrame:
        """key, did, the extra columns and _text for the (key, did) in `some`. Rows that repeat another in full come once."""
        few = some.count() <= BROADCAST_ROWS
        ids = some.select("key", "did")
        mine = self.docs.select("key", "did", "_text").join(F.broadcast(ids) if few else ids, ["key", "did"], "left_semi")
        return mine.join(some, ["key", "did"]).dropDuplicates(["key", "did"]) if self.repeated else mine.join(some, ["key", "did"])

    @property
    def repeated(self) -> bool:
        if not hasattr(self, "_repeated"):
            self._repeated = not self.rows.groupBy("key", "did").count().filter("count > 1").isEmpty()
        return self._repeated


def removed_ranges(rows: Rows) -> DataFrame:
    """key, did, spans (array of start, end; ordered, may overlap) for texts that lose bytes and are no whole copies."""
    total = rows.rows.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(1, int(total * 2 / (WINDOW - GRAM + 2) / ANCHORS_PER_BUCKET))
    told = _send(rows.single, buckets).repartition(min(buckets, MOST_PARTITIONS), "bucket").groupBy("bucket").applyInArrow(_tell, "key bigint, did bigint, anchor bigint")
    told = materialize(told.groupBy("key", "did").agg(F.collect_set("anchor").alias("anchors")), "anchors")
    ctx = materialize(_contexts(rows.texts_of(told, ["anchors"]).select("key", "did", "anchors", "_text"), buckets), "contexts")
    settled = ctx.filter(F.col("until").isNotNull()).select("key", "did", F.col("at").alias("start"), F.col("until").alias("end"))
    ctx = ctx.filter(F.col("until").isNull()).drop("until")
    hot = _frequent(ctx)
    ranges = [settled]
    cold, often = _split(ctx, hot)
    if often is not None:
        # Of equal contexts, those with the least key go on; the others lose all their bytes.
        often = materialize(often, "hot-rows")
        low = materialize(often.groupBy("h", "lead", "ctx").agg(F.min("key").alias("low")), "hot-least")
        both = materialize(often.join(low, ["h", "lead", "ctx"]), "hot-contexts")
        ranges.append(both.filter(F.col("key") > F.col("low")).select("key", "did", F.col("at").alias("start"), (F.col("at") + F.length("ctx")).alias("end")))
        least = both.filter(F.col("key") == F.col("low")).drop("low").select(*ctx.columns)
        some, very = _split(least, _frequent(least))
        cold = cold.unionByName(some)
        if very is not None:
            ranges.append(_hot_ranges(very))
    parts = max(1, ctx.count() // CONTEXTS_PER_BUCKET)
    out = cold.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(parts))).repartition(min(parts, MOST_PARTITIONS), "bucket").groupBy("bucket").applyInArrow(lambda t: _sorted_bucket(t), _RANGE)
    for more in ranges:
        out = out.unionByName(more)
    return materialize(out.groupBy("key", "did").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")), "ranges")


def _cut(batches):
    for batch in batches:
        key, did, spans, text = batch.columns
        flat = spans.flatten()
        start, end = flat.field(0).to_numpy(), flat.field(1).to_numpy()
        offs = np.cumsum([0, *[len(x) for x in spans]])
        out = []
        for i in range(batch.num_rows):
            body = text[i].as_buffer()
            a, b = start[offs[i] : offs[i + 1]], end[offs[i] : offs[i + 1]]
            upto = np.maximum.accumulate(b)
            new = np.ones(len(a), bool)
            new[1:] = a[1:] > upto[:-1]
            f = np.flatnonzero(new)
            a, b = a[f], upto[np.append(f[1:], len(upto)) - 1]
            sha, at = hashlib.sha256(), 0
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                sha.update(body[at:x])
                at = y
            sha.update(body[at:])
            out.append((int((b - a).sum()), len(a), sha.hexdigest()))
        yield pa.RecordBatch.from_arrays([key, did, *[pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else ((), (), ()), (pa.int64(), pa.int64(), pa.string()), strict=True)]], names=["key", "did", "n_removed", "n_spans", "kept"])


def op6_query(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = Rows(docs, key, text)
    cut = rows.texts_of(removed_ranges(rows), ["spans"]).select("key", "did", "spans", "_text").mapInArrow(_cut, "key bigint, did bigint, n_removed bigint, n_spans bigint, kept string")
    r = rows.rows_first.join(cut, ["key", "did"], "left")
    whole = F.col("copy") & (F.col("n_bytes") >= WINDOW)
    return r.select(
        F.col("own").alias(key), "n_bytes",
        F.when(whole, F.col("n_bytes")).when(F.col("copy"), F.lit(0)).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(whole, F.lit(1)).when(F.col("copy"), F.lit(0)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).when(F.col("copy"), F.col("sha")).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


SQL = f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS k, hex(encode(coalesce(text, ''))) AS x FROM documents),
    w AS (SELECT r, k, p, substr(x, 2 * p + 1, {2 * WINDOW}) AS s FROM (SELECT r, k, x, unnest(range(0, length(x) // 2 - {WINDOW - 1})) AS p FROM d WHERE length(x) >= {2 * WINDOW})),
    f AS (SELECT s, min(k) AS first FROM w GROUP BY s),
    g AS (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS before FROM w JOIN f USING (s) WHERE k > first),
    i AS (SELECT r, p, count_if(before IS NULL OR p > before + {WINDOW}) OVER (PARTITION BY r ORDER BY p) AS island FROM g),
    s AS (SELECT r, min(p) AS a, max(p) + {WINDOW} AS b FROM i GROUP BY r, island),
    t AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS z FROM s),
    e AS (SELECT r, any_value(doc_id) AS doc_id, any_value(x) AS x, sum(b - a) AS removed, count(a) AS spans, max(b) AS last,
                 string_agg(substr(x, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS kept
          FROM d LEFT JOIN t USING (r) GROUP BY r)
    SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, spans AS n_spans,
           sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
    FROM e"""
