"""SentencePiece encoding and decoding by the unigram model.

Method. Pieces with log scores lie in a double-array trie. Texts are cut between two bytes that no piece has
side by side, which no path through the lattice can cross, so the best segmentation of a text is that of
its segments; each different segment of a slice is solved once. The trie is walked from every
character of those segments at once, a byte at a time, and the Viterbi recursion then runs over
segments in step. A character without a piece costs the least score minus 10 and becomes byte pieces.
A space is the marker U+2581; one is put before the text, and decoding takes it away. Models of merge
ranks carry no log scores: their pieces get Zipf's law over the ranks, -log(rank * sum of 1/rank).

Defined cases: null and empty texts give no ids; U+2581 in a text is read as a space, as the format says;
repeated rows are encoded row by row; an empty table gives an empty result. Texts are encoded whole.
The trie of one vocabulary (at most MAX_PIECES pieces, checked) goes to the executors with the task.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm import textkernel as tk

MARK = "▁"
UNKNOWN_PENALTY = 10.0
MAX_PIECES = 1_000_000
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass
class Vocabulary:
    """pieces: bytes with a blank for the marker, b"" where a piece is not text; scores; byte_ids: by byte."""

    pieces: list[bytes]
    scores: np.ndarray
    byte_ids: np.ndarray
    in_trie: np.ndarray
    unknown: int


def vocabulary(pieces: list[str], scores: list[float], kinds: list[str], ranks: bool) -> Vocabulary:
    """kinds: normal, byte or other; ranks: scores are merge ranks rather than log probabilities."""
    if len(pieces) > MAX_PIECES:
        raise ValueError(f"{len(pieces)} pieces; at most {MAX_PIECES} are broadcast")
    normal = np.array([k == "normal" for k in kinds])
    s = np.array(scores, np.float32)
    if ranks:
        order = np.flatnonzero(normal)
        order = order[np.lexsort((order, -s[order]))]
        rank = np.arange(1, len(order) + 1)
        s = np.zeros(len(pieces), np.float32)
        s[order] = (-np.log(rank * (1 / rank).sum())).astype(np.float32)
    byte_ids = np.full(256, -1, np.int32)
    raw = []
    for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)):
        if k == "byte":
            byte_ids[int(p[1:-1], 16)] = i
            raw.append(bytes([int(p[1:-1], 16)]))
        else:
            raw.append(p.replace(MARK, " ").encode() if k == "normal" else b"")
    return Vocabulary(raw, s, byte_ids, normal, kinds.index("unknown") if "unknown" in kinds else 0)


@functools.lru_cache(maxsize=4)
def load(path: str = VOCABULARY) -> Vocabulary:
    """The vocabulary in a SentencePiece model file, read on the driver."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    m = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    n = p.vocab_size()
    kinds = ["byte" if p.is_byte(i) else "unknown" if p.is_unknown(i) else "other" if p.is_control(i) or p.is_unused(i) else "normal" for i in range(n)]
    return vocabulary([p.id_to_piece(i) for i in range(n)], [p.get_score(i) for i in range(n)], kinds, m.trainer_spec.model_type != 1)


def double_array(pieces: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check, value: from state s by byte c to t = base[s] + c + 1 if check[t] == s; value[t] is a piece or -1."""
    children: list[dict[int, int]] = [{}]
    ends: list[int] = [-1]
    for p, k in pieces:
        s = 0
        for c in p:
            t = children[s].get(c)
            if t is None:
                t = children[s][c] = len(children)
                children.append({})
                ends.append(-1)
            s = t
        ends[s] = k
    size = 2 * len(children) + 1024
    base, check, value = [0] * size, [-1] * size, [-1] * size
    check[0] = 0
    first, todo = 1, [(0, 0)]
    while todo:
        node, at = todo.pop()
        kids = sorted(children[node])
        if not kids:
            base[at] = 0
            continue
        pos = max(first, kids[0] + 1)
        while True:
            if pos + 300 >= size:
                more = size
                base += [0] * more
                check += [-1] * more
                value += [-1] * more
                size += more
            b = pos - kids[0] - 1
            if check[pos] < 0 and all(check[b + c + 1] < 0 for c in kids):
                break
            pos += 1
        if len(kids) > 1 and pos > first + 64:  # the region before is nearly full
            first += (pos - first) // 8
        base[at] = b
        for c in kids:
            t = b + c + 1
            check[t] = at
            value[t] = ends[children[node][c]]
            todo.append((children[node][c], t))
    pad = max(b for b in base) + 258
    trim = lambda x, fill: np.array((x + [fill] * max(0, pad - len(x)))[:pad], np.int32)
    return trim(base, 0), trim(check, -1), trim(value, -1)


@dataclass
class Encoder:
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    scores: np.ndarray
    joined: np.ndarray
    byte_ids: np.ndarray
    unknown: int
    unknown_score: np.float32
    piece_bytes: np.ndarray
    piece_starts: np.ndarray
    piece_sizes: np.ndarray


@functools.lru_cache(maxsize=4)
def _encoder(path: str) -> Encoder:
    return encoder(load(path))


def encoder(v: Vocabulary) -> Encoder:
    text = [(p, i) for i, p in enumerate(v.pieces) if v.in_trie[i] and p]
    base, check, value = double_array(text)
    joined = np.zeros(1 << 16, bool)
    for p, _ in text:
        a = np.frombuffer(p, np.uint8).astype(np.int64)
        joined[a[:-1] << 8 | a[1:]] = True
    size = np.array([len(p) for p in v.pieces])
    least = np.float32(v.scores[v.in_trie].min()) - np.float32(UNKNOWN_PENALTY)
    return Encoder(base, check, value, v.scores, joined, v.byte_ids, v.unknown, least, np.frombuffer(b"".join(v.pieces), np.uint8), np.cumsum(size) - size, size)


def solve(e: Encoder, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of the given segments, back to back, and how many each has."""
    size = ends - starts
    local = tk.ragged(starts, size)
    b = data[local]
    n = len(b)
    seg_start = np.cumsum(size) - size
    seg_end = seg_start + size
    owner_end = np.repeat(seg_end, size)
    offset = np.arange(n) - np.repeat(seg_start, size)
    lead = (b & 0xC0) != 0x80
    lead[seg_start] = True
    at = np.flatnonzero(lead)
    char_end = np.empty(len(at), np.int64)
    char_end[:-1] = at[1:]
    char_end[-1:] = n
    # All pieces that start at a character.
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    pos, state, depth = at, np.zeros(len(at), np.int64), 0
    single = np.zeros(len(at), bool)
    which = np.arange(len(at))
    while len(pos):
        t = e.base[state] + b[pos + depth] + 1
        ok = e.check[t] == state
        ok &= t != 0
        pos, state, which = pos[ok], t[ok].astype(np.int64), which[ok]
        depth += 1
        v = e.value[state]
        hit = v >= 0
        if hit.any():
            found.append((pos[hit], pos[hit] + depth, v[hit]))
            single[which[hit]] |= (pos[hit] + depth) == char_end[which[hit]]
        go = pos + depth < owner_end[pos]
        pos, state, which = pos[go], state[go], which[go]
    none = ~single
    found.append((at[none], char_end[none], np.full(int(none.sum()), -1, np.int32)))
    src, dst, piece = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(offset[src].astype(np.uint16) if n and offset.max() < 65536 else offset[src], kind="stable")
    src, dst, piece = src[order], dst[order], piece[order]
    gain = np.where(piece >= 0, e.scores[piece], e.unknown_score).astype(np.float32)
    # best has one place for each byte's end; the place before a segment's first byte is read as 0.
    best = np.full(n + 1, -np.inf, np.float32)
    back = np.full(n + 1, -1, np.int64)
    first, length = tk.runs(offset[src])
    for a, m in zip(first.tolist(), length.tolist(), strict=True):
        s, d = src[a : a + m], dst[a : a + m]
        cand = gain[a : a + m] + (best[s - 1] if offset[s[0]] else np.float32(0))
        up = cand > best[d - 1]
        d = d[up] - 1
        best[d] = cand[up]
        back[d] = np.flatnonzero(up) + a
    # Back from the ends, all segments in step.
    cur, live, steps = seg_end.copy(), np.flatnonzero(size > 0), []
    while len(live):
        edge = back[cur[live] - 1]
        steps.append((live, edge))
        cur[live] = src[edge]
        live = live[cur[live] > seg_start[live]]
    if not steps:
        return np.empty(0, np.int32), np.zeros(len(starts), np.int64)
    seg = np.concatenate([x[0] for x in steps])
    edge = np.concatenate([x[1] for x in steps])
    by = np.lexsort((src[edge], seg)) if len(seg) else seg
    seg, edge = seg[by], edge[by]
    unknown = piece[edge] < 0
    times = np.where(unknown, dst[edge] - src[edge], 1)
    ids = np.repeat(piece[edge], times)
    if unknown.any():
        place = tk.ragged(src[edge][unknown], times[unknown])
        got = e.byte_ids[b[place]]
        ids[np.repeat(unknown, times)] = np.where(got >= 0, got, e.unknown)
    return ids.astype(np.int32), np.bincount(np.repeat(seg, times), minlength=len(starts))


def encode_slice(e: Encoder, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows, back to back, and the number of each row's. data has a blank before each text that isn't empty."""
    n = len(data)
    if not n:
        return np.empty(0, np.int32), np.zeros(len(starts), np.int64)
    cut = np.ones(n, bool)
    cut[1:] = ~e.joined[data[:-1].astype(np.int64) << 8 | data[1:]]
    cut &= (data & 0xC0) != 0x80
    cut[starts[starts < n]] = True
    a = np.flatnonzero(cut)
    b = np.append(a[1:], n)
    h = tk.span_hash(data, a, b)
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    ids, count = solve(e, data, a[first], b[first])
    at = np.cumsum(count) - count
    out = ids[tk.ragged(at[inverse], count[inverse])]
    each = np.cumsum(np.append(0, count[inverse]))
    return out, each[np.searchsorted(a, ends)] - each[np.searchsorted(a, starts)]


def decode_slice(e: Encoder, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows' texts, back to back, and their sizes; the first blank of each row is taken away."""
    size = e.piece_sizes[ids]
    data = e.piece_bytes[tk.ragged(e.piece_starts[ids], size)]
    ends = np.cumsum(np.append(0, size))
    at = np.cumsum(np.append(0, counts))
    a, b = ends[at[:-1]], ends[at[1:]]
    head = a[a < b]
    head = head[data[head] == 32]
    keep = np.ones(len(data), bool)
    keep[head] = False
    total = np.cumsum(np.append(0, keep))
    return data[keep], total[b] - total[a]


def _marked(s: tk.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts as they are to be decoded again, and with a blank before each, with where the latter start and end."""
    text = pa.LargeStringArray.from_buffers(len(s), pa.py_buffer(np.append(s.starts, len(s.data)).astype(np.int64)), pa.py_buffer(s.data))
    if (s.data == 0xE2).any():
        text = pc.replace_substring(text, MARK, " ")
    offs = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1)
    plain = np.frombuffer(text.buffers()[2], np.uint8)[offs[0] : offs[-1]] if text.buffers()[2] else np.empty(0, np.uint8)
    size = np.diff(offs)
    some = size > 0
    grown = size + some
    starts = np.cumsum(grown) - grown
    data = np.full(int(grown.sum()), 32, np.uint8)
    mask = np.ones(len(data), bool)
    mask[starts[some]] = False
    data[mask] = plain
    return plain, data, starts, starts + grown


def encode(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str = VOCABULARY) -> DataFrame:
    """key, ids, n_tokens, n_byte_tokens and exact (decoding gives the text again), a row per input row."""
    e = _encoder(path)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for s in tk.slices(batches, "_text"):
            plain, data, starts, ends = _marked(s)
            ids, counts = encode_slice(e, data, starts, ends)
            again, sizes = decode_slice(e, ids, counts)
            want = (ends - starts) - (ends > starts)
            exact = sizes == want
            if exact.all():
                differs = np.flatnonzero(again != plain)
                exact[np.searchsorted(np.cumsum(want), differs, side="right")] = False
            else:
                a, b = np.cumsum(sizes) - sizes, np.cumsum(want) - want
                exact = np.array([exact[i] and np.array_equal(again[a[i] : a[i] + sizes[i]], plain[b[i] : b[i] + want[i]]) for i in range(len(s))])
            offs = np.cumsum(np.append(0, counts)).astype(np.int32)
            is_byte = np.cumsum(np.append(0, np.isin(ids, e.byte_ids)))
            yield pa.RecordBatch.from_arrays(
                [s.rows.column(0), pa.ListArray.from_arrays(pa.array(offs), pa.array(ids)), pa.array(counts.astype(np.int64)), pa.array((is_byte[offs[1:]] - is_byte[offs[:-1]]).astype(np.int64)), pa.array(exact)],
                names=["_key", "ids", "n_tokens", "n_byte_tokens", "exact"],
            )

    out = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, f"_key {kind}, ids array<int>, n_tokens bigint, n_byte_tokens bigint, exact boolean")
    return out.withColumnRenamed("_key", key)


def decode(rows: DataFrame, ids: str = "ids", key: str = "doc_id", path: str = VOCABULARY) -> DataFrame:
    """key, text: the texts that the ids stand for. Bytes that are not UTF-8 become U+FFFD; null ids give an empty text."""
    e = _encoder(path)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                col = pc.fill_null(part.column(1), pa.scalar([], part.column(1).type))
                counts = pc.list_value_length(col).to_numpy(zero_copy_only=False)
                data, sizes = decode_slice(e, pc.list_flatten(col).to_numpy(zero_copy_only=False), counts)
                ends = np.cumsum(np.append(0, sizes))
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())], names=["_key", "text"])

    return rows.select(F.col(key).alias("_key"), F.col(ids).cast("array<int>").alias("_ids")).mapInArrow(run, f"_key {kind}, text string").withColumnRenamed("_key", key)


def op10_query(docs: DataFrame) -> DataFrame:
    """doc_id, ids, n_tokens, n_byte_tokens, exact."""
    return encode(docs)


__all__ = ["Encoder", "Vocabulary", "decode", "decode_slice", "double_array", "encode", "encode_slice", "encoder", "load", "op10_query", "solve", "vocabulary"]
