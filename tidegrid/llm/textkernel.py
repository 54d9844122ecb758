"""Array kernels over the bytes of many texts at once, for operators that run in Arrow batches.

A slice is a run of rows whose texts lie back to back in one byte array. Slices are cut by bytes, so memory
follows SLICE and the longest single text, not the number of rows in a batch. Strings within a slice are
named by a 64-bit hash that mixes eight bytes at a time into its state. The hash of a string is the same in
every slice and task.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
SLICE_ROWS = 30_000
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: All bytes but letters, digits and those of characters beyond ASCII.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Spans of more bytes are hashed one by one.
LONG_SPAN = 1024
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@dataclass
class Slice:
    """rows: the other columns; data: bytes of all texts; starts, ends: where each row's text lies."""

    rows: pa.RecordBatch
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def give_back() -> None:
    """Return freed memory to the system: a worker that waits for its next task should hold little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE, most: int = SLICE_ROWS) -> Iterator[Slice]:
    """Cut batches into slices of about `limit` bytes and at most about `most` rows; a null text counts as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.schema.get_field_index(text)
        col = batch.column(k)
        size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cut = np.cumsum(size + limit / most) // limit
        edges = np.concatenate([[0], np.flatnonzero(np.diff(cut)) + 1, [len(col)]])
        others = batch.select([n for n in batch.schema.names if n != text])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            part = pc.fill_null(col.slice(a, b - a), "")  # a copy, if any, of one slice only
            width = np.int64 if pa.types.is_large_string(part.type) else np.int32
            offs = np.frombuffer(part.buffers()[1], width, len(part) + 1, part.offset * np.dtype(width).itemsize).astype(np.int64)
            raw = part.buffers()[2]
            data = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]] if raw is not None else np.empty(0, np.uint8)
            yield Slice(others.slice(a, b - a), data, offs[:-1] - offs[0], offs[1:] - offs[0])
        give_back()


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros after the end; a view of every place."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans of data, from their bytes alone: every eight bytes are mixed into the state, which begins with the length."""
    size = ends - starts
    at = eight_bytes(data)
    h = mix(size.astype(U64) * U64(_BASE))
    todo, depth = np.flatnonzero((size > 0) & (size <= LONG_SPAN)), 0
    while len(todo):
        left = size[todo] - depth
        h[todo] = mix(h[todo] ^ (at[starts[todo] + depth] & _MASKS[np.minimum(left, 8)])) + U64(_BASE)
        todo, depth = todo[left > 8], depth + 8
    for k in np.flatnonzero(size > LONG_SPAN).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return h


def same_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the `size` bytes from each a equal those from each b."""
    at = eight_bytes(data)
    ok = np.ones(len(a), bool)
    todo, depth = np.flatnonzero((size > 0) & (a != b)), 0
    while len(todo):
        left = size[todo] - depth
        mask = _MASKS[np.minimum(left, 8)]
        equal = ((at[a[todo] + depth] ^ at[b[todo] + depth]) & mask) == 0
        ok[todo[~equal]] = False
        todo, depth = todo[equal & (left > 8)], depth + 8
    return ok


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased."""
    return _LOWER[data]


def word_spans(s: Slice, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without bytes of `between`) of all rows, in order, and the row of each."""
    n = len(s.data)
    if not n:
        e = np.empty(0, np.int64)
        return e, e, e
    blank = between[s.data]
    word = ~blank
    first = word.copy()
    first[1:] &= blank[:-1]
    cuts = s.starts[s.starts < n]
    first[cuts] = word[cuts]
    last = word.copy()
    last[:-1] &= blank[1:]
    cuts = s.ends[s.ends > 0] - 1
    last[cuts] = word[cuts]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    return a, b, np.searchsorted(s.ends, a, side="right")


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal neighbours."""
    if not len(keys):
        e = np.empty(0, np.int64)
        return e, e
    a = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    return a, np.diff(np.concatenate([a, [len(keys)]]))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + length)."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    some = lengths > 0
    s, n = starts[some], lengths[some]
    if not len(s):
        return np.empty(0, np.int64)
    at = np.cumsum(n) - n
    out[at[0]] = s[0]
    out[at[1:]] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)


def one_slice(texts: list[str]) -> Slice:
    """The given texts as one slice, row i holding text i."""
    col = pa.array(texts, pa.large_string())
    return next(slices(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), col], names=["row", "text"])]), "text", 1 << 62))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words."""
    if len(hashes) < n:
        return np.empty(0, U64)
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out = out * U64(_BASE) + hashes[k : len(hashes) - n + 1 + k]
    return mix(out)
