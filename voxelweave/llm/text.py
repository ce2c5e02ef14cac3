"""Byte-level text helpers shared by the operators: Arrow views, word tables, shingles.

Texts are handled as UTF-8 bytes in numpy. Words are maximal runs of bytes outside
``[\\x20\\x09-\\x0D]`` and A-Z is lower-cased, which on UTF-8 equals the same rule on code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MIX1, MIX2, STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD1342543DE82EF95
#: Bytes of a span up to which it is hashed eight bytes at a time with all others; longer ones go through BLAKE2b.
LONG_SPAN = 512

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x + STEP
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def string_view(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string or binary column; a null counts as empty."""
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``max_bytes`` each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = string_view(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def segments(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``inside`` that do not cross a document: start, end (exclusive) and document number."""
    n = len(inside)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    cut = np.zeros(n + 1, bool)
    cut[offsets[:-1][offsets[:-1] < n]] = True
    cut[n] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last[:-1] &= ~inside[1:] | cut[1:n]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, "right") - 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the byte strings ``data[start:end]``; hashes of two seeds are independent.

    A chain of bijective mixers over eight bytes at a time, so strings of one length up to eight bytes never collide
    and no algebraic relation between strings carries over.
    """
    size = (end - start).astype(np.int64)
    state = mix64(size.astype(np.uint64) ^ np.uint64((seed * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF))
    words = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    live = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    at = 0
    while len(live):
        rest = size[live] - at
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (8 - np.minimum(rest, 8)).astype(np.uint64))
        state[live] = mix64(state[live] ^ (words[start[live] + at] & mask))
        live, at = live[rest > 8], at + 8
    for i in np.flatnonzero(size > LONG_SPAN):
        state[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return state


class Words:
    """The words of a slice of texts: document number, start, end and 64-bit hash of each (``wide``: a second one)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, wide: bool = False):
        self.n_docs = len(offsets) - 1
        self.data = _LOWER[data] if lower else data
        self.start, self.end, self.doc = segments(~_SPACE[self.data], offsets)
        self.hash = span_hashes(self.data, self.start, self.end)
        self.second = span_hashes(self.data, self.start, self.end, 1) if wide else None
        self.first = np.searchsorted(self.doc, np.arange(self.n_docs + 1))
        self.count = np.diff(self.first)


def shingles(words: Words, k: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(document, hash)`` of every run of ``k`` words, from word hashes ``h``; a document with 1 to k-1 words has its
    whole sequence as one. In order of document and place."""
    m = len(h)
    ok = words.doc[: m - k + 1] == words.doc[k - 1 :] if m >= k else np.zeros(0, bool)
    at = np.flatnonzero(ok)
    out = np.full(len(at), k, np.uint64)
    for j in range(k):
        out = out * np.uint64(BASE) + h[at + j]
    docs, vals = words.doc[at], mix64(out)
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(short):
        x = words.count[short].astype(np.uint64)
        for j in range(k - 1):
            more = words.count[short] > j
            x[more] = x[more] * np.uint64(BASE) + h[words.first[short[more]] + j]
        docs, vals = np.concatenate([docs, short]), np.concatenate([vals, mix64(x)])
        order = np.argsort(docs, kind="stable")
        docs, vals = docs[order], vals[order]
    return docs, vals


def per_doc_sets(words: Words, k: int) -> list[np.ndarray]:
    """The distinct shingles of each document as pairs of 64-bit hashes, sorted (words must be ``wide``)."""
    docs, one = shingles(words, k, words.hash)
    _, two = shingles(words, k, words.second)
    order = np.lexsort((two, one, docs))
    docs, pairs = docs[order], np.column_stack([one[order], two[order]])
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (pairs[1:] != pairs[:-1]).any(1)
    docs, pairs = docs[new], pairs[new]
    cuts = np.searchsorted(docs, np.arange(words.n_docs + 1))
    return [pairs[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
