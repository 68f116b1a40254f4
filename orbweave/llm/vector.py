"""Whole-batch text kernels on Arrow buffers: token bounds, token hashes, shingles, all in NumPy.

Tokens are maximal runs of non-separator bytes of the UTF-8 text. A token's hash is a
polynomial over a random byte table modulo 2^64, taken from one prefix sum over the batch,
then finalised; it depends on the token's bytes alone.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) | U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 2**64)

#: Separators: ASCII white space.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Separators: every ASCII byte that is neither a letter, a digit nor an underscore.
NONWORD = np.ones(256, bool)
NONWORD[128:] = False
NONWORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95]] = False

CHUNK_BYTES = 1 << 20
_pow = np.ones(1, U64)
_inv = np.ones(1, U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, CHUNK_BYTES + 1)
        with np.errstate(over="ignore"):
            _pow = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(size, U64(_BASE))]))
            _inv = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(size, U64(_INV))]))
    return _pow, _inv


def tidy(run):
    """A batch function that gives unused memory back when its task ends, as Python workers outlive tasks."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def slices(batch: pa.RecordBatch, column: int = 1, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has about ``limit`` bytes of text; a longer text is a part by itself."""
    n = batch.num_rows
    if not n:
        return
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(size, size[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, nulls as empty, and its n + 1 offsets into them."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    off = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


class Tokens:
    """Tokens of a string array. ``start``/``end``: byte bounds; ``doc``: index of the row;
    ``first``: n + 1 bounds of the rows' tokens; ``hash``: a 64-bit hash each."""

    def __init__(self, texts: pa.Array, separators: np.ndarray = SPACE):
        b, off = raw(texts)
        self.bytes, self.off = b, off
        n = len(b)
        if not n:
            self.start = self.end = self.doc = np.zeros(0, np.int64)
            self.hash = np.zeros(0, U64)
            self.first = np.zeros(len(off), np.int64)
            return
        inside = ~separators[b]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        heads = off[:-1][off[:-1] < n]
        begin[heads] = inside[heads]
        stop = np.zeros(n + 1, bool)
        stop[1:n] = inside[:-1] & ~inside[1:]
        stop[n] = inside[-1]
        tails = off[1:][off[1:] > 0]
        stop[tails] = inside[tails - 1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(stop)
        power, inverse = _powers(n + 1)
        with np.errstate(over="ignore"):
            prefix = np.empty(n + 1, U64)
            prefix[0] = 0
            np.cumsum(_BYTE[b] * power[:n], out=prefix[1:])
            self.hash = mix((prefix[self.end] - prefix[self.start]) * inverse[self.start])
        self.first = np.searchsorted(self.start, off).astype(np.int64)
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))


def shingles(tok: Tokens, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the rows' ``n``-token shingles, their rows, and the index of each one's first token.

    A row of fewer than ``n`` tokens has one shingle of all its tokens; a row of none has none.
    """
    h, count = tok.hash, np.diff(tok.first)
    if not len(h):
        return h, tok.doc, tok.start
    left = np.repeat(tok.first[1:], count) - np.arange(len(h))
    with np.errstate(over="ignore"):
        acc = h * U64(0xD6E8FEB86659FD93)
        for j in range(1, n):
            nxt = np.zeros_like(h)
            nxt[:-j or None] = h[j:] if j else h
            acc = np.where(left > j, (acc ^ (acc >> U64(29))) * U64(0xFF51AFD7ED558CCD) + nxt, acc)
    full = left >= n
    head = np.zeros(len(h), bool)
    head[tok.first[:-1][(count > 0) & (count < n)]] = True
    at = np.flatnonzero(full | head)
    return mix(acc[at]), tok.doc[at], at


def char_offsets(b: np.ndarray, off: np.ndarray, at: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Code-point offsets, within their rows, of byte positions ``at``."""
    lead = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
    return lead[at] - lead[off[row]]
