"""Operator 10, benchmark decontamination: SimHash of item-sized windows in a multi-index, then exact similarity.

Texts are lower-cased word tokens; a shingle is three words (all of an item's words, if fewer).
A shingle weighs log(1 + items / items that have it), one that no item has as much as one of a single item; a window's similarity
to an item is the weighted Jaccard similarity of their shingle multisets, the window having as many words as the
item (a document with fewer words is one window).

1. Windows of every item length that occurs are screened: one reaches ``threshold`` with an item of its length only if its
   shingles of items of that length, of whatever item, weigh at least ``threshold`` of the lightest of them. No window that
   could be reported is left out.
2. TABLES independent SimHashes of BITS bits each are taken of the windows left (running sums, so a window's length costs nothing).
   Each is looked up in a multi-index of the items of its length: BLOCKS blocks, each probed with all
   values within RADIUS // BLOCKS bits. By the pigeonhole principle every item fingerprint within RADIUS bits is found; of unrelated
   items a lookup meets under 5 %. The candidates are those within RADIUS bits in some table.
3. Candidates are verified by exact weighted similarity, in running sums as well.

Two texts of similarity 0.6 are within RADIUS bits in one of the tables with probability about 0.9, of 0.7 with 0.99; neighbouring windows of
a passage are further chances.

The benchmark is a table in the shared folder, in pieces of at most PIECE_BYTES of text that tasks read; a larger one takes
several scans of the documents, with the same results, since weights come from one table of all items' frequencies.
Null and empty texts match nothing; so do items
without words. Repeated rows give one result row; repeated items are one. Of windows of equal similarity the first is reported. Very long texts and items
count whole, in time proportional to their length. A null doc_id or item_id is carried as null. Empty tables give no rows. Extra columns, also such with
clashing names, are ignored by :func:`contaminated` and passed through by :func:`drop_contaminated`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import Masked, pick, scratch_path, stored
from .near import Frequencies, exact_frequencies
from .vector import NONWORD, U64, Tokens, mix, shingles, slices

THRESHOLD, SHINGLE = 0.6, 3
BITS, BLOCKS, RADIUS, TABLES = 52, 4, 11, 4
WIDTH = BITS // BLOCKS
PIECE_BYTES = 16 << 20
#: Weights are whole multiples of 1 / SCALE, so that running sums are exact.
SCALE = 1 << 20
#: Shingles whose running sums are held at a time.
STEP = 1 << 15
_NEAR = np.array([sum(1 << b for b in c) for r in range(RADIUS // BLOCKS + 1) for c in combinations(range(WIDTH), r)], U64)
_SALT = np.random.Generator(np.random.PCG64(10)).integers(1, 2**63, TABLES, dtype=np.int64).astype(U64)


def _tokens(texts: pa.Array) -> Tokens:
    return Tokens(pc.utf8_lower(pc.fill_null(texts, "")), NONWORD)


def prints(h: np.ndarray, w: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """SimHashes (windows, TABLES) of the windows [start, end) of shingles ``h`` with integer weights ``w``."""
    out = np.zeros((len(start), TABLES), U64)
    total = np.zeros(len(h) + 1, np.int64)
    for t in range(TABLES):
        with np.errstate(over="ignore"):
            x = mix(h + _SALT[t])
        for b in range(BITS):
            np.cumsum(np.where((x >> U64(b)) & U64(1), w, -w), out=total[1:])
            out[:, t] |= (total[end] > total[start]).astype(U64) << U64(b)
    return out


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


def _expand(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ranges [lo, lo + n) one after another."""
    return np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


class MultiIndex:
    """Fingerprints (items, TABLES) by blocks."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.order, self.values = [], []
        for t in range(TABLES):
            for b in range(BLOCKS):
                v = self._block(marks[:, t], b)
                order = np.argsort(v, kind="stable")
                self.order.append(order)
                self.values.append(v[order])

    @staticmethod
    def _block(x: np.ndarray, b: int) -> np.ndarray:
        return (x >> U64(b * WIDTH)) & U64((1 << WIDTH) - 1)

    def met(self, x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``x``, item) of all items with a block of table ``t`` within RADIUS // BLOCKS bits; a pair may come several times."""
        rows, items = [], []
        for b in range(BLOCKS):
            values, order = self.values[t * BLOCKS + b], self.order[t * BLOCKS + b]
            probe = (self._block(x, b)[:, None] ^ _NEAR).ravel()
            lo = np.searchsorted(values, probe, "left")
            n = np.searchsorted(values, probe, "right") - lo
            some = np.flatnonzero(n)
            rows.append(np.repeat(some // len(_NEAR), n[some]))
            items.append(order[_expand(lo[some], n[some])])
        return np.concatenate(rows), np.concatenate(items)

    def lookup(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) pairs, sorted, of fingerprints ``x`` (rows, TABLES) within RADIUS bits in some table."""
        keys, n = [], len(self.marks)
        for a in range(0, len(x), 1 << 12):
            for t in range(TABLES):
                row, item = self.met(x[a : a + (1 << 12), t], t)
                near = distance(x[a + row, t], self.marks[item, t]) <= RADIUS
                keys.append((a + row[near]) * n + item[near])
        key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        return key // n, key % n


class Index:
    """The benchmark: known shingles, weights, and a multi-index for each length of items."""

    def __init__(self, ids: list[int | None], texts: pa.Array, frequencies: Frequencies):
        self.ids, self.frequencies = ids, frequencies
        tok = _tokens(texts)
        self.size = np.diff(tok.first)
        h, d, _ = shingles(tok, SHINGLE)
        w = self.weights(h)
        self.bounds = np.searchsorted(d, np.arange(len(ids) + 1))
        self.hash = h
        sums = np.concatenate([[0], np.cumsum(w)])
        self.total = sums[self.bounds[1:]] - sums[self.bounds[:-1]]
        self.keys, at, key = np.unique(h, return_index=True, return_inverse=True)
        self.weight = w[at]
        # The lengths of items that each shingle occurs in.
        lengths = np.unique(np.stack([key, self.size[d]]), axis=1)
        self.lengths, self.first = lengths[1], np.searchsorted(lengths[0], np.arange(len(self.keys) + 1))
        self.bits = max(16, int(len(self.keys)).bit_length() + 4)
        self.bitmap = np.zeros(1 << self.bits, bool)
        self.bitmap[self._slot(self.keys)] = True
        self.counts: dict[int, Counter] = {}
        self.classes: dict[int, tuple[np.ndarray, int, MultiIndex]] = {}
        marks = np.zeros((len(ids), TABLES), U64)
        for a, b in _chunks(np.diff(self.bounds)):
            lo, hi = self.bounds[a], self.bounds[b]
            marks[a:b] = prints(h[lo:hi], w[lo:hi], self.bounds[a:b] - lo, self.bounds[a + 1 : b + 1] - lo)
        for m in np.unique(self.size[self.size > 0]).tolist():
            own = np.flatnonzero(self.size == m)
            self.classes[m] = own, int(self.total[own].min()), MultiIndex(marks[own])

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h & U64((1 << self.bits) - 1)).astype(np.int64)

    def weights(self, h: np.ndarray) -> np.ndarray:
        return np.rint(np.log1p(self.frequencies.docs / self.frequencies.count(h)) * SCALE).astype(np.int64)

    def known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length of items, place in ``h``, weight) wherever an item of that length has the shingle, sorted."""
        at = np.flatnonzero(self.bitmap[self._slot(h)])
        k = np.searchsorted(self.keys, h[at])
        ok = k < len(self.keys)
        ok[ok] = self.keys[k[ok]] == h[at[ok]]
        at, k = at[ok], k[ok]
        n = self.first[k + 1] - self.first[k]
        length = self.lengths[_expand(self.first[k], n)]
        order = np.argsort(length, kind="stable")
        return length[order], np.repeat(at, n)[order], np.repeat(self.weight[k], n)[order]

    def similarities(self, h: list[int], w: list[int], item: int, windows: list[tuple[int, int]]) -> Iterator[float]:
        """Weighted Jaccard similarity of windows (start, end), by start, with an item; ``w``: the weights' running sum."""
        want = self.counts.get(item)
        if want is None:
            want = self.counts[item] = Counter(self.hash[self.bounds[item] : self.bounds[item + 1]].tolist())
        total = int(self.total[item])
        have: dict[int, int] = {}
        both, s, e = 0, 0, 0
        for a, z in windows:
            if a >= e:
                have, both, s, e = {}, 0, a, a
            for k in range(e, z):
                if (x := h[k]) in want:
                    c = have.get(x, 0)
                    have[x] = c + 1
                    if c < want[x]:
                        both += w[k + 1] - w[k]
            for k in range(s, a):
                if (x := h[k]) in want:
                    c = have[x] = have[x] - 1
                    if c < want[x]:
                        both -= w[k + 1] - w[k]
            s, e = a, z
            yield both / (w[z] - w[a] + total - both)

    def matches(self, texts: pa.Array, threshold: float) -> list[tuple[int, int, float, int]]:
        """(row, item, similarity, first word) of each row's best window for each item."""
        tok = _tokens(texts)
        words = np.diff(tok.first)
        out: list[tuple[int, int, float, int]] = []
        for n in sorted({min(SHINGLE, m) for m in self.classes}):
            h, doc, first = shingles(tok, n)
            bounds = np.searchsorted(doc, np.arange(len(words) + 1))
            lengths, places, weights = self.known(h)
            for m in (m for m in self.classes if min(SHINGLE, m) == n):
                own, least, index = self.classes[m]
                least = threshold * least * (1 - 1e-9)
                a, b = np.searchsorted(lengths, [m, m + 1])
                heavy = (np.bincount(doc[places[a:b]], weights[a:b], len(words)) >= least) & (words >= n)
                rows = np.flatnonzero(heavy)
                if not len(rows):
                    continue
                # The shingles of these rows one after another.
                lo, count = bounds[rows], bounds[rows + 1] - bounds[rows]
                at = _expand(lo, count)
                x = h[at]
                use = heavy[doc[places[a:b]]]
                known = np.zeros(len(at) + 1, np.int64)
                known[np.searchsorted(at, places[a:b][use]) + 1] = weights[a:b][use]
                known = np.cumsum(known)
                width = np.minimum(m - n + 1, count)
                begins = count - width + 1
                start = _expand(np.cumsum(count) - count, begins)
                end = start + np.repeat(width, begins)
                heavy = known[end] - known[start] >= least
                start, end = start[heavy], end[heavy]
                if not len(start):
                    continue
                full = self.weights(x)
                sums, plain = np.concatenate([[0], np.cumsum(full)]).tolist(), x.tolist()
                window, item = index.lookup(self._prints(x, full, start, end))
                row = doc[at[start[window]]]
                order = np.lexsort((window, item, row))
                window, item, row = window[order], item[order], row[order]
                cut = np.flatnonzero((row[1:] != row[:-1]) | (item[1:] != item[:-1])) + 1
                for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(window)]) if len(window) else ():
                    spans = list(zip(start[window[a:b]].tolist(), end[window[a:b]].tolist()))
                    best, place = max(zip(self.similarities(plain, sums, int(own[item[a]]), spans), (-s for s, _ in spans)))
                    if best >= threshold:
                        out.append((int(row[a]), int(own[item[a]]), best, int(first[at[-place]] - tok.first[row[a]])))
        return sorted(out)

    @staticmethod
    def _prints(h: np.ndarray, w: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Fingerprints of windows sorted by start; only the shingles that they cover are summed, some windows at a time."""
        out = np.zeros((len(start), TABLES), U64)
        at = 0
        while at < len(start):
            to = max(at + 1, int(np.searchsorted(start, start[at] + STEP)))
            # What the windows cover, without the gaps.
            s, e = start[at:to] - start[at], end[at:to] - start[at]
            cover = np.zeros(int(e.max()) + 1, np.int64)
            np.add.at(cover, s, 1)
            np.add.at(cover, e, -1)
            inside = np.cumsum(cover)[:-1] > 0
            place = np.concatenate([[0], np.cumsum(inside)])
            held = np.flatnonzero(inside) + start[at]
            out[at:to] = prints(h[held], w[held], place[s], place[e])
            at = to
        return out


def _chunks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of together about STEP."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + STEP)))
        yield a, b
        a = b


_loaded: dict[str, Index] = {}


def _load(path: str, frequencies: Frequencies) -> Index:
    """The index of a piece; the last one is kept by the worker."""
    if path not in _loaded:
        _loaded.clear()
        fs, at = pyarrow.fs.FileSystem.from_uri(path)
        t = pyarrow.dataset.dataset(at, filesystem=fs, format="parquet").to_table(["item_id", "text"])
        _loaded[path] = Index(t.column(0).to_pylist(), t.column(1).combine_chunks(), frequencies)
    return _loaded[path]


def _pieces(benchmark: DataFrame) -> tuple[list[str], Frequencies | None]:
    """(paths of the benchmark's pieces, frequencies of its shingles)."""
    items = stored(pick(benchmark, item_id="bigint", text="string").filter("text is not null").distinct(), "benchmark")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0]
    if size is None:
        return [], None
    path = scratch_path(items.sparkSession, "benchmark-pieces")
    pieces = int(size // PIECE_BYTES) + 1
    items.withColumn("piece", F.pmod(F.xxhash64("item_id", "text"), F.lit(pieces))).repartition("piece").write.partitionBy("piece").parquet(path)
    found = [r.piece for r in items.sparkSession.read.parquet(path).select("piece").distinct().collect()]
    return [f"{path}/piece={k}" for k in sorted(found)], exact_frequencies(items)


def _match(path: str, frequencies: Frequencies, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _load(path, frequencies)
        for big in batches:
            for b in slices(big):
                got = index.matches(b.column(1), threshold)
                if got:
                    yield pa.record_batch(
                        [b.column(0).take(pa.array([g[0] for g in got])), pa.array([index.ids[g[1]] for g in got], pa.int64()), pa.array([g[2] for g in got]), pa.array([g[3] for g in got], pa.int32())],
                        names=["doc_id", "item_id", "similarity", "word"],
                    )

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, similarity, word): documents with a window like a benchmark item, and the best window's first word.
    One scan of the documents for each piece of the benchmark; only matches are shuffled."""
    rows = pick(docs, doc_id="bigint", text="string")
    kind = "doc_id bigint, item_id bigint, similarity double, word int"
    out = None
    paths, frequencies = _pieces(benchmark)
    for path in paths:
        part = rows.mapInArrow(_match(path, frequencies, threshold), kind)
        out = part if out is None else out.unionAll(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], kind)
    best = F.max(F.struct("similarity", (-F.col("word")).alias("w"))).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("b.similarity").alias("similarity"), (-F.col("b.w")).cast("int").alias("word"))


def _clean(path: str, frequencies: Frequencies, at: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _load(path, frequencies)
        for big in batches:
            for b in slices(big, at):
                good = np.ones(b.num_rows, bool)
                good[[g[0] for g in index.matches(b.column(at), threshold)]] = False
                yield b.filter(pa.array(good))

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without a benchmark passage; all columns as they are. No shuffle of documents."""
    m = Masked(docs)
    out, at = m.df, m.names.index("text")
    paths, frequencies = _pieces(benchmark)
    for path in paths:
        out = out.mapInArrow(_clean(path, frequencies, at, threshold), m.df.schema)
    return m.restore(out)
