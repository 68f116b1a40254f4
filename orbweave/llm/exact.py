"""Operator 4, exact dedup: a log-structured merge index of digests, then byte verification.

Every document's 128-bit digest goes to the partition of its first half. There an index takes
digests batch by batch: a memtable fills, is sorted and flushed as a run with a Bloom filter;
each flushed run is probed against the older ones (filter first, binary search after), and runs
of like size are compacted, keeping the smallest identifier of each digest. Digests met more
than once are hits. The documents of hits alone are then compared byte for byte, so a digest
collision never joins different texts.

Results: the smallest doc_id of byte-equal texts is kept. A null text equals no other and is
always kept. Empty texts equal one another; very long texts are digested and compared whole. Rows repeated with one doc_id are copies too: the
filter keeps one of them, that with the least JSON of its other columns, so ties don't depend on partitions. A null doc_id
sorts after all others. An empty table gives an empty result. Extra columns, also such with clashing names, are ignored
by :func:`exact_copies` and passed through by :func:`drop_exact_copies`.

A partition's index lives in its task's memory: about 40 bytes a distinct digest, 1.25 to 2.5 of them filter. So digests are spread
over more partitions than the session's default when there are more than PART_BYTES of them for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import Masked, join_checked, pick, spread, stored

LAST = 2**63 - 1


class Run:
    """A sorted, immutable run of digests with smallest identifiers, counts and a Bloom filter."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, ident: np.ndarray, count: np.ndarray):
        order = np.lexsort((ident, lo, hi))
        hi, lo, ident, count = hi[order], lo[order], ident[order], count[order]
        head = np.ones(len(hi), bool)
        head[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        at = np.flatnonzero(head)
        self.hi, self.lo, self.id = hi[at], lo[at], ident[at]
        self.count = np.add.reduceat(count, at) if len(at) else count
        bits = max(64, 1 << int(np.ceil(np.log2(max(1, len(at)) * 10))))
        self.mask = np.uint64(bits - 1)
        self.filter = np.zeros(bits >> 3, np.uint8)
        for k in self._probes(self.hi, self.lo):
            np.bitwise_or.at(self.filter, k >> 3, np.left_shift(1, k & 7).astype(np.uint8))

    def _probes(self, hi, lo):
        with np.errstate(over="ignore"):
            a, b = hi.astype(np.uint64), lo.astype(np.uint64) | np.uint64(1)
            return [((a + np.uint64(j) * b) & self.mask).astype(np.int64) for j in range(4)]

    def find(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The index of each digest in this run, or -1."""
        out = np.full(len(hi), -1, np.int64)
        maybe = np.ones(len(hi), bool)
        for k in self._probes(hi, lo):
            maybe &= (self.filter[k >> 3] >> (k & 7).astype(np.uint8)) & 1 == 1
        q = np.flatnonzero(maybe)
        left, right = np.searchsorted(self.hi, hi[q], "left"), np.searchsorted(self.hi, hi[q], "right")
        for step in range(int((right - left).max(initial=0))):
            at = left + step
            ok = at < right
            ok[ok] = self.lo[at[ok]] == lo[q[ok]]
            out[q[ok]] = at[ok]
        return out


class MergeIndex:
    """The log-structured merge index of one partition."""

    def __init__(self, memtable: int = 1 << 18, fan: int = 4):
        self.memtable, self.fan = memtable, fan
        self.buffer: list[tuple] = []
        self.size = 0
        self.runs: list[Run] = []
        self.hits: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, hi: np.ndarray, lo: np.ndarray, ident: np.ndarray) -> None:
        self.buffer.append((hi, lo, ident))
        self.size += len(hi)
        if self.size >= self.memtable:
            self.flush()

    def flush(self) -> None:
        if not self.size:
            return
        hi, lo, ident = (np.concatenate(x) for x in zip(*self.buffer))
        self.buffer, self.size = [], 0
        run = Run(hi, lo, ident, np.ones(len(hi), np.int64))
        twice = run.count > 1
        for old in self.runs:
            twice |= old.find(run.hi, run.lo) >= 0
        if twice.any():
            self.hits.append((run.hi[twice], run.lo[twice]))
        self.runs.append(run)
        while len(self.runs) >= self.fan and len(self.runs[-self.fan].hi) <= self.fan * len(self.runs[-1].hi):
            self.compact(self.fan)

    def compact(self, n: int) -> None:
        """Merge the last ``n`` runs, keeping the smallest identifier of each digest."""
        part = self.runs[-n:]
        self.runs[-n:] = [Run(*(np.concatenate([getattr(r, k) for r in part]) for k in ("hi", "lo", "id", "count")))]

    def duplicates(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Digests met more than once: (hi, lo, smallest identifier, count)."""
        self.flush()
        if not self.hits:
            z = np.zeros(0, np.int64)
            return z, z, z, z
        keys = Run(*(np.concatenate(x) for x in zip(*self.hits)), np.zeros(sum(len(h) for h, _ in self.hits), np.int64), np.ones(sum(len(h) for h, _ in self.hits), np.int64))
        best, count = np.full(len(keys.hi), LAST), np.zeros(len(keys.hi), np.int64)
        for r in self.runs:
            at = r.find(keys.hi, keys.lo)
            ok = at >= 0
            best[ok] = np.minimum(best[ok], r.id[at[ok]])
            count[ok] += r.count[at[ok]]
        return keys.hi, keys.lo, best, count


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = MergeIndex()
    for b in batches:
        index.add(*(b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)))
    hi, lo, best, count = index.duplicates()
    yield pa.record_batch([pa.array(hi), pa.array(lo), pa.array(best), pa.array(count)], names=["k1", "k2", "first", "n"])


def digests(text):
    """Two independent 64-bit hashes of a text column."""
    return F.xxhash64(text), F.xxhash64(F.lit(7919), text)


def repeated_digests(keyed: DataFrame, count: int) -> DataFrame:
    """(k1, k2, first, n) of digests that several rows of ``keyed`` (k1, k2, id), of at most ``count``, have; stored."""
    rows = spread(keyed, count * 24, "k1")
    return stored(rows.mapInArrow(_index, "k1 bigint, k2 bigint, first bigint, n bigint"), "digests")


def exact_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id): every document whose text is byte-equal to that of a smaller doc_id, keep_id the smallest."""
    rows = pick(docs, doc_id="bigint", text="string").filter("text is not null")
    k1, k2 = digests(F.col("text"))
    hits = repeated_digests(rows.select(k1.alias("k1"), k2.alias("k2"), F.coalesce("doc_id", F.lit(LAST)).alias("id")), docs.count())
    keyed = rows.select(k1.alias("k1"), k2.alias("k2"), "doc_id", "text")
    some = join_checked(keyed, hits.select("k1", "k2"), ["k1", "k2"], "left_semi", 24)
    kept = some.groupBy("k1", "k2", "text").agg(F.min("doc_id").alias("keep_id"))
    return (
        some.join(kept, ["k1", "k2", "text"])
        .filter("doc_id is null or doc_id <> keep_id")
        .select("doc_id", "keep_id").distinct()
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The documents without exact copies; of each group of byte-equal texts one row stays, that of the smallest doc_id."""
    m = Masked(docs)
    k1, k2 = digests(m["text"].cast("string"))
    keyed = m.df.withColumns({"k1": k1, "k2": k2, "id": F.coalesce(m["doc_id"].cast("bigint"), F.lit(LAST)), "body": m["text"].cast("string")})
    hits = repeated_digests(keyed.filter("body is not null").select("k1", "k2", "id"), docs.count()).select("k1", "k2")
    alone = join_checked(keyed.filter("body is not null"), hits, ["k1", "k2"], "left_anti", 24)
    some = join_checked(keyed.filter("body is not null"), hits, ["k1", "k2"], "left_semi", 24)
    others = [c for c, n in zip(m.cols, m.names) if n != "text"]
    rank = F.struct("id", F.to_json(F.struct(*others))) if others else F.struct("id")
    best = some.groupBy("k1", "k2", "body").agg(F.min_by(F.struct(*m.cols), rank).alias("r")).select("r.*")
    return m.restore(alone.select(*m.cols).unionAll(best).unionAll(keyed.filter("body is null").select(*m.cols)))


ORACLE = """
SELECT doc_id, keep_id FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id FROM documents WHERE text IS NOT NULL
) WHERE doc_id <> keep_id"""
