"""Operator 8, near-duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

A document's features are its distinct three-word shingles (lower case; all its words, if fewer), each
weighing tf * idf. Document frequencies are exact, counted over all documents: tasks send sorted hashes by range, those
with a frequency above 1 are written to the shared folder, one file a range, and looked up there (mapped, if the folder is
local); all others have frequency 1. SAMPLES consistent weighted samples (Ioffe 2010; the probability
that two documents agree in one is their weighted Jaccard similarity) are cut into bands of ROWS. Documents that
agree in a band are candidates; at similarity 0.5 a pair shares a band with probability 0.91, at 0.6 with 0.986.

Within a band's bucket pairs are weighed by their samples first: one is promising if it agrees in at least
AGREE samples, three standard deviations below what the threshold would give. In a first pass each bucket's documents go to
leaders (the smallest doc_id left takes all that are promising with it, and so on); the promising pairs are verified by exact
weighted Jaccard similarity of whole texts and closed to groups. Of documents that agree in all samples only the smallest is
bucketed; the others are verified against it. In a second pass every promising pair of a bucket whose
documents are not yet in one group is verified. So the groups are those of all promising pairs,
though a group of thousands of copies costs verifications in proportion to its size. No bucket is skipped or cut; large ones
are searched by pairs of samples, which finds the same pairs without comparing all with all.
The smallest doc_id of each group (connected component) is kept.

A text without words (null, empty, punctuation) is in no group, nor is a row with a null doc_id. Very long texts count whole. Rows with
one doc_id are one document: if their texts differ all are sketched and the least text is compared. Exact copies are near copies. Ties in
similarity need no order, as groups are connected components. An empty table gives no rows. Extra columns, also such with clashing names, are
ignored by :func:`near_copies` and passed through by :func:`drop_near_copies`.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import Masked, delete, drop_stored, join_checked, pick, scratch_path, spread, stored
from .vector import NONWORD, U64, Tokens, mix, shingles, slices, tidy

THRESHOLD, SHINGLE, BITS = 0.5, 3, 18
BANDS, ROWS = 18, 3
SAMPLES = BANDS * ROWS
#: Least samples that a promising pair agrees in.
AGREE = int(SAMPLES * THRESHOLD - 3 * (SAMPLES * THRESHOLD * (1 - THRESHOLD)) ** 0.5)
_rng = np.random.Generator(np.random.PCG64(8))
_POOL = 1 << 16
_R = _rng.gamma(2, 1, _POOL).astype(np.float32)
_INV_R = (1 / _R).astype(np.float32)
_LN_C = np.log(_rng.gamma(2, 1, _POOL)).astype(np.float32)
_BETA = _rng.random(_POOL).astype(np.float32)
_ODD = _rng.integers(0, 2**63, SAMPLES, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash, tf), sorted by row and hash."""
    tok = Tokens(pc.utf8_lower(pc.fill_null(texts, "")), NONWORD)
    h, doc, _ = shingles(tok, SHINGLE)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    head = np.ones(len(h), bool)
    head[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(head)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> U64(64 - BITS)).astype(np.int64)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(1 << BITS, np.int64), 0
    for big in batches:
        for b in slices(big):
            n += b.num_rows
            df += np.bincount(_bucket(features(b.column(1))[1]), minlength=1 << BITS)
    at = np.flatnonzero(df)
    yield pa.record_batch([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["f", "n"])


def inverse_frequencies(rows: DataFrame) -> np.ndarray:
    """idf by bucket, over all of ``rows`` (doc_id, text); an estimate of fixed size to compare with."""
    counts = rows.mapInArrow(tidy(_frequencies), "f bigint, n bigint").groupBy("f").agg(F.sum("n").alias("n")).toPandas()
    df, total = np.zeros(1 << BITS), int(counts.n[counts.f == -1].sum())
    real = counts[counts.f >= 0]
    df[real.f.to_numpy()] = real.n.to_numpy()
    return np.maximum(np.log((1 + total) / (1 + df)), 0.05).astype(np.float32)


#: Bytes of text for each range of hashes, and hashes that a task holds before it sends them.
RANGE_BYTES, HELD = 16 << 20, 1 << 21


def _ranged(bits: int):
    """Rows (part, hashes, counts): sorted shingles with their document frequency; part -1 has the number of documents."""

    def send(held: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        cuts = np.searchsorted(h >> U64(64 - bits), np.arange((1 << bits) + 1).astype(U64))
        full = np.flatnonzero(np.diff(cuts))
        n = n.astype(np.uint32)
        return pa.record_batch([pa.array(full, pa.int64()), *(pa.array([x[cuts[k] : cuts[k + 1]].tobytes() for k in full], pa.binary()) for x in (h, n))], names=["part", "hashes", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, docs = [], 0, 0
        for big in batches:
            for b in slices(big):
                docs += b.num_rows
                held.append(features(b.column(1))[1])
                size += len(held[-1])
                if size > HELD:
                    yield send(held)
                    held, size = [], 0
        if size:
            yield send(held)
        yield pa.record_batch([pa.array([-1], pa.int64()), pa.array([b""], pa.binary()), pa.array([np.array([docs], np.uint32).tobytes()], pa.binary())], names=["part", "hashes", "counts"])

    return run


def _merged(path: str):
    """Writes each range's frequencies above 1 to ``path``; rows (part, n): how many, for part -1 the documents."""

    def write(part: int, held: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        h, n = np.frombuffer(b"".join(x for x, _ in held), U64), np.frombuffer(b"".join(x for _, x in held), np.uint32)
        if part < 0:
            return pa.record_batch([pa.array([part]), pa.array([int(n.sum(dtype=np.int64))])], names=["part", "n"])
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order]
        head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        n = np.add.reduceat(n, head, dtype=np.uint32)
        h, n = h[head][n > 1], n[n > 1]
        fs, at = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(at)
        own = f"{at}/.{part}-{uuid.uuid4().hex}"
        with fs.open_output_stream(own) as f:
            f.write(h.tobytes())
            f.write(n.tobytes())
        fs.move(own, f"{at}/{part}")
        return pa.record_batch([pa.array([part]), pa.array([len(h)])], names=["part", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for b in batches:
            for k, h, n in zip(*(b.column(i).to_pylist() for i in range(3))):
                if held and k != part:
                    yield write(part, held)
                    held = []
                part = k
                held.append((h, n))
        if held:
            yield write(part, held)

    return run


class Frequencies:
    """Exact document frequencies in files by range of hashes."""

    def __init__(self, path: str, bits: int, sizes: dict[int, int], docs: int, text_bytes: int = 0):
        self.path, self.bits, self.sizes, self.docs, self.text_bytes = path, bits, sizes, docs, text_bytes
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __getstate__(self):
        return self.__dict__ | {"open": {}}

    def _part(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k in self.open:
            return self.open[k]
        fs, at = pyarrow.fs.FileSystem.from_uri(f"{self.path}/{k}")
        n = self.sizes[k]
        if isinstance(fs, pyarrow.fs.LocalFileSystem):
            self.open[k] = np.memmap(at, U64, "r", 0, n), np.memmap(at, np.uint32, "r", 8 * n, n)
            return self.open[k]
        with fs.open_input_stream(at) as f:
            data = f.read()
        return np.frombuffer(data, U64, n), np.frombuffer(data, np.uint32, n, 8 * n)

    def count(self, h: np.ndarray) -> np.ndarray:
        order = np.argsort(h)
        x, df = h[order], np.ones(len(h), np.int64)
        cuts = np.searchsorted(x >> U64(64 - self.bits), np.arange((1 << self.bits) + 1).astype(U64))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            if self.sizes.get(k):
                keys, counts = self._part(k)
                own = x[cuts[k] : cuts[k + 1]]
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                df[order[cuts[k] : cuts[k + 1]]] = np.where(keys[at] == own, counts[at], 1)
        return df

    def idf(self, h: np.ndarray) -> np.ndarray:
        return np.maximum(np.log((1 + self.docs) / (1 + self.count(h))), 0.05).astype(np.float32)


def exact_frequencies(rows: DataFrame) -> Frequencies:
    """Document frequencies of all shingles of ``rows`` (doc_id, text)."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(1, int(size // RANGE_BYTES).bit_length())
    path = scratch_path(rows.sparkSession, "near-frequencies")
    sent = spread(rows.mapInArrow(tidy(_ranged(bits)), "part bigint, hashes binary, counts binary"), 2 * size, "part").sortWithinPartitions("part")
    got = {r.part: r.n for r in sent.mapInArrow(tidy(_merged(path)), "part bigint, n bigint").collect()}
    return Frequencies(path, bits, {k: n for k, n in got.items() if k >= 0}, got.get(-1, 0), size)


def weigh(idf: np.ndarray | Frequencies, h: np.ndarray) -> np.ndarray:
    """idf of shingles, exact or from a table by bucket."""
    return idf.idf(h) if isinstance(idf, Frequencies) else idf[_bucket(h)]


def sketch(doc: np.ndarray, h: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows with features, their samples): SAMPLES 32-bit hashes of the chosen (shingle, level) each."""
    head = np.flatnonzero(np.diff(doc, prepend=-1))
    out = np.empty((len(head), SAMPLES), np.uint32)
    step = 1 << 15
    # Blocks of whole rows that stay in cache.
    cuts, k = [0], 0
    while k < len(head):
        k = max(k + 1, int(np.searchsorted(head, head[k] + step)))
        cuts.append(min(k, len(head)))
    for a, b in zip(cuts[:-1], cuts[1:]):
        lo, hi = head[a], head[b] if b < len(head) else len(doc)
        x, ln_s = h[lo:hi], np.log(weight[lo:hi]).astype(np.float32)
        low = x.astype(np.uint32)
        starts = head[a:b] - lo
        with np.errstate(over="ignore"):
            for i in range(SAMPLES):
                at = ((x * _ODD[i]) >> U64(48)).astype(np.int64)
                r, beta = _R[at], _BETA[at]
                t = np.floor(ln_s * _INV_R[at] + beta)
                ln_a = _LN_C[at] - r * (t + np.float32(1) - beta)
                bits = ln_a.view(np.int32)
                key = (bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))).astype(np.int64) << 32
                key |= (low ^ (t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1))).astype(np.int64)
                out[a:b, i] = np.minimum.reduceat(key, starts).astype(np.uint64).astype(np.uint32)
    return doc[head], out


def _sketched(idf: np.ndarray | Frequencies):
    """Rows (doc_id, keys, samples): the bands' keys, and a byte of each sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big):
                doc, h, tf = features(b.column(1))
                if not len(doc):
                    continue
                rows, s = sketch(doc, h, tf * weigh(idf, h))
                keys = np.zeros((len(rows), BANDS), U64)
                with np.errstate(over="ignore"):
                    for j in range(ROWS):
                        keys = mix(keys * U64(0x9E3779B97F4A7C15) + s[:, j::ROWS].astype(U64) + U64(1))
                    small = mix(s.astype(U64) + U64(7)).astype(np.uint8)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel().view(np.int64)))
                yield pa.record_batch([b.column(0).take(pa.array(rows)), lists, pa.array([x.tobytes() for x in small], pa.binary())], names=["doc_id", "keys", "samples"])

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(band, doc_ids, labels, samples) of each bucket, from rows (band, key, doc_id, label, samples) sorted by bucket and doc_id."""
    held: list[tuple] = []

    def whole():
        return held[0][0][0], *(np.concatenate(x) for x in list(zip(*held))[1:])

    for b in batches:
        if not b.num_rows:
            continue
        band, key, doc, label = (b.column(i).to_numpy() for i in range(4))
        samples = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint8).reshape(-1, SAMPLES)
        cut = np.flatnonzero((band[1:] != band[:-1]) | (key[1:] != key[:-1])) + 1
        for lo, hi in zip([0, *cut], [*cut, b.num_rows]):
            if held and held[-1][0] != (band[lo], key[lo]):
                yield whole()
                held = []
            held.append(((int(band[lo]), int(key[lo])), doc[lo:hi], label[lo:hi], samples[lo:hi]))
    if held:
        yield whole()


#: A larger bucket is searched by its samples' pairs, and groups up to FEW of equal pairs at once. Neither changes what is found.
SPLIT, FEW = 1024, 32


def _agree(samples: np.ndarray, i, j) -> np.ndarray:
    return (samples[i] == samples[j]).sum(-1) >= AGREE


def _groups(samples: np.ndarray, band: int) -> Iterator[tuple[np.ndarray | None, np.ndarray, np.ndarray]]:
    """All pairs of a bucket that are promising are in a group or a pair of these: (rows of a group, -, -) or (None, i, j), i < j.

    Beside the band's own samples, that all rows share, a promising pair agrees in AGREE - ROWS others. These are cut into one
    part less, so by the pigeonhole principle in some part it agrees in two samples: rows are grouped by every two samples of a part.
    """
    others = np.setdiff1d(np.arange(SAMPLES), np.arange(band * ROWS, band * ROWS + ROWS))
    for part in np.array_split(others, AGREE - ROWS - 1):
        for x, y in itertools.combinations(part.tolist(), 2):
            key = samples[:, x].astype(np.uint16) << 8 | samples[:, y]
            order = np.argsort(key, kind="stable")
            key = key[order]
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(head, len(key)))
            for a, n in zip(head[size > FEW].tolist(), size[size > FEW].tolist()):
                yield order[a : a + n], order[:0], order[:0]
            few = np.repeat(size <= FEW, size)
            order, key = order[few], key[few]
            for k in range(1, FEW):
                at = np.flatnonzero(key[k:] == key[:-k])
                if not len(at):
                    break
                i, j = order[at], order[at + k]
                ok = _agree(samples, i, j)
                if ok.any():
                    yield None, i[ok], j[ok]


def _led(rows: np.ndarray, samples: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(leader, members): the first row left takes all that are promising with it, and so on."""
    while len(rows) > 1:
        near = _agree(samples, rows[1:], rows[0])
        if near.any():
            yield np.full(int(near.sum()), rows[0]), rows[1:][near]
        rows = rows[1:][~near]


def _leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Promising pairs that lead from each document of a bucket to a smaller one, if there is one."""
    out = Edges()
    for band, doc, _, samples in _buckets(batches):
        if len(doc) <= SPLIT:
            for i, j in _led(np.arange(len(doc)), samples):
                yield from out.add(doc[i], doc[j])
            continue
        up = np.arange(len(doc)).tolist()

        def top(x: int, up: list[int] = up) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for rows, a, b in _groups(samples, band):
            for i, j in [(a, b)] if rows is None else _led(rows, samples):
                new = []  # of pairs that are linked already one way is enough
                for k, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
                    if (x := top(x)) != (y := top(y)):
                        up[max(x, y)] = min(x, y)
                        new.append(k)
                yield from out.add(doc[i[new]], doc[j[new]])
    yield from out.rest()


def _apart(rows: np.ndarray, samples: np.ndarray, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Promising pairs with different labels; every row but those of the commonest label is compared with the others."""
    names, own = np.unique(label[rows], return_inverse=True)
    if len(names) == 1:
        return
    most = np.bincount(own).argmax()
    base, rest = rows[own == most], rows[own != most]
    for k, i in enumerate(rest):
        far = rest[k + 1 :]
        far = np.concatenate([base, far[label[far] != label[i]]])
        far = far[_agree(samples, far, i)]
        if len(far):
            yield np.minimum(far, i), np.maximum(far, i)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All promising pairs of documents with different labels."""
    out = Edges()
    for band, doc, label, samples in _buckets(batches):
        if (label == label[0]).all():
            continue
        if len(doc) <= SPLIT:
            for i, j in _apart(np.arange(len(doc)), samples, label):
                yield from out.add(doc[i], doc[j])
            continue
        for rows, a, b in _groups(samples, band):
            for i, j in [(a, b)] if rows is None else _apart(rows, samples, label):
                ok = label[i] != label[j]
                yield from out.add(doc[i[ok]], doc[j[ok]])
    yield from out.rest()


class Edges:
    """Pairs (a, b), a < b, gathered to batches without those repeated within."""

    def __init__(self):
        self.a, self.b, self.n = [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(a):
            self.a.append(a)
            self.b.append(b)
            self.n += len(a)
            if self.n > 100_000:
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            both = np.unique(np.stack([np.concatenate(self.a), np.concatenate(self.b)]), axis=1)
            yield pa.record_batch([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])
        self.a, self.b, self.n = [], [], 0


class Verifier:
    """Exact weighted Jaccard similarity over a stream of rows (a, b, text): a leader's row (b null) and then its members'."""

    def __init__(self, idf: np.ndarray | Frequencies):
        self.idf = idf
        self.leader = -1
        self.hash, self.weight = np.zeros(0, U64), np.zeros(0)

    def feed(self, a: np.ndarray, member: np.ndarray, texts: pa.Array) -> np.ndarray:
        """Similarity of every row to its leader; rows of leaders get 1. 0 where one has no words."""
        row, h, tf = features(texts)
        w = tf * weigh(self.idf, h).astype(np.float64)
        # Leader 0 is the one carried over; a group's number is that of its first row here.
        new = np.flatnonzero(~member)
        number = np.searchsorted(a[new], a, "right")
        own = ~member[row]
        with np.errstate(over="ignore"):
            salt = U64(0x9E3779B97F4A7C15)
            ka = np.concatenate([mix(self.hash), mix(h[own] + number[row[own]].astype(U64) * salt)])
            kb = mix(h + number[row].astype(U64) * salt)
        wa = np.concatenate([self.weight, w[own]])
        totals = np.bincount(number[row[own]], w[own], len(new) + 1)
        totals[0] = self.weight.sum()
        order = np.argsort(ka)
        ka, wa = ka[order], wa[order]
        both = np.zeros(len(a))
        if len(ka) and len(kb):
            at = np.minimum(np.searchsorted(ka, kb), len(ka) - 1)
            same = ka[at] == kb
            both = np.bincount(row[same], np.minimum(wa[at[same]], w[same]), len(a))
        union = totals[number] + np.bincount(row, w, len(a)) - both
        if len(new):
            last = row == new[-1]
            self.hash, self.weight = h[last], w[last]
        return np.where(union > 0, both / np.maximum(union, 1e-12), 0.0)


def _verify(idf: np.ndarray | Frequencies, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Verifier(idf)
        for big in batches:
            for c in slices(big, 2):
                member = ~np.array(c.column(1).is_null())
                similar = v.feed(c.column(0).to_numpy(), member, c.column(2))
                yield c.filter(pa.array(member & (similar >= threshold))).select(["a", "b"])

    return run


def similar_pairs(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """((a, b) with a < b: verified pairs that connect every group, (doc_id, keep_id) of their groups)."""
    rows = pick(docs, doc_id="bigint", text="string").filter("doc_id is not null and text is not null")
    idf = exact_frequencies(rows)
    sketches = stored(rows.mapInArrow(tidy(_sketched(idf)), "doc_id bigint, keys array<bigint>, samples binary"), "near-sketches")
    # Documents with all samples equal, exact copies above all, are verified against the smallest of them, which alone is bucketed.
    same = [F.col("samples"), F.col("keys")]
    chosen = stored(sketches.groupBy(*same).agg(F.min("doc_id").alias("doc_id"), F.count_distinct("doc_id").alias("n")), "near-chosen")
    many = chosen.filter("n > 1").select(*same, F.col("doc_id").alias("a"))
    twins = stored(sketches.join(many, ["samples", "keys"]).filter("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct(), "near-twins")
    bucket = W.partitionBy("band", "key")
    bands = chosen.select("doc_id", F.posexplode("keys").alias("band", "key"))
    members = stored(bands.withColumn("n", F.count("*").over(bucket)).filter("n > 1").drop("n").distinct(), "near-buckets")
    wanted = stored(members.select("doc_id").unionByName(twins.select(F.col("a").alias("doc_id"))).unionByName(twins.select(F.col("b").alias("doc_id"))).distinct(), "near-candidates")
    texts = stored(join_checked(rows, wanted, "doc_id", "left_semi", 16).groupBy("doc_id").agg(F.min("text").alias("text")), "near-texts")
    many_rows = members.count() * (SAMPLES + 64)
    sampled = stored(join_checked(chosen.select("doc_id", "samples"), wanted, "doc_id", "left_semi", 16).groupBy("doc_id").agg(F.min("samples").alias("samples")), "near-samples")
    drop_stored(sketches)
    drop_stored(chosen)

    def proposed(labels: DataFrame | None) -> DataFrame:
        m = join_checked(members, sampled, "doc_id", "inner", SAMPLES + 48)
        if labels is None:
            m = m.withColumn("keep_id", F.col("doc_id"))
        else:
            m = m.join(labels, "doc_id", "left").withColumn("keep_id", F.coalesce("keep_id", "doc_id"))
        ordered = m.select("band", "key", "doc_id", "keep_id", "samples")
        ordered = spread(ordered, many_rows, "band", "key").sortWithinPartitions("band", "key", "doc_id")
        return stored(ordered.mapInArrow(_leaders if labels is None else _across, "a bigint, b bigint").distinct(), "near-proposed")

    def verified(pairs: DataFrame) -> DataFrame:
        # Each text is sent once per pair it is a member of, and a leader's once: no row holds two texts.
        member = pairs.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "b", "text")
        leader = pairs.select("a").distinct().join(texts.withColumnRenamed("doc_id", "a"), "a").select("a", F.lit(None).cast("bigint").alias("b"), "text")
        size = 2 * pairs.count() * (idf.text_bytes // max(1, idf.docs) + 64)
        rows = spread(member.unionByName(leader), size, "a").sortWithinPartitions("a", F.asc_nulls_first("b"))
        return stored(rows.mapInArrow(tidy(_verify(idf, threshold)), "a bigint, b bigint"), "near-verified")

    leads = proposed(None)
    first = verified(stored(leads.unionByName(twins).distinct(), "near-pairs"))
    groups = components(first)
    others = proposed(groups)
    second = verified(others)
    for used in (twins, members, wanted, texts, sampled, leads, others):
        drop_stored(used)
    delete(docs.sparkSession, idf.path)
    if second.isEmpty():
        return first, groups
    pairs = first.unionByName(second)
    return pairs, components(pairs)


def components(pairs: DataFrame) -> DataFrame:
    """(doc_id, keep_id): the smallest node of every node's component in ``pairs`` (a, b); stored.

    Each round hooks every node to the least label near it and then jumps along labels, so the
    rounds are logarithmic in the longest chain. Every round is written to the shared folder.
    """
    edges = stored(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("doc_id")).agg(F.least("doc_id", F.min("b")).alias("keep_id")), "labels")
    while True:
        near = edges.join(labels.select(F.col("doc_id").alias("b"), F.col("keep_id").alias("near")), "b").groupBy(F.col("a").alias("doc_id")).agg(F.min("near").alias("near"))
        hooked = labels.join(near, "doc_id").select("doc_id", F.least("keep_id", "near").alias("keep_id"), F.col("keep_id").alias("was"))
        up = hooked.select(F.col("doc_id").alias("keep_id"), F.col("keep_id").alias("top"))
        new = stored(hooked.join(up, "keep_id", "left").select("doc_id", F.least("keep_id", F.coalesce("top", "keep_id")).alias("keep_id"), "was"), "labels")
        changed = not new.filter("keep_id <> was").isEmpty()
        drop_stored(labels)
        labels = new
        if not changed:
            drop_stored(edges)
            return labels.select("doc_id", "keep_id")


def near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, keep_id): every document of a group but the kept one, which has the smallest doc_id."""
    return similar_pairs(docs, threshold)[1].filter("doc_id <> keep_id")


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without near copies; one of each group stays, all columns as they are."""
    m = Masked(docs)
    gone = near_copies(docs, threshold).select("doc_id")
    keyed = m.df.withColumn("doc_id", m["doc_id"].cast("bigint"))
    return m.restore(join_checked(keyed, gone, "doc_id", "left_anti", 16))
