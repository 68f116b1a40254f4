"""Operator 5, secret scans: a battery of randomness tests per inferred encoding, with length-aware false-discovery control.

Candidates are runs of at least MIN_LENGTH of ``[A-Za-z0-9+/_-]`` that no Latin letter or combining mark beyond ASCII continues
(other neighbours, such as quotes, dashes and scripts without blanks, end a run). A run's
encoding is the smallest of ENCODINGS that has all its characters; digits alone are none. A run may hold a key
with something glued to it, so these are candidates too, each with its own encoding and all counted in the control:
its parts between ``-``, ``_`` and ``/``; the whole run and each stretch of hexadecimal parts without these
separators (UUIDs, grouped keys; their ``length`` leaves the separators out, and no test of the ordinary null asks what follows what across one); and what of a run or part is of one
alphabet of AFFIXED after a prefix of at most PREFIX characters. Of candidates that overlap and are
all discoveries the first in this order is reported, the whole run before all.

Two nulls are tested:

* *random*: uniform draws from the encoding's alphabet. Chi-squared uniformity, Wald-Wolfowitz runs about the
  alphabet's middle, and lag-1 serial correlation. A secret must not be rejected (least p * 3 >= ALPHA).
* *ordinary text*: draws from the corpus. The same three questions are put to the corpus's own character, character-pair
  and class-change frequencies, counted over all documents: is the run's mean log frequency too low, are its
  characters too improbable after one another (both regardless of case), does it change between letter cases and digits too often?
  The first two scores are standardised for length, then centred and scaled by their median and quartiles over all runs of
  REFERENCE to MIN_LENGTH characters (an empirical null: such runs are words, whatever the share of secrets among long runs; the
  theoretical one counts as PRIOR runs beside them, at every size of the table, so a table and its tenfold repetition differ only by that); p is
  three times the least of the three, and Benjamini-Hochberg runs within each length class at level ``q``,
  so short runs, of which there are many and of low power, need stronger evidence. P-values are rounded up to a grid of
  eighths of a power of two, which keeps them valid and the counts of fixed size.

A null or empty text has no candidates; very long texts are scanned whole. Repeated rows give repeated results and count
as often. Ties in p share a step of the grid and are all in or all out. A null doc_id stays null. An empty table gives no rows. Extra columns
are ignored, also such with clashing names. Offsets count code points. The secret itself is not returned.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import pick, stored
from .vector import char_offsets, raw, slices

MIN_LENGTH, REFERENCE, ALPHA, Q = 16, 8, 0.001, 0.001
#: Reference runs that the theoretical null (centre 0, scale 1) weighs as much as.
PRIOR = 100
PREFIX, AFFIXED = 8, ("hex", "HEX", "base32", "base36", "BASE36", "base62")
#: Lower bounds of the length classes.
CLASSES = np.array([16, 20, 24, 32, 48, 96])
_lower, _upper, _digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: name: alphabet, by size
ENCODINGS = {
    "hex": _digit + "abcdef", "HEX": _digit + "ABCDEF", "lower": _lower, "upper": _upper, "base32": _upper + "234567",
    "base36": _digit + _lower, "BASE36": _digit + _upper, "letters": _upper + _lower, "base62": _upper + _lower + _digit,
    "base64": _upper + _lower + _digit + "+/", "base64url": _upper + _lower + _digit + "-_", "any": _upper + _lower + _digit + "+/-_",
}
NAMES = list(ENCODINGS)
_SIZE = np.array([len(a) for a in ENCODINGS.values()])
_CODE = np.full((len(NAMES), 256), -1, np.int16)
for _e, _a in enumerate(ENCODINGS.values()):
    _CODE[_e, [ord(c) for c in _a]] = np.arange(len(_a))
_HAS = np.zeros(256, np.uint16)  # bit e: the character is in encoding e
for _e in range(len(NAMES)):
    _HAS[_CODE[_e] >= 0] |= 1 << _e
_RUN = _HAS > 0
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Code points beyond ASCII that continue a word of ASCII letters: Latin letters and combining marks. (Rare phonetic signs above the BMP do not count.)
_CONTINUES = np.zeros(0x10000, bool)
for _lo, _hi in ((0x300, 0x370), (0x1AB0, 0x1B00), (0x1DC0, 0x1E00), (0x20D0, 0x2100), (0xFE20, 0xFE30)):
    _CONTINUES[_lo:_hi] = True
for _c in range(0x80, 0x10000):
    if chr(_c).isalpha() and unicodedata.name(chr(_c), "").startswith("LATIN") or chr(_c) in "ªº":
        _CONTINUES[_c] = True
_KIND = np.zeros(256, np.int8)
_KIND[48:58], _KIND[65:91], _KIND[97:123] = 1, 2, 3


def _continues(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the code point that has byte ``at`` continues a word; the bytes at ``at`` are not ASCII."""
    lead = at.copy()
    for _ in range(3):
        lead -= (b[lead] & 0xC0) == 0x80
    first = b[lead].astype(np.int64)
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    code = first & (0x7F >> size)
    for k in range(1, 4):
        code = np.where(k < size, code << 6 | b[np.minimum(lead + k, len(b) - 1)] & 0x3F, code)
    return (code < len(_CONTINUES)) & _CONTINUES[np.minimum(code, len(_CONTINUES) - 1)]


def runs(b: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte bounds of the maximal runs of at least ``least`` characters, rows apart, that no code point beyond ASCII continues."""
    n = len(b)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = _RUN[b]
    edge = np.zeros(n + 2, bool)  # a row begins here
    edge[off + 1] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[1:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[2:])) + 1
    ok = end - start >= least
    start, end = start[ok], end[ok]
    wide = np.zeros(n + 2, bool)
    wide[1:-1] = b > 127
    ok = np.ones(len(start), bool)
    for outside, touches in ((start - 1, wide[start] & ~edge[start + 1]), (end, wide[end + 1] & ~edge[end + 1])):
        at = np.flatnonzero(touches)
        ok[at] &= ~_continues(b, outside[at])
    return start[ok], end[ok]


CHANGES, LINKS = -1, -2


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n): neighbours within runs, regardless of case; under CHANGES those of different kinds, under LINKS all."""
    total, changes, links = np.zeros(128 * 128, np.int64), 0, 0
    for big in batches:
        for part in slices(big):
            b, off = raw(part.column(1))
            s, e = runs(b, off, 2)
            head = np.zeros(len(b) + 1, np.int32)
            head[s] += 1
            head[e - 1] -= 1
            at = np.flatnonzero(np.cumsum(head)[: len(b)])
            links += len(at)
            changes += int((_KIND[b[at]] != _KIND[b[at + 1]]).sum())
            f = _FOLD[b]
            total += np.bincount(f[at].astype(np.int64) * 128 + f[at + 1], minlength=128 * 128)
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array([*at.tolist(), CHANGES, LINKS], pa.int64()), pa.array([*total[at].tolist(), changes, links], pa.int64())], names=["pair", "n"])


class Ordinary:
    """Frequencies of characters, pairs and class changes within the corpus's runs."""

    def __init__(self, pairs: np.ndarray, changes: float, links: float):
        known = np.zeros(128, bool)
        known[_FOLD[np.flatnonzero(_RUN)]] = True
        c = pairs.reshape(128, 128) + 0.01 * np.outer(known, known)
        p = c / c.sum()
        one = p.sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.single = np.where(one > 0, np.log(one), 0.0)
            self.after = np.where(c > 0, np.log(c / c.sum(1, keepdims=True)), 0.0)
        self.m1 = float((one * self.single).sum())
        self.v1 = float((one * self.single**2).sum() - self.m1**2)
        self.m2 = float((p * self.after).sum())
        self.v2 = float((p * self.after**2).sum() - self.m2**2)
        self.change = min(0.5, changes / max(links, 1.0))

    def scores(self, c: np.ndarray, first: np.ndarray, n: np.ndarray, joint: np.ndarray | slice = slice(0)) -> tuple[np.ndarray, np.ndarray]:
        """Standardised improbability of the runs' characters and of their pairs; c: the runs' bytes one after another.
        A pair whose second character is at a ``joint`` is as probable as pairs are on average."""
        f = _FOLD[c].astype(np.int64)
        s1 = np.add.reduceat(self.single[f], first)
        link = np.zeros(len(c))
        link[1:] = self.after[f[:-1], f[1:]]
        link[joint] = self.m2
        link[first] = 0.0
        s2 = np.add.reduceat(link, first)
        return -(s1 - n * self.m1) / np.sqrt(np.maximum(n * self.v1, 1e-9)), -(s2 - (n - 1) * self.m2) / np.sqrt(np.maximum((n - 1) * self.v2, 1e-9))


def tail(z: np.ndarray) -> np.ndarray:
    """log of the upper tail of the standard normal distribution (an upper bound within 1 %)."""
    a = np.abs(z)
    log = -a * a / 2 - 0.9189385332046727 + np.log(4 / (3 * a + np.sqrt(a * a + 8)))
    return np.where(z >= 0, log, np.log1p(-np.minimum(np.exp(log), 0.5)))


def battery(codes: np.ndarray, start: np.ndarray, n: np.ndarray, k: np.ndarray) -> np.ndarray:
    """log p of the three tests of the random null; ``codes``: the runs' alphabet indices one after another."""
    row = np.repeat(np.arange(len(n)), n)
    count = np.zeros((len(n), int(k.max(initial=1))))
    np.add.at(count, (row, codes), 1)
    x2 = (count**2).sum(1) * k / n - n
    df = k - 1
    # Wilson-Hilferty, with the exact variance of the statistic.
    z = (np.cbrt(np.maximum(x2, 1e-9) / df) - (1 - 2 / (9 * df))) / np.sqrt(2 / (9 * df) * np.maximum(1 - 1 / n, 0.1))
    uniform = tail(z)
    high = codes * 2 >= k[row]
    total = np.add.reduceat(high.astype(np.int64), start)
    first = np.zeros(len(codes), bool)
    first[start] = True
    turn = np.zeros(len(codes), np.int64)
    turn[1:] = (high[1:] != high[:-1]) & ~first[1:]
    number = np.add.reduceat(turn, start) + 1
    a, b = total, n - total
    mean = 2 * a * b / n + 1
    var = np.maximum((mean - 1) * (mean - 2) / np.maximum(n - 1, 1), 1e-9)
    run = np.minimum(0.0, tail(np.abs(number - mean) / np.sqrt(var)) + np.log(2))
    run[(a == 0) | (b == 0)] = (np.log(0.5) * (n - 1))[(a == 0) | (b == 0)]
    x = codes - np.add.reduceat(codes, start)[row] / n[row]
    product = np.zeros(len(codes))
    product[:-1] = np.where(first[1:], 0.0, x[:-1] * x[1:])
    square = np.maximum(np.add.reduceat(x * x, start), 1e-9)
    serial = np.minimum(0.0, tail(np.abs(np.add.reduceat(product, start) / square + 1 / n) * np.sqrt(n)) + np.log(2))
    return np.stack([uniform, run, serial], 1)


_SEPARATORS, _SPLIT = b"-_/", re.compile(rb"[^-_/]+")
_HEX = (frozenset(ENCODINGS["hex"].encode()), frozenset(ENCODINGS["HEX"].encode()))
_ALPHABETS = [ENCODINGS[a].encode() for a in AFFIXED]


def candidates(run: bytes) -> list[tuple[int, int, int, bytes, tuple[int, ...]]]:
    """(level, start, end, characters, joints: characters before which separators were left out) of all candidates within a run
    of at least MIN_LENGTH characters."""
    out = [(0, 0, len(run), run, ())]
    parts = [m.span() for m in _SPLIT.finditer(run)]
    whole = {(0, len(run))}
    if parts != [(0, len(run))]:
        whole.update(p for p in parts if p[1] - p[0] >= MIN_LENGTH)
        out += [(1, a, z, run[a:z], ()) for a, z in parts if z - a >= MIN_LENGTH]
        groups = {(parts[0][0], parts[-1][1])} if len(parts) > 1 else set()
        for alphabet in _HEX:
            first = None
            for i in range(len(parts) + 1):
                fits = i < len(parts) and alphabet.issuperset(run[slice(*parts[i])])
                if fits and first is None:
                    first = i
                elif not fits and first is not None:
                    if i - first > 1:
                        groups.add((parts[first][0], parts[i - 1][1]))
                    first = None
        for a, z in sorted(groups):
            if len(joined := run[a:z].translate(None, _SEPARATORS)) >= MIN_LENGTH:
                out.append((2, a, z, joined, tuple(itertools.accumulate(y - x for x, y in parts if a <= x and y < z))))
    affixed = {(z - len(rest), z) for a, z in whole for x in _ALPHABETS if 1 <= len(lead := run[a:z].rstrip(x)) <= PREFIX for rest in [run[a + len(lead) : z]] if len(rest) >= MIN_LENGTH}
    out += [(3, a, z, run[a:z], ()) for a, z in sorted(affixed - whole)]
    return out


FIELDS = ["doc_id", "start", "end", "encoding", "length", "band", "lp_uniform", "lp_runs", "lp_serial", "z1", "z2", "lp3", "level", "run", "content"]
SCHEMA = "doc_id bigint, start int, end int, encoding string, length int, band int, lp_uniform double, lp_runs double, lp_serial double, z1 double, z2 double, lp3 double, level int, run int, content bigint"


def score(c: np.ndarray, n: np.ndarray, model: Ordinary, joint: np.ndarray) -> tuple[np.ndarray, ...]:
    """``joint``: whether a character follows a separator left out. For candidates of ``n`` characters, ``c`` one after another: which have an encoding, and for those (encoding, battery, z1, z2, log p of class changes)."""
    first = np.cumsum(n) - n
    bits = np.bitwise_and.reduceat(_HAS[c], first)
    letters = np.add.reduceat((_KIND[c] >= 2).astype(np.int64), first)
    ok = (bits > 0) & (letters > 0)
    low = np.zeros(len(n), np.int64)
    for k in reversed(range(len(NAMES))):
        low[(bits >> k) & 1 == 1] = k
    keep = np.repeat(ok, n)
    c, n, low, joint = c[keep], n[ok], low[ok], joint[keep]
    if not len(n):
        return ok, low, np.zeros((0, 3)), np.zeros(0), np.zeros(0), np.zeros(0)
    first = np.cumsum(n) - n
    tests = battery(_CODE[np.repeat(low, n), c].astype(np.int64), first, n, _SIZE[low])
    z1, z2 = model.scores(c, first, n, joint)
    change = np.zeros(len(c))
    change[1:] = _KIND[c[1:]] != _KIND[c[:-1]]
    change[first] = change[joint] = 0
    s3 = np.add.reduceat(change, first)
    x, q = s3 / (n - 1), max(model.change, 1e-6)
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = np.where(x > 0, x * np.log(x / q), 0) + np.where(x < 1, (1 - x) * np.log((1 - x) / (1 - q)), 0)
    return ok, low, tests, z1, z2, np.where(x > q, -(n - 1) * kl, 0.0)  # Chernoff bound


#: Band of the rows that count the reference's scores: (z1, z2) of a cell of the grid, ``length`` of them.
COUNTS = -1
#: Bytes of runs whose candidates are scored together.
STEP = 1 << 20


def _candidates(model: Ordinary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = np.zeros((2, 2001), np.int64)
        for big in batches:
            for part in slices(big):
                b, off = raw(part.column(1))
                s, e = runs(b, off, REFERENCE)
                short = e - s < MIN_LENGTH
                if short.any():
                    n = (e - s)[short]
                    first = np.cumsum(n) - n
                    c = b[np.repeat(s[short] - first, n) + np.arange(n.sum())]
                    words = np.add.reduceat((_KIND[c] >= 2).astype(np.int64), first) > 0
                    for k, z in enumerate(model.scores(c, first, n)):
                        grid[k] += np.bincount(np.clip(np.floor(z[words] * 10), -1000, 1000).astype(np.int64) + 1000, minlength=2001)
                s, e = s[~short], e[~short]
                if not len(s):
                    continue
                runs_row = np.searchsorted(off, s, "right") - 1
                # Few candidates at a time, since a run has several.
                step = np.flatnonzero(np.diff(np.cumsum(e - s) // STEP, prepend=-1))
                for lo, hi in zip(step, [*step[1:], len(s)]):
                    level, start, end, origin, content, pieces, joints, size = [], [], [], [], [], [], [], 0
                    for i in range(lo, hi):
                        run = b[s[i] : e[i]].tobytes()
                        h = xxhash.xxh3_64_intdigest(run) - 2**63
                        for k, x, y, chars, cuts in candidates(run):
                            level.append(k)
                            start.append(s[i] + x)
                            end.append(s[i] + y)
                            origin.append(i)
                            content.append(h)
                            pieces.append(chars)
                            joints += [size + q for q in cuts]
                            size += len(chars)
                    n = np.array([len(x) for x in pieces])
                    joint = np.zeros(size, bool)
                    joint[joints] = True
                    ok, low, tests, z1, z2, lp3 = score(np.frombuffer(b"".join(pieces), np.uint8), n, model, joint)
                    level, x, y, origin, content, n = (np.array(v)[ok] for v in (level, start, end, origin, content, n))
                    row = runs_row[origin]
                    band = np.searchsorted(CLASSES, n, "right") - 1
                    begin, shift = char_offsets(b, off, s[origin], row), s[origin]  # runs are ASCII
                    yield pa.record_batch(
                        [part.column(0).take(pa.array(row)), pa.array((begin + x - shift).astype(np.int32)), pa.array((begin + y - shift).astype(np.int32)),
                         pa.array(NAMES).take(pa.array(low)), pa.array(n.astype(np.int32)), pa.array(band.astype(np.int32)), *(pa.array(t) for t in tests.T), pa.array(z1), pa.array(z2), pa.array(lp3),
                         pa.array(level.astype(np.int32)), pa.array(begin.astype(np.int32)), pa.array(content.astype(np.int64))],
                        names=FIELDS,
                    )
        which, cell = np.nonzero(grid)
        n = len(which)
        z = (cell - 1000) / 10 + 0.05
        none = np.full(n, np.nan)
        yield pa.record_batch(
            [pa.nulls(n, pa.int64()), pa.array(which.astype(np.int32)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.array(grid[which, cell].astype(np.int32)), pa.array(np.full(n, COUNTS, np.int32)),
             *(pa.array(none) for _ in range(3)), pa.array(z), pa.array(none), pa.array(none), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())],
            names=FIELDS,
        )

    return run


def scan(docs: DataFrame, q: float = Q, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, start, end, encoding, length, p_uniform, p_runs, p_serial, p_ordinary) of every discovery."""
    rows = pick(docs, doc_id="bigint", text="string")
    counted = rows.mapInArrow(_pairs, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    pairs = np.zeros(128 * 128)
    real = counted[counted.pair >= 0]
    pairs[real.pair.to_numpy()] = real.n.to_numpy()
    of = lambda k: float(counted.n[counted.pair == k].sum())
    both = stored(rows.mapInArrow(_candidates(Ordinary(pairs, of(CHANGES), of(LINKS))), SCHEMA), "secret-candidates")
    found = both.filter(F.col("band") != COUNTS)
    centre = {"z1": (0.0, 1.0), "z2": (0.0, 1.0)}
    table = both.filter(F.col("band") == COUNTS).groupBy("start", "z1").agg(F.sum("length").alias("n")).toPandas()
    for which, t in table.groupby("start"):
        t = t.sort_values("z1")
        part = t.n.cumsum() / t.n.sum()
        lo, mid, hi = (float(t.z1[part >= f].iloc[0]) for f in (0.25, 0.5, 0.75))
        trust = float(t.n.sum() / (t.n.sum() + PRIOR))
        centre["z1" if which == 0 else "z2"] = (trust * mid, 1 + trust * (max(1.0, (hi - lo) / 1.349) - 1))

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [b.column(11).to_numpy()]
            for i, z in ((9, "z1"), (10, "z2")):
                parts.append(tail((b.column(i).to_numpy() - centre[z][0]) / centre[z][1]))
            log_p = np.minimum(0.0, np.min(parts, axis=0) + np.log(3))
            grid = np.minimum(np.floor(-log_p / np.log(2) * 8), 8000).astype(np.int32)
            yield pa.record_batch([*(b.column(i) for i in range(9)), *(b.column(i) for i in range(12, 15)), pa.array(grid)], names=[*FIELDS[:9], *FIELDS[12:], "grid"])

    scored = stored(found.mapInArrow(final, SCHEMA.split(", z1")[0] + ", level int, run int, content bigint, grid int"), "secret-scores")
    table = scored.groupBy("band", "grid").agg(F.count("*").alias("n")).toPandas().sort_values("grid", ascending=False)
    rule = F.lit(False)
    for band, t in table.groupby("band", sort=True):
        rank, m = t.n.cumsum().to_numpy(), t.n.sum()
        ok = np.exp2(-t.grid.to_numpy() / 8) <= q * rank / m
        if ok.any():
            rule = rule | ((F.col("band") == int(band)) & (F.col("grid") >= int(t.grid.to_numpy()[ok].min())))
    log_alpha = float(np.log(alpha / 3))
    hits = scored.filter(rule & (F.least("lp_uniform", "lp_runs", "lp_serial") >= log_alpha))
    # Of overlapping discoveries of one run the first level stays; rows that are repeated have equal ones.
    hits = hits.withColumn("others", F.collect_set(F.struct("level", "start", "end")).over(W.partitionBy("doc_id", "run", "content")))
    hits = hits.filter(~F.exists("others", lambda o: (o["level"] < F.col("level")) & (o["start"] < F.col("end")) & (o["end"] > F.col("start"))))
    return hits.select(
        "doc_id", "start", "end", "encoding", "length", F.exp("lp_uniform").alias("p_uniform"), F.exp("lp_runs").alias("p_runs"), F.exp("lp_serial").alias("p_serial"), F.pow(F.lit(2.0), -F.col("grid") / 8).alias("p_ordinary")
    )
