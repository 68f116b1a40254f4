"""Operator 9, language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: hashed 1- to 3-grams of lower-cased code points (every one that is no letter counts as a blank),
log(1 + tf) * idf, scaled to unit length. Document frequencies come from all documents. The
model is trained with follow-the-regularised-leader and an elastic net, on at most ``sample``
labelled rows chosen by a hash of doc_id, a fifth of which is held out to fit the temperature.

Results: a text without any letter, null and empty included, is ``und`` with probability 0 and
is rejected; so is one whose calibrated probability is under ``min_prob``, and one that is unlike all taught
languages, however many they are: the n-grams seen in training texts of its language must weigh at least FAMILIAR of what they do in the
median held-out text of that language (of all languages, if it has fewer than 5; without held-out rows this is not tested). Whole texts count, very long ones too.
Repeated rows get equal results and count as often; equal scores go to the first language by name. A null doc_id stays null. Without labelled
rows every text is ``und``. An empty table gives no rows. Extra columns, also such with clashing names, are ignored by :func:`identify` and
passed through by :func:`keep_identified`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import Masked, pick, stored
from .vector import slices, tidy

BITS = 16
#: Most labelled rows the model is fitted on.
SAMPLE = 4000
#: Least share of known n-gram weight, of that in held-out texts. Untaught scripts have under 0.02, random letters about 0.2, taught languages over 0.85.
FAMILIAR = 0.5
#: Even odds of four languages are 0.25; below this the language isn't told. Short clean texts often reach no more than 0.4.
MIN_PROB = 0.3
_TABLE = 0x3000
_LETTER = np.array([c if chr(c).isalpha() else 32 for c in range(_TABLE)], np.uint32)


def _counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hashed n-gram, count) of all texts that have a letter, sorted by row and n-gram."""
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    off = np.concatenate([[0], np.cumsum(pc.utf8_length(low).to_numpy(zero_copy_only=False).astype(np.int64))])
    c = np.frombuffer("".join(low.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    beyond = np.flatnonzero(c >= _TABLE)
    c[c < _TABLE] = _LETTER[c[c < _TABLE]]
    if len(beyond):
        code, which = np.unique(c[beyond], return_inverse=True)
        c[beyond] = np.array([x if chr(x).isalpha() else 32 for x in code.tolist()], np.uint32)[which]
    letters = np.concatenate([[0], np.cumsum(c != 32)])
    owner = np.repeat(np.arange(len(off) - 1, dtype=np.int64) << BITS, np.diff(off))
    use = np.repeat(letters[off[1:]] > letters[off[:-1]], np.diff(off))
    keys = []
    with np.errstate(over="ignore"):
        acc = np.zeros(len(c), np.uint32)
        for n in range(3):
            acc = acc[: len(c) - n] * np.uint32(0x01000193) + c[n:] if len(c) > n else acc[:0]
            h = (acc ^ np.uint32(n * 0x9E3779B9 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
            m = len(acc)
            own = owner[n:]
            inside = use[n:] if not n else use[n:] & (own == owner[:m])  # within one text
            keys.append((own + (h * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS)))[inside])
    keys = np.concatenate(keys)
    if len(off) <= 1 << (32 - BITS):
        keys = keys.astype(np.uint32)  # sorts faster
    keys.sort()
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    one = keys[at].astype(np.int64)
    return one >> BITS, one & ((1 << BITS) - 1), np.diff(np.append(at, len(keys)))


def _weighted(texts: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows with letters, bounds of their features, n-grams, values of unit length)."""
    row, gram, count = _counted(texts)
    head = np.flatnonzero(np.diff(row, prepend=-1))
    x = np.log1p(count) * idf[gram]
    size = np.diff(np.append(head, len(row)))
    norm = np.sqrt(np.add.reduceat(x * x, head)) if len(head) else x
    return row[head], np.append(head, len(row)), gram, x / np.repeat(np.maximum(norm, 1e-12), size)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(1 << BITS, np.int64), 0
    for big in batches:
        for b in slices(big):
            n += b.num_rows
            df += np.bincount(_counted(b.column(1))[1], minlength=1 << BITS)
    at = np.flatnonzero(df)
    yield pa.record_batch([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["f", "n"])


def inverse_frequencies(rows: DataFrame) -> np.ndarray:
    """idf of every hashed n-gram over all of ``rows`` (doc_id, text); a table of fixed size."""
    counts = rows.mapInArrow(tidy(_frequencies), "f bigint, n bigint").groupBy("f").agg(F.sum("n").alias("n")).toPandas()
    df, total = np.zeros(1 << BITS), int(counts.n[counts.f == -1].sum())
    real = counts[counts.f >= 0]
    df[real.f.to_numpy()] = real.n.to_numpy()
    return np.log((1 + total) / (1 + df)) + 1


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (features, languages)
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0
    known: np.ndarray | None = None  # (features, languages): seen in training texts
    least: np.ndarray | None = None  # least share of known weight by language

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[at] + self.bias

    def share(self, at: np.ndarray, x: np.ndarray, k: int) -> float:
        """The share of a text's n-gram weight that language ``k`` knows."""
        return float(x[self.known[at, k]].sum() / x.sum())

    def told(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language or -1, calibrated probability, whether it is like that language) of each text."""
        best, prob, like = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts), bool)
        if self.langs:
            rows, bounds, gram, x = _weighted(texts, self.idf)
            if len(rows):
                head = bounds[:-1]
                z = np.stack([np.add.reduceat(x * self.weights[gram, k], head) for k in range(len(self.langs))], 1)
                p = softmax((z + self.bias) / self.temperature)
                best[rows] = k = p.argmax(1)
                prob[rows] = p.max(1)
                if self.least is None:
                    like[rows] = True
                else:
                    size = np.diff(bounds)
                    own = np.add.reduceat(x * self.known[gram, np.repeat(k, size)], head)
                    like[rows] = own / np.add.reduceat(x, head) >= self.least[k]
        return best, prob, like

    def probs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language or -1, calibrated probability) of each text."""
        return self.told(texts)[:2]


def softmax(z: np.ndarray) -> np.ndarray:
    """Of one row of scores or of several."""
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(data: list[tuple[np.ndarray, np.ndarray, int]], k: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-2) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with elastic net over (features, values, class) rows; returns weights and bias."""
    z, n = np.zeros((1 << BITS, k)), np.zeros((1 << BITS, k))
    bias = np.zeros(k)

    def solve(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(data)):
            at, x, y = data[i]
            za, na = z[at], n[at]
            w = solve(za, na)
            g = softmax(x @ w + bias)
            g[y] -= 1
            grad = x[:, None] * g
            more = na + grad * grad
            z[at] = za + grad - (np.sqrt(more) - np.sqrt(na)) / alpha * w
            n[at] = more
            bias -= 0.01 * g
    return solve(z, n), bias


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least held-out log loss, by golden-section search of its logarithm."""

    def loss(log_t: float) -> float:
        z = logits / np.exp(log_t)
        m = z.max(1)
        return float(np.mean(m + np.log(np.exp(z - m[:, None]).sum(1)) - z[np.arange(len(y)), y]))

    a, b, r = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(50):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows (doc_id, text, lang); document frequencies from all rows."""
    rows = pick(docs, doc_id="bigint", text="string", lang="string")
    idf = inverse_frequencies(rows.select("doc_id", "text"))
    labelled = rows.filter("text is not null and lang is not null and lang <> ''")
    total = labelled.count()
    # Chosen by a hash of doc_id: about 0.9 of the bound if there are more rows, cut at the bound.
    mark = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 30))
    some = labelled if total <= sample else labelled.filter(mark < int((1 << 30) * 0.9 * sample / total)).limit(sample)
    got = some.withColumn("mark", mark).toPandas().sort_values(["mark", "doc_id", "text"])
    langs = sorted(got.lang.unique())
    if not langs:
        return Model([], np.zeros((1, 0)), np.zeros(0), idf)
    ys = got.lang.map({x: i for i, x in enumerate(langs)}).to_numpy()
    data, held = [], []
    for a in range(0, len(got), 100):
        found, bounds, gram, value = _weighted(pa.array(got.text.iloc[a : a + 100].tolist(), pa.large_string()), idf)
        for i, lo, hi in zip(found.tolist(), bounds[:-1], bounds[1:]):
            at, x = gram[lo:hi], value[lo:hi]
            (held if (a + i) % 5 == 4 else data).append((at.astype(np.int32), x.astype(np.float32), int(ys[a + i])))
    if not data:
        return Model([], np.zeros((1, 0)), np.zeros(0), idf)
    weights, bias = fit(data, len(langs))
    model = Model(langs, weights, bias, idf)
    model.known = np.zeros((1 << BITS, len(langs)), bool)
    for at, _, y in data:
        model.known[at, y] = True
    if held:
        shares = np.array([model.share(at, x, y) for at, x, y in held])
        own = [shares[[y == k for *_, y in held]] for k in range(len(langs))]
        model.least = FAMILIAR * np.array([np.median(x if len(x) >= 5 else shares) for x in own])
        model.temperature = temperature(np.array([model.logits(at, x) for at, x, _ in held]), np.array([y for *_, y in held]))
    return model


def _predict(model: Model, text_at: int, keep: float | None):
    """keep None: rows (doc_id, lang, prob, like); else the batches' accepted rows as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*model.langs, "und"])
        for big in batches:
            for b in slices(big, text_at):
                best, prob, like = model.told(b.column(text_at))
                if keep is None:
                    at = np.where(best < 0, len(model.langs), best)
                    yield pa.record_batch([b.column(0), names.take(pa.array(at)), pa.array(prob), pa.array(like)], names=["doc_id", "lang", "prob", "like"])
                else:
                    yield b.filter(pa.array((best >= 0) & like & (prob >= keep)))

    return run


def identify(docs: DataFrame, model: Model | None = None, min_prob: float = MIN_PROB) -> DataFrame:
    """(doc_id, lang, prob, accepted) of every row; one scan once the model is there, no shuffle."""
    model = model or train(docs)
    found = pick(docs, doc_id="bigint", text="string").mapInArrow(tidy(_predict(model, 1, None)), "doc_id bigint, lang string, prob double, like boolean")
    return found.select("doc_id", "lang", "prob", ((F.col("lang") != "und") & F.col("like") & (F.col("prob") >= min_prob)).alias("accepted"))


def keep_identified(docs: DataFrame, model: Model | None = None, min_prob: float = MIN_PROB) -> DataFrame:
    """The documents whose language is told with at least ``min_prob`` and which are like it; all columns as they are."""
    model = model or train(docs)
    m = Masked(docs)
    at = m.names.index("text")
    return m.restore(m.df.mapInArrow(tidy(_predict(model, at, min_prob)), m.df.schema))


__all__ = ["Model", "identify", "keep_identified", "stored", "train"]
