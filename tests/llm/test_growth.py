"""Kernels take time in proportion to their input: four times as long an input takes about four times as long."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from orbweave.llm import decon, exact, htmltext, langid, near, pieces, pii, repeats
from tests.llm.test_ops import Seen

CJK = "".join(chr(0x4E00 + i * 7919 % 20_000) for i in range(1 << 16))


def bucket(n):
    s = np.random.default_rng(0).integers(0, 256, (n, near.SAMPLES)).astype(np.uint8)
    s[:, : near.ROWS] = 1
    return pa.record_batch([pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, np.int64)), pa.array(np.arange(n)), pa.array(np.arange(n)), pa.array([x.tobytes() for x in s], pa.binary())], names=list("abcde"))


def hot_stretches(n):
    """One passage in ``n`` documents."""
    text = " ".join(f"t{i}" for i in range(70)).encode()
    return pa.record_batch([pa.array(np.zeros(n, np.int64)), pa.array(np.arange(n)), pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, 21, np.int32)), pa.array([text] * n, pa.binary())], names=["key", "doc_id", "start", "windows", "tokens"])


def merged_index(n):
    rng = np.random.default_rng(0)
    index = exact.MergeIndex(1 << 12)
    for _ in range(n >> 10):
        index.add(*(rng.integers(-(2**62), 2**62, 1 << 10) for _ in range(3)))
    return index.duplicates()


vocabulary = pieces.Vocabulary()
word = decon.Index([0], pa.array(["word " * 300]), Seen(["word " * 300]))
CASES = {
    "pii addresses": (lambda n: pii.spans(" ".join(f"u{i}@mail.example.com" for i in range(n))), 4000),
    "pii digits": (lambda n: pii.spans("12 34 " * n), 4000),
    "html tags without end": (lambda n: htmltext.parse("<a x" * n), 30_000),
    "html quotes": (lambda n: htmltext.parse("<a x=\">\" " * n), 10_000),
    "html end tags": (lambda n: htmltext.parse("<b>" * n + "</i>" * n), 8000),
    "html implied ends": (lambda n: htmltext.parse("<p><body>" + "<b>" * n + "<h1></h1>" * n), 4000),
    "html attributes": (lambda n: htmltext.parse("<a " + "x" * n + " b=c>"), 200_000),
    "pieces of cjk": (lambda n: pieces.Encoder(vocabulary).encode(pa.array([CJK[:n]])), 8000),
    "pieces of zeros": (lambda n: pieces.Encoder(vocabulary).encode(pa.array(["0" * n])), 20_000),
    "language": (lambda n: langid._counted(pa.array(["some words of text " * n])), 20_000),
    "near bucket, leaders": (lambda n: list(near._leaders(iter([bucket(n)]))), 8000),
    "near bucket, across": (lambda n: list(near._across(iter([bucket(n)]))), 8000),
    "repeats of one passage": (lambda n: repeats._repeated([hot_stretches(n)], 50), 20_000),
    "exact index": (merged_index, 1 << 16),
    "leak of one word": (lambda n: word.matches(pa.array(["word " * n]), 0.6), 4000),
}


@pytest.mark.parametrize("name", CASES)
def test_growth(name):
    run, n = CASES[name]

    def took(k):
        best = float("inf")
        for _ in range(3):
            began = time.process_time()
            run(k)
            best = min(best, time.process_time() - began)
        return best

    took(n // 8)
    # A quadratic kernel would take 16 times as long; some noise is allowed for.
    assert took(4 * n) <= 6 * took(n) + 0.05


def test_bucket_splitting_finds_the_same_pairs(monkeypatch):
    rng = np.random.default_rng(0)
    n = 1300
    s = rng.integers(0, 256, (n, near.SAMPLES)).astype(np.uint8)
    for g in range(40):
        c = rng.integers(0, 256, near.SAMPLES)
        for i in range(g * 30, g * 30 + 30):
            m = rng.random(near.SAMPLES) < rng.uniform(0.2, 0.9)
            s[i, m] = c[m]
    s[:, 3:6] = 1  # band 1
    s, label = s[rng.permutation(n)], rng.integers(0, 600, n)
    batch = pa.record_batch([pa.array(np.ones(n, np.int32)), pa.array(np.zeros(n, np.int64)), pa.array(np.arange(n)), pa.array(label), pa.array([x.tobytes() for x in s], pa.binary())], names=list("abcde"))
    pairs = lambda run: {p for b in run(iter([batch])) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    alike = (s[:, None] == s[None]).sum(2) >= near.AGREE
    want = {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(np.triu(alike, 1)))) if label[i] != label[j]}
    linked = {}
    for split in (near.SPLIT, 10**6):
        monkeypatch.setattr(near, "SPLIT", split)
        assert pairs(near._across) == want and len(want) > 3000
        up = {i: i for i in range(n)}
        for _ in range(20):
            for a, b in pairs(near._leaders):
                assert alike[a, b] and a < b
                up[a] = up[b] = min(up[a], up[b])
        linked[split] = len(set(up.values()))
    assert max(linked.values()) < 0.6 * n


def test_random_texts_of_one_kind_are_timed_whole():
    rng = random.Random(1)
    t = " ".join(rng.choice(["a@b.example.com", "+1 (555) 555-0199", "x"]) for _ in range(3000))
    assert len(pii.spans(t)) == t.count("@") + t.count("(")
