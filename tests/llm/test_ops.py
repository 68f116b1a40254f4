"""Operators on text against brute force, round trips, held-out accuracy, and awkward tables."""

import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orbweave.llm import decon, exact, htmltext, langid, near, pieces, pii, queries, repeats, secrets, tokenbin
from orbweave.llm.vector import NONWORD, SPACE, Tokens, shingles, slices
from tests.oracle import connect, same

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
BENCH = "item_id bigint, text string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def awkward(spark, clash=True):
    """Nulls in every column, empty and very long texts, repeated rows, ties, clashing extra columns."""
    long = " ".join(f"w{i % 977}" for i in range(40_000))
    rows = [(1, None, None, None, None), (None, "some words without an identifier here", "en", "s", 3), (2, "", "en", "s", 0), (3, "", "de", None, 0), (4, long, "en", "s", 1), (5, long, "fr", "s", 1),
            (6, "tie tie tie", "en", "s", 1), (6, "tie tie tie", "en", "s", 1), (7, "x", "es", "s", 1), (8, "   \n\t", "en", "s", 1), (9, "日本語 😀 ñ", "xx", "s", 1), (10, "0" * 5000, "en", "s", 1)]
    d = spark.createDataFrame(rows, DOCS)
    extra = {c: F.lit(7) for c in ("start", "end", "key", "k1", "band", "id", "body", "keep_id", "hash", "host", "c0", "text_a", "n", "samples", "prob")}
    d = d.withColumns(extra)
    return d.select("*", F.lit("other").alias("Text"), F.lit("z").alias("DOC_ID")) if clash else d


def bench_of(spark, rows=((1, "one two three four five six seven eight nine ten"), (2, None), (3, ""), (4, "tie tie tie"), (None, "alpha beta gamma delta"))):
    return spark.createDataFrame(list(rows), BENCH)


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, sf, con, name):
    same(queries.queries()[name](spark, sf), con, queries.oracle_sql()[name])


# --- kernels


def test_tokens_and_shingles():
    texts = ["ab  cd", None, "", " x", "ab cd ef ab cd", "é ñ"]
    t = Tokens(pa.array(texts), SPACE)
    raw = t.bytes.tobytes()
    got = [raw[a:b].decode() for a, b in zip(t.start, t.end)]
    assert got == [w for x in texts if x for w in x.split()]
    assert [got[a:b] for a, b in zip(t.first[:-1], t.first[1:])] == [(x or "").split() for x in texts]
    h = dict(zip(got, t.hash.tolist()))
    assert len(set(h.values())) == len(h) and t.hash.tolist() == [h[w] for w in got]
    s, doc, first = shingles(t, 2)
    assert doc.tolist() == [0, 3, 4, 4, 4, 4, 5]
    assert s[0] == s[2] == s[5] and len(set(s.tolist())) == 5


def test_slices_cover_all():
    b = pa.record_batch([pa.array(range(9)), pa.array(["x" * n for n in (5, 0, 50, 1, 1, 1, 99, 2, 2)])], names=["a", "b"])
    for limit in (1, 7, 60, 1000):
        parts = list(slices(b, limit=limit))
        assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(9))


# --- 1 PII


def test_pii_checks():
    assert pii.luhn("4532015112830366") and not pii.luhn("4532015112830367")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB83WEST12345698765432")


def test_pii_spans(spark):
    good = "Mail a.b@mail.example.com or +1 (555) 555-0199, card 4532015112830366, host 10.20.30.40, IBAN GB82 WEST 1234 5698 7654 32, ssn 123-45-6789."
    kinds = {k: good[a:b] for k, a, b, _ in pii.spans(good)}
    assert kinds == {"email": "a.b@mail.example.com", "phone": "+1 (555) 555-0199", "credit_card": "4532015112830366", "ipv4": "10.20.30.40", "iban": "GB82 WEST 1234 5698 7654 32", "us_ssn": "123-45-6789"}
    for clean in ("Version 2.0.0.1 of the license, 300.1.2.3, 4532015112830367", "the year 1999 and 2024, 12 of 34", "CC BY-NC 4.0"):
        assert pii.spans(clean) == []
    assert pii.spans("pay by card 4532015112830366")[0][3] > pii.spans("zzz 4532015112830366")[0][3]
    texts = ["é " + good, good * 3, "nothing", None, "", "x" * 200_000 + " a.b@mail.example.com"]
    got = {(r.doc_id, r.kind, r.start, r.end) for r in pii.pii_spans(docs_of(spark, texts)).collect()}
    assert got == {(i, k, a, b) for i, t in enumerate(texts) for k, a, b, _ in pii.spans(t)}


@pytest.mark.parametrize(
    "kind, value",
    [("phone", v) for v in ("+14155552671", "+33 6 12 34 56 78", "+49 151 23456789", "(415) 555-2671", "415-555-2671", "06 12 34 56 78", "+1 (555) 555-0199")]
    + [("us_ssn", "123-45-6789"), ("credit_card", "4532015112830366"), ("credit_card", "4532 0151 1283 0366")]
    + [("ipv6", v) for v in ("fe80::1", "2001:db8::8a2e:370:7334", "::ffff:10.20.30.40", "2001:db8:0:0:0:8a2e:370:7334", "2001:db8::")],
)
def test_pii_forms(kind, value):
    for before, after in (("zzz ", ""), ("zzz ", " zzz"), ("(", ")"), ("zzz ", ", 12"), ("zzz ", ".")):
        t = before + value + after
        assert [(k, t[a:b]) for k, a, b, _ in pii.spans(t)] == [(kind, value)], t


def test_pii_digits_beside():
    for t, card in (("4532015112830366 12/27", "4532015112830366"), ("4532015112830366 123", "4532015112830366"), ("12/27 4532 0151 1283 0366 123", "4532 0151 1283 0366"), ("1 2 3 4 5 6 7 8 9 4532015112830366", "4532015112830366")):
        assert (card) in [t[a:b] for k, a, b, _ in pii.spans(t) if k == "credit_card"], t
    t = "GB82 WEST 1234 5698 7654 32 2024 ABCD"
    assert [t[a:b] for _, a, b, _ in pii.spans(t)] == ["GB82 WEST 1234 5698 7654 32"]
    for clean in ("on 2021-12-31 and 31.12.2021", "at 12:30:45", "std::vector", "12345678901234567890123", "pages 10-12 14-16"):
        assert pii.spans(clean) == [], clean


# --- 2 repeated passages


def brute_repeats(docs, n):
    seen = {}
    for i, t in sorted(docs.items()):
        w = t.split()
        for p in range(len(w) - n + 1):
            seen.setdefault(tuple(w[p : p + n]), []).append((i, p))
    return {(i, p): (len(v), (i, p) == v[0]) for v in seen.values() if len(v) > 1 for i, p in v}


@pytest.mark.parametrize("seed", range(3))
def test_repeats_against_brute_force(spark, seed):
    rng = random.Random(seed)
    passages = [[f"p{k}_{j}" for j in range(rng.randint(8, 40))] for k in range(4)] + [["a"] * 30, ["a", "b"] * 12]
    texts = {}
    for i in range(25):
        w = [rng.choice("abcdefghij") + str(rng.randint(0, 30)) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(passages)
        texts[i] = rng.choice(["  ", " ", "\n"]).join(w)
    n = 10
    want = brute_repeats(texts, n)
    got = {}
    for r in repeats.repeated_passages(docs_of(spark, [texts[i] for i in range(25)]), n).collect():
        for p in range(r.start_word, r.end_word - n + 1):
            if want.get((r.doc_id, p), (0, None))[1] == r.first:
                got[r.doc_id, p] = r.first
        assert r.copies == max(want[r.doc_id, p][0] for p in range(r.start_word, r.end_word - n + 1) if want.get((r.doc_id, p), (0, None))[1] == r.first)
    assert got == {k: v[1] for k, v in want.items()}


def test_cut_repeats_leaves_none(spark):
    p = " ".join(f"word{i}" for i in range(60))
    d = docs_of(spark, [f"a b {p} c", f"x {p} y {p}", "short", None])
    cut = repeats.cut_repeats(d)
    assert repeats.repeated_passages(cut).isEmpty()
    got = {r.doc_id: r.text for r in cut.collect()}
    assert got[0] == f"a b {p} c" and got[1].split() == ["x", "y"] and got[2] == "short" and got[3] is None


# --- 3 token files


def test_token_files_round_trip(spark, sf, tmp_path):
    d = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    folder = f"file://{tmp_path}/t"
    rows = {r.doc_index: r for r in tokenbin.write_tokens(d, folder).collect()}
    texts = {r.doc_id: r.text for r in d.collect()}
    store, enc = tokenbin.TokenStore(folder), tokenbin.load_encoding()
    assert len(store) == len(texts) and sorted(rows) == list(range(len(store)))
    at = 0
    for i in range(len(store)):
        doc, tokens = store[i]
        assert enc.decode(tokens.tolist()) == texts[doc] and rows[i].doc_id == doc
        assert rows[i].token_offset == at and rows[i].n_tokens == len(tokens)
        at += len(tokens)


# --- 4 exact dedup


def test_merge_index_against_dict():
    rng = np.random.default_rng(0)
    index = exact.MergeIndex(memtable=50, fan=3)
    want = {}
    for _ in range(40):
        hi, lo, ident = rng.integers(-30, 30, 37), rng.integers(0, 4, 37), rng.integers(0, 10**6, 37)
        index.add(hi, lo, ident)
        for k in zip(hi.tolist(), lo.tolist(), ident.tolist()):
            want.setdefault(k[:2], []).append(k[2])
    got = {(a, b): (i, n) for a, b, i, n in zip(*(x.tolist() for x in index.duplicates()))}
    assert got == {k: (min(v), len(v)) for k, v in want.items() if len(v) > 1}


def test_exact_filter(spark):
    d = docs_of(spark, ["a", "b", "a", None, "", "", "b", None])
    assert sorted((r.doc_id for r in exact.drop_exact_copies(d).collect())) == [0, 1, 3, 4, 7]
    assert {(r.doc_id, r.keep_id) for r in exact.exact_copies(d).collect()} == {(2, 0), (5, 4), (6, 1)}


# --- 5 secrets


def test_secret_scan(spark):
    rng = random.Random(3)
    words = ["the", "and", "thing", "other", "nation", "reading", "internationalization", "incomprehensibilities", "characteristically", "counterrevolutionaries"]
    texts, true = [], set()
    for i in range(300):
        w = [rng.choice(words) for _ in range(120)]
        if i % 10 == 0:
            s = rng.choice(["".join(rng.choice("0123456789abcdef") for _ in range(40)), "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(44))])
            w[60] = f'key="{s}"'
            true.add((i, s))
        texts.append(" ".join(w))
    got = {(r.doc_id, texts[r.doc_id][r.start : r.end]) for r in secrets.scan(docs_of(spark, texts)).collect()}
    assert len(got & true) >= 0.95 * len(true)
    assert not {g for g in got if g[1] in words}


def test_secrets_beside_other_scripts(spark):
    rng = random.Random(5)
    filler = " ".join(rng.choice(["the", "and", "thing", "nation", "reading", "internationalization", "éducation"]) for _ in range(3000))
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    around = [("“", "”"), ("«", "»"), ("key—", "—"), ("密钥", "。"), ("カギは", "です"), ("กุญแจ", ""), ("😀", "😀"), ("열쇠", "입니다")]
    texts = [f"{filler} {a}{key()}{b} end" for a, b in around] + [f"{filler} é{key()} {key()}ñ {key()}e\u0301"]
    got = {(r.doc_id, texts[r.doc_id][r.start - 1], r.end - r.start) for r in secrets.scan(docs_of(spark, texts)).collect()}
    assert got == {(i, a[-1], 40) for i, (a, _) in enumerate(around)}


def test_secrets_with_prefixes_and_separators(spark):
    rng = random.Random(7)
    draw = lambda k, a="0123456789abcdef": "".join(rng.choice(a) for _ in range(k))
    words = ["the", "and", "thing", "nation", "education", "different", "mountains", "well-known", "long-term", "snake_case", "nonetheless", "internationalization", "Counterrevolutionaries", "characteristically"]
    filler = lambda: " ".join(rng.choice(words) for _ in range(100))
    kinds = [lambda: ("key-", draw(32), ""), lambda: ("SK", draw(32), ""), lambda: ("token_", draw(40), ""), lambda: ("dop_v1_", draw(64), ""), lambda: ("path/to/", draw(40), "/file"),
             lambda: ("", "-".join(draw(k) for k in (8, 4, 4, 4, 12)), ""), lambda: ("urn-", "-".join(draw(k) for k in (8, 4, 4, 4, 12)), "-x")]
    rows = [kinds[i % len(kinds)]() for i in range(140)]
    texts = [f"{filler()} {a}{k}{z} {filler()}" for a, k, z in rows]
    found = secrets.scan(docs_of(spark, texts)).collect()
    spans = {i: [] for i in range(len(rows))}
    for r in found:
        spans[r.doc_id].append((r.start, r.end))
    hit = [any(texts[i].index(k) >= x and texts[i].index(k) + len(k) <= y for x, y in spans[i]) or (texts[i].index(k), texts[i].index(k) + len(k)) in spans[i] for i, (_, k, _) in enumerate(rows)]
    assert sum(hit) >= 0.95 * len(rows) and all(any(hit[j :: len(kinds)]) for j in range(len(kinds)))
    assert all(y <= c for v in spans.values() for (_, y), (c, _) in itertools.pairwise(sorted(v)))
    assert not {texts[r.doc_id][r.start : r.end] for r in found} & set(words)


def test_randomness_battery_is_calibrated():
    rng = np.random.default_rng(1)
    n = np.full(4000, 40)
    codes = rng.integers(0, 16, n.sum())
    lp = secrets.battery(codes, np.cumsum(n) - n, n, np.full(4000, 16))
    for column in lp.T:
        for p in (0.1, 0.01):
            assert 0.4 * p < (column < math.log(p)).mean() < 2 * p
    flat = secrets.battery(np.zeros(40, np.int64), np.array([0]), np.array([40]), np.array([16]))
    assert flat.min() < math.log(1e-9)


# --- 6 HTML


def page(i, host="h.example", nav=True):
    menu = "<nav><ul><li><a href='/a'>Home</a><li><a href='/b'>About us</a></ul></nav>" if nav else ""
    return (i, f"https://{host}/p{i}", f"<!DOCTYPE html><html><head><title>T{i} &amp; more</title><style>p{{x}}</style></head><body>{menu}<script>if (a<b) track({i})</script><p>Body {i} of &lt;page&gt;<br>second<p>third {i}<!-- no --></body></html>")


def test_template_removal(spark):
    rows = [page(i) for i in range(10)] + [page(20 + i, f"solo{i}.example") for i in range(3)] + [(90, None, None), (91, "x", ""), (92, "https://h.example/z", "<p>a<b>c</p></div>d")]
    d = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r for r in htmltext.extract_pages(d).collect()}
    assert got[3].text == "Body 3 of <page>\nsecond\nthird 3" and got[3].removed >= 1 and got[3].title == "T3 & more" and got[3].host == "h.example"
    assert got[20].text == "Home\nAbout us\nBody 20 of <page>\nsecond\nthird 20" and got[20].removed == 0
    assert got[90].text == got[91].text == "" and got[92].text == "ac\nd" and len(got) == len(rows)


def site(spark, bodies):
    d = spark.createDataFrame([(i, "https://h.example/x", f"<html><head><script>track({i})</script></head><body>{b}</body></html>") for i, b in enumerate(bodies)], "page_id bigint, url string, html string")
    return [r.text for r in htmltext.extract_pages(d).orderBy("page_id").collect()]


def test_copies_keep_their_content(spark):
    menus = [f"<nav><a href='/{k}'>Menu {k}</a></nav>" for k in range(6)]
    article = "<article><h1>Head</h1><p>One article that was fetched many times</p></article>"
    kept = "Head\nOne article that was fetched many times"
    other = [menus[i % 6] + f"<p>Page {i} alone</p>" for i in range(60)]
    # Equal pages, then copies below different menus.
    assert site(spark, [menus[0] + article] * 8 + other) == [kept] * 8 + [f"Page {i} alone" for i in range(60)]
    assert site(spark, [menus[i % 6] + article for i in range(12)] + other) == [kept] * 12 + [f"Page {i} alone" for i in range(60)]
    # Every page comes below every menu.
    every = [m + f"<div><p>Long text of page {i} that is its own</p></div>" for i in range(6) for m in menus]
    assert site(spark, every) == [f"Long text of page {i} that is its own" for i in range(6) for _ in menus]


def test_large_host_with_many_templates(spark):
    # 30 menus of 7 pages each are 3 % of their host.
    pages = [f"<nav><a href='/{i % 30}'>Menu {i % 30}</a></nav><p>Text {i}</p><footer>Foot {i % 30}</footer>" for i in range(210)]
    assert site(spark, pages) == [f"Text {i}" for i in range(210)]


def test_equal_subtrees_have_equal_hashes():
    a, b = htmltext.parse("<div><p class='x' id=y>t  t</p></div>"), htmltext.parse("<DIV ><p id='y' class=\"x\">t t</p></DIV>")
    assert htmltext.subtree_hashes(a) == htmltext.subtree_hashes(b) != htmltext.subtree_hashes(htmltext.parse("<div><p>t t</p></div>"))


# --- 7 pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary()


def brute_nbest(v, text, n):
    s = pieces.MARK + text.replace(" ", pieces.MARK)
    into, best = pieces.edges(v, s), {0: [(0.0, ())]}
    for j in range(1, len(s) + 1):
        best[j] = sorted(((sc + w, (*p, (i, k))) for i, k, w in into[j] for sc, p in best[i]), key=lambda x: -x[0])[:n]
    return [sc for sc, _ in best[len(s)]]


def test_nbest_against_brute_force(vocabulary):
    rng = random.Random(5)
    texts = ["hello world", "  two  blanks ", "a", " ", "\n\t x ñ 日本 😀 zz", "x" * 90, "re re re  re"] + ["".join(rng.choice("ab éthe rin\n") for _ in range(rng.randint(1, 25))) for _ in range(60)]
    for few in (1, 10**9):  # whole-batch passes, and word by word
        pieces.FEW, old = few, pieces.FEW
        got = pieces.Encoder(vocabulary, 4).encode(pa.array(texts)).to_pylist()
        pieces.FEW = old
        for t, r in zip(texts, got):
            assert r["exact"] and vocabulary.decode(np.array(r["ids"])).decode() == t
            assert [round(e["score"], 6) for e in r["nbest"]] == [round(s, 6) for s in brute_nbest(vocabulary, t, 4)]
            whole = {tuple(pieces.expand(r["ids"], r["word_sizes"], e["changes"])) for e in r["nbest"]}
            assert len(whole) == len(r["nbest"]) and all(vocabulary.decode(np.array(w)).decode() == t for w in whole)


def test_decoding(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    e = pieces.encode_documents(d)
    assert e.filter("not exact").isEmpty()
    assert pieces.decode_documents(e).exceptAll(d.select("doc_id", "text")).isEmpty()


# --- 8 near copies


def test_near_copies_against_brute_force(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    p = d.toPandas()
    idf = near.inverse_frequencies(d.select("doc_id", "text"))
    row, h, tf = near.features(pa.array(p.text.tolist()))
    w = (tf * idf[near._bucket(h)]).astype(float)
    f = [dict(zip(h[row == i].tolist(), w[row == i].tolist())) for i in range(len(p))]
    total = [sum(x.values()) for x in f]
    label = {r.doc_id: r.keep_id for r in near.near_copies(d).collect()}
    group = [label.get(i, i) for i in p.doc_id]
    hit = miss = 0
    for i, j in itertools.combinations(range(len(p)), 2):
        both = sum(min(f[i][k], f[j][k]) for k in f[i].keys() & f[j].keys())
        if both and both / (total[i] + total[j] - both) >= near.THRESHOLD:
            hit, miss = hit + (group[i] == group[j]), miss + (group[i] != group[j])
    assert hit / max(1, hit + miss) >= 0.9 and hit > 10


def test_document_frequencies_are_exact(spark, sf):
    # More distinct shingles than 2^18 buckets tell apart.
    d = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet").select("doc_id", "text").filter("text is not null")
    _, h, _ = near.features(pa.array(d.toPandas().text.tolist(), pa.large_string()))
    keys, n = np.unique(h, return_counts=True)
    idf = near.exact_frequencies(d)
    assert idf.bits > 0 and idf.docs == d.count() and (idf.count(keys) == n).all() and sum(idf.sizes.values()) == (n > 1).sum()
    assert (idf.count(np.array([1, 2**63], np.uint64)) == 1).all()
    true = np.maximum(np.log((1 + idf.docs) / (1 + n)), 0.05)
    assert np.allclose(near.weigh(idf, keys), true, atol=1e-5) and not np.allclose(near.inverse_frequencies(d)[near._bucket(keys)], true, atol=0.1)


def test_samples_estimate_similarity():
    rng = np.random.default_rng(0)
    a = " ".join(f"w{i}" for i in range(400))
    b = " ".join(f"w{i}" if rng.random() > 0.05 else f"v{i}" for i in range(400))
    row, h, tf = near.features(pa.array([a, b]))
    w = rng.gamma(2, 1, 1 << 16)[(h >> np.uint64(48)).astype(int)] * tf
    x, y = dict(zip(h[row == 0].tolist(), w[row == 0])), dict(zip(h[row == 1].tolist(), w[row == 1]))
    both = sum(min(x[k], y[k]) for k in x.keys() & y.keys())
    true = both / (sum(x.values()) + sum(y.values()) - both)
    _, s = near.sketch(row, h, w.astype(np.float32))
    assert abs((s[0] == s[1]).mean() - true) < 4 * (true * (1 - true) / near.SAMPLES) ** 0.5


def test_verifier_over_any_cuts():
    rng = np.random.default_rng(0)
    idf = np.ones(1 << near.BITS, np.float32)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(30)], rng.integers(0, 12))) for _ in range(60)]

    def sim(x, y):
        (_, ha, ta), (_, hb, tb) = near.features(pa.array([x])), near.features(pa.array([y]))
        a, b = dict(zip(ha.tolist(), ta.tolist())), dict(zip(hb.tolist(), tb.tolist()))
        top = sum(max(a.get(k, 0), b.get(k, 0)) for k in a.keys() | b.keys())
        return sum(min(a.get(k, 0), b.get(k, 0)) for k in a.keys() & b.keys()) / top if top else 0

    rows = [(g, m, texts[j]) for g in range(10) for m, j in [(False, g), *((True, int(j)) for j in rng.integers(0, 60, 5)), (True, g)]]
    want = [sim(texts[g], t) for g, m, t in rows if m]
    for cut in (1, 2, 3, 7, 100):
        v, got = near.Verifier(idf), []
        for i in range(0, len(rows), cut):
            p = rows[i : i + cut]
            got += v.feed(np.array([r[0] for r in p]), np.array([r[1] for r in p]), pa.array([r[2] for r in p])).tolist()
        assert np.allclose([x for x, r in zip(got, rows) if r[1]], want)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 30) if i % 7] + [(40, 50), (50, 45)]
    got = {r.doc_id: r.keep_id for r in near.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got[50] == got[45] == 40 and got[13] == got[8] == 8 and got[30] == 29


# --- 9 language ID


def test_language_held_out(spark, sf):
    d = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")
    train, test = d.filter("doc_id % 3 > 0"), d.filter("doc_id % 3 = 0")
    m = langid.train(train)
    got = langid.identify(test, m).join(test.select("doc_id", F.col("lang").alias("want")), "doc_id").toPandas()
    assert (got.lang == got.want).mean() > 0.97 and got.accepted.mean() > 0.98
    assert (m.weights == 0).mean() > 0.5 and m.temperature > 0
    bound = langid.train(train, sample=50)
    assert bound.langs == m.langs


@pytest.mark.parametrize("langs", [("de", "en"), ("de", "en", "es", "fr")])
def test_untaught_text_is_rejected(spark, sf, langs):
    d = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet").filter(F.col("lang").isin(*langs))
    m = langid.train(d)
    rng = random.Random(1)
    bad = ["Все люди рождаются свободными и равными в своем достоинстве и правах.", "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι.", "すべての人間は、生まれながらにして自由であり", "人人生而自由,在尊严和权利上一律平等。"]
    bad += [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(40)) for _ in range(20)]
    assert not any(r.accepted for r in langid.identify(docs_of(spark, bad), m).collect())
    assert langid.keep_identified(docs_of(spark, bad), m).isEmpty()
    assert langid.identify(d, m).filter("accepted").count() > 0.98 * d.count()


def test_temperature_lowers_loss():
    rng = np.random.default_rng(0)
    z = rng.standard_normal((2000, 3)) * 3
    y = np.array([rng.choice(3, p=langid.softmax(r / 2)) for r in z])
    assert 1.7 < langid.temperature(z, y) < 2.4


# --- 10 decontamination


class Seen:
    """Frequencies of shingles over some items."""

    def __init__(self, items):
        self.docs, self.n = len(items), {}
        for x in items:
            for h in set(shingles(Tokens(pa.array([x]), NONWORD), 3)[0].tolist()):
                self.n[h] = self.n.get(h, 0) + 1

    def count(self, h):
        return np.array([self.n.get(x, 1) for x in h.tolist()], np.int64)


def test_multi_index_finds_all_within_radius():
    rng = np.random.default_rng(1)
    marks = rng.integers(0, 1 << decon.BITS, (80, decon.TABLES)).astype(np.uint64)
    index = decon.MultiIndex(marks)
    x = []
    for _ in range(300):
        t, k = rng.integers(decon.TABLES), int(rng.integers(80))
        row = rng.integers(0, 1 << decon.BITS, decon.TABLES).astype(np.uint64)
        row[t] = int(marks[k, t]) ^ sum(1 << int(b) for b in rng.choice(decon.BITS, int(rng.integers(0, decon.RADIUS + 5)), replace=False))
        x.append(row)
    x = np.array(x)
    want = {(r, k) for r in range(300) for k in range(80) if any((int(x[r, t]) ^ int(marks[k, t])).bit_count() <= decon.RADIUS for t in range(decon.TABLES))}
    assert set(zip(*map(np.ndarray.tolist, index.lookup(x)))) == want and len(want) > 100


def test_lookups_meet_few_of_many_items():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30_000)]
    items = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(20_000)]
    index = decon.Index(list(range(len(items))), pa.array(items), Seen(items))
    x = np.random.default_rng(2).integers(0, 1 << decon.BITS, (100, decon.TABLES)).astype(np.uint64)
    met = [len(set(zip(*map(np.ndarray.tolist, index.classes[30][2].met(x[:, t], t))))) for t in range(decon.TABLES)]
    assert max(met) < 0.05 * 100 * len(items)
    text = " ".join([rng.choice(words) for _ in range(100_000)] + items[77].split() + [rng.choice(words) for _ in range(100_000)])
    assert [(r, i, round(s, 6), w) for r, i, s, w in index.matches(pa.array([text, None, ""]), decon.THRESHOLD)] == [(0, 77, 1.0, 100_000)]


def test_fingerprints_of_windows_are_those_of_their_texts():
    rng = np.random.default_rng(3)
    h, w = rng.integers(0, 2**63, 5000).astype(np.uint64), rng.integers(1, 10**7, 5000)
    start = np.sort(rng.integers(0, 4900, 400))
    end = start + rng.integers(1, 100, 400)
    one = np.concatenate([decon.prints(h[a:b], w[a:b], np.array([0]), np.array([b - a])) for a, b in zip(start, end)])
    assert (decon.Index._prints(h, w, start, end) == one).all() and (decon.prints(h, w, start, end) == one).all()


def test_benchmark_pieces_agree(spark, sf, monkeypatch):
    d, b = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    one = set(map(tuple, decon.contaminated(d, b).collect()))
    monkeypatch.setattr(decon, "PIECE_BYTES", 2000)
    assert set(map(tuple, decon.contaminated(d, b).collect())) == one and one


# --- awkward tables

OPERATORS = {
    "pii": lambda s, d: pii.pii_spans(d),
    "repeats": lambda s, d: repeats.repeated_passages(d),
    "cut": lambda s, d: repeats.cut_repeats(d),
    "tokens": lambda s, d: tokenbin.write_tokens(d),
    "exact": lambda s, d: exact.exact_copies(d),
    "secrets": lambda s, d: secrets.scan(d),
    "pieces": lambda s, d: pieces.encode_documents(d),
    "near": lambda s, d: near.near_copies(d),
    "language": lambda s, d: langid.identify(d),
    "leaks": lambda s, d: decon.contaminated(d, bench_of(s)),
    "pages": lambda s, d: htmltext.extract_pages(d.select(F.col("doc_id").alias("page_id"), F.lit("http://h/x").alias("url"), F.col("text").alias("html"))),
    "exact_drop": lambda s, d: exact.drop_exact_copies(d),
    "near_drop": lambda s, d: near.drop_near_copies(d),
    "language_drop": lambda s, d: langid.keep_identified(d),
    "leaks_drop": lambda s, d: decon.drop_contaminated(d, bench_of(s)),
}
#: Rows that three rows of nulls give.
OF_NULLS = {"cut": 3, "tokens": 3, "pieces": 3, "language": 3, "pages": 3, "exact_drop": 3, "near_drop": 3, "leaks_drop": 3}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, docs_of(spark, [])).isEmpty()


@pytest.mark.parametrize("name", OPERATORS)
def test_all_null_table(spark, name):
    d = spark.createDataFrame([(None, None, None, None, None)] * 3, DOCS)
    assert OPERATORS[name](spark, d).count() == OF_NULLS.get(name, 0)


def test_ties_and_repeated_rows(spark):
    """Equal rows, equal doc_ids and equal scores give what the docstrings say, in whatever order the rows come."""
    rows = [(2, "same text of both", "en", "b", 1), (2, "same text of both", "en", "a", 1), (2, "same text of both", "en", "a", 1), (1, "another, one b@c.example.com b@c.example.com", "en", None, 2), (None, "same text of both", "en", "a", 1)]
    out = []
    for order in (rows, rows[::-1]):
        d = spark.createDataFrame(order, DOCS).repartition(3)
        key = lambda df: sorted(map(str, df.collect()))
        out.append([key(exact.drop_exact_copies(d)), key(exact.exact_copies(d)), key(pii.pii_spans(d)), key(tokenbin.write_tokens(d).select("doc_id", "n_tokens")), key(langid.identify(d).select("doc_id", "lang", "accepted")), key(pieces.encode_documents(d)), key(near.near_copies(d))])
    assert out[0] == out[1]
    assert out[0][0] == [str(r) for r in sorted(spark.createDataFrame([rows[1], rows[3]], DOCS).collect(), key=str)]
    assert len(out[0][2]) == 2 and len(out[0][3]) == 5 and out[0][6] == []
    # Three equal pages are one page, so nothing recurs.
    p = spark.createDataFrame([(7, "http://h/x", "<p>once</p><div>twice</div>")] * 6, "page_id bigint, url string, html string")
    assert {(r.text, r.removed) for r in htmltext.extract_pages(p).collect()} == {("once\ntwice", 0)}


def test_awkward_table(spark):
    d = awkward(spark)
    n = d.count()
    assert pii.pii_spans(d).filter("kind <> 'phone'").isEmpty()
    r = repeats.repeated_passages(d).collect()
    assert {x.doc_id for x in r} == {4, 5} and all(x.end_word <= 40_000 for x in r)
    t = tokenbin.write_tokens(d).collect()
    assert len(t) == n and {x.doc_id for x in t if not x.n_tokens} == {1, 2, 3}
    assert {(x.doc_id, x.keep_id) for x in exact.exact_copies(d).collect()} == {(3, 2), (5, 4)}
    assert exact.drop_exact_copies(d).count() == n - 3 and exact.drop_exact_copies(d).columns == d.columns
    assert {(x.doc_id, x.keep_id) for x in near.near_copies(d).collect()} == {(5, 4)}
    kept = near.drop_near_copies(d)
    assert kept.count() == n - 1 and kept.columns == d.columns
    e = {x.doc_id: x for x in pieces.encode_documents(d).collect()}
    assert e[1].ids is None and e[1].nbest == [] and e[2].ids == [] and [x.score for x in e[2].nbest] == [0.0] and all(x.exact for x in e.values())
    g = langid.identify(d).collect()
    assert len(g) == n and {x.doc_id for x in g if x.lang == "und"} == {1, 2, 3, 8, 10}
    m = langid.keep_identified(d, min_prob=0.0)
    assert m.columns == d.columns and not {r[0] for r in m.collect()} & {1, 2, 3, 8, 10}
    leaks = {(x.doc_id, x.item_id) for x in decon.contaminated(d, bench_of(spark)).collect()}
    assert leaks == {(6, 4)}
    c = decon.drop_contaminated(d, bench_of(spark))
    assert c.count() == n - 2 and c.columns == d.columns
    assert secrets.scan(d).isEmpty()
    key = "8b0e7153bf7c3706d85c524e440066559a6656c9"
    texts = [" ".join(["the", "and", "thing", "education", "different"] * 40)] * 8
    s = docs_of(spark, [*texts, texts[0] + " " + key, texts[0] + " " + key, None, ""]).unionByName(spark.createDataFrame([(None, texts[0] + " x" * 100_000 + f" {key} ", "en", "s", 1)], DOCS)).withColumns({"start": F.lit(1), "band": F.lit("x")})
    assert sorted((str(r.doc_id), r.length) for r in secrets.scan(s).collect()) == [("8", 40), ("9", 40), ("None", 40)]


def test_awkward_benchmark(spark):
    d = docs_of(spark, ["alpha beta gamma delta", "nothing"])
    assert [(r.doc_id, r.item_id) for r in decon.contaminated(d, bench_of(spark)).collect()] == [(0, None)]
    assert decon.contaminated(d, bench_of(spark, [(1, None)])).isEmpty()
    assert decon.drop_contaminated(d, spark.createDataFrame([], BENCH)).count() == 2


def test_awkward_pages(spark):
    e = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert htmltext.extract_pages(e).isEmpty()
    long = "<div>" * 3000 + "deep" + "<p>" * 2000
    d = spark.createDataFrame([(1, "HTTPS://User@A.B:80/x", long), (1, "HTTPS://User@A.B:80/x", long), (None, None, None)], "page_id bigint, url string, html string").withColumns({"host": F.lit(1), "hashes": F.lit(1)})
    got = htmltext.extract_pages(d).collect()
    assert sorted(str(r.text) for r in got) == ["", "deep", "deep"] and {r.host for r in got} == {"a.b", ""}


def test_missing_column(spark):
    with pytest.raises(ValueError, match="missing"):
        pii.pii_spans(spark.createDataFrame([(1,)], "doc_id bigint"))


# --- pipeline


def test_pipeline_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "sentencepiece"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, sf), name)
        assert docs.columns == columns
    assert exact.exact_copies(docs).isEmpty() and decon.contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).isEmpty()
    out = corpus_pipeline.run(spark, sf)
    assert 0 < out.count() == docs.count() < before and out.filter("not exact").isEmpty()


def test_pipeline_over_awkward_documents(spark, tmp_path):
    d = awkward(spark, clash=False)
    d.write.parquet(str(tmp_path / "documents.parquet"))
    bench_of(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    # 4 and 5 are copies, of which the first stays; 6 is a benchmark item, twice; the others are of no told language.
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} - {None, 7, 9} == {4}
    (d.limit(0)).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()


