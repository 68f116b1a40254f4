"""Operator 2, suffix-array dedup: passages of at least ``threshold`` words that occur more than once.

Suffixes are ordered through ``threshold`` tokens only, by most-significant-digit radix passes, so equal groups
are exactly the windows of that many tokens that occur again. Tokens are runs without ASCII white space, taken as they are.

The first digit is the window's anchor, the least hash among its ``K``-token grams (the leftmost of
equals), with its side: the tokens after the anchor that all windows hold in whose first half it lies, or those before it that all the others hold. Equal
windows have equal anchors at equal places, so a window whose first digit occurs once is unique and
leaves at once; no repeated window is lost. Neighbouring windows share digits, so only
one in about ten tokens is shuffled to be counted. For digits that occur again
the tokens of their windows go to the digit's partition, where radix passes over DIGIT tokens at
a time split the buckets and drop what has become unique, until the depth is reached. Stretches of equal tokens are sorted
once, however often they occur, so a passage of many documents costs its task only a row each.

Results: for each document the maximal runs of repeated windows, merged when they touch or overlap,
as word bounds [start_word, end_word), apart by whether the windows are the first occurrences (``first``: least doc_id,
then place) or later ones; ``copies`` is the largest number of occurrences among the
run's windows. Occurrences within one document count. A text of fewer words than the threshold, a null or an empty one has
none. Rows with a null doc_id are left out; rows with one doc_id and one text are one document, different texts of one doc_id are different ones.
Very long texts count whole. An empty table gives no rows. Extra columns, also such with clashing names, are ignored by
:func:`repeated_passages` and passed through by :func:`cut_repeats`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import BROADCAST_BYTES, Masked, join_checked, pick, spread, stored
from .vector import SPACE, U64, Tokens, mix, slices, tidy

THRESHOLD, K, DIGIT = 50, 8, 5
#: Rows whose buckets are sorted together; a bucket is never split.
ROWS = 5_000
#: About what a stretch of windows takes in a shuffle.
STRETCH_BYTES = 400


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-token grams that begin at each token; at the end of the array, of what is left."""
    out, done, part, size, power = np.zeros(len(h), U64), 0, h, 1, U64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):

        def joined(x: np.ndarray, y: np.ndarray, at: int) -> np.ndarray:
            """x and then y, that begins ``at`` tokens later and is ``size`` long."""
            x = x * power
            x[: max(0, len(h) - at)] += y[at:]
            return x

        # Grams of 1, 2, 4 ... tokens, and of the binary digits of n.
        while size <= n:
            if n & size:
                out, done = joined(out, part, done), done + size
            part, size, power = joined(part, part, size), size * 2, power * power
    return mix(out)


def anchors(tok: Tokens, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first token, windows, first digit) of every stretch of windows with one anchor and side."""
    n, span = len(tok.hash), threshold - K + 1
    if n < threshold:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(U64)
    full = _grams(tok.hash, K)
    places = U64((1 << 24) - 1)
    key = (full & ~places) | (np.arange(n).astype(U64) & places)
    width = 1
    while width * 2 <= span:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if span > width:
        key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
    begin = np.flatnonzero(tok.doc[: n - threshold + 1] == tok.doc[threshold - 1 :])
    if not len(begin):
        return begin, begin, begin.astype(U64)
    low = (key[begin] & places).astype(np.int64)
    at = begin + ((low - begin) & int(places))
    after = (threshold - K) // 2
    before = threshold - K - after + 1
    left = at - begin >= before
    one = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (left[1:] != left[:-1])]))
    first, at, left = begin[one], at[one], left[one]
    side = np.where(left, _grams(tok.hash, before)[np.maximum(at - before, 0)], _grams(tok.hash, after)[np.minimum(at + K, n - 1)])
    with np.errstate(over="ignore"):
        digit = mix(full[at] * U64(0xD6E8FEB86659FD93) + mix(side + left.astype(U64)))
    return first, np.diff(np.append(one, len(begin))), digit


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _count(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big):
                tok = Tokens(b.column(1), SPACE)
                first, _, h = anchors(tok, threshold)
                yield pa.record_batch([b.column(0).take(pa.array(tok.doc[first])), pa.array(_signed(h))], names=["doc_id", "key"])

    return run


def _stretches(threshold: int):
    """Rows (key, doc_id, start, windows, tokens): for each repeated first digit the tokens of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big):
                tok = Tokens(b.column(1), SPACE)
                first, windows, h = anchors(tok, threshold)
                if not len(first):
                    continue
                row = tok.doc[first]
                wanted = b.column(2)
                sizes = wanted.value_lengths().to_numpy(zero_copy_only=False)
                keys = wanted.flatten().to_numpy().view(U64)
                owner = np.repeat(np.arange(b.num_rows), sizes)
                # Of row and hash together: both sides as one sorted key.
                with np.errstate(over="ignore"):
                    have = np.sort(mix(keys + owner.astype(U64) * U64(0x9E3779B97F4A7C15)))
                    ask = mix(h + row.astype(U64) * U64(0x9E3779B97F4A7C15))
                if not len(have):
                    continue
                ok = have[np.minimum(np.searchsorted(have, ask), len(have) - 1)] == ask
                first, windows, row, h = first[ok], windows[ok], row[ok], h[ok]
                last = first + windows - 1 + threshold - 1
                text = tok.bytes.tobytes()
                parts = [text[x:y] for x, y in zip(tok.start[first].tolist(), tok.end[last].tolist())]
                yield pa.record_batch(
                    [pa.array(_signed(h)), b.column(0).take(pa.array(row)), pa.array((first - tok.first[row]).astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(parts, pa.binary())],
                    names=["key", "doc_id", "start", "windows", "tokens"],
                )

    return run


def radix(tokens: np.ndarray, place: np.ndarray, bucket: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Most-significant-digit radix sort of the suffixes at ``place`` within their buckets, through ``depth``
    tokens: (indices of suffixes equal to another, their groups). A digit is the hash of DIGIT tokens."""
    live, group = np.arange(len(place)), bucket
    digits = {DIGIT: _grams(tokens, DIGIT)}
    for d in range(0, depth, DIGIT):
        size = min(DIGIT, depth - d)
        if size not in digits:
            digits[size] = _grams(tokens, size)
        digit = digits[size][place[live] + d]
        order = np.lexsort((digit, group))
        live, group, digit = live[order], group[order], digit[order]
        head = np.ones(len(live), bool)
        head[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        group = np.cumsum(head) - 1
        keep = np.bincount(group, minlength=1)[group] > 1
        live, group = live[keep], group[keep]
    return live, group


def _runs(row: np.ndarray, j: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last, most copies) of the runs of neighbouring windows, that are sorted."""
    at = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (j[1:] != j[:-1] + 1)])) if len(row) else row
    end = np.append(at[1:], len(row))[: len(at)] - 1
    return row[at], j[at], j[end], np.maximum.reduceat(copies, at) if len(at) else copies


def _repeated(rows: list[pa.RecordBatch], threshold: int) -> pa.RecordBatch:
    t = pa.Table.from_batches(rows).combine_chunks()
    key, doc, start, windows = (t.column(i).to_numpy().astype(np.int64) for i in range(4))
    coded = t.column(4).combine_chunks().dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    # Occurrences by stretch, doc_id and place; a row repeated with its doc_id is the same occurrence.
    order = np.lexsort((start, doc, code))
    key, doc, start, windows, code = (x[order] for x in (key, doc, start, windows, code))
    new = np.concatenate([[True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1])])
    key, doc, start, windows, code = (x[new] for x in (key, doc, start, windows, code))
    head = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    times = np.diff(np.append(head, len(code)))
    # The windows of each stretch; its least occurrence stands for it.
    tok = Tokens(coded.dictionary.cast(pa.string()), SPACE)
    n = windows[head]
    row = np.repeat(np.arange(len(head)), n)
    j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    live, group = radix(tok.hash, tok.first[code[head[row]]] + j, np.unique(key[head], return_inverse=True)[1][row], threshold)
    # Windows of one stretch only, that occurs again.
    alone = times[row] > 1
    alone[live] = False
    alone = np.flatnonzero(alone)
    top = int(group.max(initial=-1)) + 1
    live, group = np.concatenate([live, alone]), np.concatenate([group, top + np.arange(len(alone))])
    order = np.lexsort((start[head[row[live]]] + j[live], doc[head[row[live]]], group))
    live, group = live[order], group[order]
    copies = np.bincount(group, times[row[live]], minlength=1).astype(np.int64)[group] if len(group) else group
    least = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else group.astype(bool)
    order = np.argsort(live)
    live, copies, least = live[order], copies[order], least[order]
    row, j = row[live], j[live]
    parts = []
    for of_head, mask in ((True, least), (True, ~least), (False, np.ones(len(live), bool))):
        r, a, z, most = _runs(row[mask], j[mask], copies[mask])
        if of_head:
            at, run = head[r], np.arange(len(r))
        else:  # every other occurrence has the runs of its stretch
            m = times[r] - 1
            run = np.repeat(np.arange(len(r)), m)
            at = np.repeat(head[r] + 1, m) + np.arange(len(run)) - np.repeat(np.cumsum(m) - m, m)
        parts.append((doc[at], start[at] + a[run], start[at] + z[run] + threshold, most[run], np.full(len(at), of_head and mask is least)))
    d, lo, hi, most, first = (np.concatenate(x) for x in zip(*parts))
    return pa.record_batch([pa.array(d), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(most.astype(np.int64)), pa.array(first)], names=["doc_id", "start_word", "end_word", "copies", "first"])


def _sort(threshold: int):
    """Over rows sorted by key: whole buckets are gathered and radix-sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(0).to_numpy()
            if n >= ROWS or (n and n + b.num_rows > 2 * ROWS):
                # Up to where the last held key ends, the bucket is whole.
                cut = int(np.searchsorted(key, held[-1].column(0)[-1].as_py(), "right"))
                held.append(b.slice(0, cut))
                if cut < b.num_rows:
                    yield _repeated(held, threshold)
                    held, n = [], 0
                b = b.slice(cut)
            if b.num_rows:
                held.append(b)
            n += b.num_rows
        if held:
            yield _repeated(held, threshold)

    return run


def repeated_passages(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, start_word, end_word, copies, first) of every repeated passage."""
    if threshold < K:
        raise ValueError(f"the threshold must be at least {K}")
    rows = pick(docs, doc_id="bigint", text="string").filter("doc_id is not null and text is not null")
    found = stored(rows.mapInArrow(tidy(_count(threshold)), "doc_id bigint, key bigint"), "anchors")
    again = stored(found.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "anchors-again")
    wanted = stored(join_checked(found, again, "key", "left_semi", 16).groupBy("doc_id").agg(F.collect_set("key").alias("keys")), "anchors-wanted")
    keys, held = (x or 0 for x in wanted.agg(F.sum(F.size("keys")), F.count("*")).first())
    with_keys = rows.join(F.broadcast(wanted) if keys * 8 + held * 32 <= BROADCAST_BYTES else wanted, "doc_id").select("doc_id", "text", "keys")
    stretches = with_keys.mapInArrow(tidy(_stretches(threshold)), "key bigint, doc_id bigint, start int, windows int, tokens binary")
    parts = spread(stretches, keys * STRETCH_BYTES, "key").sortWithinPartitions("key").mapInArrow(tidy(_sort(threshold)), "doc_id bigint, start_word int, end_word int, copies bigint, first boolean")
    order = W.partitionBy("doc_id", "first").orderBy("start_word", "end_word")
    before = F.max("end_word").over(order.rowsBetween(W.unboundedPreceding, -1))
    island = F.sum(F.when(before >= F.col("start_word"), 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0))
    return (
        parts.withColumn("island", island).groupBy("doc_id", "first", "island")
        .agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.max("copies").alias("copies"))
        .select("doc_id", F.col("start_word").cast("bigint").alias("start_word"), F.col("end_word").cast("bigint").alias("end_word"), "copies", "first")
    )


def _cut(batches: Iterator[pa.RecordBatch], text_at: int, cuts_at: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, cuts in zip(b.column(text_at), b.column(cuts_at)):
            t, spans = text.as_py(), cuts.as_py()
            if t and spans:
                tok = Tokens(pa.array([t]), SPACE)
                raw, at, kept = t.encode(), 0, []
                for s in sorted(spans, key=lambda s: s["a"]):
                    lo, hi = int(tok.start[s["a"]]), int(tok.end[min(s["b"], len(tok.end)) - 1])
                    if hi > at:
                        kept.append(raw[at : max(at, lo)])
                        at = hi
                t = (b"".join(kept) + raw[at:]).decode()
            out.append(t)
        yield b.set_column(text_at, b.schema.field(text_at), pa.array(out, b.schema.field(text_at).type))


def cut_repeats(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The documents with every later occurrence of a repeated passage cut out of the text; first occurrences stay."""
    m = Masked(docs)
    gone = repeated_passages(docs, threshold).filter("not first").groupBy("doc_id").agg(F.collect_list(F.struct(F.col("start_word").alias("a"), F.col("end_word").alias("b"))).alias("cuts"))
    text_at = m.names.index("text")
    joined = m.df.withColumn("doc_id", m["doc_id"].cast("bigint")).join(stored(gone, "cuts"), "doc_id", "left").select(*m.cols, "cuts")
    cuts_at = len(m.cols)
    return m.restore(joined.mapInArrow(lambda it: _cut(it, text_at, cuts_at), joined.schema))


ORACLE = f"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, w, unnest(range(0, len(w) - {THRESHOLD} + 1)) AS pos FROM t WHERE len(w) >= {THRESHOLD}),
v AS (SELECT doc_id, pos, array_to_string(w[pos + 1 : pos + {THRESHOLD}], ' ') AS s FROM u),
r AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY s) AS copies, row_number() OVER (PARTITION BY s ORDER BY doc_id, pos) = 1 AS first FROM v),
k AS (SELECT *, lag(pos) OVER (PARTITION BY doc_id, first ORDER BY pos) AS before FROM r WHERE copies > 1),
i AS (SELECT *, sum(CASE WHEN before + {THRESHOLD} >= pos THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, first ORDER BY pos) AS island FROM k)
SELECT doc_id, CAST(min(pos) AS BIGINT) AS start_word, CAST(max(pos) + {THRESHOLD} AS BIGINT) AS end_word, CAST(max(copies) AS BIGINT) AS copies, first
FROM i GROUP BY doc_id, first, island"""
