"""Operator 7, SentencePiece encoding and decoding with exact N-best segmentation.

The piece lattice of a text has an edge for every usable piece of the vocabulary at every
place; a segmentation's score is the sum of its pieces' scores. A code point without a piece is
one edge of score ``min - 10`` that is written as byte pieces. Pieces of score -1e9 are unusable, but a
lone blank mark counts as unknown. Blanks become U+2581, and one is put
before the text, as the model file asks.

Forward Viterbi gives each node the exact score of its best prefix. Backward A-star search from the
lattice's end uses it as its heuristic: being exact, the search leaves the heap with complete paths in
order of score; of equal scores the one whose last differing piece is longer comes first. No usable piece holds U+2581 behind its first place, so a text's lattice is a chain of
words' lattices. A long word's lattice (text of a script without blanks is one word) is cut further, where no piece spans the cut. Viterbi runs on all new words of a batch at once, forward and backward, which gives
each word its best path and what its second best loses. Only the words that lose least
can differ in a text's N best: those are searched, and their alternatives are merged in order.

Result: ``ids`` is the best segmentation; ``nbest`` has N entries in order (score, changes), where
changes lists the words (index, ids) that differ from the best one; :func:`expand` gives all ids. A null text has null ids and no
entries, an empty one no ids and one entry of score 0. A text with fewer segmentations has fewer
entries. Very long texts count whole. ``exact``: decoding gave back the text. Repeated rows give repeated results, a null doc_id stays null, and
no result depends on the other rows. An empty table gives no rows. Extra columns are ignored, also such with clashing names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import pick, ship, shipped
from .vector import U64, Tokens, slices, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NBEST = 4
MARK = "▁"
_ONLY_BLANK = np.zeros(256, bool)
_ONLY_BLANK[32] = True
#: Words longer than this are searched one by one.
LONG = 64
#: Of a length that fewer new words have, too: a whole-batch pass has a cost of its own.
FEW = 100
#: Words that a task keeps; the kept ones are dropped at once when there are more.
CACHE = 400_000
#: Bytes of text encoded at a time.
BATCH_BYTES = 2 << 20
_B = U64(0xD1342543DE82EF95)
_B_INV = U64(pow(0xD1342543DE82EF95, -1, 2**64))


class Vocabulary:
    """Pieces of a model file: ids, scores, byte pieces and a hash table for whole-batch lookups."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.path = path
        self.piece: dict[str, tuple[int, float]] = {}
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_id = [-1] * 256
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(p[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.bytes_of[i] = p.replace(MARK, " ").encode()
                if sp.get_score(i) > -1e8:
                    self.piece[p] = (i, float(sp.get_score(i)))
        if -1 in self.byte_id:
            raise ValueError("the model has no byte pieces; unknown characters could not be decoded")
        if any(MARK in p[1:] for p in self.piece):
            raise ValueError("a usable piece spans words")
        self.longest = max(map(len, self.piece))
        self.unknown = min(s for _, s in self.piece.values()) - 10
        for p in (MARK,):  # without a score of its own in models that never emit it by merging
            if p not in self.piece and sp.id_to_piece(i := sp.piece_to_id(p)) == p:
                self.piece[p] = (i, self.unknown)
        self.length = np.array([len(b) for b in self.bytes_of], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.length)])
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        keys = np.array([self.hash_of(p) for p in self.piece], U64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], U64(0))
        self.key_id = np.append(np.array([v[0] for v in self.piece.values()])[order], -1)
        self.key_score = np.append(np.array([v[1] for v in self.piece.values()])[order], -np.inf)
        self.slot = np.searchsorted(self.keys[:-1] >> U64(46), np.arange((1 << 18) + 1, dtype=np.int64).astype(U64)).astype(np.int32)
        self.deepest = int(np.diff(self.slot).max())

    @staticmethod
    def hash_of(piece: str) -> int:
        h, m = 0, 1
        for c in piece:
            h = (h + _scatter_int(ord(c)) * m) & (2**64 - 1)
            m = (m * int(_B)) & (2**64 - 1)
        return (h * 0xFF51AFD7ED558CCD & (2**64 - 1)) ^ ((h * 0xFF51AFD7ED558CCD & (2**64 - 1)) >> 32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash in the table; the last one (score -inf) if it is no piece."""
        slot = (h >> U64(46)).astype(np.int64)
        at, end = self.slot[slot], self.slot[slot + 1]
        out = np.full(len(h), len(self.keys) - 1)
        open_ = np.flatnonzero(at < end)
        at, end, want = at[open_], end[open_], h[open_]
        for _ in range(self.deepest):
            same = self.keys[at] == want
            out[open_[same]] = at[same]
            more = ~same & (at + 1 < end)
            open_, at, end, want = open_[more], at[more] + 1, end[more], want[more]
            if not len(open_):
                break
        return out

    def byte_ids(self, char: str) -> list[int]:
        return [self.byte_id[b] for b in char.encode("utf-8", "surrogatepass")]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of a whole segmentation, its first blank taken off."""
        out = self.joined(ids).tobytes()
        return out[1:] if out[:1] == b" " else out

    def joined(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        return self.flat[np.repeat(self.at[ids], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]


def _scatter_int(c: int) -> int:
    x = (c + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)
    return x ^ (x >> 29)


def _scatter(c: np.ndarray) -> np.ndarray:
    x = (c.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15)
    return x ^ (x >> U64(29))


def edges(v: Vocabulary, word: str) -> list[list[tuple[int, int, float]]]:
    """For every end, the lattice's edges into it: (start, piece id or -1 for unknown, score)."""
    out: list[list[tuple[int, int, float]]] = [[]]
    for j in range(1, len(word) + 1):
        into = [(i, *v.piece[word[i:j]]) for i in range(max(0, j - v.longest), j) if word[i:j] in v.piece]
        if word[j - 1 : j] not in v.piece:
            into.append((j - 1, -1, v.unknown))
        out.append(into)
    return out


def nbest(v: Vocabulary, word: str, n: int) -> list[tuple[float, list[int]]]:
    """The ``n`` best segmentations (score, ids): forward Viterbi, then backward A-star with it as heuristic."""
    into = edges(v, word)
    best: list[float] = [0.0] + [-np.inf] * len(word)
    came: list[tuple[int, int]] = [(0, 0)] * (len(word) + 1)
    for j in range(1, len(word) + 1):
        for i, piece, s in into[j]:
            if best[i] + s > best[j]:
                best[j], came[j] = best[i] + s, (i, piece)
    path, pos = [], len(word)
    while pos:
        path.append(came[pos])
        pos = came[pos][0]
    first: list[int] = []
    for i, piece in reversed(path):
        first += v.byte_ids(word[i]) if piece < 0 else [piece]
    # Of equal entries the last one goes first, so ties lead to a whole path at once.
    heap: list = [(-best[-1], 0, len(word), 0.0, None)]
    out: list[tuple[float, list[int]]] = []
    serial = 0
    while heap and len(out) < n:
        _, _, pos, score, tail = heapq.heappop(heap)
        if pos == 0:
            ids: list[int] = []
            while tail:
                (i, piece), tail = tail
                ids += v.byte_ids(word[i]) if piece < 0 else [piece]
            out.append((score, ids))
            continue
        for i, piece, s in reversed(into[pos]):
            serial -= 1
            heapq.heappush(heap, (-(best[i] + score + s), serial, i, score + s, ((i, piece), tail)))
    # The first is the forward pass's own path even if rounding puts an equal one before it.
    same = [k for k, (_, ids) in enumerate(out) if ids == first]
    return [out.pop(same[0])] + out if same else [(best[-1], first), *out[: n - 1]]


def segments(v: Vocabulary, word: str) -> list[str]:
    """A word cut wherever no usable piece spans the cut: its lattice is the chain of theirs."""
    n = len(word)
    c = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
    with np.errstate(over="ignore"):
        power, back = (np.multiply.accumulate(np.concatenate([[U64(1)], np.full(n, b)])) for b in (_B, _B_INV))
        prefix = np.concatenate([[U64(0)], np.cumsum(_scatter(c) * power[:n])])
        span = np.zeros(n + 1, np.int64)
        for size in range(2, min(v.longest, n) + 1):
            h = (prefix[size:] - prefix[:-size]) * back[: n - size + 1] * U64(0xFF51AFD7ED558CCD)
            i = np.flatnonzero(v.key_id[v.find(h ^ (h >> U64(32)))] >= 0)
            span[i + 1] += 1
            span[i + size] -= 1
    cuts = [*(np.flatnonzero(np.cumsum(span)[1:n] == 0) + 1).tolist(), n]
    return [word[a:b] for a, b in zip([0, *cuts], cuts)]


class Encoder:
    """Encodes whole batches; keeps the words met, as sorted hashes with flat arrays beside them."""

    def __init__(self, v: Vocabulary, n: int = NBEST):
        self.v, self.n = v, n
        self.more: dict[int, list[tuple[float, list[int]]]] = {}
        self.clear()

    def clear(self) -> None:
        """Forget all words but the lone blank mark, which is word 0."""
        self.hash, self.slot = np.zeros(0, U64), np.zeros(0, np.int32)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.score, self.loss = np.zeros(0), np.zeros(0)
        self.pieces = np.zeros(0, np.int32)
        self.more.clear()
        self._learn([MARK])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The word of each hash, -1 if not kept."""
        if not len(self.hash):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        return np.where(self.hash[at] == hashes, self.slot[at], -1)

    def keep(self, hashes: np.ndarray, words: list[str]) -> None:
        """Learn new words under their hashes."""
        first = len(self.start)
        self._learn(words)
        both = np.concatenate([self.hash, hashes])
        slot = np.concatenate([self.slot, np.arange(first, first + len(words), dtype=np.int32)])
        order = np.argsort(both, kind="stable")
        self.hash, self.slot = both[order], slot[order]

    def _learn(self, words: list[str]) -> None:
        """Best path, its score and the second best's loss of new words."""
        sizes, score, loss, ids = self._paths(words)
        self.start = np.concatenate([self.start, len(self.pieces) + np.cumsum(sizes, dtype=np.int64) - sizes])
        self.size, self.score, self.loss = np.concatenate([self.size, sizes]), np.concatenate([self.score, score]), np.concatenate([self.loss, loss])
        self.pieces = np.concatenate([self.pieces, ids])

    def _paths(self, words: list[str], cut: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(sizes, scores, losses, pieces of all words one after another)."""
        groups: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            groups.setdefault(len(w), []).append(k)
        n = len(words)
        sizes, score, loss = np.zeros(n, np.int32), np.zeros(n), np.zeros(n)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # (word of each piece, pieces), words' pieces in order
        long = [k for size, members in groups.items() if size > LONG for k in members] if cut else []
        if long:
            chains = [segments(self.v, words[k]) for k in long]
            number = {s: i for i, s in enumerate(dict.fromkeys(s for chain in chains for s in chain))}
            n1, s1, l1, ids1 = self._paths(list(number), False)
            first = np.cumsum(n1, dtype=np.int64) - n1
            for k, chain in zip(long, chains):
                part = np.array([number[s] for s in chain])
                m = n1[part]
                sizes[k], score[k], loss[k] = m.sum(), s1[part].sum(), l1[part].min()
                parts.append((np.full(sizes[k], k), ids1[np.repeat(first[part], m) + np.arange(sizes[k]) - np.repeat(np.cumsum(m) - m, m)]))
        for size, members in groups.items():
            if size > LONG and cut:
                continue
            if size > LONG or len(members) < FEW:
                for k in members:
                    two = nbest(self.v, words[k], 2)
                    score[k], loss[k] = two[0][0], two[0][0] - two[1][0] if len(two) > 1 else np.inf
                    sizes[k] = len(two[0][1])
                    parts.append((np.full(sizes[k], k), np.array(two[0][1], np.int32)))
            else:
                step = max(1, 100_000 // size)
                for a in range(0, len(members), step):
                    part = np.array(members[a : a + step])
                    owner, ids, score[part], loss[part] = self._viterbi([words[k] for k in part], size)
                    sizes[part] = np.bincount(owner, minlength=len(part))
                    parts.append((part[owner], ids))
        owner, ids = (np.concatenate(x) for x in zip(*parts))
        return sizes, score, loss, ids[np.argsort(owner, kind="stable")]

    def _viterbi(self, words: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of words of one length: (word of each piece, pieces, best scores, losses of the second best)."""
        v, m = self.v, len(words)
        c = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(m, size).T.copy()
        prefix = np.zeros((size + 1, m), U64)
        back = np.ones(size + 1, U64)
        score: dict[tuple[int, int], np.ndarray] = {}
        ident: dict[tuple[int, int], np.ndarray] = {}
        with np.errstate(over="ignore"):
            power = U64(1)
            for j in range(size):
                prefix[j + 1] = prefix[j] + _scatter(c[j]) * power
                power, back[j + 1] = power * _B, back[j] * _B_INV
            best = np.full((size + 1, m), -np.inf)
            best[0] = 0
            came = np.zeros((size + 1, m), np.int16)
            for j in range(1, size + 1):
                for i in range(max(0, j - v.longest), j):
                    h = (prefix[j] - prefix[i]) * back[i] * U64(0xFF51AFD7ED558CCD)
                    at = v.find(h ^ (h >> U64(32)))
                    s, k = v.key_score[at], v.key_id[at]
                    if i == j - 1:
                        s = np.where(k < 0, v.unknown, s)
                    elif not (k >= 0).any():
                        continue
                    score[i, j], ident[i, j] = s, k
                    t = best[i] + s
                    up = t > best[j]
                    best[j][up] = t[up]
                    came[j][up] = i
        rest = np.full((size + 1, m), -np.inf)
        rest[size] = 0
        for (i, j), s in sorted(score.items(), key=lambda x: -x[0][1]):
            np.maximum(rest[i], s + rest[j], out=rest[i])
        on = np.zeros((size + 1, m), bool)  # ends of the best path's edges
        pos, rows = np.full(m, size), np.arange(m)
        for _ in range(size):
            on[pos, rows] = True
            pos = np.where(pos > 0, came[pos, rows], 0)
        second = np.full(m, -np.inf)
        path: list[tuple[np.ndarray, np.ndarray]] = []
        for (i, j), s in score.items():  # by end, so that a word's pieces come in order
            used = on[j] & (came[j] == i)
            t = best[i] + s + rest[j]
            t[used] = -np.inf
            np.maximum(second, t, out=second)
            at = np.flatnonzero(used)
            if not len(at):
                continue
            k = ident[i, j][at]
            if i == j - 1 and (k < 0).any():
                path.append((at[k >= 0], k[k >= 0]))
                unknown = at[k < 0]
                code = c[i][unknown]
                data = code.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
                path.append((np.repeat(unknown, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)), np.array(v.byte_id)[np.frombuffer(data, np.uint8)]))
            else:
                path.append((at, k))
        owner, ids = (np.concatenate(x) for x in zip(*path))
        order = np.argsort(owner, kind="stable")
        return owner[order], ids[order].astype(np.int32), best[size], best[size] - second

    def _alternatives(self, key: int, word: str) -> list[tuple[float, list[int]]]:
        """(loss, ids) of a word's segmentations but the best, by loss."""
        got = self.more.get(key)
        if got is None:
            if len(word) > LONG:
                got = self._chained(word)
            else:
                found = nbest(self.v, word, self.n)
                got = [(found[0][0] - s, ids) for s, ids in found[1:]]
            self.more[key] = got
        return got

    def _chained(self, word: str) -> list[tuple[float, list[int]]]:
        """(loss, ids) of a long word's segmentations but the best: the segments that lose least are searched and merged."""
        chain = segments(self.v, word)
        number = {s: i for i, s in enumerate(dict.fromkeys(chain))}
        sizes, _, losses, ids = self._paths(list(number), False)
        part = np.array([number[s] for s in chain])
        loss = losses[part]
        near = np.sort(np.argsort(loss, kind="stable")[: self.n - 1])
        options = []
        for x in near[np.isfinite(loss[near])].tolist():
            found = nbest(self.v, chain[x], self.n)
            options.append((x, [(found[0][0] - s, other) for s, other in found[1:]]))
        first = np.cumsum(sizes) - sizes
        best = [ids[first[k] : first[k] + sizes[k]].tolist() for k in part.tolist()]
        out = []
        for lost, changes in merged(options, self.n)[1:]:
            new = dict(changes)
            out.append((lost, [i for x, own in enumerate(best) for i in new.get(x, own)]))
        return out

    def encode(self, texts: pa.Array) -> pa.StructArray:
        """Rows (ids, nbest, exact) of a string array."""
        tok = Tokens(texts, _ONLY_BLANK)
        n = len(texts)
        null = np.array(texts.is_null())
        distinct, first, which = np.unique(tok.hash, return_index=True, return_inverse=True)
        if len(self.hash) > CACHE:
            self.clear()
        buffer = tok.bytes.tobytes()
        bounds = list(zip(tok.start[first].tolist(), tok.end[first].tolist()))
        new = np.flatnonzero(self.find(distinct) < 0)
        if len(new):
            self.keep(distinct[new], [MARK + buffer[bounds[k][0] : bounds[k][1]].decode("utf-8", "surrogatepass") for k in new.tolist()])
        index = self.find(distinct)[which]
        # Words in order, a lone mark for each blank beyond the one before a word.
        gap = np.zeros(len(tok.start), np.int64)
        if len(gap):
            gap[1:] = tok.start[1:] - tok.end[:-1] - 1
            heads = tok.first[:-1][np.diff(tok.first) > 0]
            gap[heads] = tok.start[heads] - tok.off[tok.doc[heads]]
        tail = np.zeros(n, np.int64)
        has = np.diff(tok.first) > 0
        tail[has] = tok.off[1:][has] - tok.end[tok.first[1:][has] - 1]
        tail[~has] = np.diff(tok.off)[~has] + (np.diff(tok.off)[~has] > 0)
        words = np.diff(tok.first) + np.bincount(tok.doc, gap, n).astype(np.int64) + tail
        lone = 0
        unit = np.full(int(words.sum()), lone)
        begin = np.concatenate([[0], np.cumsum(words)])
        place = begin[tok.doc] + np.arange(len(tok.start)) - tok.first[tok.doc]
        cum = np.cumsum(gap)
        place += cum - (cum - gap)[tok.first[tok.doc]] if len(gap) else 0
        unit[place] = index
        size = self.size[unit]
        ids = self.pieces[np.repeat(self.start[unit], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
        ends = np.concatenate([[0], np.cumsum(size)])[begin]
        back = self.v.joined(ids)
        back_ends = np.concatenate([[0], np.cumsum(self.v.length[ids])])[ends]
        exact = np.ones(n, bool)
        whole = len(back) == len(tok.bytes) + int((np.diff(tok.off) > 0).sum())
        if whole:
            keep = np.ones(len(back), bool)
            keep[back_ends[:-1][np.diff(back_ends) > 0]] = False
            whole = np.array_equal(back[keep], tok.bytes)
        if not whole:
            for i in range(n):
                exact[i] = back[back_ends[i] : back_ends[i + 1]].tobytes()[1:] == buffer[tok.off[i] : tok.off[i + 1]]
        total = np.concatenate([[0], np.cumsum(self.score[unit])])[begin]
        loss = self.loss[unit]
        back_at = np.full(len(unit), -1)
        back_at[place] = np.arange(len(place))
        entries, counts, changes, change_counts, change_ids, change_sizes = [], np.zeros(n, np.int64), [], [], [], []
        for i in range(n):
            if null[i]:
                continue
            a, b = int(begin[i]), int(begin[i + 1])
            part = loss[a:b]
            m = self.n - 1
            near = np.argpartition(part, m)[: m + 1] if b - a > m + 1 else np.arange(b - a)
            if b - a > m + 1:
                # Ties at the cut go to earlier words.
                cut = np.sort(part[near])[m - 1]
                near = np.concatenate([np.flatnonzero(part < cut), np.flatnonzero(part == cut)])[:m]
            near = [int(x) for x in np.sort(near) if np.isfinite(part[x])]
            options = []
            for x in near:
                t = int(back_at[a + x])
                if t >= 0:
                    w = MARK + buffer[tok.start[t] : tok.end[t]].decode("utf-8", "surrogatepass")
                    options.append((x, self._alternatives(int(unit[a + x]), w)))
                else:
                    options.append((x, self._alternatives(lone, MARK)))
            found = merged(options, self.n)
            counts[i] = len(found)
            score = float(total[i + 1] - total[i])
            for lost, pick_ in found:
                entries.append(score - lost)
                change_counts.append(len(pick_))
                for x, alt in pick_:
                    changes.append(x)
                    change_sizes.append(len(alt))
                    change_ids += alt
        lists = lambda sizes, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))]), pa.int32()), values)
        change = pa.StructArray.from_arrays([pa.array(changes, pa.int32()), lists(change_sizes, pa.array(change_ids, pa.int32()))], ["word", "ids"])
        entry = pa.StructArray.from_arrays([pa.array(entries, pa.float64()), lists(change_counts, change)], ["score", "changes"])
        best = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.append(null, False)), pa.array(ids, pa.int32()))
        alternatives = lists(counts, entry)
        sizes_ = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(size, pa.int32()))
        return pa.StructArray.from_arrays([best, sizes_, alternatives, pa.array(exact)], ["ids", "word_sizes", "nbest", "exact"])


def merged(options: list[tuple[int, list[tuple[float, list[int]]]]], n: int) -> list[tuple[float, list[tuple[int, list[int]]]]]:
    """The ``n`` combinations of least total loss: each word is at its best or at one of its alternatives."""
    combos: list[tuple[float, tuple]] = [(0.0, ())]
    for word, alternatives in options:
        wide = combos + [(lost + more, (*chosen, (word, k))) for lost, chosen in combos for k, (more, _) in enumerate(alternatives)]
        combos = heapq.nsmallest(n, wide)
    ids = {word: alternatives for word, alternatives in options}
    return [(lost, [(w, ids[w][k][1]) for w, k in chosen]) for lost, chosen in combos]


def expand(ids: list[int], word_sizes: list[int], changes: list) -> list[int]:
    """All ids of an entry of ``nbest``."""
    new = {c["word"]: list(c["ids"]) for c in changes}
    out, at = [], 0
    for w, k in enumerate(word_sizes):
        out += new.get(w, list(ids[at : at + k]))
        at += k
    return out


_vocabularies: dict[str, Vocabulary] = {}


def _vocabulary(name: str) -> Vocabulary:
    """Of a model file sent to the executors; one a worker."""
    if (path := shipped(name)) not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def _run(name: str, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(_vocabulary(name), n)
        for big in batches:
            for b in slices(big, limit=BATCH_BYTES):
                r = encoder.encode(b.column(1))
                yield pa.record_batch([b.column(0), *r.flatten()], names=["doc_id", "ids", "word_sizes", "nbest", "exact"])
                del r

    return tidy(run)


SCHEMA = "doc_id bigint, ids array<int>, word_sizes array<int>, nbest array<struct<score: double, changes: array<struct<word: int, ids: array<int>>>>>, exact boolean"


def encode_documents(docs: DataFrame, model: str = MODEL, n: int = NBEST) -> DataFrame:
    """(doc_id, ids, word_sizes, nbest, exact) of every document. One scan, no shuffle."""
    return pick(docs, doc_id="bigint", text="string").mapInArrow(_run(ship(docs.sparkSession, model), n), SCHEMA)


def _back(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(name)
        for b in batches:
            texts = [None if x.as_py() is None else v.decode(np.array(x.as_py(), np.int64)).decode("utf-8", "replace") for x in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of rows with (doc_id, ids)."""
    return pick(encoded, doc_id="bigint", ids="array<int>").mapInArrow(_back(ship(encoded.sparkSession, model)), "doc_id bigint, text string")
