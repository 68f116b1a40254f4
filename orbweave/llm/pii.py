"""Operator 1, PII: patterns propose spans, checksums confirm, nearby context words adjust the score.

Kinds: email, phone, ipv4, ipv6, credit_card (Luhn), iban (mod 97), us_ssn. A proposal with a
checksum that fails is tried with fewer groups at its end and then from its next group on, so digits beside a number
don't hide it. Phones are international (``+``, grouped or not) or national; one without ``+`` is reported without a context word only if it has
North American form, area code in parentheses or five pairs from 0 on. Score = base of the kind + what the checksum adds + what
context words within CONTEXT characters add, at most 1; spans under ``min_score`` are dropped.
Of overlapping spans the higher score stays (ties: the longer, then the earlier, then the kind's name).

A null or empty text has no spans; whole texts are scanned whatever their length, in time proportional to it. Repeated rows
give repeated spans. A null doc_id stays null. An empty table gives no rows. Extra columns are ignored, also such with
clashing names. Offsets count code points.
"""

from __future__ import annotations

import bisect
import ipaddress
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import pick
from .vector import raw, slices

MIN_SCORE = 0.5
CONTEXT = 48


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0 and len(set(digits)) > 1


def mod97(iban: str) -> bool:
    s = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


_IBAN_LENGTH = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}


def _card(s: str) -> float | None:
    d = re.sub(r"\D", "", s)
    return 0.3 if 13 <= len(d) <= 19 and d[0] in "23456" and luhn(d) else None


def _iban(s: str) -> float | None:
    s = re.sub(r"[ -]", "", s)
    return 0.4 if 15 <= len(s) <= 34 and len(s) == _IBAN_LENGTH.get(s[:2], len(s)) and mod97(s) else None


def _ipv4(s: str) -> float | None:
    p = s.split(".")
    return 0.0 if all(int(x) < 256 and (x == "0" or x[0] != "0") for x in p) else None


def _ssn(s: str) -> float | None:
    a, b, c = s.split("-")
    return 0.0 if a not in ("000", "666") and a < "900" and b != "00" and c != "0000" else None


_NANP = re.compile(r"\(?[2-9]\d\d\)?[ .-]{1,2}[2-9]\d\d[ .-]\d{4}", re.ASCII)
_PAIRS = re.compile(r"0[1-9](?:[ .-]\d\d){4}", re.ASCII)


def _phone(s: str) -> float | None:
    d = re.sub(r"\D", "", s)
    if not 8 <= len(d) <= 15:
        return None
    return 0.25 if s[0] == "+" else 0.2 if _NANP.fullmatch(s) or _PAIRS.fullmatch(s) else 0.15 if "(" in s else 0.0


def _ipv6(s: str) -> float | None:
    try:
        ipaddress.IPv6Address(s)
    except ValueError:
        return None
    return 0.0 if any(c.isdigit() for c in s) else None


#: kind: (pattern, base score, check: what it adds or None to drop, context words)
KINDS = {
    "email": (re.compile(r"(?<![\w.+%-])[A-Za-z0-9_][\w.+%-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w-])", re.ASCII), 0.9, lambda s: 0.0, "mail e-mail email contact courriel correo"),
    "phone": (re.compile(r"(?<![\w.+-])(?:\+\d{1,15}(?:[ .-]?\(\d{1,4}\)[ .-]?\d{1,12})?(?:[ .-]\d{1,12}){0,6}|0[1-9](?:[ .-]\d\d){4}|(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{2,4}[ .-]\d{2,4}(?:[ .-]\d{2,4})?|0\d{9}|[2-9]\d\d[2-9]\d{6})(?![\w-]|\.\d)", re.ASCII), 0.35, _phone, "phone tel telephone mobile call fax telefon téléphone teléfono"),
    "ipv4": (re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)", re.ASCII), 0.6, _ipv4, "ip address host server adresse dirección"),
    "ipv6": (re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::(?:\d{1,3}(?:\.\d{1,3}){3}|[0-9A-Fa-f]{0,4})){2,8}(?!\w|\.\d)", re.ASCII), 0.7, _ipv6, "ip address host server"),
    "credit_card": (re.compile(r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])", re.ASCII), 0.4, _card, "card credit visa mastercard amex carte karte tarjeta"),
    "iban": (re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?:[ -]?[A-Z0-9]{4}){2,7}(?:[ -]?[A-Z0-9]{1,3})?(?!\w)"), 0.5, _iban, "iban account bank konto compte cuenta"),
    "us_ssn": (re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.ASCII), 0.55, _ssn, "ssn social security"),
}
_WORDS = {k: re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, v[3].split())) + r")(?!\w)", re.I) for k, v in KINDS.items()}
_NEED_AT, _NEED_DIGIT = ("email",), ("phone", "ipv4", "ipv6", "credit_card", "iban", "us_ssn")
#: Against this a phone, card or address is likelier something else.
_AGAINST = re.compile(r"(?<!\w)(?:version|license|lizenz|isbn|order|invoice|build)(?!\w)", re.I)


_END = {"phone": re.compile(r"[ .-]"), "credit_card": re.compile(r"[ -]"), "iban": re.compile(r"[ -]"), "ipv6": re.compile(r":+$")}


def _proposals(kind: str, text: str) -> Iterator[tuple[int, int, float]]:
    """(start, end, what the check adds): for each proposal the best of its ends that the check confirms, the longest of equals."""
    pattern, _, check, _ = KINDS[kind]
    at = 0
    while m := pattern.search(text, at):
        s, cuts = m.group(), []
        if kind in _END:
            cuts = [c.start() for c in _END[kind].finditer(s) if c.start()]
        confirmed = [(more, n) for n in (len(s), *cuts) if (more := check(s[:n])) is not None]
        if confirmed:
            more, n = max(confirmed)
            yield m.start(), m.start() + n, more
            at = m.start() + n
        else:
            at = m.start() + (cuts[0] if cuts else len(s))


def spans(text: str | None, min_score: float = MIN_SCORE, kinds: tuple[str, ...] = tuple(KINDS)) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of one text, by start."""
    found = []
    for kind in kinds if text else ():
        base = KINDS[kind][1]
        for start, end, more in _proposals(kind, text):
            near = text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]
            score = base + more + 0.3 * bool(_WORDS[kind].search(near)) - 0.2 * (kind != "email" and bool(_AGAINST.search(near)))
            score = round(min(1.0, score), 6)
            if score >= min_score:
                found.append((kind, start, end, score))
    return disjoint(found)


def disjoint(found: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """Of overlapping spans those of higher rank, by start. Spans are resolved within stretches that touch no other span."""
    out: list[tuple[str, int, int, float]] = []
    found = sorted(found, key=lambda s: s[1])
    at = 0
    while at < len(found):
        end, to = found[at][2], at + 1
        while to < len(found) and found[to][1] < end:
            end = max(end, found[to][2])
            to += 1
        if to - at == 1:
            out.append(found[at])
        else:
            # Kept spans don't overlap, so only the neighbours by start can be in the way.
            kept: list[tuple[int, int, str, float]] = []
            for kind, a, z, score in sorted(found[at:to], key=lambda s: (-s[3], s[1] - s[2], s[1], s[0])):
                i = bisect.bisect_left(kept, (a,))
                if (i == len(kept) or kept[i][0] >= z) and (i == 0 or kept[i - 1][1] <= a):
                    kept.insert(i, (a, z, kind, score))
            out += [(kind, a, z, score) for a, z, kind, score in kept]
        at = to
    return out


_HAS = np.zeros(256, np.uint8)
_HAS[48:58], _HAS[64] = 1, 2


def _scan(min_score: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big):
                data, off = raw(b.column(1))
                ids, kind, start, end, score = [], [], [], [], []
                marks = _HAS[data]
                at = np.flatnonzero(marks)
                row = np.searchsorted(off, at, "right") - 1
                flags = np.zeros(b.num_rows, np.uint8)
                np.bitwise_or.at(flags, row, marks[at])
                texts, keys = b.column(1), b.column(0)
                for i in np.flatnonzero(flags):
                    kinds = (_NEED_AT if flags[i] & 2 else ()) + (_NEED_DIGIT if flags[i] & 1 else ())
                    for s in spans(texts[int(i)].as_py(), min_score, kinds):
                        ids.append(keys[int(i)].as_py())
                        for c, v in zip((kind, start, end, score), s):
                            c.append(v)
                if ids:
                    yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(kind), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(score)], names=["doc_id", "kind", "start", "end", "score"])

    return scan


def pii_spans(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """(doc_id, kind, start, end, score) of all personal data in ``docs`` (doc_id, text). One scan, no shuffle."""
    return pick(docs, doc_id="bigint", text="string").mapInArrow(_scan(min_score), "doc_id bigint, kind string, start int, end int, score double")
