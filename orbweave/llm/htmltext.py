"""Operator 6, HTML extraction: site templates are removed by counting hashed subtrees per host.

Every element's subtree (tag, sorted class/id/href/src attributes, texts, children) is hashed.
Spark counts on how many distinct pages of a host each hash occurs. A subtree on at least ``min_pages`` is
template, however large the host is, and is deleted with all
it holds; the text of what remains is the result. Scripts, styles, comments and the like never give text.
Block elements end a line; entities are resolved.

Copies don't make their own content a template: pages with equal visible text are one page, and so are those that
have equal text (or, without any, an equal longest text) outside the subtrees that recur. So an article fetched
many times below different menus and ads is kept in all its copies. A passage that distinct pages share, such as a
license line, is template.

A null page or an empty one gives an empty text; so does a page that is all template. A url
without a host has the host ''. A repeated row counts as one page and each has its own result; so do rows with one page_id. Equal counts need no
order: a subtree is template or not by its count alone. Markup that never closes is closed at its parent's end; a tag that never ends is text. Very long
pages are parsed whole, in time proportional to their length. Empty tables give no rows. Extra columns are ignored, also such with clashing names.

Templates beyond the broadcast limit are joined to the pages by shuffle on the host; a hot host's partition is
split by adaptive execution (skew join), which repeats only its template list.
"""

from __future__ import annotations

import bisect
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import BROADCAST_BYTES, pick, stored

MIN_PAGES = 5
_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>)", re.S)
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*+)")
_ATTR = re.compile(r"(?<![-\w:.])([A-Za-z_:][-\w:.]*+)\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_MARK = re.compile(r"[>\"']")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noscript", "noembed")}
_MUTE = frozenset("script style template noscript iframe noembed svg object head textarea select button".split())
_BLOCK = frozenset("address article aside blockquote br body dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())
#: An opening tag of the key closes open elements of these kinds up to a boundary.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}, "tbody": {"tr", "td", "th", "thead"}}
_P_ENDS = _BLOCK - {"br", "td", "th", "tr", "li", "option", "body", "html", "tbody", "thead", "tfoot", "title", "dd", "dt", "figcaption"}
_BOUNDARY = frozenset("ul ol dl table div article section body html nav main aside header footer blockquote form".split())
_P = frozenset("p")
_IMPLIED = frozenset(x for v in _CLOSES.values() for x in v)
_KEEP = frozenset(("class", "id", "href", "src", "alt", "type"))
_SPACE = re.compile(r"[^\S\n]+")


class Ends:
    """Where tags end: whether a ``>`` outside quotes follows a place. Quotes without a partner end nothing."""

    def __init__(self, page: str):
        self.at = [m.start() for m in _MARK.finditer(page)]
        n = len(self.at)
        self.closed = [False] * (n + 1)
        after = {'"': n, "'": n}  # the next quote of each kind
        for i in range(n - 1, -1, -1):
            c = page[self.at[i]]
            if c == ">":
                self.closed[i] = True
            else:
                self.closed[i] = after[c] < n and self.closed[after[c] + 1]
                after[c] = i

    def __call__(self, pos: int) -> bool:
        return self.closed[bisect.bisect_left(self.at, pos)]


class Open:
    """The stack of open elements, with counts by tag, so that an end tag or an implied end is searched for only if there is one to find."""

    def __init__(self, root: Node):
        self.stack, self.tags, self.scopes = [root], {}, [{}]

    def push(self, node: Node) -> None:
        self.stack.append(node)
        self.tags[node.tag] = self.tags.get(node.tag, 0) + 1
        if node.tag in _BOUNDARY:
            self.scopes.append({})
        elif node.tag in _IMPLIED:
            self.scopes[-1][node.tag] = self.scopes[-1].get(node.tag, 0) + 1

    def pop(self) -> str:
        tag = self.stack.pop().tag
        self.tags[tag] -= 1
        if tag in _BOUNDARY:
            self.scopes.pop()
        elif tag in _IMPLIED:
            self.scopes[-1][tag] -= 1
        return tag

    def end(self, tag: str) -> None:
        if self.tags.get(tag):
            while self.pop() != tag:
                pass

    def imply(self, tags: frozenset | set) -> None:
        """End the innermost open element of these kinds within the scope, and all it holds."""
        if any(self.scopes[-1].get(t) for t in tags):
            while self.pop() not in tags:
                pass


class Node:
    __slots__ = ("tag", "attrs", "kids", "hash")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids, self.hash = tag, attrs, [], 0


def parse(page: str | None) -> Node:
    """The element tree of a page, hashed."""
    root = Node("#root")
    opened, pos, page = Open(root), 0, page or ""
    stack, at, ends = opened.stack, 0, None
    while (at := page.find("<", at)) >= 0:
        if ends and (name := _NAME.match(page, at)) and not ends(name.end()):
            m = None
        else:
            m = _TAG.match(page, at)
        if m is None:
            if ends is None and _NAME.match(page, at):
                ends = Ends(page)  # from now on no tag is tried that doesn't end
            at += 1
            continue
        if at > pos:
            stack[-1].kids.append(page[pos:at])
        pos = at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            opened.end(tag)
            continue
        shut = _CLOSES.get(tag, _P if tag in _P_ENDS else None)
        if shut:
            opened.imply(shut)
        attrs = m.group(3)
        if "=" in attrs:
            attrs = " ".join(sorted(f"{a.lower()}={v.strip(chr(34) + chr(39))}" for a, v in _ATTR.findall(attrs) if a.lower() in _KEEP))
        else:
            attrs = ""
        node = Node(tag, attrs)
        stack[-1].kids.append(node)
        if tag in _RAW:
            end = _RAW[tag].search(page, pos)
            stop = end.start() if end else len(page)
            if stop > pos:
                node.kids.append(page[pos:stop])
            pos = at = end.end() if end else len(page)
        elif tag not in _VOID and not m.group(3).endswith("/"):
            opened.push(node)
    if pos < len(page):
        stack[-1].kids.append(page[pos:])
    return _hashed(root)


def _hashed(root: Node) -> Node:
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += [k for k in n.kids if k.__class__ is Node]
    for n in reversed(order):
        parts = [n.tag, n.attrs]
        for k in n.kids:
            if k.__class__ is Node:
                parts.append(f"\x01{k.hash}")
            elif s := " ".join(k.split()):
                parts.append(s)
        n.hash = xxhash.xxh3_64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")) - 2**63
    return root


def subtree_hashes(root: Node) -> set[int]:
    """Hashes of all elements below the body (or the root) that hold some text or a child."""
    out: set[int] = set()
    todo = [root]
    while todo:
        n = todo.pop()
        for k in n.kids:
            if k.__class__ is Node:
                if k.tag not in ("html", "body", "head") and k.kids and k.tag not in _MUTE:
                    out.add(k.hash)
                if k.tag not in _MUTE:
                    todo.append(k)
    return out


def text_of(root: Node, template: set[int]) -> tuple[str, str, int]:
    """(title, text, subtrees removed) of a tree without its template subtrees."""
    parts: list[str] = []
    title, removed = "", 0
    todo: list = [root]
    while todo:
        n = todo.pop()
        if n.__class__ is not Node:
            parts.append(n)
            continue
        if n.tag == "title" or n.tag == "head":
            for k in [n] if n.tag == "title" else n.kids:
                if k.__class__ is Node and k.tag == "title" and not title:
                    title = " ".join(entities.unescape("".join(x for x in k.kids if x.__class__ is str)).split())
            continue
        if n.tag in _MUTE:
            continue
        if n.hash in template and n.tag not in ("html", "body", "#root"):
            removed += 1
            parts.append("\n")
            continue
        if n.tag in _BLOCK:
            parts.append("\n")
            todo.append("\n")
        todo += reversed(n.kids)
    lines = []
    # Source line breaks are blanks; only block elements end lines.
    for line in "".join(p if p == "\n" else p.replace("\n", " ").replace("\r", " ") for p in parts).split("\n"):
        if line := _SPACE.sub(" ", entities.unescape(line)).strip():
            lines.append(line)
    return title, "\n".join(lines), removed


def host(url):
    """The lower-cased host of a url column, '' if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def body_text(root: Node, without: set[int] = frozenset()) -> list[str]:
    """The visible texts of a tree, head and mute elements apart, outside the subtrees ``without``."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        if n.__class__ is not Node:
            if n := " ".join(n.split()):
                out.append(n)
        elif n.tag not in _MUTE and n.hash not in without:
            todo += reversed(n.kids)
    return out


def _hash(texts: list[str]) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(texts).encode("utf-8", "surrogatepass")) - 2**63


def _rows(hosts: list, hashes: list, pages: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(pages, pa.int64())], names=["host", "hash", "page"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, hash, page): every page's subtrees and the hash of its visible text."""
    for b in batches:
        hosts, hashes, pages = [], [], []
        for h, page in zip(b.column(0).to_pylist(), b.column(1)):
            root = parse(page.as_py())
            found = subtree_hashes(root)
            hosts += [h] * len(found)
            hashes += found
            pages += [_hash(body_text(root))] * len(found)
        yield _rows(hosts, hashes, pages)


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, hash, page): every page's candidates and the hash of what tells the page from others:
    its text outside all candidates or, if there is none, its longest text."""
    sets: dict[str, set] = {}
    for b in batches:
        hosts, hashes, pages = [], [], []
        for h, page, t in zip(b.column("host").to_pylist(), b.column("html"), b.column("hashes")):
            if h not in sets:
                if len(sets) > 10_000:
                    sets.clear()
                sets[h] = set(t.as_py())
            root = parse(page.as_py())
            found = subtree_hashes(root) & sets[h]
            if found:
                own = body_text(root, sets[h]) or [max(body_text(root), key=len, default="")]
                hosts += [h] * len(found)
                hashes += found
                pages += [_hash(own)] * len(found)
        yield _rows(hosts, hashes, pages)


def _frequent(seen: DataFrame, min_pages: int, label: str) -> DataFrame:
    """(host, hashes): those on at least ``min_pages`` distinct pages of ``seen`` (host, hash, page); stored."""
    often = seen.groupBy("host", "hash").agg(F.count_distinct("page").alias("n")).filter(F.col("n") >= min_pages)
    return stored(often.groupBy("host").agg(F.collect_set("hash").alias("hashes")), label)


def _with(rows: DataFrame, known: DataFrame, how: str) -> DataFrame:
    size = known.agg(F.sum(F.size("hashes") * 8 + 64)).first()[0] or 0
    return rows.join(F.broadcast(known) if size <= BROADCAST_BYTES else known, "host", how)


def templates(rows: DataFrame, min_pages: int) -> DataFrame:
    """(host, hashes): the template subtrees of each host of ``rows`` (page_id, url, host, html); stored."""
    seen = "host string, hash bigint, page bigint"
    candidates = _frequent(rows.select("host", "html").mapInArrow(_count, seen), min_pages, "template-candidates")
    return _frequent(_with(rows.select("host", "html"), candidates, "inner").mapInArrow(_own, seen), min_pages, "templates")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets: dict[str, tuple[list, set]] = {}
    for b in batches:
        titles, texts, removed = [], [], []
        for h, page, t in zip(b.column("host").to_pylist(), b.column("html"), b.column("hashes")):
            if h not in sets:
                if len(sets) > 10_000:
                    sets.clear()
                sets[h] = set(t.as_py() or ())
            title, text, n = text_of(parse(page.as_py()), sets[h])
            titles.append(title)
            texts.append(text)
            removed.append(n)
        yield pa.record_batch([b.column("page_id"), b.column("url"), b.column("host"), pa.array(titles, pa.string()), pa.array(texts, pa.string()), pa.array(removed, pa.int32())], names=["page_id", "url", "host", "title", "text", "removed"])


def extract_pages(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, url, host, title, text, removed) of every page, templates of its host removed."""
    rows = pick(pages, page_id="bigint", url="string", html="string").withColumn("host", host(F.col("url")))
    joined = _with(rows, templates(rows, min_pages), "left")
    return joined.mapInArrow(_extract, "page_id bigint, url string, host string, title string, text string, removed int")
