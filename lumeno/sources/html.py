"""HTML to element rows (S8), in Arrow batches.

A static tree from the standard parser, with void elements, implied end tags and missing end tags. Elements are numbered in
document order; pre and post are an interval that holds those of all descendants, and path has the ids from the root down to the element.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
FENCES = frozenset("ul ol dl table select body html".split())
ELEMENTS = "page_id long, el_id int, parent_id int, tag string, pre int, post int, depth int, own_text array<string>, attrs map<string,string>, path array<int>"


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []  # parent, tag, pre, post, depth, texts, attrs
        self.stack: list[int] = []
        self.clock = 0

    def _close(self, k: int) -> None:
        self.rows[k][3] = self.clock
        self.clock += 1

    def _close_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            self._close(self.stack.pop())

    def handle_starttag(self, tag: str, attrs: list) -> None:
        closes = CLOSES.get(tag, frozenset()) | ({"p"} if tag in ENDS_P else frozenset())
        for d in range(len(self.stack) - 1, -1, -1):
            name = self.rows[self.stack[d]][1]
            if name in closes:
                self._close_to(d)
                break
            if name in FENCES:
                break
        self.rows.append([self.stack[-1] if self.stack else None, tag, self.clock, None, len(self.stack), [], {k: v or "" for k, v in reversed(attrs)}])
        self.clock += 1
        if tag in VOID:
            self._close(len(self.rows) - 1)
        else:
            self.stack.append(len(self.rows) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack and self.rows[self.stack[-1]][1] == tag:
            self._close(self.stack.pop())

    def handle_endtag(self, tag: str) -> None:
        for d in range(len(self.stack) - 1, -1, -1):
            if self.rows[self.stack[d]][1] == tag:
                self._close_to(d)
                break

    def handle_data(self, data: str) -> None:
        if self.stack and data.strip():
            self.rows[self.stack[-1]][5].append(data)


def tree(html: str) -> list[tuple]:
    """el_id, parent_id, tag, pre, post, depth, own_text, attrs of each element."""
    t = _Tree()
    t.feed(html)
    t.close()
    t._close_to(0)
    return [(k, *row) for k, row in enumerate(t.rows)]


def flattened(rows: list[tuple]) -> list[tuple]:
    """Rows of tree() as they are rendered with declarative shadow roots (S9): el_id, parent_id, tag, pre, post, depth, own_text, attrs, host_id.

    The first template of an element with shadowrootmode is its shadow root: what it holds stands in the element instead of the element's own
    children, which go to the root's slots of their name (the first one of a name; no name: the one without). A slot without any keeps what it holds; children
    without a slot aren't rendered. host_id is the element whose shadow tree a row belongs to.
    """
    kids: dict[int | None, list[int]] = {}
    for r in rows:
        kids.setdefault(r[1], []).append(r[0])
    roots: dict[int, int] = {}
    for r in rows:
        if r[2] == "template" and "shadowrootmode" in r[7] and r[1] is not None:
            roots.setdefault(r[1], r[0])
    made: list[tuple] = []
    clock = 0
    #: What is still to be done: an element with its parent, depth, host and the children that wait for its host's slots, or the end of one.
    todo: list[tuple] = [(k, None, 0, None, {}) for k in reversed(kids.get(None, []))]
    while todo:
        k, parent, depth, host, waiting = todo.pop()
        if parent == "end":
            made[k] = (*made[k][:4], clock, *made[k][5:])
            clock += 1
            continue
        r = rows[k]
        made.append((k, parent, r[2], clock, None, depth, r[6], r[7], host))
        clock += 1
        todo.append((len(made) - 1, "end", 0, None, {}))
        if k in roots:
            given: dict[str, list[tuple]] = {}
            for c in kids.get(k, []):
                if c != roots[k]:
                    given.setdefault(rows[c][7].get("slot", ""), []).append((c, host, waiting))
            below = [(c, k, depth + 1, k, given) for c in kids.get(roots[k], [])]
        else:
            taken = waiting.pop(r[7].get("name", ""), None) if r[2] == "slot" and host is not None else None
            below = [(c, k, depth + 1, h, w) for c, h, w in taken] if taken else [(c, k, depth + 1, host, waiting) for c in kids.get(k, [])]
        todo += reversed(below)
    return made


def parse_shadow(pages: DataFrame) -> DataFrame:
    """Element rows of pages as rendered, with host_id: the element whose declarative shadow root a row stands in. Templates that are no shadow roots keep what they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                up: dict[int, list[int]] = {}
                rows = []
                for k, parent, *rest, host in flattened(tree(html or "")):
                    up[k] = [*up.get(parent, []), k]
                    rows.append((page, k, parent, *rest[:-1], list(rest[-1].items()), up[k], host))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    names = ["page_id", "el_id", "parent_id", "tag", "pre", "post", "depth", "own_text", "attrs", "path", "host_id"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.map_(pa.string(), pa.string()), pa.list_(pa.int32()), pa.int32()]
    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, ELEMENTS + ", host_id int")


def parse(pages: DataFrame) -> DataFrame:
    """Element rows of pages (page_id, html); null html gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for page, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                up: list[list[int]] = []
                for r in tree(html or ""):
                    up.append([r[0]] if r[1] is None else [*up[r[1]], r[0]])
                    rows.append((page, *r[:7], list(r[7].items()), up[-1]))
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    names = ["page_id", "el_id", "parent_id", "tag", "pre", "post", "depth", "own_text", "attrs", "path"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.map_(pa.string(), pa.string()), pa.list_(pa.int32())]
    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, ELEMENTS)


def selectors(css: str) -> list[str]:
    """A selector list cut at its top-level commas (F15, T10): not within parentheses, brackets or quotes."""
    out, part, depth, quote = [], "", 0, ""
    for c in css:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        if c == "," and depth == 0 and not quote:
            out.append(part.strip())
            part = ""
        else:
            part += c
    return [s for s in [*out, part.strip()] if s]


def style_selectors(pages: DataFrame) -> DataFrame:
    """page_id, selector of the rules in a page's style elements (S13); at-rules are skipped, as their conditions need a browser."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for page, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for css in re.findall(r"<style[^>]*>(.*?)</style>", html or "", re.S | re.I):
                    for head in re.findall(r"([^{}]+)\{[^{}]*\}", re.sub(r"/\*.*?\*/", "", css, flags=re.S)):
                        for s in selectors(head) if not head.strip().startswith("@") else []:
                            ids.append(page)
                            found.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], names=["page_id", "selector"])

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, "page_id long, selector string")
