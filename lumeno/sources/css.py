"""Style sheets to compiled selectors (S13), in Arrow batches.

A sheet is read token by token with a stack of the blocks that are open. Rules count if all blocks around them apply: @media by the
window's size, @supports as if every declaration were supported; other at-rules hold no selectors of elements. Each
selector of a list is a row of its own, cut into compounds from left to right with the combinator before each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""/\*.*?\*/|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\\.|[{};]|[^{};"'\\/]+|/""", re.S)
_FEATURE = re.compile(r"\(\s*([a-z-]+)\s*(?:(:|<=|>=|<|>|=)\s*([^()]+?)\s*)?\)")
_NAME = r"(?:[-\w\u0080-\U0010ffff]|\\.)+"
_PART = re.compile(rf"""(?P<space>\s*[>+~]\s*|\s+)|(?P<id>#{_NAME})|(?P<cls>\.{_NAME})|(?P<attr>\[(?:[^\]"']|"[^"]*"|'[^']*')*\])|(?P<pseudo>::?{_NAME})|(?P<open>\()|(?P<tag>\*|{_NAME})""")
_ATTR = re.compile(rf"""\[\s*({_NAME})\s*(?:([~|^$*]?=)\s*("[^"]*"|'[^']*'|[^\s\]]+)\s*([iIsS])?)?\s*\]""")
#: Pixels of a unit (fixed values of a browser's default style).
UNITS = {"px": 1.0, "em": 16.0, "rem": 16.0, "": 1.0}
#: Order pseudo-classes by the counter they test and the positions a * n + b that fit; those with an argument have None.
ORDER = {
    "first-child": ("at", (0, 1)), "last-child": ("from_end", (0, 1)), "nth-child": ("at", None), "nth-last-child": ("from_end", None), "first-of-type": ("of_type", (0, 1)),
    "last-of-type": ("of_type_from_end", (0, 1)), "nth-of-type": ("of_type", None), "nth-last-of-type": ("of_type_from_end", None), "root": ("root", (0, 1)), "empty": ("empty", (0, 1)),
}
#: Pseudo-classes that stand for two order tests, and for attributes.
BOTH = {"only-child": ("first-child", "last-child"), "only-of-type": ("first-of-type", "last-of-type")}
AS_ATTR = {"checked": "checked", "disabled": "disabled", "link": "href", "any-link": "href"}
_LITE = "tag:string,ids:array<string>,classes:array<string>,attrs:array<struct<name:string,op:string,value:string>>,orders:array<struct<counter:string,a:int,b:int>>"
SCHEMA = f"page_id long, sheet int, sel_id int, selector string, hover boolean, by_order boolean, by_attr boolean, compounds array<struct<combinator:string,{_LITE},nots:array<struct<{_LITE}>>,anys:array<array<struct<{_LITE}>>>>>"


class Unmatched(Exception):
    """A selector that no element of a page at rest matches, or that isn't understood."""


def media_applies(query: str, width: float, height: float) -> bool:
    """Whether a list of media queries holds for a screen whose window has this size; features that aren't known don't."""
    return any(_one_query(q.strip().lower(), width, height) for q in query.split(",")) if query.strip() else True


def _one_query(q: str, width: float, height: float) -> bool:
    negated = q.startswith("not ")
    kind = re.match(r"(?:not\s+|only\s+)?([a-z]+)", q)
    ok = not (kind and kind[1] not in ("all", "screen", "and", "not", "only"))
    rest = _FEATURE.sub("", q)
    ok = ok and "(" not in rest and all(_feature(n, op, v, width, height) for n, op, v in _FEATURE.findall(q))
    return ok != negated


def _feature(name: str, op: str, value: str, width: float, height: float) -> bool:
    if name == "orientation":
        return value == ("landscape" if width >= height else "portrait")
    bound, _, side = name.rpartition("-") if name.startswith(("min-", "max-")) else ("", "", name)
    have = {"width": width, "height": height}.get(side)
    if have is None:
        return False
    if not op:
        return have > 0
    m = re.fullmatch(r"([\d.]+)([a-z]*)", value)
    if m is None or m[2] not in UNITS:
        return False
    want = float(m[1]) * UNITS[m[2]]
    op = {"min": ">=", "max": "<="}.get(bound, "=" if op == ":" else op)
    return {">=": have >= want, "<=": have <= want, ">": have > want, "<": have < want, "=": have == want}[op]


def rule_heads(css: str, width: float, height: float) -> list[str]:
    """The selector lists of the rules that apply."""
    heads, head, stack = [], "", []
    for token in _TOKEN.findall(css):
        if token.startswith("/*"):
            continue
        if token == "{":
            text, head = head.strip(), ""
            name = re.match(r"@([\w-]+)", text)
            within = not stack or stack[-1] == "rules"
            if not within:
                stack.append("skip")
            elif name is None:
                heads.append(text)
                stack.append("skip")
            elif name[1] in ("media", "supports", "layer", "container"):
                applies = name[1] == "layer" or (name[1] == "media" and media_applies(text[6:], width, height)) or (name[1] == "supports" and not re.match(r"@supports\s+not\b", text))
                stack.append("rules" if applies else "skip")
            else:
                stack.append("skip")
        elif token == "}":
            head = ""
            if stack:
                stack.pop()
        elif token == ";":
            head = ""
        else:
            head += token
    return heads


def _plain(name: str) -> str:
    return re.sub(r"\\(.)", r"\1", name)


def _lite() -> dict:
    return {"tag": None, "ids": [], "classes": [], "attrs": [], "orders": []}


def _nth(text: str) -> tuple[int, int]:
    text = text.strip().lower().replace(" ", "")
    text = {"odd": "2n+1", "even": "2n"}.get(text, text)
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?|([+-]?\d+)", text)
    if m is None:
        raise Unmatched(text)
    if m[3] is not None:
        return 0, int(m[3])
    return int(m[1] + "1") if m[1] in ("", "+", "-") else int(m[1]), int(m[2] or 0)


def _argument(text: str, at: int) -> tuple[str, int]:
    """What the parentheses that open at text[at] hold, and where they end."""
    depth, quote = 0, ""
    for k in range(at, len(text)):
        c = text[k]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth == 0:
                return text[at + 1 : k], k + 1
    raise Unmatched(text)


def compiled(selector: str, without_hover: bool = False) -> list[dict]:
    """The compounds of one selector. Without hover, :hover is left out: a compound of nothing else fits every element, unless it is
    the first, which nothing at rest fits."""
    from lumeno.sources.html import selectors

    compounds, own, at, combinator, parts = [], None, 0, "", [0]
    text = selector.strip()
    while at < len(text):
        m = _PART.match(text, at)
        if m is None or m.lastgroup == "open":
            raise Unmatched(selector)
        kind, token, at = m.lastgroup, m[0], m.end()
        if kind == "space":
            if own is None:
                raise Unmatched(selector)
            compounds.append(own)
            own, combinator = None, token.strip() or " "
            parts.append(0)
            continue
        if own is None:
            own = {"combinator": combinator, **_lite(), "nots": [], "anys": []}
        if kind == "tag":
            own["tag"] = None if token == "*" else _plain(token).lower()
        elif kind == "id":
            own["ids"].append(_plain(token[1:]))
        elif kind == "cls":
            own["classes"].append(_plain(token[1:]))
        elif kind == "attr":
            own["attrs"].append(_attribute(token))
        else:
            name = token[1:].lower()
            argument = None
            if at < len(text) and text[at] == "(":
                argument, at = _argument(text, at)
            if name == "hover" and without_hover:
                continue
            _pseudo(own, name, argument, without_hover, selectors)
        parts[-1] += 1
    if own is None or parts[0] == 0:
        raise Unmatched(selector)
    return [*compounds, own]


def _attribute(token: str) -> dict:
    m = _ATTR.fullmatch(token)
    if m is None:
        raise Unmatched(token)
    value = m[3][1:-1] if m[3] and m[3][0] in "\"'" else m[3]
    return {"name": _plain(m[1]).lower(), "op": (m[2] or "") + ("i" if (m[4] or "").lower() == "i" else ""), "value": value}


def _pseudo(own: dict, name: str, argument: str | None, without_hover: bool, split) -> None:
    if name in BOTH:
        for x in BOTH[name]:
            _pseudo(own, x, None, without_hover, split)
    elif name in ORDER:
        counter, fixed = ORDER[name]
        a, b = fixed or _nth(argument or "")
        own["orders"].append({"counter": counter, "a": a, "b": b})
    elif name in AS_ATTR:
        own["attrs"].append({"name": AS_ATTR[name], "op": "", "value": None})
        if AS_ATTR[name] == "href":
            own["anys"].append([_lite() | {"tag": t} for t in ("a", "area")])
    elif name in ("not", "is", "where", "matches") and argument is not None:
        inner = []
        for s in split(argument):
            if without_hover and s.replace(":hover", "").strip() == "":
                continue
            made = compiled(s, without_hover)
            if len(made) > 1 or made[0]["nots"] or made[0]["anys"]:
                raise Unmatched(s)
            inner.append({k: made[0][k] for k in _lite()})
        if not inner:
            raise Unmatched(argument)
        if name == "not":
            own["nots"] += inner
        else:
            own["anys"].append(inner)
    else:
        raise Unmatched(name)


def by_order(compounds: list[dict]) -> bool:
    """Whether a selector depends on the order of elements."""
    inner = [x for c in compounds for x in (c, *c["nots"], *(y for some in c["anys"] for y in some))]
    return any(c["combinator"] in ("+", "~") for c in compounds) or any(c["orders"] for c in inner)


def compile_sheets(sheets: DataFrame, width: float = 1440, height: float = 900) -> DataFrame:
    """page_id, sheet, sel_id, selector, hover, by_order, by_attr, compounds of sheets (page_id, sheet, css, media; null media: all).

    Selectors with :hover are rows of their own with hover set, and compiled without it. Those that fit no element at rest have no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lumeno.sources.html import selectors

        for batch in batches:
            # Sheets that pages have in common are compiled once a batch.
            rows, spans, at = [], {}, []
            for css, media in zip(*(batch.column(k).to_pylist() for k in (2, 3))):
                if (css, media) not in spans:
                    first = len(rows)
                    heads = rule_heads(css or "", width, height) if media_applies(media or "", width, height) else []
                    for n, s in enumerate(x for h in heads for x in selectors(h)):
                        hover = re.search(r"(?<!\\):hover\b", s) is not None
                        try:
                            made = compiled(s, without_hover=hover)
                        except Unmatched:
                            continue
                        rows.append({"sel_id": n, "selector": s, "hover": hover, "by_order": by_order(made), "by_attr": re.search(r"\[\s*(id|class|style)\s*[\]=]", s) is not None, "compounds": made})
                    spans[css, media] = range(first, len(rows))
                at.append(spans[css, media])
            of = pa.array([k for k, span in enumerate(at) for _ in span], pa.int64())
            made = pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(arrow)[2:])).take(pa.array([x for span in at for x in span], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), *made.columns], schema=arrow)

    lite = [("tag", pa.string()), ("ids", pa.list_(pa.string())), ("classes", pa.list_(pa.string())), ("attrs", pa.list_(pa.struct([(c, pa.string()) for c in ("name", "op", "value")]))), ("orders", pa.list_(pa.struct([("counter", pa.string()), ("a", pa.int32()), ("b", pa.int32())])))]
    compound = pa.struct([("combinator", pa.string()), *lite, ("nots", pa.list_(pa.struct(lite))), ("anys", pa.list_(pa.list_(pa.struct(lite))))])
    arrow = pa.schema([("page_id", pa.int64()), ("sheet", pa.int32()), ("sel_id", pa.int32()), ("selector", pa.string()), ("hover", pa.bool_()), ("by_order", pa.bool_()), ("by_attr", pa.bool_()), ("compounds", pa.list_(compound))])
    return sheets.select(F.col("page_id").cast("long"), F.col("sheet").cast("int"), "css", "media").mapInArrow(run, SCHEMA)


def sheets_of(elements: DataFrame) -> DataFrame:
    """page_id, sheet (the element's id), css, media of the style elements of pages."""
    return elements.where("tag = 'style'").select("page_id", F.col("el_id").alias("sheet"), F.array_join("own_text", "").alias("css"), F.col("attrs")["media"].alias("media"))
