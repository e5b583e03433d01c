"""Style sheets and selectors against a plain matcher."""

import random

import numpy as np
import pytest

from lumeno.operators import selectors
from lumeno.sources import css, html


@pytest.mark.parametrize(("query", "want"), [("", True), ("all", True), ("print", False), ("screen and (min-width: 600px)", True), ("(max-width: 50em)", False), ("not print", True), ("(width >= 1440px)", True), ("(width > 1440px)", False), ("(orientation: portrait), screen", True), ("(orientation: portrait)", False), ("(hover: hover)", False), ("only screen and (min-width:600px) and (max-height:900px)", True)])
def test_media(query, want):
    assert css.media_applies(query, 1440, 900) == want


def test_rules_of_open_blocks():
    sheet = """/* a { } */ a, b > c { x: "}"; } @media print { p { x: y } } @media (min-width: 10px) { .m { x: y } @supports (display: grid) { .s { x: y } } }
        @supports not (display: grid) { .t { x: y } } @font-face { src: url(a;b) } @keyframes k { from { x: y } to { x: y } } @import "x.css"; .last\\:x { a: b; &.inner { c: d } } .end { }"""
    assert css.rule_heads(sheet, 1440, 900) == ["a, b > c", ".m", ".s", ".last\\:x", ".end"]


def test_compiled_parts():
    one = css.compiled('div#a.b.c[href^="x y" i]:not(.d, p):nth-child(2n + 1) > *')
    assert [c["combinator"] for c in one] == ["", ">"] and one[0]["ids"] == ["a"] and one[0]["classes"] == ["b", "c"] and one[0]["orders"] == [{"counter": "at", "a": 2, "b": 1}]
    assert one[0]["attrs"] == [{"name": "href", "op": "^=i", "value": "x y"}] and [x["tag"] for x in one[0]["nots"]] == [None, "p"] and one[1]["tag"] is None
    assert css.compiled(".md\\:x")[0]["classes"] == ["md:x"]
    assert [len(css.compiled(s, without_hover=True)) for s in ("a:hover", "a :hover", "a:hover > b", "p:is(:hover, .x)")] == [1, 2, 2, 1]
    for bad in ("a::before", "a:focus", ":hover", ":hover p", "a:not(:hover)", "a:nth-child(x)", "> a", "a >", "a[", "a:is(b c)"):
        with pytest.raises(css.Unmatched):
            css.compiled(bad, without_hover=True)


def plain_matcher(rows, compounds):
    """el_ids that fit, by recursion from the right."""
    by_id = {r["el_id"]: r for r in rows}
    kids = {}
    for r in rows:
        kids.setdefault(r["parent_id"], []).append(r["el_id"])

    def lite(c, r):
        a, own = r["attrs"], kids[r["parent_id"]]
        same = [k for k in own if by_id[k]["tag"] == r["tag"]]
        counters = {"at": own.index(r["el_id"]) + 1, "from_end": len(own) - own.index(r["el_id"]), "of_type": same.index(r["el_id"]) + 1, "of_type_from_end": len(same) - same.index(r["el_id"]), "root": int(r["parent_id"] is None), "empty": int(r["el_id"] not in kids and not r["own_text"])}
        ok = c["tag"] in (None, r["tag"]) and all(a.get("id") == x for x in c["ids"]) and all(x in a.get("class", "").split() for x in c["classes"])
        for t in c["attrs"]:
            have, want, op = a.get(t["name"]), t["value"], t["op"]
            if have is None:
                return False
            if op.endswith("i"):
                have, want, op = have.lower(), want.lower(), op[:-1]
            ok = ok and {"": True, "=": have == want, "~=": want in have.split() if want else False, "|=": have == want or have.startswith(f"{want}-"), "^=": bool(want) and have.startswith(want or ""), "$=": bool(want) and have.endswith(want or ""), "*=": bool(want) and (want or "") in have}[op]
        for o in c["orders"]:
            ok = ok and any(o["a"] * n + o["b"] == counters[o["counter"]] for n in range(60))
        return ok

    def one(c, r):
        return lite(c, r) and not any(lite(x, r) for x in c["nots"]) and all(any(lite(x, r) for x in some) for some in c["anys"])

    def up(r):
        return by_id.get(r["parent_id"])

    def whole(k, r):
        if not one(compounds[k], r):
            return False
        if k == 0:
            return True
        how, own = compounds[k]["combinator"], kids[r["parent_id"]]
        at = own.index(r["el_id"])
        if how == ">":
            others = [up(r)]
        elif how == " ":
            others, p = [], up(r)
            while p is not None:
                others.append(p)
                p = up(p)
        else:
            others = [by_id[x] for x in (own[max(at - 1, 0) : at] if how == "+" else own[:at])]
        return any(x is not None and whole(k - 1, x) for x in others)

    return {r["el_id"] for r in rows if whole(len(compounds) - 1, r)}


def random_html(r, depth=0):
    tag = r.choice(["div", "span", "p", "ul", "li", "a", "section"])
    attrs = "".join([f' class="{" ".join(r.sample("abc", r.randint(1, 2)))}"' if r.random() < 0.6 else "", f' id="i{r.randint(0, 3)}"' if r.random() < 0.3 else "", f' data-x="{r.choice(["one two", "en-GB", "en", "One"])}"' if r.random() < 0.3 else ""])
    return f"<{tag}{attrs}>{'text' if r.random() < 0.3 else ''}{''.join(random_html(r, depth + 1) for _ in range(r.randint(0, 4 if depth < 4 else 0)))}</{tag}>"


def test_matches_equal_a_plain_matcher(spark):
    r = random.Random(6)
    part = lambda: r.choice(["div", "span", "p", "li", "*", ".a", ".b", ".a.b", "#i1", "div.c", "[id]", "[data-x]", "[data-x~=two]", "[data-x|=en]", '[data-x^="o" i]', "[data-x$=B]", "[data-x*=n-]", ":first-child", "li:last-child", ":nth-child(2n+1)", ":nth-child(-n+2)", "span:nth-of-type(2)", ":nth-last-child(2)", ":only-child", ":empty", ":not(.a)", "p:not(.a, #i1)", ":is(span, .b)", ":root"])
    sheet = [part() + "".join(r.choice([" ", " > ", " + ", " ~ ", " "]) + part() for _ in range(r.choice([0, 1, 1, 2, 3]))) for _ in range(300)]
    pages = spark.createDataFrame([(k, "<html><body>" + "".join(random_html(r) for _ in range(4)) + "</body></html>") for k in range(3)], "page_id long, html string")
    e = html.parse(pages).cache()
    rules = css.compile_sheets(spark.createDataFrame([(k, 0, " ".join(s + " { x: y }" for s in sheet), None) for k in range(3)], "page_id long, sheet int, css string, media string"))
    got = {}
    for x in selectors.matches(e, rules).collect():
        got.setdefault((x.page_id, x.sel_id), set()).add(x.el_id)
    rows = [x.asDict() for x in e.collect()]
    n = 0
    for page in range(3):
        own = sorted((x for x in rows if x["page_id"] == page), key=lambda x: x["el_id"])
        for k, s in enumerate(sheet):
            want = plain_matcher(own, css.compiled(s))
            assert got.get((page, k), set()) == want, s
            n += len(want)
    assert n > 1000


def test_styled_flags(spark):
    body = """<style>a:hover { x: y } @media print { p:hover { x: y } } li + li { x: y } [class] > b { x: y } .menu:hover > i { x: y }</style><style media="print">u:hover { x: y }</style>
        <a>1</a><p>2</p><ul><li>3</li><li>4</li></ul><div class="menu"><b>5</b><i>6</i></div><u>7</u>"""
    e = html.parse(spark.createDataFrame([(1, f"<html><body>{body}</body></html>"), (2, "<html><body><a>no sheet</a></body></html>"), (3, None)], "page_id long, html string"))
    tags = {x.el_id: x.own_text[0] for x in e.where("page_id = 1 AND size(own_text) > 0").collect()}
    got = {tags[x.el_id]: (x.hover_styled, x.order_styled, x.attr_styled) for x in selectors.styled(e).where("page_id = 1").collect()}
    assert got == {"1": (True, False, False), "4": (False, True, False), "5": (False, False, True), "6": (True, False, False)}
    assert selectors.styled(e).where("page_id > 1").count() == 0


def test_hover_styles_make_computed_controls(spark):
    from lumeno.operators import snapshot
    from lumeno.sources import snapshots

    pages = spark.createDataFrame([(1, "<html><body><style>.go:hover { x: y }</style><div class='go' data-box='0,0,90,30'>Go</div><div data-box='0,40,90,60'>No</div></body></html>")], "page_id long, html string")
    assert [r.own_text for r in snapshot.computed_controls(snapshots.from_pages(pages, hover=True)).collect()] == [["Go"]]
    assert snapshot.computed_controls(snapshots.from_pages(pages)).count() == 0


def test_sheets_in_common_are_not_joined_by_page(spark, monkeypatch):
    """Few compounds are broadcast, many are joined by page; pages with several sheets, and sheets of some pages only, fit the same elements."""
    rng = np.random.default_rng(8)
    rows = [(p, k, None if k == 0 else int(rng.integers(k)), str(rng.choice(["div", "p", "a"])), {"class": f"c{k % 3}", "id": f"i{k}"}, [""] if k % 5 else [], k) for p in range(12) for k in range(25)]
    e = spark.createDataFrame(rows, "page_id long, el_id int, parent_id int, tag string, attrs map<string,string>, own_text array<string>, pre int")
    texts = ["div > p:hover { x: y } .c1 + a { x: y }", "a:empty { x: y } [id] p { x: y }", "i { x: y }"]
    sheets = spark.createDataFrame([(p, n, texts[(p + n) % 3], None if p % 2 else "screen") for p in range(12) for n in range(p % 3)], "page_id long, sheet int, css string, media string")
    got = sorted(map(tuple, selectors.styled(e, sheets=sheets).collect()))
    tables, made = {}, selectors.written
    monkeypatch.setattr(selectors, "written", lambda df, name: tables.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString()) or made(df, name))
    assert sorted(map(tuple, selectors.styled(e, sheets=sheets).collect())) == got and len(got) > 50
    assert "BroadcastHashJoin" in tables["candidates"][0] and "key#" not in "".join(x for x in tables["candidates"][0].split("\n") if "Exchange hash" in x)
    monkeypatch.setattr(selectors, "FEW_PARTS", 0)
    assert sorted(map(tuple, selectors.styled(e, sheets=sheets).collect())) == got
    rules = css.compile_sheets(sheets)
    flags = {(r.page_id, r.sheet, r.sel_id): (r.hover, r.by_order and not r.hover, r.by_attr and not r.hover) for r in rules.collect()}
    want: dict = {}
    for x in selectors.matches(e, rules).collect():
        f = flags[x.page_id, x.sheet, x.sel_id]
        want[x.page_id, x.el_id] = tuple(a or b for a, b in zip(want.get((x.page_id, x.el_id), (False,) * 3), f))
    assert got == sorted((*k, *v) for k, v in want.items() if any(v))
