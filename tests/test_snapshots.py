"""Hand-made pages with stated boxes, and the groups that the rules give."""

import numpy as np
import pytest

from lumeno.operators import groups, snapshot
from lumeno.sources import snapshots

P = "page_id long, url string, html string"
BODY = '<body data-box="0,0,1440,2000">{}</body>'


def page(spark, body):
    pages = spark.createDataFrame([(1, "http://www.site.com/", BODY.format(body))], P)
    return snapshots.from_pages(pages), pages


def nav(n, out, across=True):
    boxes = [f"{100 * k},10,{100 * k + 80},30" if across else f"10,{40 * k},90,{40 * k + 30}" for k in range(n)]
    return "<nav data-box='0,0,1440,300'><ul>" + "".join(f"<li><a data-box='{b}' href='{'https://else.org/' if k < out else '/p'}{k}'>item {k}</a></li>" for k, b in enumerate(boxes)) + "</ul></nav><main><p>text</p></main>"


@pytest.mark.parametrize(("n", "out", "across", "want"), [(4, 0, True, ["menusH"]), (5, 2, True, ["menusH"]), (5, 3, True, []), (3, 0, False, ["menusV"]), (2, 0, True, [])])
def test_menus(spark, n, out, across, want):
    e, p = page(spark, nav(n, out, across))
    assert [r.kind for r in groups.menus(e, p).collect()] == want


def test_headers_footers_main_body_and_logo(spark):
    e, p = page(spark, "<div id=h data-box='0,0,1440,100'><a href='/' data-box='5,5,80,60'><img data-box='5,5,80,60'></a></div><div data-box='0,100,1440,1800'><p data-box='10,120,700,140'>some text</p></div><div data-box='0,1900,1440,2000'>foot</div>")
    tops = {r.el_id for r in groups.headers(e).collect()}
    ends = {r.el_id for r in groups.footers(e).collect()}
    mains = {r.el_id for r in groups.main_body(e).collect()}
    kids = [r.el_id for r in e.where("depth = 1").orderBy("pre").collect()]
    assert (tops, mains, ends) == ({kids[0]}, {kids[1]}, {kids[2]})
    assert groups.logos(e, p).count() == 1


def test_titles_need_a_larger_font(spark):
    e, _ = page(spark, "<div><h2 data-font='30'>The title</h2></div><p data-font='12'>some smaller text of a line or so</p>")
    assert [r.text for r in groups.titles(e).collect()] == ["The title"]
    e, _ = page(spark, "<h2>alone</h2>")
    assert groups.titles(e).count() == 0


@pytest.mark.parametrize(("text", "want"), [("", "login"), ("Search the site", "search"), ("Subscribe to our newsletter", "newsletter")])
def test_function_areas(spark, text, want):
    e, _ = page(spark, f"<form>{text}<input type='text'><button>go</button></form><p>x</p>")
    assert [r.kind for r in groups.function_areas(e).collect()] == [want]


def test_visibility_and_clipping(spark):
    e, _ = page(spark, "<div data-opacity='0.05'><p id=a>faint</p></div><div data-overflow='hidden' data-box='0,0,100,100'><p data-box='200,200,300,300'>cut</p><p data-position='absolute' data-box='200,200,300,300'>free</p></div><p data-hidden='1'>gone</p><svg><g>x</g></svg><map><area></map><p data-box='0,0,50,50'>seen</p>")
    seen = {tuple(r.own_text) for r in snapshot.visible(e).where("tag = 'p'").collect()}
    assert seen == {("free",), ("seen",)}
    assert not {"g", "area", "map"} & {r.tag for r in snapshot.visible(e).collect()}


def test_computed_controls_and_primitives(spark):
    e, _ = page(spark, "<div data-box='0,0,90,30' data-cursor='pointer'>Go</div><a href='/x' data-box='0,40,90,60'>link</a><p><a href='/y' data-box='0,70,90,90'>inline</a></p><button>b</button><img data-box='0,100,20,120'><img data-box='0,200,600,600'>")
    assert sorted(r.tag for r in snapshot.computed_controls(e).collect()) == ["a", "div"]
    kinds = {r.kind for r in snapshot.graphics(e).collect()}
    assert kinds == {"icon", "main"}
    fam = sorted(r.family for r in snapshot.primitives(e).collect())
    assert fam == ["cntrl", "cntrl", "cntrl", "graphic", "graphic", "txt"]


def test_pixels(spark):
    raw = bytearray(np.array([[255, 0, 0, 255], [0, 0, 255, 255]], np.uint8).tobytes())
    r = snapshot.pixel_stats(spark.createDataFrame([(1, 2, raw)], "page_id long, el_id int, rgba binary")).first()
    assert r.mean == [127.5, 0.0, 127.5] and r.sd == 85.0
    d = snapshot.image_difference(spark.createDataFrame([(1, raw, raw), (2, raw, bytearray(8))], "page_id long, one binary, two binary")).orderBy("page_id").collect()
    assert (d[0].same, d[0].difference) == (True, 0) and (d[1].same, d[1].difference) == (False, 4 * 255)


def test_overlays_bars_and_banners(spark):
    e, _ = page(spark, "<p data-box='0,500,300,540'>under</p>" + "".join(f"<p data-box='0,{600 + 50 * k},300,{640 + 50 * k}'>t{k}</p>" for k in range(8)) + "<div data-position='absolute' data-box='0,490,400,560'><p data-box='10,500,20,510'>pop</p></div><nav data-position='fixed' data-box='0,0,1440,60'>bar</nav>")
    assert [(r.tag, r.l, r.t) for r in groups.overlays(e).collect()] == [("div", 0.0, 490.0)]
    assert [(r.tag, r.location) for r in groups.fixed_areas(e).collect()] == [("nav", "top")]
    e, _ = page(spark, "<div><img data-box='0,0,800,300'><img data-hidden='1' data-box='0,0,800,300'><img data-hidden='1' data-box='0,0,100,300'></div>")
    assert groups.rotating_banners(e).count() == 1


def test_main_text(spark):
    e, p = page(spark, "<article><p>A sentence that is long enough to count here.</p><p>And a second one that is long enough to count.</p></article><form><p>A sentence that stands in a form and does not count.</p><input></form>")
    assert [r.el_id for r in groups.main_text(e, p).collect()] == [r.el_id for r in e.where("tag = 'article'").collect()]


def test_scramble_keeps_shape():
    from lumeno.functions.scramble import scrambled

    t = "Hello, World 42! Ünï ß"
    s = scrambled(t)
    assert sorted(s.lower()) == sorted(t.lower()) and [c.isupper() for c in s] == [c.isupper() for c in t] and [c for c in s if not c.isalnum()] == [c for c in t if not c.isalnum()]


def test_text_lines(spark):
    rows = [(1, 0, 10.0, 0.0, 50.0), (1, 0, 12.0, 60.0, 90.0), (1, 0, 16.0, 0.0, 40.0), (1, 0, 30.0, 0.0, 70.0)]
    r = groups.text_lines(spark.createDataFrame(rows, "page_id long, group_id int, t double, l double, r double")).first()
    assert (r.n_lines, r.width) == (3, 90.0 + 40.0 + 70.0)
