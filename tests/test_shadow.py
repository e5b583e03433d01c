"""Declarative shadow roots, and frames in the coordinates of their page."""

from lumeno.operators import clusters, frames
from lumeno.sources import html

CARD = "<x-card><template shadowrootmode='open'><h1>{}</h1><slot name='a'><em>none</em></slot><slot></slot></template>{}</x-card>"


def lines(page):
    """Tags with their depth and host in the order of rendering."""
    rows = html.flattened(html.tree(page))
    tags = {r[0]: r[2] for r in rows}
    assert all(r[3] < r[4] for r in rows) and len({x for r in rows for x in r[3:5]}) == 2 * len(rows)
    return [(r[2], r[5], tags.get(r[8])) for r in rows]


def test_slots():
    assert lines(CARD.format("t", "<b slot='a'>1</b><i>2</i><u slot='gone'>3</u><i>4</i>")) == [("x-card", 0, None), ("h1", 1, "x-card"), ("slot", 1, "x-card"), ("b", 2, None), ("slot", 1, "x-card"), ("i", 2, None), ("i", 2, None)]
    assert lines(CARD.format("t", "")) == [("x-card", 0, None), ("h1", 1, "x-card"), ("slot", 1, "x-card"), ("em", 2, "x-card"), ("slot", 1, "x-card")]
    assert lines("<div><template><p>1</p></template><slot><b>2</b></slot></div>") == [("div", 0, None), ("template", 1, None), ("p", 2, None), ("slot", 1, None), ("b", 2, None)]
    assert html.flattened([]) == []


def test_nested_hosts():
    inner = CARD.format("inner", "<b slot='a'>1</b>")
    got = lines(f"<y-box><template shadowrootmode='open'><div>{inner}</div><slot></slot></template>{CARD.format('light', '<s>2</s>')}</y-box>")
    assert got == [("y-box", 0, None), ("div", 1, "y-box"), ("x-card", 2, "y-box"), ("h1", 3, "x-card"), ("slot", 3, "x-card"), ("b", 4, "y-box"), ("slot", 3, "x-card"), ("slot", 1, "y-box"), ("x-card", 2, None), ("h1", 3, "x-card"), ("slot", 3, "x-card"), ("em", 4, "x-card"), ("slot", 3, "x-card"), ("s", 4, None)]


def test_pages_without_shadow_roots_are_as_parsed(spark):
    pages = spark.createDataFrame([(1, "<html><body><div><p>a<b>c</b></p><img></div></body></html>"), (2, None), (3, "")], "page_id long, html string")
    plain, shadow = html.parse(pages), html.parse_shadow(pages)
    shown = lambda df: sorted(map(str, df.select(*plain.columns).collect()))
    assert shown(plain) == shown(shadow) and shadow.where("host_id IS NOT NULL").count() == 0


def test_frames_of_a_page_cluster_as_one(spark):
    f = spark.createDataFrame([(1, 10, None, 100.0, 200.0), (1, 11, 10, 5.0, 6.0)], "page_id long, frame_id int, parent_id int, l double, t double")
    rects = spark.createDataFrame([(1, None, 1, 0.0, 0.0, 9.0, 9.0), (1, 10, 1, 1.0, 2.0, 3.0, 4.0), (1, 11, 1, 1.0, 2.0, 3.0, 4.0), (1, 99, 1, 1.0, 2.0, 3.0, 4.0)], "page_id long, frame_id int, el_id int, l double, t double, r double, b double")
    got = {r.key: (r.l, r.t, r.r, r.b) for r in frames.in_page(rects, frames.absolute_frames(f)).collect()}
    assert got == {"1": (0.0, 0.0, 9.0, 9.0), "10/1": (101.0, 202.0, 103.0, 204.0), "11/1": (106.0, 208.0, 108.0, 210.0)}


def test_stand_alone_frames_are_groups(spark):
    labels = spark.createDataFrame([(1, "m", 1, 1), (1, "m", 2, 1), (1, "m", 3, 2)], clusters.LABELS)
    found = spark.createDataFrame([(1, "m", 1, 7, 0.9)], "page_id long, method string, label int, root_el int, cost_ben double")
    boxes = spark.createDataFrame([(1, 20, 0.0, 0.0, 300.0, 200.0), (1, 21, 0.0, 0.0, 150.0, 30.0)], "page_id long, el_id int, l double, t double, r double, b double")
    made = clusters.with_frames(clusters.groups(labels, found), frames.frame_kinds(boxes).where("alone"))
    got = {r.group_id: (r.has_root, r.root_el, r.els, r.frame) for r in made.collect()}
    assert got == {"ClustID_1": (True, 7, None, False), "ClustID_2": (False, None, [3], False), "ClustID_3": (True, 20, None, True)}
