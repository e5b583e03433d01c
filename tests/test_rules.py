"""Gap areas, cuts and paths on hand-made cases."""

import numpy as np
import pytest

from lumeno.operators import boxes, clusters, dom, frames
from lumeno.sources import html


@pytest.mark.parametrize(
    ("container", "kids", "want"),
    [
        ((0, 0, 100, 50), [(10, 10, 40, 40), (60, 10, 90, 40)], 5000 - 1800),  # 10 on each side, half of 20 between
        ((0, 0, 100, 50), [(10, 10, 90, 40)], 100 * 50 - 80 * 30),  # a single child: the distance to the container
        ((0, 0, 100, 50), [(0, 0, 50, 50), (50, 0, 100, 50)], 0),  # no gaps
        ((0, 0, 2, 2), [(0.5, 0.5, 1, 1)], 0),  # too small a container
    ],
)
def test_gap_areas(spark, container, kids, want):
    rows = [(1, 7, *map(float, container), *map(float, k)) for k in kids]
    made = boxes.flex_space(spark.createDataFrame(rows, "page_id long, box_id long, c_l double, c_t double, c_r double, c_b double, l double, t double, r double, b double"))
    assert made.first().space == pytest.approx(want)


def test_static_cut():
    merges = [(0, 1, 1.0), (2, 8, 1.0), (3, 9, 1.0), (4, 5, 1.0), (6, 11, 1.0), (7, 12, 1.0), (10, 13, 10.0)]
    assert clusters.static_cut(merges, 8).tolist() == [1, 1, 1, 1, 2, 2, 2, 2]


def test_chains_merge_in_order_of_height():
    d = np.random.default_rng(4).random((40, 40))
    d = d + d.T
    np.fill_diagonal(d, 0)
    made = clusters.ward(d)
    assert len(made) == 39 and all(x <= y + 1e-12 for (_, _, x), (_, _, y) in zip(made, made[1:]))
    assert sorted(k for a, b, _ in made for k in (a, b)) == list(range(78))


def test_paths_are_made_from_parents_where_they_are_missing(spark):
    e = html.parse(spark.createDataFrame([(1, "<div><section><p>a<b>c</b></p></section><p>d</p></div>"), (2, "<p>x</p>")], "page_id long, html string"))
    want = {(r.page_id, r.el_id): r.path for r in e.collect()}
    assert {(r.page_id, r.el_id): r.path for r in dom.paths(e.drop("path")).collect()} == want


def test_frames_of_frames(spark):
    rows = [(1, 0, None, 5.0, 6.0), (1, 1, 0, 10.0, 20.0), (1, 2, 1, 1.0, 2.0), (2, 9, None, 0.0, 0.0)]
    made = frames.absolute_frames(spark.createDataFrame(rows, "page_id long, frame_id int, parent_id int, l double, t double"))
    assert {(r.page_id, r.frame_id): (r.l, r.t, r.depth) for r in made.collect()} == {(1, 0): (5, 6, 0), (1, 1): (15, 26, 1), (1, 2): (16, 28, 2), (2, 9): (0, 0, 0)}


def plain_cut(merges, d, share=0.95, least=2, deep=1):
    """The same rules from the top down: each node of the tree says what it is, from what its two sides are."""
    n, heights = len(d), [m[2] for m in merges]
    top = share * max(heights)
    low = heights[max(1, round(len(heights) * 0.05)) - 1]
    allowed = clusters.CORE_SCATTER[deep]
    most, gap = low + allowed * (top - low), 0.75 * (1 - allowed) * (top - low)
    closed = []  # elements, height of the end, where it began

    def core(els):
        size = len(els) if len(els) <= least / 2 + 1 else int(least / 2 + 1 + (len(els) - least / 2 - 1) ** 0.5)
        pairs = [d[x, y] for k, x in enumerate(els[:size]) for y in els[:k]]
        return sum(pairs) / len(pairs)

    def bad(els, h):
        return len(els) < least or core(els) > most or h - core(els) < gap

    def node(k):
        """("one", element), ("branch", elements, begin) or ("whole", elements, None)"""
        if k < n:
            return "one", [k], None
        x, y, h = merges[k - n]
        a, b = node(x), node(y)
        if a[0] == "one" or b[0] == "one":
            if a[0] == b[0]:
                return "branch", a[1] + b[1], k
            one, rest = (a, b) if a[0] == "one" else (b, a)
            return rest[0], rest[1] + one[1], rest[2]
        first, second = (b, a) if len(b[1]) < len(a[1]) else (a, b)
        for own, other in ((first, second), (second, first)):
            if own[0] == "branch" and bad(own[1], h):
                return other[0], other[1] + own[1], other[2]
        closed.extend((z[1], h, z[2]) for z in (first, second) if z[0] == "branch")
        kept = second if second[0] == "whole" else first if first[0] == "whole" else ("whole", [], None)
        return "whole", kept[1], None

    inner = {x for m in merges if m[2] <= top for x in m[:2]}
    for k in range(n, n + len(merges)):
        if merges[k - n][2] <= top and k not in inner:
            kind, els, begin = node(k)
            if kind == "branch":
                closed.append((els, top, begin))
    good = [(els, begin) for els, h, begin in closed if len(els) >= least and core(els) < most and h - core(els) > gap]
    labels = [0] * n
    for k, (els, _) in enumerate(sorted(good, key=lambda g: (-len(g[0]), g[1])), 1):
        for x in els:
            labels[x] = k
    return labels


def test_hybrid_cut_equals_plain_rules():
    rng = np.random.default_rng(7)
    many = 0
    for _ in range(300):
        n = int(rng.integers(3, 40))
        centers = rng.normal(0, rng.choice([0.5, 2, 6]), (int(rng.integers(1, 6)), 2))
        x = centers[rng.integers(0, len(centers), n)] + rng.normal(0, rng.choice([0.2, 1.0]), (n, 2))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        merges, least, deep = clusters.ward(d), int(rng.choice([2, 2, 4])), int(rng.integers(0, 5))
        got = clusters.hybrid_cut(merges, d, least=least, deep=deep).tolist()
        if sum(m[2] <= 0.95 * max(h[2] for h in merges) for m in merges) >= least:
            assert got == plain_cut(merges, d, least=least, deep=deep)
        many += len(set(got)) > 2
    assert many > 50


def test_three_groups_on_a_line():
    y = np.array([0, 0.1, 0.2, 5, 5.1, 5.2, 20, 20.1, 20.2])[:, None]
    labels = clusters.hybrid_cut(clusters.ward(np.abs(y - y.T)), np.abs(y - y.T)).reshape(3, 3)
    assert (labels == labels[:, :1]).all() and sorted(labels[:, 0].tolist()) == [1, 2, 3]


def test_derived_sets_are_made_again_after_release(spark):
    from lumeno.operators import groups
    from lumeno.plans.shared import release
    from lumeno.sources import snapshots

    pages = spark.createDataFrame([(1, "<html><body data-box='0,0,1440,2000'><div data-box='0,0,1440,100'>top</div><p data-box='0,200,900,220'>text</p></body></html>")], "page_id long, html string")
    e = snapshots.from_pages(pages)
    before = groups.headers(e).count()
    release(spark)
    assert groups.headers(e).count() == before == 1
