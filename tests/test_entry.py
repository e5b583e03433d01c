"""The contract, also without the corpus operators; and operators on hand-made cases."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from lumeno.functions import text as T
from lumeno.operators import clusters, dom
from lumeno.sources import html, tables

ROOT = Path(__file__).resolve().parents[1]


def test_entry_runs_and_imports_without_corpus_operators(spark, tmp_path):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
    for p in ("__spark_entry__.py", "lumeno"):
        subprocess.run(["cp", "-r", ROOT / p, tmp_path], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "lumeno/llm"], check=True)
    out = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin"}, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 40 and out[1] == "False"


@pytest.mark.parametrize(("host", "want"), [("www.example.co.uk", "example.co.uk"), ("www.example.com", "example.com"), ("www.abc.com", "www.abc.com"), ("localhost", "localhost"), ("", "")])
def test_base_host(spark, host, want):
    assert spark.createDataFrame([(host,)], "h string").select(T.base_host(T.F.col("h"))).first()[0] == want


def test_external_links_and_resolution(spark):
    page = [(1, "http://www.site.com/a/b.html?q#f", "<a href='c.html'>x</a><a href='/d'>y</a><a href='#g'>z</a><a href='http://m.site.com/'>m</a><a href='https://else.org/'>e</a><a href='//else.org/q'>f</a><a>no</a>")]
    pages = spark.createDataFrame(page, "page_id long, url string, html string")
    got = [(r.href, r.external) for r in dom.links(html.parse(pages), pages).orderBy("el_id").collect()]
    assert got == [("http://www.site.com/a/c.html", False), ("http://www.site.com/d", False), ("http://www.site.com/a/b.html?q#g", False), ("http://m.site.com/", False), ("https://else.org/", True), ("http://else.org/q", True)]


def test_tree_repairs_and_intervals():
    rows = html.tree("<html><body><p>a<p>b<ul><li>c<li>d<br>e</ul><script>var t='</p>'</script><b>f")
    assert [(r[2], r[1]) for r in rows] == [("html", None), ("body", 0), ("p", 1), ("p", 1), ("ul", 1), ("li", 4), ("li", 4), ("br", 6), ("script", 1), ("b", 1)]
    for r in rows:
        kids = [x for x in rows if x[1] == r[0]]
        assert r[3] < r[4] and all(r[3] < k[3] and k[4] < r[4] for k in kids)


def test_containment_operators(spark):
    pages = spark.createDataFrame([(1, "<div><section><p>one</p></section><p>two</p></div><form><input value='v'><input type='submit'><button>go</button></form>")], "page_id long, html string")
    e = html.parse(pages).cache()
    assert [r.tag for r in dom.outermost(e.where("tag in ('div','section','p')")).collect()] == ["div"]
    assert sorted(r.tag for r in dom.innermost(e.where("tag in ('div','section','p')")).collect()) == ["p", "p"]
    assert sorted(r.shown for r in dom.text_controls(e).collect()) == ["Submit", "go", "v"]
    assert sorted(r.text for r in dom.paragraphs(e).collect()) == ["one", "two"]
    ids = {(r.tag, r.depth): r.el_id for r in e.collect()}
    dist = {(r.a_id, r.b_id): r.value for r in dom.html_distance(e.where("tag in ('div','section','p')")).collect()}
    assert dist[ids["div", 0], ids["section", 1]] == 1 and dist[ids["section", 1], ids["p", 1]] == 2


def test_html_distance_query_has_all_elements_of_a_page(spark, tmp_path):
    from lumeno import catalog

    page = [(1, "http://a.b/", "<html><body><div><section><p>a<b>c</b></p></section><h1>d</h1></div><a>e</a></body></html>")]
    spark.createDataFrame(page, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    e = {r.el_id: r for r in html.parse(spark.read.parquet(f"{tmp_path}/pages.parquet")).collect()}

    def up(k):
        return [k, *(up(e[k].parent_id) if e[k].parent_id is not None else [])]

    want = {(a, b): min(up(a).index(c) + up(b).index(c) for c in up(a) if c in up(b)) for a in e for b in e if a != b}
    assert {(r.a_id, r.b_id): r.value for r in catalog.QUERIES["dom_html_distance"](spark, str(tmp_path)).collect()} == want


def test_overlaps_and_envelopes_of_all_rectangles(spark):
    from lumeno import catalog
    from lumeno.operators import boxes

    sf = "/root/testdata/sf0.001"
    made = catalog.QUERIES["rectangle_range_join_all"](spark, sf).collect()
    assert {(r.a_id + r.b_id) % 2 for r in made} == {0, 1}
    r = catalog.rects(spark, sf)
    want = boxes.shared_envelopes(boxes.enclosed(r, r)).count()
    assert catalog.matrices(spark, sf).where("metric = 'mod_bgAndBrd'").count() == want > boxes.shared_envelopes(boxes.enclosed(r, r.where("el_id % 3 = 0"))).count()


def plain_ward(d):
    groups, out = [[k] for k in range(len(d))], []
    while len(groups) > 1:
        def cost(a, b):  # from squared distances alone
            s = lambda x, y: sum(d[i][j] ** 2 for i in x for j in y)
            n, m = len(a), len(b)
            return 2 * n * m / (n + m) * (s(a, b) / (n * m) - s(a, a) / (2 * n * n) - s(b, b) / (2 * m * m))
        h, i, j = min((cost(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        out.append(h**0.5)
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [groups[i] + groups[j]]
    return out


def test_ward_equals_plain_version_and_cut_finds_clusters():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (9, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    got = [m[2] for m in clusters.ward(d)]
    assert np.allclose(got, plain_ward(d)) and all(a <= b + 1e-9 for a, b in zip(got, got[1:]))
    y = np.concatenate([rng.normal(0, 0.1, (5, 2)), rng.normal(9, 0.1, (4, 2))])
    d = np.sqrt(((y[:, None] - y[None]) ** 2).sum(-1))
    assert clusters.hybrid_cut(clusters.ward(d), d).tolist() == [1] * 5 + [2] * 4


def test_roots_of_two_containers(spark):
    pages = spark.createDataFrame([(1, "<body><div><p>a</p><p>b</p><p>c</p></div><section><p>d</p><p>e</p></section></body>")], "page_id long, html string")
    e = html.parse(pages)
    p = [r.el_id for r in e.where("tag = 'p'").orderBy("pre").collect()]
    labels = spark.createDataFrame([(1, "m", k, 1 if i < 3 else 2) for i, k in enumerate(p)], clusters.LABELS)
    tags = {r.el_id: r.tag for r in e.collect()}
    assert {r.label: tags[r.root_el] for r in clusters.roots(clusters.ladders(labels, e)).collect()} == {1: "div", 2: "section"}
    one = labels.selectExpr("page_id", "method", "el_id", "1 AS label")
    assert clusters.roots(clusters.ladders(one, e)).count() == 0


def test_matrix_files_round_trip(spark, tmp_path):
    (tmp_path / "withCmp_dist_html_sum.txt").write_text("x1\tx2\tx3\trowElId\nNA\t1\t2\tx1\n1\tNA\t3\tx2\n2\t3\tNA\tx3\n")
    (tmp_path / "small_dist_html_sum.txt").write_text("x1\tx2\trowElId\nNA\t1\tx1\n1\tNA\tx2\n")
    got = tables.read_matrix(spark, f"{tmp_path}/withCmp*.txt").collect()
    assert {(r.metric, r.a_id, r.b_id): r.value for r in got}["withCmp_dist_html_sum", "x2", "x3"] == 3 and len(got) == 6
    assert tables.read_matrix(spark, f"{tmp_path}/small*.txt").count() == 0
    assert html.selectors("a:not(.b, .c), [x='1,2'] , p") == ["a:not(.b, .c)", "[x='1,2']", "p"]
