"""What grows with the tables: broadcasts, and calls for each of very many small groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumeno import catalog
from lumeno.operators import boxes, clusters, dom

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    """The plan before anything has run."""
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["site_titles", "site_function_areas", "tree_visible", "tree_styled"])
def test_elements_are_not_broadcast_by_the_size_of_their_files(spark, name):
    got = plan(catalog.QUERIES[name](spark, SF))
    assert "Join" in got and "BroadcastHashJoin" not in got


def test_main_text_needs_no_closure_of_all_elements(spark, monkeypatch):
    """Links, bars and texts bring their own paths, for menus and forms too, which main_text leaves out."""

    def closure(*args, **kwargs):
        raise AssertionError("the paths of all elements are exploded")

    monkeypatch.setattr(dom, "closure", closure)
    want = {r.p_partkey: 1 for r in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey").collect()}
    assert {r.page_id: r.n for r in catalog.QUERIES["site_main_text"](spark, SF).collect()} == want


def test_paths_of_pages_across_batches(spark):
    rng, rows, want = np.random.default_rng(1), [], {}
    for p in range(40):
        n = int(rng.choice([1, 2, 3, 9, 30]))
        up = {2 * k: (None if k == 0 or rng.random() < 0.1 else 2 * int(rng.integers(k))) for k in range(n)}
        up[0] = None if p % 3 else 1001  # a parent that isn't there
        for k in up:
            path, x = [], k
            while x is not None:
                path.append(x)
                x = up.get(x)
            want[f"p{p}", k] = path[::-1]
            rows.append((f"p{p}", k, up[k]))
    e = spark.createDataFrame([rows[k] for k in rng.permutation(len(rows))], "page_id string, el_id int, parent_id int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        made = dom.paths(e)
        assert "FlatMapGroups" not in plan(made) and {(r.page_id, r.el_id): r.path for r in made.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_an_element_above_itself_is_an_error(spark):
    with pytest.raises(Exception, match="its own ancestor"):
        dom.paths(spark.createDataFrame([(1, 0, 1), (1, 1, 0)], "page_id long, el_id int, parent_id int")).collect()


def test_clusters_and_gaps_of_small_pages_without_a_call_each(spark):
    rng = np.random.default_rng(2)
    want, rows, kids, areas = {}, [], [], {}
    for p in range(30):
        n = int(rng.integers(2, 12))
        d = rng.random((n, n)).round(2)
        d = np.maximum(d, d.T)
        rows += [(p, m, i, j, float(d[i, j])) for m in ("x", "y") for i in range(n) for j in range(n) if i != j]
        np.fill_diagonal(d, 0)
        if n > 2:
            want |= {(p, f"{m}_hbrdCut", k): int(v) for m in ("x", "y") for k, v in enumerate(clusters.hybrid_cut(clusters.ward(d), d))}
        kids += [(p, 0, 20.0 * k + 10, 10.0, 20.0 * k + 20, 20.0, 0.0, 0.0, 20.0 * n + 10, 30.0) for k in range(n)]
        areas[p] = 20.0 * n * 30 - 100.0 * n  # children grow by half the gap of ten across and by ten up and down
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        made = clusters.cluster(spark.createDataFrame(rows, "page_id long, metric string, a_id int, b_id int, value double"))
        gaps = boxes.flex_space(spark.createDataFrame(kids, "page_id long, box_id long, l double, t double, r double, b double, c_l double, c_t double, c_r double, c_b double"))
        assert "FlatMapGroups" not in plan(made) + plan(gaps)
        assert {(r.page_id, r.method, r.el_id): r.label for r in made.collect()} == want
        assert {r.page_id: r.space for r in gaps.collect()} == pytest.approx(areas)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 12])
def test_few_elements_are_clustered_as_many_are(n):
    rng = np.random.default_rng(n)
    for digits in (0, 1, 9):  # with and without equal distances
        d = rng.random((n, n)).round(digits)
        s = np.maximum(d, d.T) ** 2
        np.fill_diagonal(s, np.inf)
        assert clusters._chains_of_few(s.tolist()) == clusters._chains(s.copy())


def test_sheets_in_common_go_to_their_pages(spark):
    from lumeno.sources import css

    sheets = spark.createDataFrame([(p, 0, "a > b { x: y } .c:hover { x: y }" if p % 4 else "i { x: y }", None if p % 5 else "print") for p in range(50)], "page_id long, sheet int, css string, media string").coalesce(1)
    got = [(r.page_id, r.sel_id, r.selector, r.hover) for r in css.compile_sheets(sheets).collect()]
    want = [(p, n, s, h) for p in range(50) if p % 5 for n, (s, h) in enumerate([("a > b", False), (".c:hover", True)] if p % 4 else [("i", False)])]
    assert sorted(got) == want


def test_checked_controls_make_their_sets_once(spark):
    import duckdb

    made = catalog.QUERIES["tree_checked_controls"](spark, SF)
    assert plan(made).count("Exchange") < 12
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    assert sorted((r.page_id, r.el_id) for r in made.collect()) == sorted(db.execute(catalog.ORACLES["tree_checked_controls"]).fetchall())


def test_clusters_of_pages_without_joins(spark):
    """No shuffle of pairs; labels are those of the long matrices, for pages above and below what is clustered without arrays."""
    got = catalog.QUERIES["matrix_clusters"](spark, SF)
    assert "Join" not in plan(got) and plan(got).count("Exchange") <= 2
    rng = np.random.default_rng(5)
    rows = [(p, k, *(float(x) for x in (l, t, l + rng.integers(5, 60), t + rng.integers(5, 60)))) for p in range(40) for k in range(int(rng.choice([1, 2, 3, 4, 9, 12, 13, 20]))) for l, t in [rng.integers(0, 90, 2)]]
    r = spark.createDataFrame([rows[k] for k in rng.permutation(len(rows))], "page_id long, el_id int, l double, t double, r double, b double")
    cells = F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in catalog.measures().items()])
    long = boxes.pairs(r).select("page_id", "a_id", "b_id", F.explode(cells).alias("x")).select("page_id", "x.metric", "a_id", "b_id", "x.value").unionByName(boxes.shared_envelopes(boxes.enclosed(r, r)))
    want = {(x.page_id, x.method, x.el_id): x.label for x in clusters.cluster(clusters.methods(long).where(F.endswith("metric", F.lit("mod_bgAndBrd")))).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        made = clusters.cluster_pages(boxes.page_pairs(r).select("page_id", "a_id", "b_id", *[v.alias(k) for k, v in catalog.measures().items()], boxes.encloses("b_", "a_").alias("mod_bgAndBrd")))
        assert {(x.page_id, x.method, x.el_id): x.label for x in made.collect()} == want and len(want) > 1000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("n", [4, 7, 12])
def test_few_elements_are_cut_as_many_are(n):
    rng = np.random.default_rng(n)
    for digits in (1, 9):
        for _ in range(50):
            d = rng.random((n, n)).round(digits)
            d = np.maximum(d, d.T)
            np.fill_diagonal(d, 0)
            merges = clusters.ward(d)
            assert clusters.hybrid_cut(merges, d.tolist()).tolist() == clusters.hybrid_cut(merges, d).tolist()
            for b in range(2, n + 1):
                core = clusters._Branch(list(range(b)))
                assert core.scatter(d.tolist(), 2) == core.scatter(d, 2)


def test_written_tables_leave_no_shuffle_files(spark):
    import os

    from lumeno.plans.shared import CLEANUP, written

    def files() -> set[str]:
        return {f for d in dirs for _, _, fs in os.walk(d) for f in fs if f.startswith("shuffle_") and f.endswith(".data")}

    dirs = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    before, kept = files(), spark.conf.get(CLEANUP, None)
    made = written(spark.range(10_000).repartition(7, "id").groupBy(F.col("id") % 5000).count(), "growth")
    assert made.count() == 5000 and spark.conf.get(CLEANUP, None) == kept
    assert len(files() - before) <= 4  # of the count above


def test_bars_explode_paths_of_bars_only(spark, monkeypatch):
    """Paths of all elements are exploded twice, for floats and for the visible tree, not for every question about their ancestors."""
    from lumeno.operators import bars

    tables, made = {}, bars.written
    monkeypatch.setattr(bars, "written", lambda df, name: tables.setdefault(name, made(df, name)))
    got = sorted((r.page_id, r.el_id) for r in catalog.QUERIES["tree_headers"](spark, SF).collect())
    assert "chains" not in tables and tables["nodes"].count() <= tables["boxed"].count()

    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    assert got == sorted(db.execute(catalog.ORACLES["tree_headers"]).fetchall())
