"""Captured snapshots: what is written is read, by file, and rows that break the contract aren't."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lumeno.operators import dom, groups, snapshot
from lumeno.sources import captured, snapshots

PAGE = "<html><body data-box='0,0,1440,2000'><div data-box='0,0,1440,100'><a href='/' data-box='5,5,80,60'><img data-box='5,5,80,60'></a></div><main data-box='0,100,1440,1800'><p data-box='10,120,700,140'>some text</p></main></body></html>"


@pytest.fixture
def folder(spark, tmp_path):
    captured.register(spark)
    pages = spark.createDataFrame([(k, "http://www.site.com/", PAGE) for k in range(40)], "page_id long, url string, html string")
    e = snapshots.from_pages(pages)
    e.repartitionByRange(5, "page_id").write.format("captured").mode("append").save(str(tmp_path))
    return str(tmp_path), e, pages


def test_round_trip_and_pushed_filters(spark, folder):
    path, e, _ = folder
    got = spark.read.format("captured").load(path)
    same = [c for c in e.columns if c in got.columns]
    assert set(captured.NEEDED) <= set(same)
    shown = lambda df: sorted(map(str, df.select(*same).withColumn("attrs", F.map_entries("attrs")).collect()))
    assert shown(got) == shown(e)
    assert got.rdd.getNumPartitions() == 5
    some = got.where("page_id = 7")
    assert some.rdd.getNumPartitions() == 1 and some.count() == e.where("page_id = 7").count()
    assert got.where("page_id IN (1, 39)").rdd.getNumPartitions() == 2 and got.where("page_id >= 36").select("page_id").distinct().count() == 4
    e.where("page_id < 3").withColumn("page_id", F.col("page_id") + 100).write.format("captured").mode("append").save(path)
    assert spark.read.format("captured").load(path).select("page_id").distinct().count() == 43


def test_operators_run_on_captured_rows(spark, folder):
    path, e, pages = folder
    got = dom.paths(spark.read.format("captured").load(path))
    for f in (groups.headers, snapshot.visible):
        keys = lambda df: sorted((r.page_id, r.el_id) for r in df.select("page_id", "el_id").collect())
        assert keys(f(got)) == keys(f(e)), f.__name__
    assert groups.page_bars(got, pages).count() == groups.page_bars(e, pages).count() > 0


def test_rows_that_break_the_contract(spark, tmp_path):
    captured.register(spark)
    good = {"page_id": 1, "el_id": 0, "tag": "p", "pre": 0, "post": 1, "depth": 0, "l": 0, "t": 0, "r": 5, "b": 5, "doc_width": 10, "doc_height": 10}
    rows = [good, good | {"l": 9}, good | {"tag": None}, good | {"page_id": "x"}, good | {"opacity": 2}, good | {"parent_id": 0}, good | {"position": "floating"}, good | {"margins": [1, 2]}, good | {"color": [1]}, good | {"t": float("nan")}, [1], good | {"own_text": [1]}, good | {"el_id": 1, "extra": 3}]
    os.makedirs(tmp_path / "_files")
    (tmp_path / "a.jsonl").write_text("\n".join([*map(json.dumps, rows), "{broken", "", json.dumps(good | {"el_id": 2})]))
    (tmp_path / "orphan.jsonl").write_text(json.dumps(good | {"el_id": 9}))
    (tmp_path / "_files" / "x.json").write_text(json.dumps([{"name": "a.jsonl", "first": 1, "last": 1}]))
    read = spark.read.format("captured")
    assert sorted(r.el_id for r in read.load(str(tmp_path)).collect()) == [0, 1, 2]
    bad = {r.line: r.reason for r in spark.read.format("captured").option("rows", "rejected").load(str(tmp_path)).collect()}
    assert sorted(bad) == [*range(2, 13), 14] and bad[2] == "the box is inside out" and bad[3] == "tag is missing" and bad[4] == "page_id is no long" and bad[14] == "no JSON"
    with pytest.raises(Exception, match="line 2"):
        spark.read.format("captured").option("mode", "fail").load(str(tmp_path)).collect()
