"""Every registered query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from lumeno import catalog

DIR = "/root/testdata/sf0.001"
#: The test pages have no controls, images or forms.
MAY_BE_EMPTY = {"dom_controls", "snapshot_graphics", "snapshot_positioned", "snapshot_full_window", "snapshot_computed_controls", "group_headers", "group_footers", "group_forms", "group_logos", "group_social_buttons", "group_function_areas", "group_menus", "group_titles", "group_overlays", "group_fixed_areas", "group_rotating_banners", "group_main_text"}


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=lambda r: tuple(map(str, r)))


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    got = df.collect()
    if name not in catalog.ORACLES:
        assert got or name in MAY_BE_EMPTY
        return
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    a, b = rows(df.columns, got), rows(want.columns, want.fetchall())
    assert len(a) == len(b)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    assert not bad, bad[:3]
