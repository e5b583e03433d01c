"""All queries over the page and element operators, and their SQL.

Rectangles come from lineitem: a page is an order, an element a line. Their pages hold at most a few dozen elements.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumeno.functions import color as C
from lumeno.functions import geometry as G
from lumeno.functions import scramble
from lumeno.functions import styles as ST
from lumeno.functions import text as T
from lumeno.operators import bars, boxes, clusters, controls, dom, frames, groups, jobs, paragraphs, pixels, selectors, snapshot
from lumeno.plans.shared import written
from lumeno.sources import html, snapshots, tables
from lumeno.sources import pixels as tiled_images

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RECTS = """SELECT l_orderkey AS page_id,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS INT) AS el_id,
    l_quantity * 20 AS l, l_discount * 5000 AS t, l_quantity * 20 + 50 + l_tax * 2000 AS r, l_discount * 5000 + 20 + (l_partkey % 7) * 10 AS b FROM {lineitem}"""
R = f"r AS ({RECTS.format(lineitem='lineitem')})"
#: Pairs of a page's rectangles with signed gaps and shares of the first on both axes.
PAIRS = f"""{R}, p AS (SELECT x.page_id, x.el_id AS a_id, y.el_id AS b_id,
    CASE WHEN x.l < y.l THEN y.l - x.r ELSE x.l - y.r END AS gx, CASE WHEN x.t < y.t THEN y.t - x.b ELSE x.t - y.b END AS gy,
    greatest(least(x.r, y.r) - greatest(x.l, y.l), 0) / (x.r - x.l) AS ox, greatest(least(x.b, y.b) - greatest(x.t, y.t), 0) / (x.b - x.t) AS oy,
    greatest(least(x.r, y.r) - greatest(x.l, y.l), 0) / (y.r - y.l) AS qx, greatest(least(x.b, y.b) - greatest(x.t, y.t), 0) / (y.b - y.t) AS qy
    FROM r x JOIN r y ON x.page_id = y.page_id AND x.el_id <> y.el_id)"""
FADE = "CASE WHEN {0} < 0 THEN 1 WHEN {0} > 44 THEN 0 ELSE exp(-pow(floor({0} + 0.5), 2) / 392) END"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rects(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(RECTS.format(lineitem="{lineitem}"), lineitem=read(spark, sf, "lineitem"))


def elements(spark: SparkSession, sf: str) -> DataFrame:
    return html.parse(read(spark, sf, "pages"))


def held(spark: SparkSession, sf: str) -> DataFrame:
    """The elements, parsed once, for queries that read them several times."""
    return written(elements(spark, sf), "elements")


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


# URLs and texts


@query("SELECT page_id, regexp_extract(url || '/', '(http[s]*://[\\w.-]*/|$)', 1) AS homepage FROM pages")
def url_homepage(spark, sf):
    return read(spark, sf, "pages").select("page_id", T.homepage(F.col("url")).alias("homepage"))


@query("SELECT page_id, split_part(trim(url || chr(9) || page_id), chr(9), 1) AS url FROM pages WHERE contains(url, 'http')")
def url_list_scan(spark, sf):
    lines = read(spark, sf, "pages").select("page_id", F.concat("url", F.lit("\t"), F.col("page_id").cast("string")).alias("value"))
    return tables.urls_of(lines).select("page_id", "url")


HOST = "split_part(split_part(url, '://', 2), '/', 1)"
BASE = "CASE WHEN len(h) > 2 AND length(h[len(h) - 1]) <= 3 THEN array_to_string(h[-3:], '.') ELSE array_to_string(h[-2:], '.') END"


@query(f"SELECT page_id, {HOST} AS host, CASE WHEN regexp_matches(url, '^(\\w+)://([^/]+)/(.*)$') THEN regexp_extract(url, '^(\\w+)://([^/]+)/', 2) ELSE url END AS strict_host, {BASE} AS base_host FROM (SELECT *, string_split({HOST}, '.') AS h FROM pages)")
def url_hosts(spark, sf):
    u = F.col("url")
    return read(spark, sf, "pages").select("page_id", T.url_host(u).alias("host"), T.host_from_url(u).alias("strict_host"), T.base_host(T.url_host(u)).alias("base_host"))


@query("SELECT page_id, list_filter(string_split(p, '/'), lambda x: x <> '') AS parts, CASE WHEN n = '' THEN '[empty]' ELSE n END AS icon FROM (SELECT *, list_extract(string_split(p, '/'), -1) AS n FROM (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^\\w+://[^/]*', '') AS p FROM pages))")
def url_path_parts(spark, sf):
    path = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"^\w+://[^/]*", "")
    return read(spark, sf, "pages").select("page_id", T.path_parts(path).alias("parts"), T.icon_name(F.col("url")).alias("icon"))


INV = "[\\f\\n\\r\\t\\v\\x{200b}\\x{00a0}\\x{1680}\\x{180e}\\x{2000}\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}"


@query(f"SELECT doc_id, length(regexp_replace(text, '{INV} ]', '', 'g')) AS n_clean, md5(regexp_replace(text, '{INV}]', '', 'g')) AS visible FROM documents")
def text_clean(spark, sf):
    t = F.col("text")
    return read(spark, sf, "documents").select("doc_id", F.length(T.clean_string(t)).cast("long").alias("n_clean"), F.md5(T.cut_invisible(t).cast("binary")).alias("visible"))


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN 1 ELSE round(length(regexp_replace(text, '[^0-9]', '', 'g')) / length(text), 6) END AS share FROM documents")
def text_digit_share(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.round(T.digit_share(F.col("text")), 6).alias("share"))


# Jobs


def job_rows(spark, sf):
    p = read(spark, sf, "pages")
    return jobs.create_jobs(p.select(T.homepage(F.col("url")).alias("url"), F.col("page_id").alias("ord")))


JOB = "j AS (SELECT regexp_extract(url || '/', '(http[s]*://[\\w.-]*/|$)', 1) AS url, min(page_id) AS ord FROM pages GROUP BY 1)"


@query(f"WITH {JOB} SELECT url, CAST(NULL AS VARCHAR) AS actual_url, false AS previsiting_done, false AS all_done, ord FROM j")
def jobs_create(spark, sf):
    return job_rows(spark, sf)


@query("SELECT o_custkey AS actual_url, min(o_orderkey) AS ord FROM orders GROUP BY 1")
def jobs_dedup_actual_url(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("actual_url"), F.col("o_orderkey").alias("ord"))
    return jobs.first_of(o, "actual_url")


@query(f"WITH {JOB} SELECT url, CASE WHEN ord % 3 = 0 THEN url || 'x' END AS actual_url, ord % 3 = 0 AS all_done, ord FROM j")
def jobs_update(spark, sf):
    j = job_rows(spark, sf)
    change = j.where("ord % 3 = 0").select("url", F.concat("url", F.lit("x")).alias("actual_url"), F.lit(True).alias("all_done"))
    return jobs.update(j, change)[0].select("url", "actual_url", "all_done", "ord")


@query("SELECT 'http://none/' || CAST(page_id AS VARCHAR) AS url, true AS all_done FROM pages WHERE page_id % 5 = 0")
def jobs_update_missing_keys(spark, sf):
    change = read(spark, sf, "pages").where("page_id % 5 = 0").select(F.concat(F.lit("http://none/"), F.col("page_id").cast("string")).alias("url"), F.lit(True).alias("all_done"))
    return jobs.update(job_rows(spark, sf), change)[1]


@query(f"WITH {JOB} SELECT url, ord FROM j WHERE ord % 3 <> 0")
def jobs_remove(spark, sf):
    j = job_rows(spark, sf)
    return jobs.remove(j, j.where("ord % 3 = 0")).select("url", "ord")


@query(f"WITH {JOB} SELECT url, ord FROM j WHERE ord % 2 = 1")
def jobs_pending(spark, sf):
    j = job_rows(spark, sf).withColumn("previsiting_done", F.col("ord") % 2 == 0)
    return jobs.pending_previsits(j).select("url", "ord")


@query(f"WITH {JOB} SELECT url, ord FROM j WHERE ord >= 10 ORDER BY ord, url LIMIT 1")
def jobs_next(spark, sf):
    return jobs.next_job(job_rows(spark, sf).withColumn("all_done", F.col("ord") < 10)).select("url", "ord")


@query(f"WITH {JOB} SELECT count(*) FILTER (ord % 4 <> 0) AS n_open, count(*) FILTER (ord % 4 = 0) AS n_done, bool_and(ord % 4 = 0) AS finished FROM j")
def jobs_progress(spark, sf):
    return jobs.progress(job_rows(spark, sf).withColumn("all_done", F.col("ord") % 4 == 0))


@query("SELECT event_id FROM events WHERE event_id % 600 < 400")
def jobs_drop_failed(spark, sf):
    return jobs.drop_failed(read(spark, sf, "events").withColumn("status", F.col("event_id") % 600)).select("event_id")


@query("SELECT p_partkey, p_size * 300 > pow(2, 13.5) AS too_high, p_size * 40 > 1440 AS too_wide, p_size * 300 < 905 AS too_low, p_size % 5 > 3 AS has_frameset FROM part")
def page_warnings(spark, sf):
    s = F.col("p_size")
    return read(spark, sf, "part").select("p_partkey", *[v.alias(k) for k, v in jobs.warnings(s * 300, s * 40, F.lit(1440), F.lit(900), F.greatest(F.lit(0), s % 5 - 3)).items()])


@query(f"WITH {JOB}, h AS (SELECT DISTINCT split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages WHERE page_id % 7 = 0) SELECT url, split_part(split_part(url, '://', 2), '/', 1) NOT IN (SELECT host FROM h) AS all_done FROM j")
def jobs_reset(spark, sf):
    hosts = read(spark, sf, "pages").where("page_id % 7 = 0").select(T.url_host(F.col("url")).alias("host"))
    return jobs.reset(job_rows(spark, sf).withColumn("all_done", F.lit(True)), hosts).select("url", "all_done")


@query(f"WITH {JOB} SELECT url, ord, ord % 2 = 0 AS all_done FROM j")
def jobs_text_round_trip(spark, sf):
    j = job_rows(spark, sf).withColumn("all_done", F.col("ord") % 2 == 0)
    return tables.parse_jobs(tables.jobs_text(j)).join(j.select("url", F.col("ord").alias("at")), "url").select("url", F.col("at").alias("ord"), "all_done")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k <= 2")
def sample_first_n(spark, sf):
    return jobs.sample_first(read(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 2)


# Colors

RGB = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_partkey % 256 AS DOUBLE) AS r1, CAST(l_suppkey * 37 % 256 AS DOUBLE) AS g1, CAST(l_orderkey % 256 AS DOUBLE) AS b1, CAST(l_quantity * 5 AS DOUBLE) AS r2, CAST(l_linenumber * 31 AS DOUBLE) AS g2, CAST(l_partkey * 7 % 256 AS DOUBLE) AS b2 FROM {lineitem}"


def _lab_sql(k: int) -> str:
    lin = [f"(CASE WHEN {c}{k} / 255 > 0.04045 THEN pow(({c}{k} / 255 + 0.055) / 1.055, 2.4) ELSE {c}{k} / 255 / 12.92 END)" for c in "rgb"]
    return ", ".join(f"100 * ({' + '.join(f'{lin[j]} * {w}' for j, w in enumerate(row))}) / {white} AS {n}{k}" for n, row, white in zip("xyz", C.TO_XYZ, C.WHITE))


def _f(v: str) -> str:
    return f"(CASE WHEN {v} > 0.008856 THEN pow({v}, 1.0 / 3) ELSE 7.787 * {v} + 16.0 / 116 END)"


KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def colors(spark, sf):
    c = spark.sql(RGB.format(lineitem="{lineitem}"), lineitem=read(spark, sf, "lineitem"))
    return c.withColumns({"one": F.array("r1", "g1", "b1"), "two": F.array("r2", "g2", "b2")})


@query(f"WITH c AS ({RGB.format(lineitem='lineitem')}), v AS (SELECT *, {_lab_sql(1)} FROM c) SELECT {KEY}, round(116 * {_f('y1')} - 16, 4) AS lab_l, round(500 * ({_f('x1')} - {_f('y1')}), 4) AS lab_a, round(200 * ({_f('y1')} - {_f('z1')}), 4) AS lab_b FROM v")
def color_lab(spark, sf):
    lab = C.lab(F.col("one"))
    return colors(spark, sf).select(*KEY.split(", "), *[F.round(lab[k], 4).alias(f"lab_{n}") for k, n in enumerate("lab")])


@query(f"WITH c AS ({RGB.format(lineitem='lineitem')}), v AS (SELECT *, {_lab_sql(1)}, {_lab_sql(2)} FROM c), w AS (SELECT *, 116 * {_f('y1')} - 16 AS l1, 116 * {_f('y2')} - 16 AS l2 FROM v) SELECT {KEY}, round((greatest(l1, l2) / 100 + 0.05) / (least(l1, l2) / 100 + 0.05), 3) AS lum, round(sqrt((pow(r1 - r2, 2) + pow(g1 - g2, 2) + pow(b1 - b2, 2)) / 3), 1) AS rgb, abs(r1 - r2) + abs(g1 - g2) + abs(b1 - b2) > 15.3 AS differs FROM w")
def color_contrasts(spark, sf):
    a, b = F.col("one"), F.col("two")
    return colors(spark, sf).select(*KEY.split(", "), C.luminance_contrast(a, b).alias("lum"), C.rgb_contrast(a, b).alias("rgb"), C.differ(a, b).alias("differs"))


@query(f"WITH c AS ({RGB.format(lineitem='lineitem')}) SELECT {KEY}, round(r1 * (l_linenumber / 10.0) + r2 * (1 - l_linenumber / 10.0), 6) AS r, floor(l_linenumber / 10.0 * 255 + 0.5) AS alpha FROM c")
def color_over(spark, sf):
    a = F.col("l_linenumber") / 10
    return colors(spark, sf).select(*KEY.split(", "), F.round(C.over(F.array("r1", "g1", "b1", a), F.col("two"))[0], 6).alias("r"), C.alpha_byte(a).alias("alpha"))


# Rectangles


@query(f"WITH {PAIRS} SELECT page_id, a_id, b_id, round(sqrt(pow(greatest(gx, 0), 2) + pow(greatest(gy, 0), 2)), 6) AS value FROM p")
def spatial_distance_l2(spark, sf):
    return rounded(boxes.spatial_distance(rects(spark, sf)), "value").drop("metric")


@query(f"WITH {PAIRS} SELECT page_id, a_id, b_id, round(greatest(gx, 0) + greatest(gy, 0), 6) AS l1, round(greatest(gx, gy, 0), 6) AS mx, CASE WHEN gx < 5 AND gy < 5 THEN 0 ELSE 1 END AS bin FROM p")
def spatial_distance_other(spark, sf):
    p = boxes.pairs(rects(spark, sf))
    x, y = boxes._axes(G.gap)
    return rounded(p.select("page_id", "a_id", "b_id", G.merge(x, y, "l1").alias("l1"), G.merge(x, y, "max").alias("mx"), G.merge(x, y, "bin").cast("int").alias("bin")), "l1", "mx")


@query(f"WITH {PAIRS} SELECT page_id, a_id, b_id, round(ox, 6) AS x, round(oy, 6) AS y FROM p")
def spatial_overlap(spark, sf):
    return rounded(boxes.spatial_overlap(rects(spark, sf)), "x", "y")


@query(f"WITH {PAIRS} SELECT page_id, a_id, b_id, round(greatest(ox * {FADE.format('gy')} + oy * {FADE.format('gx')}, qx * {FADE.format('gy')} + qy * {FADE.format('gx')}), 6) AS value FROM p")
def spatial_connectedness(spark, sf):
    return rounded(boxes.connectedness(rects(spark, sf)), "value").drop("metric")


@query(f"WITH {R} SELECT x.page_id, x.el_id AS a_id, y.el_id AS b_id FROM r x JOIN r y ON x.page_id = y.page_id AND x.el_id % 2 = 0 AND y.el_id % 2 = 1 WHERE least(x.r, y.r) - greatest(x.l, y.l) > 10 AND least(x.b, y.b) - greatest(x.t, y.t) > 10")
def rectangle_range_join(spark, sf):
    r = rects(spark, sf)
    return boxes.overlapping(r.where("el_id % 2 = 0"), r.where("el_id % 2 = 1"), 10).select("page_id", "a_id", "b_id")


@query(f"WITH {R} SELECT x.page_id, x.el_id AS a_id, y.el_id AS b_id FROM r x JOIN r y ON x.page_id = y.page_id AND x.el_id < y.el_id WHERE least(x.r, y.r) - greatest(x.l, y.l) > 10 AND least(x.b, y.b) - greatest(x.t, y.t) > 10")
def rectangle_range_join_all(spark, sf):
    """Every pair of a page's rectangles once; rectangle_range_join, whose SQL is fixed, joins even with odd elements only."""
    r = rects(spark, sf)
    return boxes.overlapping(r, r, 10).where("a_id < b_id").select("page_id", "a_id", "b_id")


@query(f"WITH {R} SELECT page_id, round(min(l), 6) AS l, round(min(t), 6) AS t, round(max(r), 6) AS r, round(max(b), 6) AS b FROM r GROUP BY page_id")
def bounding_union(spark, sf):
    return rounded(boxes.bounding_union(rects(spark, sf), "page_id"), "l", "t", "r", "b")


@query(f"WITH {R} SELECT x.page_id, count(*) FILTER (abs(x.l - y.l) <= 5) AS n_equal, count(*) AS n_pairs FROM r x JOIN r y ON x.page_id = y.page_id AND x.el_id < y.el_id GROUP BY 1")
def equal_coordinates(spark, sf):
    return boxes.equal_coordinates(rects(spark, sf), "l")


ENC = f"{R}, i AS (SELECT e.page_id, e.el_id AS env_id, p.el_id FROM r e JOIN r p ON e.page_id = p.page_id WHERE e.el_id % 3 = 0 AND e.b - e.t >= (p.b - p.t) / 2 AND e.r - e.l >= (p.r - p.l) / 2 AND least(e.r, p.r) - greatest(e.l, p.l) > least(p.r - p.l, p.b - p.t) / 2 AND least(e.b, p.b) - greatest(e.t, p.t) > least(p.r - p.l, p.b - p.t) / 2)"


@query(f"WITH {ENC} SELECT x.page_id, x.el_id AS a_id, y.el_id AS b_id, CAST(count(*) AS DOUBLE) AS value FROM i x JOIN i y ON x.page_id = y.page_id AND x.env_id = y.env_id AND x.el_id <> y.el_id GROUP BY 1, 2, 3")
def enclosure_counts(spark, sf):
    r = rects(spark, sf)
    return boxes.shared_envelopes(boxes.enclosed(r, r.where("el_id % 3 = 0"))).drop("metric")


@query(f"WITH {ENC.replace('e.el_id % 3 = 0 AND ', '')} SELECT x.page_id, x.el_id AS a_id, y.el_id AS b_id, CAST(count(*) AS DOUBLE) AS value FROM i x JOIN i y ON x.page_id = y.page_id AND x.env_id = y.env_id AND x.el_id <> y.el_id GROUP BY 1, 2, 3")
def enclosure_counts_all(spark, sf):
    """With all rectangles as envelopes; enclosure_counts, whose SQL is fixed, takes every third."""
    r = rects(spark, sf)
    return boxes.shared_envelopes(boxes.enclosed(r, r)).drop("metric")


@query(f"WITH {R} SELECT page_id, el_id, least(r - l, b - t) <= 40 AND greatest(r - l, b - t) >= 1.5 * least(r - l, b - t) AS ui, greatest(r - l, b - t) <= 48 AND greatest(r - l, b - t) <= 1.5 * least(r - l, b - t) AS icon, CASE WHEN (r - l) * (b - t) <= 4500 THEN 'primitive' ELSE 'standalone' END AS iframe, 1440 * 900 * 0.8 > (r - l) * (b - t) AS widget FROM r")
def box_kinds(spark, sf):
    w, h = F.col("r") - F.col("l"), F.col("b") - F.col("t")
    return rects(spark, sf).select("page_id", "el_id", G.is_ui(w, h).alias("ui"), G.is_icon(w, h).alias("icon"), G.iframe_kind(w, h).alias("iframe"), G.is_widget(w * h, F.lit(1440 * 900)).alias("widget"))


@query(f"WITH {R} SELECT page_id, el_id, round(l, 6) AS l, round(greatest(t, 50), 6) AS t, round(greatest(least(r, 700), l), 6) AS r, round(greatest(least(b, 300), greatest(t, 50)), 6) AS b FROM (SELECT page_id, el_id, greatest(l, 100) AS l, t, r, b FROM r)")
def box_clip(spark, sf):
    made = G.clip({k: F.col(k) for k in "ltrb"}, {"l": F.lit(100.0), "t": F.lit(50.0), "r": F.lit(700.0), "b": F.lit(300.0)})
    return rects(spark, sf).select("page_id", "el_id", *[F.round(v, 6).alias(k) for k, v in made.items()])


@query(f"""WITH {R}, s AS (SELECT page_id, el_id, (l - 20) / 2 AS l, t - 2 AS t, r * 1.5 AS r, b + 500 AS b FROM r)
    SELECT page_id, el_id, CASE WHEN (r - l > 1296 AND b - t > 405) OR (r - l > 648 AND b - t > 810) THEN NULL
    WHEN r - l > 1296 AND t < 5 AND t > -5 THEN 'top' WHEN r - l > 1296 AND b < 905 AND b > 895 THEN 'bottom'
    WHEN b - t > 810 AND l < 5 AND l > -5 THEN 'left' WHEN b - t > 810 AND r < 1445 AND r > 1435 THEN 'right' END AS bar FROM s""")
def box_sticky_bar(spark, sf):
    box = {"l": (F.col("l") - 20) / 2, "t": F.col("t") - 2, "r": F.col("r") * 1.5, "b": F.col("b") + 500}
    return rects(spark, sf).select("page_id", "el_id", G.sticky_bar(box).alias("bar"))


def _samples_sql() -> str:
    parts = []
    for lo, hi, o1, o2, flip in (("l", "r", "t", "b", False), ("t", "b", "l", "r", True)):
        along, across = f"floor({lo} - s / n / 2 + i * s / n + 0.5)", "floor(o + 0.5)"
        x, y = (across, along) if flip else (along, across)
        parts.append(f"SELECT page_id, el_id, {x} AS x, {y} AS y FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM (SELECT *, unnest([{o1} - 2, {o1} - 5, {o2} + 2, {o2} + 5]) AS o FROM (SELECT *, {hi} - {lo} AS s, CAST(CASE WHEN {hi} - {lo} < 20 THEN greatest(1, floor(({hi} - {lo}) / 5)) ELSE 4 END AS INT) AS n FROM r)))")
    return f"WITH {R}, q AS ({' UNION ALL '.join(parts)}) SELECT page_id, el_id, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM q WHERE x >= 0 AND x < 1440 AND y >= 0 AND y < 900"


@query(_samples_sql())
def outside_samples(spark, sf):
    return boxes.outside_samples(rects(spark, sf), 1440, 900)


@query()
def flex_space(spark, sf):
    r = rects(spark, sf)
    c = boxes.bounding_union(r, "page_id").select("page_id", F.lit(0).cast("long").alias("box_id"), *[F.col(k).alias(f"c_{k}") for k in "ltrb"])
    return boxes.flex_space(r.join(c, "page_id"))


# Matrices and clusters


def measures() -> dict[str, Column]:
    """Of a pair of rectangles."""
    x, y = boxes._axes(G.gap)
    return {"dist_html_sum": F.abs(F.col("a_id") - F.col("b_id")).cast("double"), "dist_spat_l2": G.merge(x, y, "l2"), "sim_spatConnect_gauss": boxes.connected()}


def matrices(spark, sf, envelopes="true", mods=True):
    """Spatial, connectedness and enclosure matrices of rectangles, and element distance as an HTML stand-in; one join gives all of a pair."""
    r = rects(spark, sf)
    pair = boxes.pairs(r)
    cells = F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in measures().items()])
    made = pair.select("page_id", "a_id", "b_id", F.explode(cells).alias("x")).select("page_id", "x.metric", "a_id", "b_id", "x.value")
    return made.unionByName(boxes.shared_envelopes(boxes.enclosed(r, r.where(envelopes)))) if mods else made


CONN = f"greatest(ox * {FADE.format('gy')} + oy * {FADE.format('gx')}, qx * {FADE.format('gy')} + qy * {FADE.format('gx')})"
NORM = f"""{PAIRS}, m AS (SELECT page_id, a_id, b_id, CAST(abs(a_id - b_id) AS DOUBLE) AS h, sqrt(pow(greatest(gx, 0), 2) + pow(greatest(gy, 0), 2)) AS s, {CONN} AS c FROM p),
    n AS (SELECT page_id, a_id, b_id, CASE WHEN max(h) OVER w = 0 THEN 0 ELSE h / max(h) OVER w END AS h, CASE WHEN max(s) OVER w = 0 THEN 0 ELSE s / max(s) OVER w END AS s, 1 - CASE WHEN max(c) OVER w = 0 THEN 0 ELSE c / max(c) OVER w END AS c FROM m WINDOW w AS (PARTITION BY page_id))"""


@query(f"WITH {NORM} SELECT page_id, 'dist_html_sum' AS metric, a_id, b_id, round(h, 6) AS value FROM n UNION ALL SELECT page_id, 'dist_spat_l2', a_id, b_id, round(s, 6) FROM n UNION ALL SELECT page_id, 'sim_spatConnect_gauss', a_id, b_id, round(c, 6) FROM n")
def matrix_normalise(spark, sf):
    return rounded(clusters.normalised(matrices(spark, sf, mods=False)), "value")


@query(f"WITH {NORM} SELECT page_id, a_id, b_id, round((h + 0.5 * s) / 1.5, 6) AS html_spat, round((h + 0.5 * c) / 1.5, 6) AS html_conn FROM n")
def matrix_combine(spark, sf):
    n = clusters.normalised(matrices(spark, sf, mods=False))
    value = lambda p: F.max(F.when(F.col("metric") == p, F.col("value")))
    g = n.groupBy("page_id", "a_id", "b_id").agg(*[((value("dist_html_sum") + 0.5 * value(p)) / 1.5).alias(k) for k, p in (("html_spat", "dist_spat_l2"), ("html_conn", "sim_spatConnect_gauss"))])
    return rounded(g, "html_spat", "html_conn")


@query(f"WITH {NORM}, i AS ({ENC.split('i AS (', 1)[1]}, e AS (SELECT x.page_id, x.el_id AS a_id, y.el_id AS b_id, count(*) + 1 AS k FROM i x JOIN i y ON x.page_id = y.page_id AND x.env_id = y.env_id AND x.el_id <> y.el_id GROUP BY 1, 2, 3) SELECT page_id, a_id, b_id, round(h / coalesce(k, 1), 6) AS value FROM n LEFT JOIN e USING (page_id, a_id, b_id)")
def matrix_modify(spark, sf):
    n = clusters.normalised(matrices(spark, sf, "el_id % 3 = 0"))  # as its SQL has it
    mod = F.startswith("metric", F.lit("mod_"))
    return rounded(clusters.modified(n.where(F.col("metric") == "dist_html_sum"), n.where(mod)), "value").drop("metric")


@query()
def matrix_clusters(spark, sf):
    """The five methods that the export keeps, clustered."""
    pair = boxes.page_pairs(rects(spark, sf), least=3)
    return clusters.cluster_pages(pair.select("page_id", "a_id", "b_id", *[v.alias(k) for k, v in measures().items()], boxes.encloses("b_", "a_").alias("mod_bgAndBrd")))


# Trees


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<a href=\"([^\"]*)\"')) AS BIGINT) AS n_links, CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT) AS n_items FROM pages")
def dom_counts(spark, sf):
    e = elements(spark, sf).groupBy("page_id").agg(F.count_if((F.col("tag") == "a") & F.col("attrs")["href"].isNotNull()).alias("n_links"), F.count_if(F.col("tag") == "li").alias("n_items"))
    return read(spark, sf, "pages").select("page_id").join(e, "page_id", "left").na.fill(0)


ROOT = "regexp_extract(url, '^\\w+://[^/?#]+')"


@query(f"SELECT page_id, CASE WHEN u LIKE '/%' THEN {ROOT} || u ELSE u END AS href, CAST(count(*) AS BIGINT) AS n, false AS external FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS u FROM pages) GROUP BY 1, 2")
def links(spark, sf):
    made = dom.links(elements(spark, sf), read(spark, sf, "pages"))
    return made.groupBy("page_id", "href").agg(F.count("*").alias("n"), F.bool_or("external").alias("external"))


@query("WITH h AS (SELECT page_id, (CASE WHEN contains(html, '<body>') THEN 1 ELSE 0 END) AS k FROM pages) SELECT page_id, CAST(k AS BIGINT) AS n FROM h")
def dom_bodies(spark, sf):
    e = elements(spark, sf).where("tag = 'body'").groupBy("page_id").agg(F.count("*").alias("n"))
    return read(spark, sf, "pages").select("page_id").join(e, "page_id", "left").na.fill(0)


@query()
def dom_elements(spark, sf):
    return elements(spark, sf)


@query()
def dom_closure(spark, sf):
    return dom.closure(elements(spark, sf))


@query()
def dom_outermost(spark, sf):
    return dom.outermost(elements(spark, sf).where(F.col("tag").isin(*dom.BLOCKS))).select("page_id", "el_id", "tag")


@query()
def dom_innermost(spark, sf):
    return dom.innermost(elements(spark, sf).where(F.col("tag").isin(*dom.BLOCKS))).select("page_id", "el_id", "tag")


@query()
def dom_members(spark, sf):
    e = held(spark, sf)
    return dom.members(e.where(F.col("tag").isin("nav", "article", "footer")).withColumn("group_id", F.col("el_id")), dom.with_text(e))


@query()
def dom_nearest_block(spark, sf):
    e = held(spark, sf)
    return dom.nearest_ancestor(e, e.where(F.col("tag").isin(*dom.BLOCKS)))


@query()
def dom_html_distance(spark, sf):
    return dom.html_distance(held(spark, sf))


@query()
def dom_inner_text(spark, sf):
    return dom.inner_text(elements(spark, sf).where(~F.col("tag").isin("script", "style")))


@query()
def dom_paragraphs(spark, sf):
    return dom.paragraphs(held(spark, sf))


@query()
def dom_icons(spark, sf):
    return dom.icons(elements(spark, sf))


@query()
def dom_controls(spark, sf):
    return dom.native_controls(elements(spark, sf)).select("page_id", "el_id", "tag")


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<style>')) AS BIGINT) AS n FROM pages")
def css_selectors(spark, sf):
    s = html.style_selectors(read(spark, sf, "pages")).groupBy("page_id").agg(F.count("*").alias("n"))
    return read(spark, sf, "pages").select("page_id").join(s, "page_id", "left").na.fill(0)


@query()
def dom_clusters_with_roots(spark, sf):
    """HTML distances of text elements, clustered, with the root of each cluster."""
    e = held(spark, sf)
    t = dom.with_text(e).select("page_id", "el_id")
    pair = dom.html_distance(e)
    both = pair.join(t.withColumnRenamed("el_id", "a_id"), ["page_id", "a_id"], "left_semi").join(t.withColumnRenamed("el_id", "b_id"), ["page_id", "b_id"], "left_semi")
    labels = clusters.cluster(clusters.normalised(both))
    areas = snapshots.from_elements(e).select("page_id", "el_id", ((F.col("r") - F.col("l")) * (F.col("b") - F.col("t"))).alias("area"))
    labels = written(labels, "labels")
    return clusters.groups(labels, clusters.roots(clusters.ladders(labels, e), areas))


@query("SELECT n_regionkey AS ord, n_name AS line FROM nation WHERE false UNION ALL SELECT 1099511627776 - n_nationkey, n_name || chr(9) || n_regionkey FROM nation UNION ALL SELECT -1, 'n_name' || chr(9) || 'n_regionkey'")
def tsv_export(spark, sf):
    return tables.tsv_lines(read(spark, sf, "nation").select(F.col("n_nationkey").cast("long"), "n_name", "n_regionkey"), "n_nationkey")


# Trees and snapshots derived from tables, so that SQL can say what is right

TAGS = ("div", "p", "a", "input", "img", "form", "section", "span", "button", "svg", "li", "nav")
#: A page is an order. Its elements, in the order of its lines, are a heap: element k stands in element (k - 1) // 2, the first in none.
TREE = f"""t AS (SELECT page_id, el_id - 1 AS el_id, CASE WHEN el_id > 1 THEN CAST(floor((el_id - 2) / 2) AS INT) END AS parent_id,
    [{', '.join(f"'{t}'" for t in TAGS)}][1 + (page_id * 7 + el_id * el_id * 5) % {len(TAGS)}] AS tag,
    CASE WHEN (page_id + el_id) % 3 = 0 THEN 'Text ' || el_id || '.' ELSE '' END AS txt, l, t AS top, r, b, page_id % 5 AS m,
    ['static', 'relative', 'absolute', 'fixed', 'sticky'][1 + (page_id + el_id * 3) % 5] AS position, 4.0 * ((page_id + el_id) % 6) AS font_size,
    (page_id + el_id) % 4 = 0 AS pictured, (page_id * 3 + el_id) % 11 = 0 AS faint FROM r)"""
#: up: every element with each of its ancestors, itself included.
UP = f"""{R}, {TREE}, up AS (SELECT page_id, el_id, el_id AS anc_id, 0 AS dist, parent_id AS nxt FROM t
    UNION ALL SELECT u.page_id, u.el_id, t.el_id, u.dist + 1, t.parent_id FROM up u JOIN t ON t.page_id = u.page_id AND t.el_id = u.nxt)"""
WITH_UP = f"WITH RECURSIVE {UP}"
BLOCK_TAGS = "('div', 'p', 'form', 'section', 'li', 'nav')"
HAS_TEXT = "txt <> '' AND tag NOT IN ('button')"
MAX_SIDE, MIN_SIDE = "greatest(r - l, b - top)", "least(r - l, b - top)"
UI = f"({MIN_SIDE} <= CASE WHEN real THEN {int(G.UI_SIDE_REAL)} ELSE {int(G.UI_SIDE)} END AND {MAX_SIDE} >= 1.5 * {MIN_SIDE})"
ICON = f"({MAX_SIDE} <= CASE WHEN real THEN {int(G.ICON_SIDE_REAL)} ELSE {int(G.ICON_SIDE)} END AND {MAX_SIDE} <= 1.5 * {MIN_SIDE})"


def tree(spark, sf) -> DataFrame:
    """Snapshot rows of the heaps, with pre and post left out: paths are made from the parents."""
    r = rects(spark, sf)
    p, k = F.col("page_id"), F.col("el_id")
    pick = lambda names, at: F.element_at(F.array(*[F.lit(x) for x in names]), (1 + at % len(names)).cast("int"))
    k0 = r.select("page_id", (k - 1).alias("el_id"), F.when(k > 1, F.floor((k - 2) / 2).cast("int")).alias("parent_id"), *"ltrb")
    k = F.col("el_id") + 1
    made = dom.paths(k0).select(
        "page_id", "el_id", "parent_id", "path", pick(TAGS, p * 7 + k * k * 5).alias("tag"),
        F.array(F.when((p + k) % 3 == 0, F.concat(F.lit("Text "), k.cast("string"), F.lit("."))).otherwise("")).alias("own_text"), F.lit(None).cast("map<string,string>").alias("attrs"),
        "l", "t", "r", "b", pick(("static", "relative", "absolute", "fixed", "sticky"), p + k * 3).alias("position"), (4.0 * ((p + k) % 6)).alias("font_size"),
        F.when((p + k) % 4 == 0, F.lit("url(x.png)")).alias("bg_image"), F.when((p * 3 + k) % 11 == 0, 0.05).otherwise(1.0).alias("opacity"), (k - 1).alias("pre"),
        F.array(*[F.lit(0.0)] * 3).alias("color"), F.lit("auto").alias("cursor"), F.lit("visible").alias("visibility"), F.lit("block").alias("display"), F.lit(1440.0).alias("doc_width"), F.lit(900.0).alias("doc_height"),
    )
    return written(made.withColumn("depth", F.floor(F.log2(F.col("el_id") + 1)).cast("int")), "tree")


@query(f"{WITH_UP} SELECT page_id, anc_id, el_id AS desc_id, dist FROM up")
def tree_closure(spark, sf):
    return dom.closure(tree(spark, sf))


@query(f"{WITH_UP} SELECT page_id, el_id FROM t WHERE tag IN {BLOCK_TAGS} AND NOT EXISTS (SELECT 1 FROM up u JOIN t x ON x.page_id = u.page_id AND x.el_id = u.anc_id WHERE u.page_id = t.page_id AND u.el_id = t.el_id AND u.dist > 0 AND x.tag IN {BLOCK_TAGS})")
def tree_outermost(spark, sf):
    return dom.outermost(tree(spark, sf).where(F.col("tag").isin(*dom.BLOCKS))).select("page_id", "el_id")


@query(f"{WITH_UP} SELECT page_id, el_id FROM t WHERE tag IN {BLOCK_TAGS} AND NOT EXISTS (SELECT 1 FROM up u JOIN t x ON x.page_id = u.page_id AND x.el_id = u.el_id WHERE u.page_id = t.page_id AND u.anc_id = t.el_id AND u.dist > 0 AND x.tag IN {BLOCK_TAGS})")
def tree_innermost(spark, sf):
    return dom.innermost(tree(spark, sf).where(F.col("tag").isin(*dom.BLOCKS))).select("page_id", "el_id")


@query(f"{WITH_UP} SELECT u.page_id, u.anc_id AS group_id, u.el_id FROM up u JOIN t g ON g.page_id = u.page_id AND g.el_id = u.anc_id JOIN t e ON e.page_id = u.page_id AND e.el_id = u.el_id WHERE g.tag IN ('nav', 'form') AND {HAS_TEXT.replace('txt', 'e.txt').replace('tag', 'e.tag')}")
def tree_members(spark, sf):
    e = tree(spark, sf)
    return dom.members(e.where("tag in ('nav', 'form')").withColumn("group_id", F.col("el_id")), dom.with_text(e))


@query(f"{WITH_UP} SELECT u.page_id, u.el_id, arg_min(u.anc_id, u.dist) AS anc_id, min(u.dist) AS dist FROM up u JOIN t x ON x.page_id = u.page_id AND x.el_id = u.anc_id WHERE u.dist > 0 AND x.tag IN {BLOCK_TAGS} GROUP BY 1, 2")
def tree_nearest_block(spark, sf):
    e = tree(spark, sf)
    return dom.nearest_ancestor(e, e.where(F.col("tag").isin(*dom.BLOCKS)))


@query(f"{WITH_UP} SELECT x.page_id, x.el_id AS a_id, y.el_id AS b_id, CAST(min(x.dist + y.dist) AS DOUBLE) AS value FROM up x JOIN up y ON x.page_id = y.page_id AND x.anc_id = y.anc_id AND x.el_id <> y.el_id GROUP BY 1, 2, 3")
def tree_html_distance(spark, sf):
    return dom.html_distance(tree(spark, sf)).drop("metric")


@query(f"{WITH_UP} SELECT x.page_id, x.el_id AS a_id, y.el_id AS b_id, arg_min(x.anc_id, x.dist) AS lca_id FROM up x JOIN up y ON x.page_id = y.page_id AND x.anc_id = y.anc_id AND x.el_id < y.el_id GROUP BY 1, 2, 3")
def tree_common_ancestor(spark, sf):
    e = tree(spark, sf)
    a, b = (e.select("page_id", F.col("el_id").alias(f"{k}_id")) for k in "ab")
    return dom.common_ancestor(a.join(b, "page_id").where("a_id < b_id"), e).select("page_id", "a_id", "b_id", "lca_id")


@query(f"{WITH_UP} SELECT u.page_id, u.anc_id AS el_id, string_agg(e.txt, '' ORDER BY e.el_id) AS text FROM up u JOIN t e ON e.page_id = u.page_id AND e.el_id = u.el_id WHERE {HAS_TEXT.replace('txt', 'e.txt').replace('tag', 'e.tag')} GROUP BY 1, 2")
def tree_inner_text(spark, sf):
    return dom.inner_text(tree(spark, sf))


@query(f"{WITH_UP}, n AS (SELECT u.page_id, u.el_id, arg_min(u.anc_id, u.dist) AS anc_id FROM up u JOIN t x ON x.page_id = u.page_id AND x.el_id = u.anc_id WHERE x.tag IN {BLOCK_TAGS} GROUP BY 1, 2) SELECT n.page_id, n.anc_id AS el_id, count(*) AS n_texts, string_agg(e.txt, '' ORDER BY e.el_id) AS text FROM n JOIN t e ON e.page_id = n.page_id AND e.el_id = n.el_id WHERE {HAS_TEXT.replace('txt', 'e.txt').replace('tag', 'e.tag')} GROUP BY 1, 2")
def tree_paragraphs(spark, sf):
    return dom.paragraphs(tree(spark, sf))


@query(f"WITH {R}, {TREE} SELECT page_id, el_id, tag FROM t WHERE tag IN ('input', 'button')")
def tree_controls(spark, sf):
    return dom.native_controls(tree(spark, sf)).select("page_id", "el_id", "tag")


@query(f"{WITH_UP} SELECT page_id, el_id FROM t WHERE NOT EXISTS (SELECT 1 FROM up u JOIN t x ON x.page_id = u.page_id AND x.el_id = u.anc_id WHERE u.page_id = t.page_id AND u.el_id = t.el_id AND x.tag IN ('form', 'nav'))")
def tree_by_tag(spark, sf):
    """Elements that stand in neither form nor nav (F5, inverse)."""
    e = tree(spark, sf)
    return dom.by_tag(e, ("form", "nav"), inverse=True, ancestors=e).select("page_id", "el_id")


@query(f"""WITH {R}, {TREE}, g AS (SELECT *, tag IN ('img', 'svg') AS real FROM t WHERE tag IN ('img', 'svg') OR pictured)
    SELECT page_id, el_id, tag, CASE WHEN real THEN '' ELSE 'bg.' END || CASE WHEN {UI} THEN 'ui' WHEN {ICON} THEN 'icon' ELSE 'main' END AS kind FROM g""")
def tree_graphics(spark, sf):
    return snapshot.graphics(tree(spark, sf)).select("page_id", "el_id", "tag", "kind")


@query(f"WITH {R}, {TREE} SELECT page_id, el_id, tag FROM t WHERE position <> 'static'")
def tree_positioned(spark, sf):
    return snapshot.positioned(tree(spark, sf)).select("page_id", "el_id", "tag")


@query(f"WITH {R}, {TREE} SELECT page_id, el_id FROM t WHERE {HAS_TEXT} AND font_size > 3")
def tree_visible_text(spark, sf):
    return snapshot.visible_text(tree(spark, sf)).select("page_id", "el_id")


@query(f"WITH {R}, {TREE}, g AS (SELECT * FROM t WHERE tag IN ('img', 'svg') OR pictured) SELECT page_id, coalesce(string_agg(el_id, '__' ORDER BY CAST(el_id AS VARCHAR)) FILTER (WHERE r - l >= 100 AND b - top >= 60), '') AS window_ids, coalesce(string_agg(el_id, '__' ORDER BY CAST(el_id AS VARCHAR)) FILTER (WHERE r - l >= 1440 AND b - top >= 900), '') AS document_ids FROM g GROUP BY 1")
def tree_full_window(spark, sf):
    """Graphics as large as a window of 100 by 60, as no rectangle of these is larger."""
    return snapshot.full_window(tree(spark, sf), 100, 60)


@query(f"""WITH {R}, {TREE}, s AS (SELECT page_id, el_id, position, (l - 20) / 2 AS l, top - 2 AS t, r * 2 AS r, b FROM t)
    SELECT page_id, el_id, location FROM (SELECT *, CASE WHEN (r - l > 1296 AND b - t > 405) OR (r - l > 648 AND b - t > 810) THEN NULL
    WHEN r - l > 1296 AND t < 5 AND t > -5 THEN 'top' WHEN r - l > 1296 AND b < 905 AND b > 895 THEN 'bottom'
    WHEN b - t > 810 AND l < 5 AND l > -5 THEN 'left' WHEN b - t > 810 AND r < 1445 AND r > 1435 THEN 'right' END AS location FROM s WHERE position IN ('fixed', 'sticky')) WHERE location IS NOT NULL""")
def tree_fixed_areas(spark, sf):
    e = tree(spark, sf).withColumns({"l": (F.col("l") - 20) / 2, "t": F.col("t") - 2, "r": F.col("r") * 2})
    return groups.fixed_areas(e).select("page_id", "el_id", "location")


SVG = "EXISTS (SELECT 1 FROM up u JOIN t x ON x.page_id = u.page_id AND x.el_id = u.anc_id WHERE u.page_id = t.page_id AND u.el_id = t.el_id AND (u.dist > 0 AND x.tag = 'svg' OR x.faint))"


@query(f"{WITH_UP} SELECT page_id, el_id FROM t WHERE (greatest(least(r, 1440), l) - l) * (greatest(least(b, 900), top) - top) > 2 AND greatest(least(r, 1440), l) - l >= 1 AND greatest(least(b, 900), top) - top >= 1 AND NOT {SVG}")
def tree_visible(spark, sf):
    """Without clipping ancestors but with transparent ones and those in svg (F1)."""
    return snapshot.visible(tree(spark, sf).withColumn("overflow", F.lit("visible"))).select("page_id", "el_id")


ZED = "CASE WHEN (page_id + el_id) % 4 = 0 THEN NULL ELSE (page_id * 5 + el_id) % 3 END"


#: Of every element its path and the positions there of positioned ones with their z-indexes.
STACK = f"""z AS (SELECT page_id, el_id, coalesce({ZED}, 0) AS z FROM t WHERE position <> 'static'), n AS (SELECT page_id, el_id, count(*) AS n, list(anc_id ORDER BY dist DESC) AS path FROM up GROUP BY 1, 2),
    s AS (SELECT n.page_id, n.el_id, any_value(n.path) AS path, list({{'d': n.n - u.dist - 1, 'z': z.z}} ORDER BY u.dist DESC) FILTER (z.z IS NOT NULL) AS zs
        FROM n JOIN up u ON u.page_id = n.page_id AND u.el_id = n.el_id LEFT JOIN z ON z.page_id = u.page_id AND z.el_id = u.anc_id GROUP BY 1, 2)"""
FIRST = "coalesce(list_filter(coalesce({0}.zs, []), lambda i: i.d >= len(list_intersect(x.path, y.path)))[1].z, 0)"


@query(f"""{WITH_UP}, {STACK}, m AS (SELECT x.page_id, x.el_id AS a_id, y.el_id AS b_id, {FIRST.format('x')} AS za, {FIRST.format('y')} AS zb FROM s x JOIN s y ON x.page_id = y.page_id AND x.el_id <> y.el_id)
    SELECT page_id, a_id, b_id, za > zb OR (za = zb AND a_id > b_id) AS above FROM m""")
def tree_stacking(spark, sf):
    p, k = F.col("page_id"), F.col("el_id") + 0
    e = tree(spark, sf).withColumn("z_index", F.when((p + k) % 4 != 0, ((p * 5 + k) % 3).cast("int")))
    a, b = (e.select("page_id", F.col("el_id").alias(f"{x}_id")) for x in "ab")
    return frames.is_above(a.join(b, "page_id").where("a_id <> b_id"), e)


@query(f"""{WITH_UP}, o AS (SELECT *, b * 4 - 900 <= 0 OR r * 2 - 900 <= 0 OR top * 4 - 900 >= 900 OR l * 2 - 900 >= 1440 AS out FROM t)
    SELECT page_id, el_id FROM o WHERE out AND EXISTS (SELECT 1 FROM up u JOIN o x ON x.page_id = u.page_id AND x.el_id = u.anc_id WHERE u.page_id = o.page_id AND u.el_id = o.el_id AND x.position = 'fixed' AND x.out)""")
def tree_outside_viewport(spark, sf):
    e = tree(spark, sf)
    return frames.outside_viewport(e.withColumns({"l": F.col("l") * 2 - 900, "r": F.col("r") * 2 - 900, "t": F.col("t") * 4 - 900, "b": F.col("b") * 4 - 900}))


@query(f"""{WITH_UP} SELECT page_id, el_id, CASE WHEN m IN (0, 1) THEN 'glyph' ELSE 'img' END AS kind, CASE WHEN m = 0 THEN 'before' ELSE 'after' END AS place FROM t WHERE m < 3 AND NOT ({HAS_TEXT})
    AND NOT EXISTS (SELECT 1 FROM t k WHERE k.page_id = t.page_id AND k.parent_id = t.el_id)
    AND NOT EXISTS (SELECT 1 FROM up u JOIN t x ON x.page_id = u.page_id AND x.el_id = u.anc_id WHERE u.page_id = t.page_id AND u.el_id = t.el_id AND x.tag IN ('input', 'img', 'button', 'svg'))""")
def tree_pseudo_icons(spark, sf):
    m = F.col("page_id") % 5
    e = tree(spark, sf).withColumns({"before_content": F.when(m == 0, F.lit('"\u2192"')).otherwise("none"), "after_content": F.when(m == 1, F.lit('"\u2192"')).when(m == 2, "url(x.png)").otherwise('"long"')})
    return frames.pseudo_icons(e)


@query(f"WITH RECURSIVE {R}, {TREE}, f AS (SELECT page_id, el_id AS frame_id, l, top AS t, 0 AS depth FROM t WHERE parent_id IS NULL UNION ALL SELECT t.page_id, t.el_id, t.l + f.l, t.top + f.t, f.depth + 1 FROM t JOIN f ON f.page_id = t.page_id AND f.frame_id = t.parent_id) SELECT page_id, frame_id, round(l, 4) AS l, round(t, 4) AS t, depth FROM f")
def frame_offsets(spark, sf):
    made = frames.absolute_frames(tree(spark, sf).select("page_id", F.col("el_id").alias("frame_id"), "parent_id", "l", "t"))
    return made.withColumns({c: F.round(c, 4) for c in "lt"})


@query(f"WITH {R} SELECT page_id, arg_min(el_id, struct_pack(x := t, y := el_id)) AS top_id, arg_max(el_id, struct_pack(x := b, y := -el_id)) AS bottom_id FROM r GROUP BY 1")
def topmost_elements(spark, sf):
    return frames.topmost(rects(spark, sf), "page_id")


@query(f"WITH c AS ({RGB.format(lineitem='lineitem')}) SELECT l_orderkey AS page_id, l_linenumber AS el_id, round(avg(r1), 6) AS red, round(avg(g1), 6) AS green, round(avg(b1), 6) AS blue FROM c GROUP BY 1, 2")
def sampled_colors(spark, sf):
    made = frames.sampled_average(colors(spark, sf).select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("el_id"), F.col("one").alias("rgb")))
    return made.select("page_id", "el_id", *[F.round(F.get("color", k), 6).alias(n) for k, n in enumerate(("red", "green", "blue"))])


@query(f"WITH c AS ({RGB.format(lineitem='lineitem')}) SELECT {KEY}, CASE WHEN l_linenumber / 5.0 < 0.9 OR l_partkey % 3 = 0 THEN r2 ELSE r1 END AS red FROM c")
def element_background(spark, sf):
    css = F.array("r1", "g1", "b1", F.col("l_linenumber") / 5)
    made = ST.background(css, F.when(F.col("l_partkey") % 3 == 0, "url(x)").otherwise("none"), F.col("two"))
    return colors(spark, sf).select(*KEY.split(", "), F.get(made, 0).alias("red"))


@query("""SELECT p_partkey, p_size * 20 <= 300 AS thin, p_size * 20 >= 500 AS bold, p_size % 3 > 0 AS italic, p_size % 2 = 1 AS underline,
    CASE WHEN p_size % 4 = 0 THEN 0 ELSE (p_size + 10 - p_size / 2.0) / 2 END AS gap, CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size / 10.0 END AS spacing,
    CASE WHEN p_size % 3 = 0 THEN 'center' WHEN (p_size % 3 = 1) = (p_size % 2 = 0) THEN 'left' ELSE 'right' END AS align FROM part""")
def text_styles(spark, sf):
    p, s = read(spark, sf, "part"), F.col("p_size")
    flags = ST.font_flags(s * 20, F.when(s % 3 == 0, "normal").when(s % 3 == 1, "italic").otherwise("oblique"), F.when(s % 2 == 1, "underline").otherwise("none"))
    gap = ST.line_gap(F.when(s % 4 == 0, "normal").otherwise(F.concat((s + 10).cast("string"), F.lit("px"))), s / 2)
    spacing = ST.letter_spacing(F.when(s % 5 == 0, "normal").otherwise(F.concat((s / 10).cast("string"), F.lit("px"))))
    align = ST.alignment(F.when(s % 3 == 0, "center").when(s % 3 == 1, "start").otherwise("end"), F.when(s % 2 == 0, "ltr").otherwise("rtl"))
    return p.select("p_partkey", *[v.alias(k) for k, v in flags.items()], gap.alias("gap"), spacing.alias("spacing"), align.alias("align"))


@query("""SELECT p_partkey, 'old_name=' || p_name AS prefixed, CASE WHEN p_size % 2 = 0 THEN 'size' ELSE 'name,size' END AS kept, 'size=' || p_size || ',none=' AS picked,
    length(regexp_replace(p_name, '[^0-9]', '', 'g')) AS digits, length(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) AS letters, length(regexp_replace(p_name, '[^A-Z]', '', 'g')) AS capitals FROM part""")
def map_helpers(spark, sf):
    p, size = read(spark, sf, "part"), F.col("p_size").cast("string")
    one = F.create_map(F.lit("name"), F.col("p_name"), F.lit("size"), size)
    two = F.create_map(F.lit("name"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("x"))
    shown = lambda m: F.array_join(F.transform(F.map_entries(m), lambda x: F.concat(x["key"], F.lit("="), F.coalesce(x["value"], F.lit("")))), ",")
    kinds = [v.cast("long").alias(k) for k, v in ST.character_kinds(F.col("p_name")).items()]
    name = F.create_map(F.lit("name"), F.col("p_name"))
    return p.select("p_partkey", shown(ST.with_prefix(name, "old_")).alias("prefixed"), F.array_join(F.map_keys(ST.without_equal(one, two)), ",").alias("kept"), shown(ST.picked(one, ["size", "none"])).alias("picked"), *kinds)


BOXES = f"x AS (SELECT page_id, el_id, l, t, r, b, (el_id % 3) * 2.0 AS p, el_id % 2 * 1.0 AS w, (el_id % 4) * 3.0 AS m FROM r), y AS (SELECT *, l + p + w AS i_l, t + p + w AS i_t, greatest(l + p + w, r - p - w) AS i_r, greatest(t + p + w, b - p - w) AS i_b, l - m AS o_l, t - m AS o_t, r + m AS o_r, b + m AS o_b FROM x)"


def nested_boxes(spark, sf):
    k = F.col("el_id")
    sides = lambda v: F.array(*[v.cast("double")] * 4)
    return boxes.inner_outer(rects(spark, sf).withColumns({"paddings": sides(k % 3 * 2.0), "borders": sides(k % 2 * 1.0), "margins": sides(k % 4 * 3.0)}))


@query(f"WITH {R}, {BOXES} SELECT page_id, el_id, {', '.join(f'round({p}_{k}, 6) AS {p}_{k}' for p in 'io' for k in 'ltrb')} FROM y")
def box_inner_outer(spark, sf):
    cols = [f"{p}_{k}" for p in "io" for k in "ltrb"]
    return nested_boxes(spark, sf).select("page_id", "el_id", *[F.round(c, 6).alias(c) for c in cols])


@query(f"WITH {R}, {BOXES} SELECT page_id, round(sum(greatest((o_r - o_l) * (o_b - o_t) - (i_r - i_l) * (i_b - i_t), 0)), 4) AS space FROM y GROUP BY 1")
def padding_margin_space(spark, sf):
    return boxes.padding_margin_space(nested_boxes(spark, sf), "page_id").select("page_id", F.round("space", 4).alias("space"))


@query(f"WITH {R}, {BOXES}, s AS (SELECT page_id, sum(greatest((o_r - o_l) * (o_b - o_t) - (i_r - i_l) * (i_b - i_t), 0)) AS space FROM y GROUP BY 1 UNION ALL SELECT page_id, sum(2 * greatest(0, (b - t - 30) / 2) * (r - l)) FROM r GROUP BY 1) SELECT page_id, round(sum(space), 4) AS space FROM s GROUP BY 1")
def useful_white_space(spark, sf):
    """Paddings, margins and space around text together (A5); these groups have no flex containers."""
    n = nested_boxes(spark, sf).withColumn("group_id", F.lit(0))
    x = rects(spark, sf).select("page_id", F.lit(0).alias("group_id"), (F.col("b") - F.col("t")).alias("line_height"), F.lit(30.0).alias("font_size"), (F.col("r") - F.col("l")).alias("width"), F.lit(1).alias("n_words"), F.lit(1).alias("n_chars"), F.lit(2.0).alias("word_spacing"), F.lit(0.5).alias("letter_spacing"))
    text = groups.text_white_space(x)
    made = boxes.useful_white_space(boxes.padding_margin_space(n, "page_id", "group_id"), text.limit(0), text)
    return made.select("page_id", F.round("space", 4).alias("space"))


# Snapshots and semantic groups (on the stand-in layout)


#: Pages whose parts follow from the part's number k: what is on a page, and where.
SITE = {
    "header": ("k % 2 = 0", "<div data-box='0,0,1440,100'><a href='/' data-box='5,5,80,60'><img data-box='5,5,80,60'></a></div>"),
    "menu": ("k % 3 <> 0", "<nav data-box='0,110,1440,140'><ul>" + "".join(f"<li><a href='/p{x}' data-box='{100 * x},112,{100 * x + 80},130'>item {x}</a></li>" for x in range(4)) + "</ul></nav>"),
    "text": ("true", "<article data-box='0,150,1440,800'><h2 data-font='30' data-box='10,160,900,200'>The title of it</h2><p data-box='10,210,900,230'>A sentence that is long enough to count here.</p><p data-box='10,240,900,260'>And a second one that is long enough to count.</p><p data-box='0,400,300,440'>And a third one that may have something over it.</p></article>"),
    "banner": ("k % 4 = 0", "<section data-box='0,500,1440,850'><img data-box='0,500,800,800'><img data-hidden='1' data-box='0,500,800,800'></section>"),
    "form": ("k % 5 = 0", "<form data-box='10,900,300,1000'>Search the site<input type='text' data-box='20,910,200,930'><button data-box='210,910,280,930'>go</button></form>"),
    "social": ("k % 7 = 0", "<a href='https://else.org/x' data-box='10,1010,40,1040'><img data-box='10,1010,40,1040'></a>"),
    "bar": ("k % 11 = 0", "<div data-position='fixed' data-box='0,840,1440,900'>bar</div>"),
    "overlay": ("k % 6 = 1", "<div data-position='absolute' data-box='0,390,400,460'><p data-box='10,400,20,410'>pop</p></div>"),
    "footer": ("k % 3 <> 1", "<div data-box='0,1900,1440,2000'>foot</div>"),
}


def sites(spark, sf) -> DataFrame:
    k = read(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    k = k.repartition(max(1, k.count() // 5000))  # a small file is many pages, which are parsed
    parts = [F.when(F.expr(on), F.lit(html_)).otherwise("") for on, html_ in SITE.values()]
    return k.select(F.col("k").alias("page_id"), F.lit("http://www.site.com/").alias("url"), F.concat(F.lit("<html><body data-box='0,0,1440,2000'>"), *parts, F.lit("</body></html>")).alias("html"))


def site_query(name: str, on: str, n: int, f: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """How many rows f gives for each page: n where the condition holds, else none."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        pages = sites(spark, sf)
        return f(written(snapshots.from_pages(pages), "snapshot"), pages).groupBy("page_id").agg(F.count("*").alias("n"))

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = f"SELECT page_id, CAST({n} AS BIGINT) AS n FROM (SELECT p_partkey AS page_id, p_partkey AS k FROM part) WHERE {on}"


for _name, (_on, _n, _f) in {
    "site_headers": ("k % 2 = 0", 1, lambda e, p: groups.headers(e)),
    "site_footers": ("k % 3 <> 1", 1, lambda e, p: groups.footers(e)),
    "site_menus": ("k % 3 <> 0", 1, lambda e, p: groups.menus(e, p).where("kind = 'menusH' AND n_items = 4")),
    "site_logos": ("k % 2 = 0", 1, lambda e, p: groups.logos(e, p)),
    "site_forms": ("k % 5 = 0", 1, lambda e, p: groups.forms(e)),
    "site_function_areas": ("k % 5 = 0", 1, lambda e, p: groups.function_areas(e).where("kind = 'search'")),
    "site_social_buttons": ("k % 7 = 0", 1, lambda e, p: groups.social_buttons(e, p)),
    "site_fixed_areas": ("k % 11 = 0", 1, lambda e, p: groups.fixed_areas(e).where("location = 'bottom'")),
    "site_overlays": ("k % 6 = 1", 1, lambda e, p: groups.overlays(e)),
    "site_rotating_banners": ("k % 4 = 0", 1, lambda e, p: groups.rotating_banners(e)),
    "site_titles": ("true", 1, lambda e, p: groups.titles(e).where("text = 'The title of it'")),
    "site_main_text": ("true", 1, lambda e, p: groups.main_text(e, p)),
    "site_computed_controls": ("k % 3 <> 0", 4, lambda e, p: snapshot.computed_controls(e).where("tag = 'a' AND t = 112")),
}.items():
    site_query(_name, _on, _n, _f)


def snapshot_query(name: str, f: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        pages = read(spark, sf, "pages")
        return f(written(snapshots.from_pages(pages), "snapshot"), pages)

    run.__name__ = name
    QUERIES[name] = run


KEYS = ("page_id", "el_id", "tag")
for _name, _f in {
    "snapshot_clipped": lambda e, p: snapshot.clipped(e).select(*KEYS, "cl", "ct", "cr", "cb"),
    "snapshot_visible": lambda e, p: snapshot.visible(e).select(*KEYS),
    "snapshot_visible_text": lambda e, p: snapshot.visible_text(e).select(*KEYS),
    "snapshot_graphics": lambda e, p: snapshot.graphics(e).select(*KEYS, "kind"),
    "snapshot_positioned": lambda e, p: snapshot.positioned(e).select(*KEYS),
    "snapshot_computed_controls": lambda e, p: snapshot.computed_controls(e).select(*KEYS),
    "snapshot_primitives": lambda e, p: snapshot.primitives(e),
    "snapshot_full_window": lambda e, p: snapshot.full_window(e),
    "group_root": lambda e, p: groups.root_element(e).select(*KEYS),
    "group_headers": lambda e, p: groups.headers(e).select(*KEYS),
    "group_footers": lambda e, p: groups.footers(e).select(*KEYS),
    "group_forms": lambda e, p: groups.forms(e).select(*KEYS),
    "group_main_body": lambda e, p: groups.main_body(e).select(*KEYS),
    "group_menus": lambda e, p: groups.menus(e, p),
    "group_titles": lambda e, p: groups.titles(e),
    "group_logos": lambda e, p: groups.logos(e, p),
    "group_social_buttons": lambda e, p: groups.social_buttons(e, p),
    "group_function_areas": lambda e, p: groups.function_areas(e),
    "group_properties": lambda e, p: groups.properties(e.where("tag in ('nav', 'article', 'footer')").withColumn("group_id", F.col("el_id")), dom.members(e.where("tag in ('nav', 'article', 'footer')").withColumn("group_id", F.col("el_id")), dom.with_text(e)), e),
}.items():
    snapshot_query(_name, _f)


for _name, _f in {
    "group_overlays": lambda e, p: groups.overlays(e).select(*KEYS),
    "group_fixed_areas": lambda e, p: groups.fixed_areas(e),
    "group_rotating_banners": lambda e, p: groups.rotating_banners(e),
    "group_main_text": lambda e, p: groups.main_text(e, p),
}.items():
    snapshot_query(_name, _f)


@query(f"WITH {R}, s AS (SELECT page_id, l_tag, sum(n) AS n FROM (SELECT page_id, floor(t / 100) AS l_tag, el_id AS n FROM r) GROUP BY 1, 2) SELECT page_id, CAST(arg_max(l_tag, struct_pack(n := n, f := l_tag)) AS DOUBLE) AS font_size FROM s GROUP BY 1")
def common_font_size(spark, sf):
    t = rects(spark, sf).select("page_id", F.lit(0).alias("group_id"), F.floor(F.col("t") / 100).cast("double").alias("font_size"), F.col("el_id").alias("n_chars"))
    return groups.common_font_size(t).select("page_id", "font_size")


@query(f"WITH {R} SELECT page_id, round(sum(2 * greatest(0, (b - t - 30) / 2) * (r - l) + (b - t) * (2 * (el_id - 1) + 0.5 * (el_id * 6 - 1))), 4) AS space FROM r GROUP BY 1")
def text_white_space(spark, sf):
    x = rects(spark, sf).select("page_id", F.lit(0).alias("group_id"), (F.col("b") - F.col("t")).alias("line_height"), F.lit(30.0).alias("font_size"), (F.col("r") - F.col("l")).alias("width"), F.col("el_id").alias("n_words"), (F.col("el_id") * 6).alias("n_chars"), F.lit(2.0).alias("word_spacing"), F.lit(0.5).alias("letter_spacing"))
    return groups.text_white_space(x).select("page_id", F.round("space", 4).alias("space"))


@query()
def text_lines(spark, sf):
    return groups.text_lines(rects(spark, sf).withColumn("group_id", F.lit(0)))


@query("SELECT p_partkey, length(p_name) AS n, repeat('█', CAST(length(p_name) AS INT)) AS black FROM part")
def text_scramble(spark, sf):
    made = read(spark, sf, "part").select("p_partkey", "p_name", scramble.scramble(F.col("p_name")).alias("s"))
    return made.select("p_partkey", F.length("s").cast("long").alias("n"), scramble.black(F.col("p_name")).alias("black"))


# Header and footer search

#: A page is a part; its elements, in the order of its lines, are a heap of three children each, below a body of 1440 by 2000.
LAYOUT = """z0 AS (SELECT l_partkey AS page_id, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS INT) - 1 AS el_id FROM {lineitem}),
    z AS (SELECT page_id, el_id, CASE WHEN el_id > 0 THEN CAST(floor((el_id - 1) / 3) AS INT) END AS parent_id, el_id = 0 OR (page_id + el_id * el_id) % 5 <> 0 AS seen,
    CASE WHEN el_id = 0 OR (page_id + el_id) % 4 <> 0 THEN 0.0 ELSE 100.0 END AS l, CASE WHEN el_id = 0 OR (page_id + el_id) % 4 <> 0 THEN 1440.0 ELSE 700.0 END AS r,
    1.0 * CASE WHEN el_id = 0 THEN 0 WHEN (page_id + el_id) % 3 = 0 THEN (el_id * 53) % 200 WHEN (page_id + el_id) % 3 = 1 THEN 1500 + (el_id * 71) % 450 ELSE (el_id * 97 + page_id * 13) % 2000 END AS t,
    CASE WHEN el_id = 0 THEN 2000.0 ELSE 40.0 * ((el_id * 31 + page_id) % 7) END AS h, ((page_id * 5 + el_id * 11) % 9) * 90 AS n, (page_id + el_id * 2) % 11 = 0 AS menu, el_id % 4 = 3 AS prim FROM z0)"""
BARS = f"""WITH RECURSIVE {LAYOUT.format(lineitem='lineitem')}, zb AS (SELECT *, t + h AS b FROM z),
    up AS (SELECT page_id, el_id, el_id AS anc_id, 0 AS dist, parent_id AS nxt FROM z UNION ALL SELECT u.page_id, u.el_id, z.el_id, u.dist + 1, z.parent_id FROM up u JOIN z ON z.page_id = u.page_id AND z.el_id = u.nxt),
    held AS (SELECT u.page_id, u.anc_id, min(x.t) AS t, max(x.b) AS b FROM up u JOIN zb x ON x.page_id = u.page_id AND x.el_id = u.el_id WHERE u.dist > 0 AND x.b > x.t GROUP BY 1, 2),
    f AS (SELECT zb.* REPLACE (CASE WHEN zb.h = 0 THEN coalesce(held.t, zb.t) ELSE zb.t END AS t, CASE WHEN zb.h = 0 THEN coalesce(held.b, zb.b) ELSE zb.b END AS b) FROM zb LEFT JOIN held ON held.page_id = zb.page_id AND held.anc_id = zb.el_id),
    near AS (SELECT u.page_id, u.el_id, arg_min(u.anc_id, u.dist) AS up_id, min(u.dist) AS dist FROM up u JOIN z a ON a.page_id = u.page_id AND a.el_id = u.anc_id AND a.seen JOIN z e ON e.page_id = u.page_id AND e.el_id = u.el_id AND e.seen WHERE u.dist > 0 GROUP BY 1, 2),
    edges AS (SELECT near.page_id, near.el_id, near.up_id FROM near JOIN up u ON u.page_id = near.page_id AND u.el_id = near.el_id AND u.dist = near.dist - 1 QUALIFY near.dist = min(near.dist) OVER (PARTITION BY near.page_id, u.anc_id)),
    kids AS (SELECT page_id, up_id, count(*) AS k FROM edges GROUP BY 1, 2),
    walk AS (SELECT DISTINCT page_id, 0 AS el_id FROM z UNION ALL SELECT w.page_id, e.el_id FROM walk w JOIN kids ON kids.page_id = w.page_id AND kids.up_id = w.el_id AND kids.k = 1 JOIN edges e ON e.page_id = w.page_id AND e.up_id = w.el_id),
    root AS (SELECT w.page_id, w.el_id FROM walk w LEFT JOIN kids ON kids.page_id = w.page_id AND kids.up_id = w.el_id WHERE coalesce(kids.k, 0) <> 1),
    flags AS (SELECT f.*, f.r - f.l >= 0.9 * (q.r - q.l) AND f.b <= 510 AND f.n <= 504 AND NOT EXISTS (SELECT 1 FROM up u JOIN z x ON x.page_id = u.page_id AND x.el_id = u.el_id AND x.menu WHERE u.page_id = f.page_id AND u.anc_id = f.el_id) AS is_h, f.r - f.l >= 0.9 * (q.r - q.l) AND f.t <= 510 AS in_h,
        f.r - f.l >= 0.9 * (q.r - q.l) AND f.t >= 1200 AND f.n <= 756 AS is_f, f.r - f.l >= 0.9 * (q.r - q.l) AND f.b >= 1200 AS in_f FROM f JOIN root ON root.page_id = f.page_id JOIN f q ON q.page_id = root.page_id AND q.el_id = root.el_id),
    hs AS (SELECT e.page_id, e.el_id FROM root JOIN edges e ON e.page_id = root.page_id AND e.up_id = root.el_id UNION ALL SELECT e.page_id, e.el_id FROM hs JOIN flags g ON g.page_id = hs.page_id AND g.el_id = hs.el_id AND g.in_h AND NOT g.is_h JOIN edges e ON e.page_id = hs.page_id AND e.up_id = hs.el_id),
    fs AS (SELECT e.page_id, e.el_id FROM root JOIN edges e ON e.page_id = root.page_id AND e.up_id = root.el_id UNION ALL SELECT e.page_id, e.el_id FROM fs JOIN flags g ON g.page_id = fs.page_id AND g.el_id = fs.el_id AND g.in_f AND NOT g.is_f JOIN edges e ON e.page_id = fs.page_id AND e.up_id = fs.el_id),
    c AS (SELECT g.page_id, g.el_id, 'header' AS kind, g.t, g.b, g.b <= 255 AS ok, g.t AS edge FROM hs JOIN flags g ON g.page_id = hs.page_id AND g.el_id = hs.el_id AND g.is_h UNION ALL SELECT g.page_id, g.el_id, 'footer', g.t, g.b, g.t >= 1600, -g.b FROM fs JOIN flags g ON g.page_id = fs.page_id AND g.el_id = fs.el_id AND g.is_f),
    bars AS (SELECT * FROM c QUALIFY ok OR (NOT bool_or(ok) OVER (PARTITION BY page_id, kind) AND row_number() OVER (PARTITION BY page_id, kind ORDER BY edge, el_id) = 1)),
    alone AS (SELECT k.page_id, k.kind, min(p.t) AS first, max(p.b) AS last FROM (SELECT DISTINCT page_id, kind FROM bars) k JOIN zb p ON p.page_id = k.page_id AND p.prim
        WHERE NOT EXISTS (SELECT 1 FROM bars x JOIN up u ON u.page_id = x.page_id AND (u.el_id = p.el_id AND u.anc_id = x.el_id OR u.el_id = x.el_id AND u.anc_id = p.el_id) WHERE x.page_id = k.page_id AND x.kind = k.kind) GROUP BY 1, 2)
    SELECT bars.page_id, bars.el_id, bars.kind FROM bars LEFT JOIN alone ON alone.page_id = bars.page_id AND alone.kind = bars.kind WHERE CASE WHEN bars.kind = 'header' THEN coalesce(first >= bars.t, true) ELSE coalesce(last <= bars.b, true) END"""


def layout(spark, sf) -> DataFrame:
    """Snapshot rows of the layout."""
    z = spark.sql(f"WITH {LAYOUT.format(lineitem='{lineitem}')} SELECT * FROM z", lineitem=read(spark, sf, "lineitem"))
    made = z.select("page_id", "el_id", "parent_id", "seen", "l", "r", "t", (F.col("t") + F.col("h")).alias("b"), "n", "menu", "prim", F.when(F.col("el_id") == 0, "body").otherwise("div").alias("tag"), F.col("el_id").alias("pre"), F.lit(2000.0).alias("doc_height"))
    return written(dom.paths(made.withColumns({c: F.col(c).cast("double") for c in "ltrb"})), "layout")


def bar_query(name: str, kind: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        e = layout(spark, sf)
        found = bars.search(e, e.where("seen AND tag <> 'body'"), e, e.where("menu"), e.where("prim"))
        return found.where(F.col("kind") == kind).select("page_id", "el_id")

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = f"SELECT page_id, el_id FROM ({BARS}) WHERE kind = '{kind}'"


bar_query("tree_headers", "header")
bar_query("tree_footers", "footer")


# Style sheets

SHEET = """div > p.c1:hover { x: y } nav .c2:hover, .none:hover { x: y } li + a { x: y } form ~ .c0 { x: y } span:nth-child(2) { x: y } [id] > img { x: y }
    @media print { svg:hover { x: y } } @media (min-width: 1000px) { .c0 > svg:hover { x: y } } @media (max-width: 1000px) { [class] { x: y } }"""


@query(f"""{WITH_UP}, f AS (SELECT t.page_id, t.el_id,
        (t.tag = 'p' AND t.el_id % 3 = 1 AND p.tag = 'div') OR (t.el_id % 3 = 2 AND EXISTS (SELECT 1 FROM up u JOIN t x ON x.page_id = u.page_id AND x.el_id = u.anc_id AND x.tag = 'nav' WHERE u.page_id = t.page_id AND u.el_id = t.el_id AND u.dist > 0)) OR (t.tag = 'svg' AND p.el_id % 3 = 0) AS h,
        (t.tag = 'a' AND s.tag = 'li') OR (t.el_id % 3 = 0 AND s.tag = 'form') OR (t.tag = 'span' AND t.el_id > 0 AND t.el_id % 2 = 0) AS o, t.tag = 'img' AND p.el_id % 4 = 0 AS a
        FROM t LEFT JOIN t p ON p.page_id = t.page_id AND p.el_id = t.parent_id LEFT JOIN t s ON s.page_id = t.page_id AND s.el_id = t.el_id - 1 AND t.el_id % 2 = 0 AND t.el_id > 0)
    SELECT page_id, el_id, coalesce(h, false) AS hover_styled, coalesce(o, false) AS order_styled, coalesce(a, false) AS attr_styled FROM f WHERE h OR o OR a""")
def tree_styled(spark, sf):
    """Elements that selectors with :hover, of order and of attributes fit."""
    k = F.col("el_id")
    named = F.map_filter(F.create_map(F.lit("class"), F.concat(F.lit("c"), (k % 3).cast("string")), F.lit("id"), F.when(k % 4 == 0, F.concat(F.lit("i"), k.cast("string")))), lambda n, v: v.isNotNull())
    e = tree(spark, sf).withColumn("attrs", named)
    return selectors.styled(e, sheets=e.select("page_id").distinct().select("page_id", F.lit(0).alias("sheet"), F.lit(SHEET).alias("css"), F.lit("screen").alias("media")))


# Computed controls, once more is known

#: Sets of the layout's elements: controls, logos, menus, edged ones, texts and pictures.
SETS = {"controls": "el_id % 4 = 2", "logos": "(page_id + el_id) % 23 = 0", "menus": "el_id % 7 = 1", "edged": "(page_id * 3 + el_id) % 4 = 0", "texts": "el_id % 3 <> 0", "pictures": "(page_id + el_id) % 5 = 0"}


def _holds(outer: str, inner: str, name: str) -> str:
    """SQL: whether the element `outer` holds one of a set; with inner it stands in one."""
    a, b = ("u.anc_id", "u.el_id") if inner == "below" else ("u.el_id", "u.anc_id")
    return f"EXISTS (SELECT 1 FROM up u JOIN z x ON x.page_id = u.page_id AND x.el_id = {b} AND ({SETS[name].replace('page_id', 'x.page_id').replace('el_id', 'x.el_id')}) WHERE u.page_id = {outer}.page_id AND {a} = {outer}.el_id)"


CHECKED = f"""WITH RECURSIVE {LAYOUT.format(lineitem='lineitem')}, zb AS (SELECT *, t + h AS b FROM z),
    up AS (SELECT page_id, el_id, el_id AS anc_id, 0 AS dist, parent_id AS nxt FROM z UNION ALL SELECT u.page_id, u.el_id, z.el_id, u.dist + 1, z.parent_id FROM up u JOIN z ON z.page_id = u.page_id AND z.el_id = u.nxt),
    held AS (SELECT u.page_id, u.anc_id, min(x.t) AS t, max(x.b) AS b FROM up u JOIN zb x ON x.page_id = u.page_id AND x.el_id = u.el_id WHERE u.dist > 0 AND x.b > x.t GROUP BY 1, 2),
    f AS (SELECT zb.page_id, zb.el_id, zb.r - zb.l AS w, CASE WHEN zb.h = 0 THEN coalesce(held.b - held.t, 0) ELSE zb.h END AS h FROM zb LEFT JOIN held ON held.page_id = zb.page_id AND held.anc_id = zb.el_id),
    c AS (SELECT f.*, {_holds('f', 'below', 'texts')} AND NOT {_holds('f', 'below', 'pictures')} AS words, {_holds('f', 'above', 'menus')} OR {_holds('f', 'below', 'edged')} AS stays FROM f WHERE {SETS['controls']} AND NOT {_holds('f', 'above', 'logos')} AND NOT {_holds('f', 'below', 'logos')}),
    found AS (SELECT page_id, el_id FROM c WHERE NOT words OR stays
        UNION SELECT c.page_id, g.el_id FROM c JOIN up u ON u.page_id = c.page_id AND u.el_id = c.el_id JOIN f g ON g.page_id = c.page_id AND g.el_id = u.anc_id WHERE words AND NOT stays AND ({SETS['edged'].replace('page_id', 'g.page_id').replace('el_id', 'g.el_id')}) AND g.w <= c.w * 1.1 AND g.h <= c.h * 1.1)
    SELECT page_id, el_id FROM found WHERE NOT EXISTS (SELECT 1 FROM up u JOIN found x ON x.page_id = u.page_id AND x.el_id = u.anc_id WHERE u.page_id = found.page_id AND u.el_id = found.el_id AND u.dist > 0)"""


@query(CHECKED)
def tree_checked_controls(spark, sf):
    """Computed controls without those of logos and plain texts, or what outlines them (F16)."""
    e = layout(spark, sf)
    return controls.checked(e, *(e.where(SETS[k]) for k in ("controls", "logos", "menus", "edged", "texts", "pictures"))).select("page_id", "el_id")


# Elements over others


@query(f"""{WITH_UP}, {STACK}, c AS (SELECT * FROM t WHERE position IN ('relative', 'absolute', 'sticky')), p AS (SELECT * FROM t WHERE el_id % 2 = 0),
    m AS (SELECT c.page_id, c.el_id, {FIRST.format('x')} AS za, {FIRST.format('y')} AS zb, c.el_id > p.el_id AS later,
        EXISTS (SELECT 1 FROM up u JOIN t h ON h.page_id = u.page_id AND h.el_id = u.anc_id AND h.position <> 'static' WHERE u.page_id = p.page_id AND u.el_id = p.el_id)
        AND abs(c.l - p.l) < 0.05 * (c.r - c.l) AND abs(c.r - p.r) < 0.05 * (c.r - c.l) AND abs(c.top - p.top) < 0.05 * (c.b - c.top) AND abs(c.b - p.b) < 0.05 * (c.b - c.top) AS same
        FROM c JOIN p ON p.page_id = c.page_id AND least(c.r, p.r) - greatest(c.l, p.l) > least(p.r - p.l, p.b - p.top) / 2 AND least(c.b, p.b) - greatest(c.top, p.top) > least(p.r - p.l, p.b - p.top) / 2
        JOIN s x ON x.page_id = c.page_id AND x.el_id = c.el_id JOIN s y ON y.page_id = p.page_id AND y.el_id = p.el_id
        WHERE NOT EXISTS (SELECT 1 FROM up u WHERE u.page_id = c.page_id AND (u.el_id = p.el_id AND u.anc_id = c.el_id OR u.el_id = c.el_id AND u.anc_id = p.el_id)))
    SELECT DISTINCT page_id, el_id FROM m WHERE NOT same AND (za > zb OR (za = zb AND later))""")
def tree_covering(spark, sf):
    """Positioned elements drawn over every other element of the tree that they overlap (G1), by cells and stacking."""
    p, k = F.col("page_id"), F.col("el_id") + 0
    e = tree(spark, sf).withColumns({"z_index": F.when((p + k) % 4 != 0, ((p * 5 + k) % 3).cast("int")), "bg_color": F.array(*[F.lit(255.0)] * 3)})
    return groups.covering(e, e.where("position IN ('relative', 'absolute', 'sticky')"), e.where("el_id % 2 = 0"))


@query(f"WITH {R} SELECT x.page_id, x.el_id AS a_id, y.el_id AS b_id FROM r x JOIN r y ON x.page_id = y.page_id AND x.el_id <> y.el_id AND least(x.r, y.r) - greatest(x.l, y.l) > 4 AND least(x.b, y.b) - greatest(x.t, y.t) > 4")
def rectangle_tile_join(spark, sf):
    """Pairs of overlapping rectangles by cells of the page."""
    r = rects(spark, sf)
    return boxes.tiled(r, r, 4.0).where("a_id <> b_id").select("page_id", "a_id", "b_id")


# Clipping


#: From the root down: the clips for flow, absolute and fixed children, and what is left of each box.
CLIPS = f"""WITH RECURSIVE {R}, {TREE}, e AS (SELECT page_id, el_id, parent_id, position, l::DOUBLE AS l, top::DOUBLE AS t, r::DOUBLE AS r, b::DOUBLE AS b, (page_id + el_id) % 3 = 0 AS clips, (page_id * 2 + el_id) % 7 = 0 AS moved FROM t),
    k AS (SELECT page_id, el_id, position, clips, moved, {{'l': greatest(l, 0.0::DOUBLE), 't': greatest(t, 0.0::DOUBLE), 'r': greatest(least(r, 700.0::DOUBLE), greatest(l, 0.0::DOUBLE)), 'b': greatest(least(b, 400.0::DOUBLE), greatest(t, 0.0::DOUBLE))}} AS c,
            {{'l': 0.0::DOUBLE, 't': 0.0::DOUBLE, 'r': 700.0::DOUBLE, 'b': 400.0::DOUBLE}} AS own, {{'l': 0.0::DOUBLE, 't': 0.0::DOUBLE, 'r': 700.0::DOUBLE, 'b': 400.0::DOUBLE}} AS lifted, {{'l': 0.0::DOUBLE, 't': 0.0::DOUBLE, 'r': 700.0::DOUBLE, 'b': 400.0::DOUBLE}} AS fixed FROM e WHERE parent_id IS NULL
        UNION ALL SELECT page_id, el_id, position, clips, moved, {{'l': greatest(l, o.l), 't': greatest(t, o.t), 'r': greatest(least(r, o.r), l, o.l), 'b': greatest(least(b, o.b), t, o.t)}}, o, lifted, fixed FROM (
            SELECT e.*, CASE e.position WHEN 'fixed' THEN CASE WHEN k.moved THEN CASE WHEN k.clips THEN k.c ELSE k.own END ELSE k.fixed END
                    WHEN 'absolute' THEN CASE WHEN k.moved OR k.position <> 'static' THEN CASE WHEN k.clips THEN k.c ELSE k.own END ELSE k.lifted END ELSE CASE WHEN k.clips THEN k.c ELSE k.own END END AS o,
                CASE WHEN k.moved OR k.position <> 'static' THEN CASE WHEN k.clips THEN k.c ELSE k.own END ELSE k.lifted END AS lifted,
                CASE WHEN k.moved THEN CASE WHEN k.clips THEN k.c ELSE k.own END ELSE k.fixed END AS fixed
            FROM k JOIN e ON e.page_id = k.page_id AND e.parent_id = k.el_id))
    SELECT page_id, el_id, round(c.l, 6) AS cl, round(c.t, 6) AS ct, round(c.r, 6) AS cr, round(c.b, 6) AS cb FROM k"""


@query(CLIPS)
def tree_clipped(spark, sf):
    """Boxes within their clipping ancestors, with every kind of position and transforms (F2)."""
    k = F.col("page_id") + F.col("el_id")
    e = tree(spark, sf).withColumns({"overflow": F.when(k % 3 == 0, "hidden").otherwise("visible"), "transform": F.when((F.col("page_id") + k) % 7 == 0, "scale(1)"), "doc_width": F.lit(700.0), "doc_height": F.lit(400.0)})
    return rounded(snapshot.clipped(e).select("page_id", "el_id", "cl", "ct", "cr", "cb"), "cl", "ct", "cr", "cb")


# Pixels

#: An image for each part, six points wide, whose points are its lines; a second version has other reds in every fourth point, and one row less for every third part.
PIXELS = """z AS (SELECT l_partkey AS page_id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity) - 1 AS k, CAST(l_quantity AS INT) AS q, l_suppkey AS s, count(*) OVER (PARTITION BY l_partkey) AS n FROM {lineitem}),
    p AS (SELECT page_id, 1 AS img_id, CAST(k % 6 AS INT) AS x, CAST(floor(k / 6) AS INT) AS y, CAST(q * 5 % 256 AS INT) AS r, CAST((page_id * 7 + k * 31) % 256 AS INT) AS g, CAST(s % 256 AS INT) AS b, CASE WHEN k % 5 = 0 THEN 128 ELSE 255 END AS a,
        CAST(CASE WHEN k % 4 = 1 THEN (q * 5 + k) % 256 ELSE q * 5 % 256 END AS INT) AS r2, page_id % 3 = 0 AND k >= 6 * (floor(n / 6) - 1) AS cut FROM z WHERE k < 6 * floor(n / 6))"""
PIXEL_SQL = f"WITH {PIXELS.format(lineitem='lineitem')}"


def drawn(spark, sf) -> DataFrame:
    return written(spark.sql(f"WITH {PIXELS.format(lineitem='{lineitem}')} SELECT * FROM p", lineitem=read(spark, sf, "lineitem")), "drawn")


@query(f"""{PIXEL_SQL}, v AS (SELECT *, r * a / 255.0 AS u, g * a / 255.0 AS v, b * a / 255.0 AS w FROM p)
    SELECT page_id, count(*) AS n, round(avg(u), 6) AS red, round(avg(v), 6) AS green, round(avg(w), 6) AS blue, round(avg(a), 6) AS alpha,
    round(sqrt(greatest((avg(u * u) - avg(u) * avg(u) + avg(v * v) - avg(v) * avg(v) + avg(w * w) - avg(w) * avg(w)) / 3, 0)), 2) AS sd FROM v GROUP BY page_id""")
def pixel_stats(spark, sf):
    """Mean colors and spread of tiled images."""
    made = pixels.stats(tiled_images.tiles_of_pixels(drawn(spark, sf), tile=4))
    return made.select("page_id", "n", *[F.round(F.col("rgb")[k], 6).alias(c) for k, c in enumerate(("red", "green", "blue"))], F.round(F.col("rgba")[3], 6).alias("alpha"), "sd")


@query(f"""{PIXEL_SQL}, d AS (SELECT page_id, CASE WHEN NOT cut AND abs(r - r2) * a / 255.0 > 2 THEN abs(r - r2) * a / 255.0 ELSE 0 END AS d, cut FROM p)
    SELECT page_id, sum(d) = 0 AS same, round(sum(d) + 765 * count(*) FILTER (cut), 6) AS difference, 4 * count(*) FILTER (cut) AS size_difference FROM d GROUP BY page_id""")
def image_difference(spark, sf):
    """What two versions of an image differ by (A10)."""
    p = drawn(spark, sf)
    one, two = (tiled_images.tiles_of_pixels(x, tile=4) for x in (p, p.where("NOT cut").withColumn("r", F.col("r2"))))
    return pixels.difference(one, two).select("page_id", "same", F.round("difference", 6).alias("difference"), "size_difference")


@query(f"{PIXEL_SQL}, s AS (SELECT page_id, (page_id * j) % 7 AS x, (page_id + j * 3) % 9 AS y FROM (SELECT DISTINCT page_id FROM p), (SELECT unnest(range(1, 6)) AS j)) SELECT s.page_id, round(avg(p.r), 6) AS red, round(avg(p.g), 6) AS green, round(avg(p.b), 6) AS blue FROM s JOIN p ON p.page_id = s.page_id AND p.x = s.x AND p.y = s.y GROUP BY s.page_id")
def sampled_pixels(spark, sf):
    """The mean color of points of an image, of those that lie in it."""
    p = drawn(spark, sf)
    at = p.select("page_id", "img_id").distinct().withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(5)))).select("page_id", "img_id", (F.col("page_id") * F.col("j") % 7).alias("x"), ((F.col("page_id") + F.col("j") * 3) % 9).alias("y"))
    made = pixels.average(pixels.at_points(tiled_images.tiles_of_pixels(p, tile=4), at, tile=4), "page_id")
    return made.select("page_id", *[F.round(F.col("color")[k], 6).alias(c) for k, c in enumerate(("red", "green", "blue"))])


# Paragraphs

#: Lines of texts: an element's box, and for even ones a second one to the right and below.
TEXT_LINES = "k AS (SELECT page_id, el_id, l, top AS t, r, b FROM t UNION ALL SELECT page_id, el_id, l + 100, top + 3 + el_id, r + 120, b + 20 FROM t WHERE el_id % 2 = 0)"


def text_rects(e: DataFrame) -> DataFrame:
    k = F.col("el_id")
    more = e.where(k % 2 == 0).select("page_id", "el_id", (F.col("l") + 100).alias("l"), (F.col("t") + 3 + k).alias("t"), (F.col("r") + 120).alias("r"), (F.col("b") + 20).alias("b"))
    return e.select("page_id", "el_id", *"ltrb").unionByName(more)


@query(f"""{WITH_UP}, {TEXT_LINES}, n AS (SELECT u.page_id, u.el_id, arg_min(u.anc_id, u.dist) AS anc_id FROM up u JOIN t x ON x.page_id = u.page_id AND x.el_id = u.anc_id JOIN t e ON e.page_id = u.page_id AND e.el_id = u.el_id WHERE x.tag IN {BLOCK_TAGS} AND {HAS_TEXT.replace('txt', 'e.txt').replace('tag', 'e.tag')} GROUP BY 1, 2),
    w AS (SELECT n.page_id, n.anc_id, count(*) AS n_texts, string_agg(e.txt, '' ORDER BY e.el_id) AS text FROM n JOIN t e ON e.page_id = n.page_id AND e.el_id = n.el_id GROUP BY 1, 2),
    z AS (SELECT n.page_id, n.anc_id, e.font_size AS s, sum(len(e.txt)) AS c, min(e.el_id) AS f FROM n JOIN t e ON e.page_id = n.page_id AND e.el_id = n.el_id GROUP BY 1, 2, 3),
    y AS (SELECT page_id, anc_id, s FROM z QUALIFY row_number() OVER (PARTITION BY page_id, anc_id ORDER BY c DESC, f) = 1),
    q AS (SELECT n.page_id, n.anc_id, k.l::DOUBLE AS l, k.t::DOUBLE AS t, k.r::DOUBLE AS r, k.b::DOUBLE AS b FROM n JOIN k ON k.page_id = n.page_id AND k.el_id = n.el_id),
    c AS (SELECT page_id, anc_id, count(*) FILTER (m IS NULL OR l >= m) AS n FROM (SELECT *, max(r) OVER (PARTITION BY page_id, anc_id ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM q) GROUP BY 1, 2),
    i AS (SELECT page_id, anc_id, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b,
        list_reduce(list({{'n': 1, 'top': t, 'lo': l, 'hi': r, 'w': 0.0::DOUBLE}} ORDER BY t, l, r, b), lambda s, x: CASE WHEN x.top - s.top >= 5 THEN {{'n': s.n + 1, 'top': x.top, 'lo': x.lo, 'hi': x.hi, 'w': s.w + s.hi - s.lo}} ELSE {{'n': s.n, 'top': s.top, 'lo': least(s.lo, x.lo), 'hi': greatest(s.hi, x.hi), 'w': s.w}} END) AS v FROM q GROUP BY 1, 2)
    SELECT i.page_id, i.anc_id AS el_id, w.n_texts, w.text, round(i.l, 6) AS l, round(i.t, 6) AS t, round(i.r, 6) AS r, round(i.b, 6) AS b, v.n AS n_lines, round(v.w + v.hi - v.lo, 6) AS lines_width, CASE WHEN v.n > 1 THEN c.n ELSE 1 END AS n_columns, y.s::DOUBLE AS font_size
    FROM i JOIN w ON w.page_id = i.page_id AND w.anc_id = i.anc_id JOIN c ON c.page_id = i.page_id AND c.anc_id = i.anc_id JOIN y ON y.page_id = i.page_id AND y.anc_id = i.anc_id""")
def tree_paragraph_boxes(spark, sf):
    """Paragraphs with their box, lines, columns and common font size."""
    e = tree(spark, sf)
    made = paragraphs.paragraphs(e, text_rects(e)).drop("width_chars")
    return made.withColumns({c: F.round(c, 6) for c in ("l", "t", "r", "b", "lines_width")})


# Small rules


@query("SELECT p_partkey, replace(replace(replace(replace('$$c(' || p_name || ');$$r(a);$$w(1);$$(b)', '$$c(', 'addCssF('), '$$r(', '$.remove('), '$$w(', '$.wait('), '$$(', '$(') AS script FROM part")
def script_short_hands(spark, sf):
    """Short-hands of page scripts written out."""
    p = read(spark, sf, "part")
    return p.select("p_partkey", T.short_hands(F.concat(F.lit("$$c("), "p_name", F.lit(");$$r(a);$$w(1);$$(b)"))).alias("script"))


@query("SELECT DISTINCT p_brand AS prim_set FROM part WHERE p_size % 2 = 0")
def primitive_set_names(spark, sf):
    """Sets that matrix files are named after, of those that are text files."""
    end = F.when(F.col("p_size") % 2 == 0, ".txt").otherwise(".bin")
    return tables.primitive_sets(read(spark, sf, "part").select(F.concat(F.lit("mtx/run/"), F.col("p_brand"), F.lit("_"), F.col("p_size").cast("string"), end).alias("path")))


@query(f"""WITH {R}, {TREE}, s AS (SELECT page_id, el_id, 'top' AS side, el_id % 3 AS w, 1.0 AS a, 200 AS c FROM t UNION ALL SELECT page_id, el_id, 'right', 2, CASE WHEN m = 0 THEN 0.0 ELSE 1.0 END, 100 FROM t
    UNION ALL SELECT page_id, el_id, 'bottom', 1, 1.0, 103 FROM t UNION ALL SELECT page_id, el_id, 'left', m, 1.0, 100 FROM t)
    SELECT s.page_id, s.el_id, side, CAST(w AS DOUBLE) AS width FROM s JOIN t ON t.page_id = s.page_id AND t.el_id = s.el_id WHERE w > 0 AND a >= 0.05 AND (t.el_id % 4 = 0 OR abs(c - 100) * 3 > 15.3)""")
def tree_bordered(spark, sf):
    """Sides of borders that can be seen (F21): clear ones and those of the color inside can't, unless the inside is clear."""
    k, m = F.col("el_id"), F.col("page_id") % 5
    color = lambda v, a: F.array(*[F.lit(float(v))] * 3, a)
    e = tree(spark, sf).withColumns({
        "border_widths": F.array((k % 3).cast("double"), F.lit(2.0), F.lit(1.0), m.cast("double")),
        "border_colors": F.array(color(200, F.lit(1.0)), color(100, F.when(m == 0, 0.0).otherwise(1.0)), color(103, F.lit(1.0)), color(100, F.lit(1.0))),
        "bg_color": color(100, F.when(k % 4 == 0, 0.0).otherwise(1.0)),
    })
    return snapshot.bordered(e)


@query(f"{WITH_UP} SELECT u.page_id, u.el_id, arg_min(u.anc_id, u.dist) AS from_id, 's' || arg_min(u.anc_id, u.dist) AS style FROM up u WHERE (u.page_id + u.anc_id) % 4 = 0 GROUP BY 1, 2")
def tree_inherited_style(spark, sf):
    """The recorded style of the nearest element that has one."""
    e = tree(spark, sf)
    styles = e.where((F.col("page_id") + F.col("el_id")) % 4 == 0).select("page_id", "el_id", F.concat(F.lit("s"), F.col("el_id").cast("string")).alias("style"))
    return snapshot.inherited_style(e, styles)


@query(f"WITH {R}, {TREE} SELECT page_id, el_id, 'f' || el_id AS machine_id, el_id * 2 AS frame_id FROM t WHERE tag = 'section' AND el_id % 3 <> 0")
def tree_frame_records(spark, sf):
    """Elements that show a frame with its record, by machine id."""
    e = tree(spark, sf).select("page_id", "el_id", "tag", F.concat(F.lit("f"), F.col("el_id").cast("string")).alias("machine_id"))
    records = e.where("el_id % 3 <> 0").select("page_id", "machine_id", (F.col("el_id") * 2).alias("frame_id"))
    return frames.frame_records(e.where("tag = 'section'").select("page_id", "el_id", "machine_id"), records)


@query(f"WITH {R}, h AS (SELECT page_id, 'h' || ((page_id + el_id * el_id) % 3) || '.com' AS host, count(*) AS n, min(el_id) AS f FROM r WHERE el_id % 5 <> 0 GROUP BY 1, 2) SELECT page_id, host FROM h QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC, f) = 1")
def common_hosts(spark, sf):
    """The host that most links of a page have, of equal ones the first (A3)."""
    k = F.col("el_id")
    href = F.concat(F.when(k % 5 != 0, "http://h").otherwise("mailto:h"), ((F.col("page_id") + k * k) % 3).cast("string"), F.lit(".com/a/b"))
    return dom.common_host(rects(spark, sf).select("page_id", "el_id", href.alias("href")))


@query(f"WITH {R} SELECT x.page_id, x.el_id AS a_id, y.el_id AS b_id FROM r x JOIN r y ON x.page_id = y.page_id AND x.el_id < y.el_id AND abs(x.l - y.l) <= 150 AND abs(x.t - y.t) <= 150 AND abs(x.r - y.r) <= 150 AND abs(x.b - y.b) <= 150")
def similar_boxes(spark, sf):
    """Pairs of a page's boxes whose sides differ by 150 at most."""
    r = rects(spark, sf)
    return boxes.pairs(r, ordered=False).where(G.same_box("a_", "b_", 150)).select("page_id", "a_id", "b_id")


@query("SELECT p_partkey, CAST(CASE WHEN p_retailprice < 1500 THEN p_retailprice ELSE 1000 END AS DOUBLE) AS width FROM part")
def sane_widths(spark, sf):
    """Scroll widths, or the window's where they are one and a half times that or more."""
    return read(spark, sf, "part").select("p_partkey", G.sane_width(F.col("p_retailprice"), F.lit(1000.0)).cast("double").alias("width"))


# Frames and shadow trees


@query(f"""WITH RECURSIVE {R}, {TREE}, f AS (SELECT page_id, el_id AS frame_id, l, top AS t FROM t WHERE parent_id IS NULL UNION ALL SELECT t.page_id, t.el_id, t.l + f.l, t.top + f.t FROM t JOIN f ON f.page_id = t.page_id AND f.frame_id = t.parent_id)
    SELECT t.page_id, CASE WHEN t.el_id % 3 = 0 THEN t.el_id || '' ELSE (t.el_id - 1) || '/' || t.el_id END AS key, round(t.l + CASE WHEN t.el_id % 3 = 0 THEN 0 ELSE f.l END, 6) AS l, round(t.top + CASE WHEN t.el_id % 3 = 0 THEN 0 ELSE f.t END, 6) AS t, round(t.r + CASE WHEN t.el_id % 3 = 0 THEN 0 ELSE f.l END, 6) AS r, round(t.b + CASE WHEN t.el_id % 3 = 0 THEN 0 ELSE f.t END, 6) AS b
    FROM t LEFT JOIN f ON f.page_id = t.page_id AND f.frame_id = t.el_id - 1""")
def frame_rectangles(spark, sf):
    """Rectangles of nested frames in the coordinates of their page (C19): two in three stand in the frame before them."""
    e, k = tree(spark, sf), F.col("el_id")
    offsets = frames.absolute_frames(e.select("page_id", k.alias("frame_id"), "parent_id", "l", "t"))
    made = frames.in_page(e.select("page_id", F.when(k % 3 != 0, k - 1).alias("frame_id"), "el_id", *"ltrb"), offsets)
    return made.select("page_id", "key", *[F.round(c, 6).alias(c) for c in "ltrb"])


@query("""SELECT p_partkey AS page_id, 'name ' || CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'unknown' END || ' end' || CASE WHEN p_size % 3 = 0 THEN ' rest' ELSE '' END AS text FROM part""")
def shadow_text(spark, sf):
    """The text of pages with a declarative shadow root as it is rendered (S9): half of them fill the slot that has a name, a third the one without."""
    p = read(spark, sf, "part")
    named = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("<b slot='n'>"), "p_name", F.lit("</b>"))).otherwise(F.lit("<b slot='none'>lost</b>"))
    rest = F.when(F.col("p_size") % 3 == 0, F.lit("<i> rest</i>")).otherwise("")
    page = F.concat(F.lit("<x-card>"), rest, F.lit("<template shadowrootmode='open'><p>name </p><slot name='n'><u>unknown</u></slot><p> end</p><slot></slot></template>"), named, F.lit("</x-card>"))
    e = html.parse_shadow(p.select(F.col("p_partkey").alias("page_id"), page.alias("html"))).where("size(own_text) > 0")
    return e.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pre", F.array_join("own_text", "").alias("x")))), lambda v: v["x"]), "").alias("text"))


# Named sets of primitives

_OUT = "NOT EXISTS (SELECT 1 FROM up u JOIN t x ON x.page_id = u.page_id AND x.el_id = u.anc_id WHERE u.page_id = s.page_id AND u.el_id = s.el_id AND {})"


@query(f"""{WITH_UP}, g AS (SELECT *, tag IN ('img', 'svg') AS real FROM t WHERE tag IN ('img', 'svg') OR pictured),
    s AS (SELECT page_id, el_id, 'txt' AS family, true AS plain FROM t WHERE {HAS_TEXT} AND font_size > 3 UNION ALL SELECT page_id, el_id, 'cntrl', true FROM t WHERE tag IN ('input', 'button')
        UNION ALL SELECT page_id, el_id, 'cntrl', false FROM t WHERE el_id % 5 = 4 AND tag NOT IN ('input', 'button') UNION ALL SELECT page_id, el_id, 'graphic', true FROM g WHERE real OR {UI} OR {ICON}
        UNION ALL SELECT page_id, el_id, 'edge', true FROM t WHERE el_id % 6 = 1)
    SELECT s.*, CASE family WHEN 'txt' THEN {_OUT.format("x.el_id % 5 = 4 AND x.tag NOT IN ('input', 'button')")} WHEN 'graphic' THEN {_OUT.format("(x.el_id % 5 = 4 OR x.tag IN ('input', 'button'))")} ELSE true END AS grouped
    FROM s WHERE {_OUT.format("x.position = 'sticky' AND x.tag = 'div'")}""")
def tree_primitive_sets(spark, sf):
    """Primitives with and without computed controls, outside overlays."""
    e = tree(spark, sf)
    computed = e.where("el_id % 5 = 4 AND tag NOT IN ('input', 'button')")
    return snapshot.primitive_sets(e, computed, edged=e.where("el_id % 6 = 1"), overlays=e.where("position = 'sticky' AND tag = 'div'"))
