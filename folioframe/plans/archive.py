"""Queries of the document-table engine bound to the driver's tables, each with its SQL twin.

Roles: region is a parish, nation a book, an order a page (opening = o_orderkey % 700), a line item a table on it with a
rectangle from its integers; its ordinal is its place among all columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from ..operators import extract, grid, layout, stats, tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
RECTS_SQL = f"""
SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ORDER)}) AS ord,
  (l_partkey * 7) % 1000 AS x, (l_suppkey * 13) % 800 AS y, CAST(l_quantity AS BIGINT) * 8 AS w, CAST(l_linenumber AS BIGINT) * 60 AS h, l_returnflag, l_linenumber
FROM lineitem"""


def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, ord, rectangle and its parts."""
    order = Window.partitionBy("l_orderkey").orderBy(*ORDER)
    # only what orders the rows is shuffled: all the rest is made of it behind the shuffle
    ranked = load(spark, sf_dir, "lineitem").select("l_orderkey", *ORDER).withColumn("ord", F.row_number().over(order))
    rows = ranked.select(
        F.col("l_orderkey").alias("page"), "ord", ((F.col("l_partkey") * 7) % 1000).alias("x"), ((F.col("l_suppkey") * 13) % 800).alias("y"),
        (F.col("l_quantity").cast("long") * 8).alias("w"), (F.col("l_linenumber").cast("long") * 60).alias("h"), "l_returnflag", "l_linenumber",
    )
    return rows.withColumn("r", g.rect(F.col("x"), F.col("y"), F.col("w"), F.col("h")))


def book_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, expected tables, book and parish. Customers, nations and regions are dimensions; the planner broadcasts those that are small."""
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), "o_custkey", (F.col("o_orderkey") % 3 + 1).alias("expected"))
    customers = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    books = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("book"), F.col("r_name").alias("parish"))
    return orders.join(customers, "o_custkey").join(books, "n_nationkey").select("page", "expected", "book", "parish")


PAGES_SQL = """
per AS (SELECT l_orderkey AS page, count(*) AS n_tables, sum(CAST(l_quantity AS BIGINT)) AS n_rows, max(l_linenumber) AS n_cols FROM lineitem GROUP BY 1),
pages AS (
  SELECT o_orderkey AS page, o_orderkey % 3 + 1 AS expected, n_name AS book, r_name AS parish, coalesce(n_tables, 0) AS n_tables, n_rows, n_cols
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN per ON per.page = o_orderkey)"""
BUCKETS_SQL = """count(*) AS pages, CAST(sum(n_tables) AS BIGINT) AS tables, count(*) FILTER (n_tables = 0) AS pages_zero, count(*) FILTER (n_tables > expected AND n_tables > 0) AS pages_more,
  count(*) FILTER (n_tables < expected AND n_tables > 0) AS pages_fewer, count(*) FILTER (n_tables = expected) AS pages_as_expected"""


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_quantity").cast("long").alias("n_rows"), F.col("l_linenumber").alias("n_cols"))
    return stats.page_stats(lines, book_pages(spark, sf_dir), "page")


@query(f"WITH {PAGES_SQL} SELECT parish, book, {BUCKETS_SQL}, median(n_cols) AS median_cols, median(n_rows) AS median_rows, round(CAST(sum(n_tables) AS DOUBLE) / count(*), 4) AS tables_per_page FROM pages GROUP BY parish, book")
def page_table_stats(spark, sf_dir):
    """Statistics of each book."""
    out = _stats(spark, sf_dir).groupBy("parish", "book").agg(*stats.count_buckets(), F.median("n_cols").alias("median_cols"), F.median("n_rows").alias("median_rows"))
    return out.withColumn("tables_per_page", F.round(stats.ratio(F.col("tables").cast("double"), "pages"), 4))


@query(f"WITH {PAGES_SQL} SELECT parish, book, {BUCKETS_SQL} FROM pages GROUP BY ROLLUP (parish, book)")
def parish_rollup(spark, sf_dir):
    """D1 to D3 in one pass: books, parishes and the total."""
    return _stats(spark, sf_dir).rollup("parish", "book").agg(*stats.count_buckets())


@query(f"""WITH {PAGES_SQL}, l AS (SELECT *, CASE WHEN n_tables > 3 THEN 'more than two tables' WHEN n_tables <> expected THEN 'wrong number of tables' WHEN n_cols = page % 7 + 1 THEN 'correct'
  WHEN abs(n_cols - (page % 7 + 1)) < 2 THEN 'columns off by one' ELSE 'columns off by more than one' END AS label FROM pages)
SELECT book, label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY book), 6) AS percent FROM l GROUP BY book, label""")
def layout_labels(spark, sf_dir):
    """Agreement of pages with their layout, counted by book."""
    pages = _stats(spark, sf_dir)
    cols, want = F.array("n_cols"), F.array((F.col("page") % 7 + 1).cast("int"))
    label = layout.layout_label(F.when(F.col("n_tables") > 3, 3).otherwise(F.least("n_tables", F.lit(2))), F.when(F.col("n_tables") == F.col("expected"), F.least("n_tables", F.lit(2))).otherwise(-1), cols, want)
    counts = pages.withColumn("label", label).groupBy("book", "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("book")), 6))


@query("""WITH p AS (SELECT l_orderkey AS page, count(*) AS n, list(l_linenumber ORDER BY l_linenumber) AS cols FROM lineitem GROUP BY 1),
e AS (SELECT *, page % 2 + 1 AS want, page % 7 + 1 AS a, page % 5 + 1 AS b FROM p)
SELECT CASE WHEN n > 2 THEN 'more than two tables' WHEN n <> want THEN 'wrong number of tables' WHEN want = 1 AND cols[1] = a OR want = 2 AND cols[1] = a AND cols[2] = b THEN 'correct'
  WHEN abs(cols[1] - a) < 2 AND (want = 1 OR abs(cols[2] - b) < 2) THEN 'columns off by one' ELSE 'columns off by more than one' END AS label, want AS expected, count(*) AS n FROM e GROUP BY 1, 2""")
def layout_labels_of_two(spark, sf_dir):
    """Agreement of pages whose layout has one table or two, by the widths of all their tables."""
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("int").alias("w"))
    pages = lines.groupBy("page").agg(F.sort_array(F.collect_list("w")).alias("cols"))
    want = (F.col("page") % 2 + 1).cast("int")
    widths = F.slice(F.array((F.col("page") % 7 + 1).cast("int"), (F.col("page") % 5 + 1).cast("int")), F.lit(1), want)
    label = layout.layout_label(F.size("cols"), want, F.slice("cols", 1, 2), widths)
    return pages.select(label.alias("label"), want.cast("long").alias("expected")).groupBy("label", "expected").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_brand, p_type, n, rank FROM (SELECT p_brand, p_type, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS rank FROM part GROUP BY p_brand, p_type) WHERE rank <= 5")
def layout_topk(spark, sf_dir):
    """Most frequent layouts of each category."""
    return stats.top_per_group(load(spark, sf_dir, "part"), "p_brand", "p_type", 5)


@query("SELECT p_type, n, CAST(sum(n) OVER w AS BIGINT) AS running, round(sum(n) OVER w / sum(n) OVER (), 9) AS share FROM (SELECT p_type, count(*) AS n FROM part GROUP BY 1) WINDOW w AS (ORDER BY n DESC, p_type ROWS UNBOUNDED PRECEDING)")
def layout_cumulative(spark, sf_dir):
    """Cumulative histogram of layouts."""
    return stats.cumulative(load(spark, sf_dir, "part").select("p_type"), "p_type").withColumn("share", F.round("share", 9))


SPEC_SQL = "'Print ' || (p_partkey % 5) || ':' || (p_partkey % 50) || '-' || (p_partkey % 50 + p_size) || ', handrawn in, print ' || (p_partkey % 3) || ': 100-200'"
RANGES_SQL = f"""
parts AS (SELECT p_partkey, unnest(string_split(spec, ',')) AS part, generate_subscripts(string_split(spec, ','), 1) - 1 AS pos FROM (SELECT p_partkey, {SPEC_SQL} AS spec FROM part)),
fields AS (SELECT p_partkey, pos, lower(trim(split_part(part, ':', 1))) AS name, trim(split_part(part, ':', 2)) AS span FROM parts),
ranges AS (SELECT p_partkey, name, arg_max(coalesce(TRY_CAST(split_part(span, '-', 1) AS INTEGER), 0), pos) AS "start", arg_max(coalesce(TRY_CAST(split_part(span, '-', 2) AS INTEGER), 999999), pos) AS "end", min(pos) AS ord FROM fields GROUP BY 1, 2)"""


def _ranges(spark, sf_dir):
    k = F.col("p_partkey")
    s = lambda c: c.cast("string")
    spec = F.concat(F.lit("Print "), s(k % 5), F.lit(":"), s(k % 50), F.lit("-"), s(k % 50 + F.col("p_size")), F.lit(", handrawn in, print "), s(k % 3), F.lit(": 100-200"))
    return layout.book_ranges(load(spark, sf_dir, "part"), "p_partkey", spec)


@query(f'WITH {RANGES_SQL} SELECT p_partkey, name, "start", "end", CAST(ord AS INTEGER) AS ord FROM ranges')
def book_type_parse(spark, sf_dir):
    """Layouts and page ranges of a book from its annotation."""
    return _ranges(spark, sf_dir)


@query(f"""WITH {RANGES_SQL}, o AS (SELECT l_partkey AS p_partkey, l_orderkey, l_orderkey % 700 AS opening FROM lineitem GROUP BY 1, 2, 3),
j AS (SELECT o.*, name, ord, opening BETWEEN "start" AND "end" AS inside, "start" FROM o LEFT JOIN ranges USING (p_partkey))
SELECT p_partkey, l_orderkey, opening, name FROM j QUALIFY row_number() OVER (PARTITION BY p_partkey, l_orderkey, opening ORDER BY NOT inside, CASE WHEN inside THEN 0 ELSE abs("start" - opening) END, ord) = 1""")
def opening_type(spark, sf_dir):
    """The layout of an opening, by range or else the nearest start."""
    openings = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", (F.col("l_orderkey") % 700).alias("opening")).distinct()
    return layout.type_of_opening(openings, _ranges(spark, sf_dir), "p_partkey", "l_orderkey", "opening")


@query("""WITH f AS (SELECT o_orderkey, 'autods_' || lower(replace(o_orderpriority, '-', '_')) || '_muuttaneet_' || (1800 + o_orderkey % 99) || '-' || (1850 + o_orderkey % 99) || '_mko' || (o_custkey % 9) || '_' || (o_orderkey % 700) || CASE WHEN o_orderkey % 11 = 0 THEN '.jpg' ELSE '.xml' END AS name FROM orders),
p AS (SELECT o_orderkey, name, '^(?:autods_|mands-)([a-z_]+)_([a-z_]+)_(\\d{4}-\\d{4})_(.+)_(\\d+)\\.xml$' AS rx FROM f)
SELECT o_orderkey, nullif(regexp_extract(name, rx, 1), '') AS parish, nullif(regexp_extract(name, rx, 2), '') AS doctype, nullif(regexp_extract(name, rx, 3), '') AS year_range, nullif(regexp_extract(name, rx, 4), '') AS source,
  TRY_CAST(nullif(regexp_extract(name, rx, 5), '') AS INTEGER) AS page_number, (CAST(nullif(regexp_extract(name, '(\\d{4})-(\\d{4})', 1), '') AS DOUBLE) + CAST(nullif(regexp_extract(name, '(\\d{4})-(\\d{4})', 2), '') AS DOUBLE)) / 2 AS year_mean FROM p""")
def filename_meta(spark, sf_dir):
    """Fields of a file name."""
    k, s = F.col("o_orderkey"), lambda c: c.cast("string")
    name = F.concat(F.lit("autods_"), F.lower(F.replace("o_orderpriority", F.lit("-"), F.lit("_"))), F.lit("_muuttaneet_"), s(1800 + k % 99), F.lit("-"), s(1850 + k % 99), F.lit("_mko"), s(F.col("o_custkey") % 9), F.lit("_"), s(k % 700), F.when(k % 11 == 0, ".jpg").otherwise(".xml"))
    named = load(spark, sf_dir, "orders").select("o_orderkey", name.alias("name")).withColumn("m", t.file_meta("name"))
    return named.select("o_orderkey", "m.parish", "m.doctype", "m.year_range", "m.source", "m.page_number", t.year_mean(F.col("name")).alias("year_mean"))


@query("""SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN coalesce(last_value(CASE WHEN event_type <> 'error' THEN props END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE props END AS text FROM events""")
def ditto_resolve(spark, sf_dir):
    """E5: cells that say `same as above`."""
    same = F.col("event_type") == "error"
    return load(spark, sf_dir, "events").select("event_id", "user_id", grid.resolve_same_as(F.col("props"), same, F.lit(False), ["user_id"], ["event_id"]).alias("text"))


@query("""WITH e AS (SELECT event_id, user_id, CASE event_type WHEN 'view' THEN 'Do.' WHEN 'signup' THEN '---' ELSE event_type END AS x FROM events),
w AS (SELECT *, last_value(CASE WHEN x NOT IN ('Do.', '---', '') THEN x END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a FROM e)
SELECT event_id, user_id, CASE WHEN x = 'Do.' THEN coalesce(a, 'Not able to resolve: Do.') ELSE x END AS text FROM w""")
def ditto_unresolved(spark, sf_dir):
    """Dittos by pattern, with a mark where nothing stands above."""
    x = F.when(F.col("event_type") == "view", "Do.").when(F.col("event_type") == "signup", "---").otherwise(F.col("event_type"))
    rows = load(spark, sf_dir, "events").select("event_id", "user_id", x.alias("x"))
    return rows.select("event_id", "user_id", grid.repeat_column(F.col("x"), t.is_ditto("x"), ["user_id"], ["event_id"]).alias("text"))


CELLS_SQL = "cells AS (SELECT CAST(user_id % 50 AS BIGINT) AS tab, CAST(hour(ts) AS INTEGER) AS row, CAST(user_id // 50 % 10 AS INTEGER) AS col, min(event_type) AS text FROM events GROUP BY 1, 2, 3)"


def _cells(spark, sf_dir):
    events = load(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("tab"), F.hour("ts").alias("row"), (F.floor(F.col("user_id") / 50) % 10).cast("int").alias("col"), "event_type")
    return events.groupBy("tab", "row", "col").agg(F.min("event_type").alias("text"))


@query(f"""WITH {CELLS_SQL}, size AS (SELECT tab, max(row) AS r, max(col) AS c FROM cells GROUP BY tab), full_ AS (SELECT tab, r.generate_series AS row, c.generate_series AS col FROM size, generate_series(0, 23) r, generate_series(0, 9) c WHERE r.generate_series <= size.r AND c.generate_series <= size.c)
SELECT f.tab AS tab, CAST(f.row AS INTEGER) AS row, CAST(f.col AS INTEGER) AS col, coalesce(text, '') AS text FROM full_ f LEFT JOIN cells USING (tab, row, col)""")
def grid_densify(spark, sf_dir):
    """H4: a full grid from sparse cells."""
    return grid.densify(_cells(spark, sf_dir), ["tab"]).select("tab", "row", "col", "text")


@query(f"WITH {CELLS_SQL} SELECT tab, row, " + ", ".join(f"max(text) FILTER (col = {i}) AS c{i}" for i in range(10)) + " FROM cells GROUP BY tab, row")
def cells_pivot(spark, sf_dir):
    """H5: grid rows with a column for each cell."""
    return grid.to_wide(_cells(spark, sf_dir), ["tab"], 10)


@query("SELECT o_orderkey, item, text FROM (SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority FROM orders) UNPIVOT (text FOR item IN (status, priority))")
def cells_unpivot(spark, sf_dir):
    """H5: cells of wide rows."""
    rows = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return rows.unpivot("o_orderkey", ["status", "priority"], "item", "text")


@query(f"""WITH {CELLS_SQL}, lines AS (SELECT tab, row, '| ' || string_agg(text, ' | ' ORDER BY col) || ' |' AS l FROM cells GROUP BY 1, 2) SELECT tab, string_agg(l, chr(10) ORDER BY row) AS markdown FROM lines GROUP BY tab""")
def markdown_tables(spark, sf_dir):
    """Tables as Markdown."""
    return grid.markdown(grid.to_rows(_cells(spark, sf_dir), ["tab"]), ["tab"])


@query(f"""WITH {CELLS_SQL}, s AS (SELECT tab, col, coalesce(median(length(text)) FILTER (trim(text) <> ''), 0.0) AS score FROM cells GROUP BY 1, 2) SELECT tab, CAST(arg_max(col, score * 1000 - col) AS INTEGER) AS name_col, max(score) AS name_score FROM s GROUP BY tab""")
def name_column(spark, sf_dir):
    """The column of the longest texts."""
    return grid.name_column(_cells(spark, sf_dir), ["tab"])


OVERLAP = "greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y))"


@query(f"""WITH r AS ({RECTS_SQL}), p AS (SELECT page, list({{'ord': ord, 'x': x, 'y': y, 'w': w, 'h': h}} ORDER BY -(w * h), ord) AS ts FROM r GROUP BY page),
k AS (SELECT page, list_reduce(list_transform(ts, lambda t: [t]), lambda acc, u: CASE WHEN len(list_filter(acc, lambda z: {OVERLAP.format(a="z", b="u[1]")} > 0.3 * (u[1].w * u[1].h))) > 0 THEN acc ELSE list_concat(acc, u) END) AS kept FROM p)
SELECT page, CAST(u.ord AS INTEGER) AS ord FROM (SELECT page, unnest(kept) AS u FROM k)""")
def overlap_dedup(spark, sf_dir):
    """Larger tables hide smaller ones under them."""
    return tables.remove_overlapping(page_tables(spark, sf_dir), "page", "ord", F.col("r"), 0.3)


IOU_SQL = f"""r AS ({RECTS_SQL}), pairs AS (
  SELECT a.page AS page, a.ord AS i, b.ord AS j, {OVERLAP.format(a="a", b="b")} AS o, a.w * a.h + b.w * b.h AS s FROM r a JOIN r b ON a.page = b.page AND a.ord % 2 = 1 AND b.ord % 2 = 0),
lists AS (SELECT page, list({{'i': i, 'j': j, 'iou': CAST(o AS DOUBLE) / (s - o)}} ORDER BY -(CAST(o AS DOUBLE) / (s - o)), i, j) AS ps FROM pairs WHERE o > 0 GROUP BY page),
taken AS (SELECT page, unnest(list_reduce(list_transform(ps, lambda p: [p]), lambda acc, u: CASE WHEN len(list_filter(acc, lambda z: z.i = u[1].i OR z.j = u[1].j)) > 0 THEN acc ELSE list_concat(acc, u) END)) AS m FROM lists),
matches AS (SELECT r.page AS page, r.ord AS i, m.j AS j, coalesce(m.iou, 0.0) AS iou FROM r LEFT JOIN taken ON taken.page = r.page AND m.i = r.ord WHERE r.ord % 2 = 1)"""


def _matches(spark, sf_dir):
    rows = page_tables(spark, sf_dir).select("page", "ord", "r")
    return tables.match_greedy(rows.filter("ord % 2 = 1"), rows.filter("ord % 2 = 0"), "page")


@query(f"WITH {IOU_SQL} SELECT page, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(iou, 9) AS iou FROM matches")
def iou_match(spark, sf_dir):
    """Greedy matching of predicted with true tables."""
    return _matches(spark, sf_dir).withColumn("iou", F.round("iou", 9))


@query(f"""WITH {IOU_SQL}, n AS (SELECT count(*) FILTER (ord % 2 = 0) AS np FROM r) SELECT round(count(*) FILTER (j IS NOT NULL AND iou >= 0.1) / (SELECT np FROM n), 9) AS precision_, round(count(*) FILTER (j IS NOT NULL AND iou >= 0.1) / count(*), 9) AS recall_, round(sum(CASE WHEN iou >= 0.1 THEN iou ELSE 0 END) / count(*), 9) AS mean_iou FROM matches""")
def iou_pr(spark, sf_dir):
    """Precision, recall and mean IoU."""
    n = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.floor(F.count(F.lit(1)) / 2).alias("k")).agg(F.sum("k").alias("np"))
    p, r, m = tables.precision_recall(_matches(spark, sf_dir), F.count(F.lit(1)), F.first("np"), 0.1)
    return _matches(spark, sf_dir).join(F.broadcast(n)).agg(F.round(p, 9).alias("precision_"), F.round(r, 9).alias("recall_"), F.round(m, 9).alias("mean_iou"))


@query(f"""WITH r AS ({RECTS_SQL}), n AS (SELECT *, count(*) OVER (PARTITION BY page) AS c FROM r), l AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY x, ord) AS k FROM n),
p AS (SELECT a.page AS page, a.ord AS ord, a.x AS x, least(a.y, b.y) AS y, greatest(a.x + a.w, b.x + b.w) - a.x AS w, greatest(a.y + a.h, b.y + b.h) - least(a.y, b.y) AS h, a.l_linenumber + b.l_linenumber AS n_cols
  FROM l a JOIN l b ON a.page = b.page AND a.k = 1 AND b.k = 2 WHERE a.c = 2 AND a.page % 3 = 0 AND abs(a.x + a.w - b.x) < 200)
SELECT page, CAST(ord AS INTEGER) AS ord, x, y, w, h, CAST(n_cols AS INTEGER) AS n_cols, true AS merged FROM p UNION ALL SELECT page, CAST(ord AS INTEGER), x, y, w, h, CAST(l_linenumber AS INTEGER), false FROM r WHERE page NOT IN (SELECT page FROM p)""")
def merge_pairs(spark, sf_dir):
    """Two tables where one is expected become one if the gap between them is small."""
    rows = page_tables(spark, sf_dir).withColumn("expected", F.col("page") % 3 + 1).withColumnRenamed("l_linenumber", "n_cols")
    return tables.merge_separated(rows, "page", "expected", F.lit(1000))


@query(f"WITH r AS ({RECTS_SQL}) SELECT page, l_returnflag, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, count(*) AS n_cells FROM r GROUP BY 1, 2")
def row_boxes(spark, sf_dir):
    """The rectangle around the cells of each row."""
    return tables.boxes(page_tables(spark, sf_dir), "page", "l_returnflag")


@query(f"WITH r AS ({RECTS_SQL}) SELECT page, CAST(ord AS INTEGER) AS ord, CASE WHEN (x + w // 2) / 1000.0 < 0.4 THEN 'left' WHEN (x + w // 2) / 1000.0 > 0.6 THEN 'right' ELSE 'both' END AS side FROM r")
def page_side(spark, sf_dir):
    """The side of the opening on which a table lies."""
    return page_tables(spark, sf_dir).select("page", "ord", g.page_side(F.col("r"), F.lit(1000)).alias("side"))


@query(f"WITH r AS ({RECTS_SQL}), a AS (SELECT l_returnflag, degrees(atan2(h, w - 200)) - 90 AS a FROM r) SELECT l_returnflag, round(avg(a), 6) AS mean_, round(stddev_samp(a), 6) AS sd, round(min(a), 6) AS lo, round(max(a), 6) AS hi FROM a GROUP BY 1")
def angles_stats(spark, sf_dir):
    """Statistics of edge angles."""
    a = g.vertical_angle(F.lit(200), F.lit(0), F.col("w"), F.col("h"))
    return page_tables(spark, sf_dir).withColumn("a", a).groupBy("l_returnflag").agg(F.round(F.avg("a"), 6).alias("mean_"), F.round(F.stddev_samp("a"), 6).alias("sd"), F.round(F.min("a"), 6).alias("lo"), F.round(F.max("a"), 6).alias("hi"))


SIM = "CASE WHEN len(string_split({a}, ' ')) = 2 AND length({b}) > 3 AND ({b} = string_split({a}, ' ')[1] OR {b} = string_split({a}, ' ')[2]) THEN 1.0 ELSE 1 - CAST(levenshtein(lower({a}), lower({b})) AS DOUBLE) / greatest(length({a}), length({b}), 1) END"
NEAR_SQL = f"""n AS (SELECT p_partkey, p_brand, p_name, p_type, lag(p_type) OVER w AS before_, lead(p_type) OVER w AS after_ FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)),
s AS (SELECT p_partkey, p_brand, greatest({SIM.format(a="p_name", b="p_type")}, coalesce({SIM.format(a="p_name", b="before_")}, 0), coalesce({SIM.format(a="p_name", b="after_")}, 0)) AS similarity FROM n)"""


def _near(spark, sf_dir):
    best = extract.best_of_neighbours(F.col("p_name"), F.col("p_type"), ["p_brand"], "p_partkey")
    return load(spark, sf_dir, "part").select("p_partkey", "p_brand", best.alias("similarity"))


@query(f"WITH {NEAR_SQL} SELECT p_partkey, p_brand, round(similarity, 9) AS similarity FROM s")
def similarity_neighbors(spark, sf_dir):
    """The best similarity with the row and its neighbours."""
    return _near(spark, sf_dir).withColumn("similarity", F.round("similarity", 9))


@query(f"WITH {NEAR_SQL} SELECT p_brand, round(avg(similarity), 9) AS avg_similarity, round(avg(CAST(similarity = 1 AS INTEGER)), 9) AS exact, round(avg(CAST(similarity >= 0.4 AS INTEGER)), 9) AS over_04, round(avg(CAST(similarity >= 0.75 AS INTEGER)), 9) AS over_075, count(*) AS n FROM s GROUP BY p_brand")
def extraction_summary(spark, sf_dir):
    """Summary of extraction by item."""
    out = stats.item_summary(_near(spark, sf_dir), "p_brand", "similarity")
    return out.select("p_brand", *[F.round(c, 9).alias(c) for c in ("avg_similarity", "exact", "over_04", "over_075")], "n")


@query("""WITH p AS (SELECT p_name AS reference, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN upper(p_name) ELSE substr(p_name, 2) END AS prediction, CASE WHEN p_size % 7 = 0 THEN 'multi' WHEN regexp_matches(regexp_replace(p_name, '\\s+', '', 'g'), '^[0-9][0-9.,/-]*$') THEN 'numeric' ELSE 'text' END AS kind FROM part)
SELECT kind, round(sum(levenshtein(prediction, reference)) / sum(length(reference)), 9) AS cer, round(avg(CAST(prediction = reference AS INTEGER)), 9) AS exact, count(*) AS n FROM p GROUP BY kind""")
def cer_by_class(spark, sf_dir):
    """Character error rate and exact match by class."""
    k = F.col("p_partkey") % 3
    pred = F.when(k == 0, F.col("p_name")).when(k == 1, F.upper("p_name")).otherwise(F.substring("p_name", 2, 1000))
    kind = F.when(F.col("p_size") % 7 == 0, "multi").when(t.is_numeric(F.col("p_name")), "numeric").otherwise("text")
    out = stats.error_rates(load(spark, sf_dir, "part").select(F.col("p_name").alias("reference"), pred.alias("prediction"), kind.alias("kind")), "prediction", "reference", "kind")
    return out.select("kind", F.round("cer", 9).alias("cer"), F.round("exact", 9).alias("exact"), "n")


@query("SELECT p_partkey, lower(regexp_replace(p_name, '\\s+', '', 'g')) AS norm, lower(regexp_replace(p_name, '\\s+', '', 'g')) = lower(regexp_replace(upper(p_name), '\\s+', '', 'g')) AS same FROM part")
def exact_match_norm(spark, sf_dir):
    """Texts without white space and case."""
    return load(spark, sf_dir, "part").select("p_partkey", t.norm("p_name").alias("norm"), (t.norm("p_name") == t.norm(F.upper("p_name"))).alias("same"))


@query("""WITH h AS (SELECT p_partkey, (['Namn', 'Nimi', 'MP', 'vp', 'Hvarifrån kommen', 'Mihin', 'N:o', 'anmärkn'])[p_partkey % 8 + 1] || ' ' || p_size AS header FROM part)
SELECT p_partkey, header, CASE p_partkey % 8 WHEN 0 THEN 'name' WHEN 1 THEN 'name' WHEN 2 THEN 'male' WHEN 3 THEN 'female' WHEN 4 THEN 'parish' WHEN 5 THEN 'parish' ELSE 'unknown' END AS class FROM h""")
def header_classify(spark, sf_dir):
    """Classes of column headers."""
    names = F.array(*map(F.lit, ["Namn", "Nimi", "MP", "vp", "Hvarifrån kommen", "Mihin", "N:o", "anmärkn"]))
    header = F.concat_ws(" ", F.get(names, (F.col("p_partkey") % 8).cast("int")), F.col("p_size").cast("string"))
    return load(spark, sf_dir, "part").select("p_partkey", header.alias("header"), t.header_class(header).alias("class"))


@query("SELECT source, bool_or(length(trim(text)) > 0) AS has_text, count(*) FILTER (length(trim(text)) > 0) AS n FROM documents GROUP BY source")
def file_has_text(spark, sf_dir):
    """Files that hold any text."""
    has = F.length(F.trim("text")) > 0
    return load(spark, sf_dir, "documents").groupBy("source").agg(F.bool_or(has).alias("has_text"), F.count_if(has).alias("n"))


@query("SELECT doc_id, 'labelled' AS kind FROM documents SEMI JOIN labels USING (doc_id) UNION ALL SELECT o_orderkey, 'no table' FROM orders ANTI JOIN (SELECT l_orderkey AS o_orderkey FROM lineitem) USING (o_orderkey)")
def semi_anti_files(spark, sf_dir):
    """Rows with and without a partner."""
    labelled = load(spark, sf_dir, "documents").select("doc_id").join(load(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").withColumn("kind", F.lit("labelled"))
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return labelled.unionByName(orders.join(load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id")), "doc_id", "left_anti").withColumn("kind", F.lit("no table")))


@query("WITH b AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS batch FROM conversations) SELECT conv_id, batch, string_agg(text, ' | ' ORDER BY turn) AS texts FROM b GROUP BY 1, 2")
def row_batches(spark, sf_dir):
    """Rows in batches of fixed size."""
    rows = grid.batches(load(spark, sf_dir, "conversations"), ["conv_id"], "turn", 3)
    listed = F.sort_array(F.collect_list(F.struct("turn", "text")))
    return rows.groupBy("conv_id", "batch").agg(F.array_join(F.transform(listed, lambda x: x["text"]), " | ").alias("texts"))


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 2")
def head_per_table(spark, sf_dir):
    """First rows of each table."""
    return grid.head(load(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], 2)


@query("SELECT doc_id, lang FROM documents ORDER BY md5('42' || doc_id), doc_id LIMIT 50")
def det_sample(spark, sf_dir):
    """A sample that does not depend on partitions."""
    return grid.sample(load(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 50)


@query(f"WITH {PAGES_SQL} SELECT diff, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM (SELECT n_tables - expected AS diff FROM pages) GROUP BY diff")
def column_diff_hist(spark, sf_dir):
    """Distribution of differences."""
    counts = _stats(spark, sf_dir).groupBy((F.col("n_tables") - F.col("expected")).alias("diff")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("SELECT quality, count(*) FILTER (toxic = 0) AS toxic_0, count(*) FILTER (toxic = 1) AS toxic_1 FROM labels GROUP BY quality")
def confusion_matrix(spark, sf_dir):
    """Counts of true against predicted classes."""
    wide = load(spark, sf_dir, "labels").groupBy("quality").pivot("toxic", [0, 1]).agg(F.count(F.lit(1)))
    return wide.select("quality", *[F.coalesce(F.col(str(i)), F.lit(0)).alias(f"toxic_{i}") for i in (0, 1)])


@query("""WITH c AS (SELECT q.v AS class, count(*) FILTER (quality = q.v AND toxic = q.v) AS tp, count(*) FILTER (toxic = q.v) AS np, count(*) FILTER (quality = q.v) AS support FROM labels, (VALUES (0), (1)) q(v) GROUP BY q.v)
SELECT class, round(coalesce(tp / nullif(np, 0), 0), 9) AS precision, round(coalesce(tp / nullif(support, 0), 0), 9) AS recall, round(coalesce(2.0 * tp / nullif(np + support, 0), 0), 9) AS f1, support FROM c""")
def class_report(spark, sf_dir):
    """Precision, recall and F1 of each class."""
    out = stats.class_report(load(spark, sf_dir, "labels"), "quality", "toxic", [0, 1])
    return out.select("class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"""WITH {PAGES_SQL} SELECT page, CASE WHEN n_tables = expected THEN 'zip' WHEN expected = 1 THEN 'one for all' WHEN expected = 2 AND page % 2 = 0 THEN 'first for all' ELSE 'wrong number of tables' END AS branch, n_tables FROM pages""")
def standardize_union(spark, sf_dir):
    """Which annotation a page's tables take."""
    return _stats(spark, sf_dir).select("page", layout.standard_branch(F.col("n_tables"), F.col("expected"), F.col("page") % 2 == 0).alias("branch"), "n_tables")


@query("SELECT event_type, CAST(props->>'k' AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_items(spark, sf_dir):
    """Items of JSON records."""
    k = F.from_json("props", "k INT")["k"]
    return load(spark, sf_dir, "events").groupBy("event_type", k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH y AS (SELECT (year(o_orderdate) + year(o_orderdate) + o_orderkey % 9) / 2.0 AS m FROM orders) SELECT CAST(floor(m) AS BIGINT) AS year_, count(*) AS n, round(avg(m), 6) AS mean_ FROM y GROUP BY 1")
def year_histogram(spark, sf_dir):
    """Histogram of mean years."""
    y = F.year("o_orderdate")
    m = t.year_mean(F.concat_ws("-", y.cast("string"), (y + F.col("o_orderkey") % 9).cast("string")))
    return load(spark, sf_dir, "orders").groupBy(F.floor(m).alias("year_")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(m), 6).alias("mean_"))


@query("SELECT tag, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z0-9]+)', 1)) AS tag FROM pages) GROUP BY tag")
def html_scan(spark, sf_dir):
    """Elements of marked-up pages."""
    tags = load(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-z0-9]+)"), F.lit(1))).alias("tag"))
    per_page = tags.groupBy("tag", "page_id").agg(F.count(F.lit(1)).alias("c"))
    return per_page.groupBy("tag").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_pages"))


@query(f"""WITH r AS ({RECTS_SQL}) SELECT page, CAST(ord AS INTEGER) AS ord, (x + 5) || ',' || (y + 7) || ' ' || (x + w + 5) || ',' || (y + h + 7) AS points FROM r""")
def polygon_transform(spark, sf_dir):
    """Points from text, moved, and text again."""
    c = lambda a, b: F.concat_ws(",", F.col(a).cast("string") if isinstance(a, str) else a.cast("string"), F.col(b).cast("string") if isinstance(b, str) else b.cast("string"))
    text = F.concat_ws(" ", c("x", "y"), c(F.col("x") + F.col("w"), F.col("y") + F.col("h")))
    return page_tables(spark, sf_dir).select("page", "ord", g.points_text(g.shift(g.parse_points(text), F.lit(5), F.lit(7))).alias("points"))


@query()
def gmm_lines(spark, sf_dir):
    """Mixtures of one to four lines over cell places."""
    return stats.mixtures(page_tables(spark, sf_dir).select(F.col("x").cast("double").alias("x")), "x", 4)
