"""Queries of the catalogue, of statistics and of table repair, bound to the driver's tables, each with its SQL twin.

Roles: a nation is a book of the catalogue's first sheet, a fixed list of rows its second sheet; orders are tables of grids whose width
and texts come from their keys.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import book_stats, catalogue, extract, grid, layout, predict, repair, stats
from .archive import RECTS_SQL, load, page_tables, query

# ---- the catalogue -----------------------------------------------------------------------------

SPECS = ["Print 1:1-5, handrawn in:6-9", "print 2", "Halfbook, print 1: 3-4", "free text:1-2,print 3:2-6, other:7-8", "Print 2:4-6, handrawn out/in:20-30"]
SPEC_SQL = "[" + ", ".join(f"'{x}'" for x in SPECS) + "][n_nationkey % 5 + 1]"
#: Rows of the sheet of printed layouts: name, kind, direction, columns, headers.
SHEET = [
    ("Print 1", "one table", "in", "3", ["nro", " nimi", "mistä"]), ("print 2", "two tables", "out", "left 2", ["nimi", "mihin "]), (None, None, "both", "right 3", ["nimi", "mp", "muuttopaikka"]),
    ("print 3", "one table", "inside", "2.0", ["namn", None]), ("print 4", "one table", "in", "unknown", ["x"]), ("Print 1", "one table", "both", "2", ["nimi", "mistä"]),
]


def book_sheet(spark, sf_dir):
    k = F.col("n_nationkey")
    cells = {1: F.when(k != 20, F.col("n_name")), 4: (k * 3 % 11 + 1).cast("string"), 5: F.lit("muuttaneet"), 6: F.concat(F.lit("u"), k.cast("string")), 8: F.concat((1800 + k).cast("string"), F.lit("-1900")), 9: F.concat(F.lit("MKO"), F.col("n_regionkey").cast("string")), 17: F.lit("Muuttaneet")}
    spec = F.get(F.array(*map(F.lit, SPECS)), (k % 5).cast("int"))
    return load(spark, sf_dir, "nation").select((k + 2).alias("row_no"), F.array(*[spec if i in (18, 19) else cells.get(i, F.lit(None).cast("string")) for i in range(1, 20)]).alias("cells"))


BOOKS_SQL = f"""books AS (SELECT n_name || '_muuttaneet_' || (1800 + n_nationkey) || '-1900_mko' || n_regionkey AS book_id, n_name AS parish, CAST(n_nationkey * 3 % 11 + 1 AS INTEGER) AS images, 'muuttaneet' AS label, 'u' || n_nationkey AS url,
  (1800 + n_nationkey) || '-1900' AS years, 'mko' || n_regionkey AS source, 'muuttaneet' AS doctype, {SPEC_SQL} AS older_spec, {SPEC_SQL} AS spec FROM nation WHERE n_nationkey < 20)"""
NOTES_SQL = """notes AS (SELECT book_id, i AS note, trim(split_part(p, ':', 1)) AS layout, contains(p, ':') AS ranged, TRY_CAST(trim(split_part(split_part(p, ':', 2), '-', 1)) AS INTEGER) AS a, TRY_CAST(trim(split_part(split_part(p, ':', 2), '-', 2)) AS INTEGER) AS b
  FROM (SELECT book_id, unnest(string_split(lower(spec), ',')) AS p, generate_subscripts(string_split(spec, ','), 1) AS i FROM books)),
pages AS (SELECT book_id, CAST(unnest(range(1, images + 1)) AS INTEGER) AS page FROM books)"""


@query(f"WITH {BOOKS_SQL} SELECT * FROM books")
def catalogue_books(spark, sf_dir):
    """Books up to the first row without a parish."""
    return catalogue.books(book_sheet(spark, sf_dir))


def _type_sheet(spark):
    rows = [(i + 2, [name, kind, way, None, None, n, *heads, *[None] * (3 - len(heads))]) for i, (name, kind, way, n, heads) in enumerate(SHEET)]
    return spark.createDataFrame(rows, "row_no int, cells array<string>")


def _values(x):
    return "NULL" if x is None else "[" + ", ".join(map(_values, x)) + "]" if isinstance(x, list) else f"'{x}'" if isinstance(x, str) else str(x)


SHEET_SQL = f"""sheet AS (SELECT * FROM (VALUES {", ".join("(" + ", ".join(_values(v) for v in (i, *row)) + ")" for i, row in enumerate(SHEET))}) s(i, name, kind, way, n, heads)),"""
TYPES_OF_SQL = """wide AS (SELECT *, lead(way) OVER (ORDER BY i) AS way2, lead(n) OVER (ORDER BY i) AS n2, lead(heads) OVER (ORDER BY i) AS heads2 FROM sheet),
flat AS (SELECT i, lower(name) AS print_type, 0 AS ord, CASE kind WHEN 'one table' THEN 'opening' ELSE 'left' END AS page, way, n, heads FROM wide WHERE kind IS NOT NULL UNION ALL SELECT i, lower(name), 1, 'right', way2, n2, heads2 FROM wide WHERE kind = 'two tables'),
counted AS (SELECT *, TRY_CAST(trim(replace(replace(n, 'left', ''), 'right', '')) AS DOUBLE) AS k FROM flat),
whole AS (SELECT *, bool_and(k IS NOT NULL) OVER (PARTITION BY i) AS ok FROM counted),
numbered AS (SELECT *, max(CASE WHEN ok THEN i END) OVER (PARTITION BY print_type) AS last FROM whole),
types AS (SELECT print_type, CAST(ord AS INTEGER) AS ord, page, CASE WHEN way IN ('in', 'out', 'both', 'out abroad') THEN way ELSE '?' END AS direction, list_transform(heads[:CAST(k AS INTEGER)], lambda h: coalesce(trim(h), 'None')) AS headers FROM numbered WHERE ok AND i = last)"""


TYPES_SQL = f"{SHEET_SQL}\n{TYPES_OF_SQL}"
#: The same sheet with a row for each supplier: layouts repeat, kinds, directions and columns come from its key, a header from its nation.
WAYS, COUNTS = ["in", "out", "both", "inside", None], ["left 3", "right 2", "2.0", "unknown", "1", None, "3"]
SUPPLIER_SHEET_SQL = f"""sheet AS (SELECT s_suppkey AS i, CASE WHEN s_suppkey % 4 <> 2 THEN 'Print ' || s_suppkey % 37 END AS name, (['one table', 'two tables', NULL, 'one table'])[s_suppkey % 4 + 1] AS kind, ({_values(WAYS)})[s_suppkey % 5 + 1] AS way,
  ({_values(COUNTS)})[s_suppkey % 7 + 1] AS n, ['h' || s_nationkey, ' nimi ', CASE WHEN s_suppkey % 3 > 0 THEN 'mistä' END] AS heads FROM supplier),"""


@query(f"WITH {SUPPLIER_SHEET_SQL} {TYPES_OF_SQL} SELECT print_type, ord, page, direction, array_to_string(headers, '|') AS headers FROM types")
def catalogue_print_types(spark, sf_dir):
    """Printed layouts, two rows for two tables."""
    k = F.col("s_suppkey")
    of = lambda values, n: F.get(F.array(*[F.lit(v) if v is not None else F.lit(None).cast("string") for v in values]), (k % n).cast("int"))
    none = F.lit(None).cast("string")
    heads = [F.concat(F.lit("h"), F.col("s_nationkey").cast("string")), F.lit(" nimi "), F.when(k % 3 > 0, "mistä")]
    cells = F.array(F.when(k % 4 != 2, F.concat(F.lit("Print "), (k % 37).cast("string"))), of(["one table", "two tables", None, "one table"], 4), of(WAYS, 5), none, none, of(COUNTS, 7), *heads)
    sheet = load(spark, sf_dir, "supplier").select((k + 2).cast("int").alias("row_no"), cells.alias("cells"))
    return catalogue.print_types(sheet).withColumn("headers", F.array_join("headers", "|"))


@query(f"WITH {BOOKS_SQL}, {NOTES_SQL}, h AS (SELECT p.book_id, p.page, n.layout, n.note FROM pages p LEFT JOIN notes n ON n.book_id = p.book_id AND (NOT n.ranged OR p.page BETWEEN n.a AND n.b)) SELECT book_id, page, coalesce(arg_max(layout, note), 'unknown') AS layout, count(layout) > 1 AS overlaps FROM h GROUP BY book_id, page")
def catalogue_pages(spark, sf_dir):
    """The layout of every page of a book."""
    return catalogue.page_layouts(catalogue.books(book_sheet(spark, sf_dir)))


KNOWN_SQL = "(layout LIKE 'print %' OR layout LIKE 'handrawn%' OR layout LIKE 'halfbook%' OR layout LIKE 'free text%')"
STATISTICS_SQL = f"""{BOOKS_SQL}, {NOTES_SQL}, h AS (SELECT p.book_id, p.page, n.layout, n.note FROM pages p LEFT JOIN notes n ON n.book_id = p.book_id AND {KNOWN_SQL} AND (a IS NULL OR b IS NULL OR p.page BETWEEN n.a AND n.b)),
listed AS (SELECT parish || '_' || label || '_' || years || '_' || source || '_' || page || '.xml' AS file, coalesce(arg_max(layout, note), 'other layout') AS layout FROM h JOIN books USING (book_id) GROUP BY book_id, page, parish, label, years, source)"""


def _listed(spark, sf_dir):
    return catalogue.statistics_pages(catalogue.books(book_sheet(spark, sf_dir)))


@query(f"WITH {STATISTICS_SQL} SELECT file, layout FROM listed")
def catalogue_statistics_pages(spark, sf_dir):
    """Pages with their layout for annotation statistics."""
    return _listed(spark, sf_dir)


@query(f"""WITH {STATISTICS_SQL}, k AS (SELECT file, CASE WHEN layout LIKE 'print%' THEN 'print' WHEN layout LIKE 'handrawn%' THEN 'handrawn' WHEN layout LIKE 'halfbook%' THEN 'halfbook' WHEN layout LIKE 'free text%' THEN 'free text' ELSE 'other' END AS kind FROM listed),
p AS (SELECT kind, 'all' AS part FROM k UNION ALL SELECT kind, 'local' FROM k WHERE length(file) % 2 = 0 UNION ALL SELECT kind, 'annotated' FROM k WHERE length(file) % 3 = 0), n AS (SELECT count(*) FILTER (part = 'all') AS a, count(*) FILTER (part = 'local') AS l FROM p)
SELECT part, kind, count(*) AS n, round(100.0 * count(*) / CASE part WHEN 'annotated' THEN max(l) ELSE (CASE part WHEN 'local' THEN max(a) ELSE max(a) END) END, 2) AS percent FROM p, n GROUP BY part, kind""")
def annotation_counts(spark, sf_dir):
    """Pages, local files and annotated files by kind of layout."""
    pages = _listed(spark, sf_dir)
    return book_stats.annotation_counts(pages, pages.filter(F.length("file") % 2 == 0), pages.filter(F.length("file") % 3 == 0))


@query(f"""WITH {BOOKS_SQL}, {NOTES_SQL}, n AS (SELECT *, CASE WHEN ranged THEN a + 1 ELSE 1 END AS lo, CASE WHEN ranged THEN b ELSE images END AS hi FROM notes JOIN books USING (book_id) WHERE layout LIKE 'print%' AND (NOT ranged OR (a IS NOT NULL AND b IS NOT NULL))),
f AS (SELECT 'images/' || parish || '/' || label || '_' || years || '_' || source || '/' || parish || '_' || label || '_' || years || '_' || source || '_' || p || '.jpg' AS file, layout || CASE WHEN ranged THEN ':' || a || '-' || b ELSE '' END AS note FROM (SELECT *, unnest(range(lo, hi + 1)) AS p FROM n))
SELECT file, note FROM f WHERE file NOT LIKE '%_3.jpg'""")
def images_to_sample(spark, sf_dir):
    """Images of a layout without the excluded ones."""
    books = catalogue.books(book_sheet(spark, sf_dir))
    all_ = catalogue.pages_to_sample(books, "all printed")
    return catalogue.pages_to_sample(books, "all printed", all_.filter(F.col("file").endswith("_3.jpg")).select(F.col("file").alias("name")))


def _expected(spark, sf_dir):
    books = catalogue.books(book_sheet(spark, sf_dir))
    ranges = layout.book_ranges(books, "book_id", F.col("spec"))
    openings = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(load(spark, sf_dir, "nation"), "n_nationkey")
    book = F.concat("n_name", F.lit("_muuttaneet_"), (1800 + F.col("n_nationkey")).cast("string"), F.lit("-1900_mko"), F.col("n_regionkey").cast("string"))
    side = F.get(F.array(F.lit("left"), F.lit("right"), F.lit("both")), (F.col("c_custkey") % 3).cast("int"))
    pages = openings.select(book.alias("book_id"), F.col("c_custkey").alias("page"), (F.col("c_custkey") % 40).alias("opening"), side.alias("side"))
    return catalogue.page_expectations(pages, ranges, catalogue.print_types(_type_sheet(spark)), "book_id", "page", "opening", F.col("side"))


@query(f"""WITH {BOOKS_SQL}, {TYPES_SQL}, r AS (SELECT book_id, i, lower(trim(split_part(p, ':', 1))) AS name, coalesce(TRY_CAST(trim(split_part(split_part(p, ':', 2), '-', 1)) AS INTEGER), 0) AS a, coalesce(TRY_CAST(trim(split_part(split_part(p, ':', 2), '-', 2)) AS INTEGER), 999999) AS b FROM (SELECT book_id, unnest(string_split(spec, ',')) AS p, generate_subscripts(string_split(spec, ','), 1) AS i FROM books)),
o AS (SELECT c_custkey AS page, c_custkey % 40 AS opening, (['left', 'right', 'both'])[c_custkey % 3 + 1] AS side, n_name || '_muuttaneet_' || (1800 + n_nationkey) || '-1900_mko' || n_regionkey AS book_id FROM customer JOIN nation ON c_nationkey = n_nationkey),
m AS (SELECT o.*, name FROM o LEFT JOIN r USING (book_id) QUALIFY row_number() OVER (PARTITION BY page ORDER BY NOT (opening BETWEEN a AND b), CASE WHEN opening BETWEEN a AND b THEN 0 ELSE abs(a - opening) END, i) = 1),
g AS (SELECT print_type, count(*) AS k, arg_min(headers, ord) AS h1, arg_max(headers, ord) AS h2, arg_min(direction, ord) AS d1, arg_max(direction, ord) AS d2 FROM types GROUP BY 1)
SELECT book_id, page, opening, name AS layout, coalesce(contains(name, 'print'), false) AS printed, name IS NOT NULL AND (NOT contains(name, 'print') OR k IS NOT NULL) AS known, CAST(CASE WHEN contains(name, 'print') THEN k WHEN name IS NOT NULL THEN 1 END AS INTEGER) AS n_expected,
  CASE WHEN contains(name, 'print') THEN array_to_string(CASE side WHEN 'right' THEN h2 ELSE h1 END, '|') END AS headers, CASE WHEN contains(name, 'print') THEN CASE side WHEN 'right' THEN d2 ELSE d1 END ELSE regexp_extract(name, '\\b(in/out|out/in|in|out)$', 1) END AS direction
FROM m LEFT JOIN g ON print_type = name""")
def page_expectations(spark, sf_dir):
    """Headers, direction and number of tables that the catalogue expects on an opening."""
    return _expected(spark, sf_dir).drop("annotations").withColumn("headers", F.array_join("headers", "|"))


# ---- statistics of books -----------------------------------------------------------------------

BOOK_SQL = f"""
r AS ({RECTS_SQL}), pg AS (SELECT o_orderkey AS page, r_name AS parish, n_name AS book_id, CASE WHEN o_orderkey % 97 <> 0 THEN o_orderkey % 700 END AS opening, n_nationkey <> 7 AS known, CASE o_orderkey % 4 WHEN 1 THEN [4] WHEN 2 THEN [3, 5] END AS expected
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
u AS (SELECT *, known AND opening IS NOT NULL AS ok FROM pg),
tb AS (SELECT u.page, parish, book_id, expected, l_linenumber AS c, w // 8 AS q, row_number() OVER (PARTITION BY u.page ORDER BY CASE WHEN len(expected) = 2 THEN x ELSE 0 END, ord) AS pos, count(*) OVER (PARTITION BY u.page) AS n FROM u JOIN r USING (page) WHERE ok),
per AS (SELECT page, count(*) AS n, sum(c) AS cols, sum(q) AS rows_, count(*) FILTER (expected IS NOT NULL AND n = len(expected) AND c <> CASE len(expected) WHEN 1 THEN expected[1] ELSE expected[pos] END) AS bad,
  count(*) FILTER (expected IS NOT NULL AND n = len(expected) AND c > CASE len(expected) WHEN 1 THEN expected[1] ELSE expected[pos] END) AS over_, count(*) FILTER (expected IS NOT NULL AND n = len(expected) AND c < CASE len(expected) WHEN 1 THEN expected[1] ELSE expected[pos] END) AS under_ FROM tb GROUP BY page),
f AS (SELECT u.*, coalesce(n, 0) AS n, coalesce(cols, 0) AS cols, coalesce(rows_, 0) AS rows_, coalesce(bad, 0) AS bad, coalesce(over_, 0) AS over_, coalesce(under_, 0) AS under_, CASE WHEN ok THEN len(expected) END AS want FROM u LEFT JOIN per USING (page)),
sums AS (SELECT parish, book_id, CAST(sum(CAST(known AS INTEGER)) AS BIGINT) AS num_xml_files, CAST(sum(n) AS BIGINT) AS num_tables_total, CAST(sum(CASE WHEN want IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS num_tables_printed, CAST(sum(CASE WHEN want IS NULL THEN n ELSE 0 END) AS BIGINT) AS num_tables_handwritten,
  CAST(sum(cols) AS BIGINT) AS num_columns_total, CAST(sum(rows_) AS BIGINT) AS num_rows_total, count(*) FILTER (n = 0 AND want > 0) AS num_pages_zero_tables, count(*) FILTER (n > 0 AND n <> want) AS num_pages_wrong_non_zero_table_count, count(*) FILTER (n > 0 AND n > want) AS num_pages_more_tables_than_expected_non_zero,
  count(*) FILTER (n > 0 AND n < want) AS num_pages_fewer_tables_than_expected_non_zero, CAST(sum(bad) AS BIGINT) AS num_printed_tables_wrong_cols, CAST(sum(over_) AS BIGINT) AS num_printed_tables_more_cols_than_expected, CAST(sum(under_) AS BIGINT) AS num_printed_tables_fewer_cols_than_expected FROM f GROUP BY parish, book_id)"""
PAGE_SHARES = ", ".join(f"round({c} / nullif(num_xml_files, 0), 9) AS {c.replace('num_', 'perc_', 1)}" for c in book_stats.PAGE_RATIOS)


def _table_shares(none):
    return ", ".join(f"CASE WHEN num_tables_printed > 0 THEN round({c} / num_tables_printed, 9) WHEN num_xml_files > 0 THEN {none} END AS {c.replace('num_', 'perc_', 1)}" for c in book_stats.TABLE_RATIOS)


def _books(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")), "o_custkey")
    named = orders.join(load(spark, sf_dir, "nation"), "n_nationkey").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("o_orderkey")
    want = F.when(k % 4 == 1, F.array(F.lit(4))).when(k % 4 == 2, F.array(F.lit(3), F.lit(5)))
    pages = named.select(k.alias("page"), F.col("r_name").alias("parish"), F.col("n_name").alias("book_id"), F.when(k % 97 != 0, k % 700).alias("opening"), (F.col("n_nationkey") != 7).alias("known"), want.alias("expected"))
    tables = page_tables(spark, sf_dir).select("page", "x", "ord", F.col("l_linenumber").alias("n_cols"), (F.col("w") / 8).cast("long").alias("n_rows"))
    return book_stats.per_book(tables, pages)


@query(f"WITH {BOOK_SQL}, med AS (SELECT parish, book_id, median(c) AS median_columns_per_table, median(q) AS median_rows_per_table FROM tb GROUP BY 1, 2) SELECT sums.*, median_columns_per_table, median_rows_per_table, {PAGE_SHARES}, {_table_shares('0.0')} FROM sums LEFT JOIN med USING (parish, book_id)")
def book_statistics(spark, sf_dir):
    """The 24 fields of every book."""
    out = _books(spark, sf_dir)
    return out.select(*[F.round(c, 9).alias(c) if c.startswith("perc_") else c for c in out.columns])


@query(f"""WITH {BOOK_SQL}, lv AS (SELECT CASE WHEN grouping(parish) = 1 THEN 'Total' ELSE 'Parish' END AS level, parish, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in book_stats.COUNTS)} FROM sums GROUP BY ROLLUP (parish)) SELECT *, {PAGE_SHARES}, {_table_shares("NULL")} FROM lv""")
def level_statistics(spark, sf_dir):
    """Parishes and the total with their level."""
    out = book_stats.per_level(_books(spark, sf_dir))
    return out.select(*[F.round(c, 9).alias(c) if c.startswith("perc_") else c for c in out.columns])


CATEGORIES = ["free text", "halfbook", "handrawn", "print", "unknown"]


@query("""WITH p AS (SELECT (['free text', 'halfbook', 'handrawn', 'handrawn in', 'print 1', 'print 2', 'print 17', 'unknown', 'empty'])[l_partkey % 9 + 1] AS l FROM lineitem), q AS (SELECT CASE WHEN l IN ('free text', 'halfbook', 'handrawn') THEN l || ' misc' ELSE l END AS layout FROM p),
n AS (SELECT layout, count(*) AS n FROM q GROUP BY 1), c AS (SELECT category, layout, n FROM n, (VALUES ('free text'), ('halfbook'), ('handrawn'), ('print'), ('unknown')) k(category) WHERE starts_with(layout, category))
SELECT category, NULL AS layout, CAST(sum(n) AS BIGINT) AS n, round(sum(n) / (SELECT sum(n) FROM n) * 100, 2) AS percent, 0 AS rank FROM c GROUP BY category
UNION ALL SELECT category, layout, n, round(n / sum(n) OVER (PARTITION BY category) * 100, 2), CAST(row_number() OVER (PARTITION BY category ORDER BY n DESC, layout) AS INTEGER) FROM c QUALIFY row_number() OVER (PARTITION BY category ORDER BY n DESC, layout) <= 5""")
def layout_shares(spark, sf_dir):
    """Totals and most frequent layouts of every category, in percent."""
    names = F.array(*map(F.lit, ["free text", "halfbook", "handrawn", "handrawn in", "print 1", "print 2", "print 17", "unknown", "empty"]))
    pages = load(spark, sf_dir, "lineitem").select(F.get(names, (F.col("l_partkey") % 9).cast("int")).alias("layout"))
    return book_stats.layout_shares(pages, "layout", CATEGORIES)


@query("WITH l AS (SELECT CASE WHEN turn % 5 = 0 THEN ' ? ' WHEN turn % 7 = 0 THEN '' ELSE text END AS text FROM conversations) SELECT count(*) FILTER (length(trim(text)) > 0 AND trim(text) <> '?') AS text_lines, count(*) FILTER (trim(text) = '?') AS unclear_lines FROM l")
def line_counts(spark, sf_dir):
    """Lines with text and unclear ones."""
    text = F.when(F.col("turn") % 5 == 0, " ? ").when(F.col("turn") % 7 == 0, "").otherwise(F.col("text"))
    return book_stats.line_counts(load(spark, sf_dir, "conversations").select(text.alias("text")))


# ---- repair ------------------------------------------------------------------------------------

HEADS = [["nimi", "mp"], ["nro", "nimi", "mp"], ["nimi", "mp", "vp", "mihin"], ["nro", "pvm", "nimi", "mp", "vp"], ["nro", "mp"]]
NAME_AT = [next((i for i, h in enumerate(hs) if h == "nimi"), None) for hs in HEADS]
GRID_SQL = f"""
cells AS (SELECT o_orderkey AS tab, CAST(r.row AS INTEGER) AS row, CAST(c.col AS INTEGER) AS col, CASE WHEN o_orderkey % 10 = 0 THEN '' WHEN c.col = o_orderkey % 3 THEN 'Anna ' || o_custkey WHEN c.col < o_orderkey % 3 AND o_custkey % 2 = 0 THEN '' WHEN c.col >= 2 AND o_custkey % 3 = 0 THEN '' ELSE 'z' END AS text
  FROM orders, range(0, 2) r(row), range(0, 7) c(col) WHERE c.col < 3 + o_orderkey % 4),
plans AS (SELECT o_orderkey AS tab, ([{", ".join(str(len(h)) for h in HEADS)}])[o_orderkey % 5 + 1] AS expected, ([{", ".join("NULL" if n is None else str(n) for n in NAME_AT)}])[o_orderkey % 5 + 1] AS name_at FROM orders),
score AS (SELECT tab, col, coalesce(median(length(text)) FILTER (trim(text) <> ''), 0.0) AS s, bool_and(text = '') AS empty FROM cells GROUP BY tab, col),
best AS (SELECT tab, col AS name_col FROM score WHERE s >= 2 QUALIFY row_number() OVER (PARTITION BY tab ORDER BY s DESC, col) = 1),
size AS (SELECT tab, max(col) + 1 AS n, bool_and(text = '') AS blank FROM cells GROUP BY tab)"""


def _grids(spark, sf_dir):
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    places = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("row")).select("*", F.explode(F.sequence(F.lit(0), (2 + k % 4).cast("int"))).alias("col"))
    text = F.when(k % 10 == 0, "").when(F.col("col") == k % 3, F.concat(F.lit("Anna "), cust.cast("string"))).when((F.col("col") < k % 3) & (cust % 2 == 0), "").when((F.col("col") >= 2) & (cust % 3 == 0), "").otherwise("z")
    plans = load(spark, sf_dir, "orders").select(k.alias("tab"), F.get(F.array(*[F.array(*map(F.lit, h)) for h in HEADS]), (k % 5).cast("int")).alias("headers"))
    return places.select(k.alias("tab"), "row", "col", text.alias("text")), plans


@query(f"WITH {GRID_SQL}, wrong AS (SELECT tab, expected FROM size JOIN plans USING (tab) WHERE blank AND n <> expected) SELECT * FROM cells WHERE tab NOT IN (SELECT tab FROM wrong) UNION ALL SELECT tab, 0, CAST(unnest(range(0, expected)) AS INTEGER), '' FROM wrong")
def match_empty_tables(spark, sf_dir):
    """Empty tables take the width of their layout."""
    return repair.match_empty(*_grids(spark, sf_dir), ["tab"])


@query(f"""WITH {GRID_SQL}, w AS (SELECT tab, n, greatest(0, name_col - name_at) AS l, greatest(0, n - expected - greatest(0, name_col - name_at)) AS r FROM size JOIN plans USING (tab) JOIN best USING (tab) WHERE n > expected AND name_at IS NOT NULL),
parts AS (SELECT tab, col, empty, 'l' AS p FROM score JOIN w USING (tab) WHERE col < l UNION ALL SELECT tab, col, empty, 'r' FROM score JOIN w USING (tab) WHERE col >= n - r),
gone AS (SELECT DISTINCT tab, col FROM (SELECT tab, col, bool_and(empty) OVER (PARTITION BY tab, p ORDER BY col ROWS UNBOUNDED PRECEDING) AS run FROM parts) WHERE run)
SELECT tab, row, CAST(dense_rank() OVER (PARTITION BY tab ORDER BY col) - 1 AS INTEGER) AS col, text FROM cells ANTI JOIN gone USING (tab, col)""")
def remove_surplus_columns(spark, sf_dir):
    """Empty columns at the sides go, with the column of names as anchor, each table by its own layout."""
    return repair.remove_surplus(*_grids(spark, sf_dir), ["tab"])


@query(f"""WITH {GRID_SQL}, w AS (SELECT tab, n, expected, name_at - name_col AS pad FROM size JOIN plans USING (tab) JOIN best USING (tab) WHERE n < expected AND name_at IS NOT NULL AND name_col <= name_at AND n + name_at - name_col <= expected)
SELECT c.tab AS tab, row, CAST(col + coalesce(pad, 0) AS INTEGER) AS col, text FROM cells c LEFT JOIN w ON w.tab = c.tab UNION ALL SELECT tab, row, CAST(c AS INTEGER), '' FROM (SELECT tab, unnest(range(0, expected)) AS c, pad, n FROM w) JOIN (SELECT DISTINCT tab, row FROM cells) USING (tab) WHERE c < pad OR c >= pad + n""")
def pad_tables(spark, sf_dir):
    """Missing columns are added so that the names stand in their place."""
    return repair.pad(*_grids(spark, sf_dir), ["tab"])


@query(f"WITH {GRID_SQL}, m AS (SELECT tab, col, max(length(text)) AS k FROM cells GROUP BY 1, 2) SELECT tab, CAST(CASE WHEN max(k) > 0 THEN arg_max(col, k * 100 - col) ELSE -1 END AS INTEGER) AS col FROM m GROUP BY tab")
def longest_columns(spark, sf_dir):
    """The column of the longest text."""
    return repair.longest_column(_grids(spark, sf_dir)[0], ["tab"])


@query(f"WITH {GRID_SQL}, d AS (SELECT tab, row, col - CASE WHEN col > 1 THEN 1 ELSE 0 END AS col, text FROM cells WHERE col <> 1), n AS (SELECT tab, max(col) + 1 AS n FROM d GROUP BY tab) SELECT tab, row, CAST(col + 1 AS INTEGER) AS col, text FROM d UNION ALL SELECT DISTINCT tab, row, 0, '' FROM d UNION ALL SELECT DISTINCT tab, row, CAST(n + 1 AS INTEGER), '' FROM d JOIN n USING (tab)")
def edit_columns(spark, sf_dir):
    """Columns deleted and inserted."""
    cells = repair.delete_columns(_grids(spark, sf_dir)[0], ["tab"], F.array(F.lit(1), F.lit(50)))
    return repair.insert_empty_columns(cells, ["tab"], [0, 99])


@query(f"WITH {GRID_SQL}, i AS (SELECT tab, CASE WHEN row >= 1 THEN row + 1 ELSE row END AS row, col, text FROM cells WHERE tab % 4 = 0 UNION ALL SELECT DISTINCT tab, 1, c, (['a', 'b', 'c'])[c + 1] FROM cells, (VALUES (0), (1), (2)) v(c) WHERE tab % 4 = 0) SELECT tab, CAST(row - 1 AS INTEGER) AS row, CAST(col AS INTEGER) AS col, CASE WHEN row = 2 AND col = 0 THEN 'set' ELSE text END AS text FROM i WHERE row <> 0")
def edit_rows(spark, sf_dir):
    """Rows inserted and removed, a cell set."""
    cells = _grids(spark, sf_dir)[0].filter("tab % 4 = 0")
    return repair.set_cell(repair.remove_row(repair.insert_row(cells, ["tab"], 1, ["a", "b", "c"]), ["tab"], 0), 1, 0, "set")


TEXTS_SQL = f"r AS ({RECTS_SQL}), cells AS (SELECT page, CAST(ord AS INTEGER) AS ord, CAST(r2.row AS INTEGER) AS row, CAST(c.col AS INTEGER) AS col, ord || '-' || r2.row || '-' || c.col AS text, l_linenumber AS n FROM r, range(0, 2) r2(row), range(0, 7) c(col) WHERE c.col < l_linenumber AND r2.row < 1 + l_linenumber % 2)"


@query(f"""WITH {TEXTS_SQL}, k AS (SELECT *, count(*) OVER (PARTITION BY page) AS c, row_number() OVER (PARTITION BY page ORDER BY x, ord) AS k FROM r),
m AS (SELECT a.page AS page, a.ord AS a, b.ord AS b, a.l_linenumber AS n FROM k a JOIN k b ON a.page = b.page AND a.k = 1 AND b.k = 2 WHERE a.c = 2 AND a.page % 3 = 0 AND abs(a.x + a.w - b.x) < 200)
SELECT c.page AS page, CAST(CASE WHEN c.ord = b THEN a ELSE c.ord END AS INTEGER) AS ord, row, CAST(CASE WHEN c.ord = b THEN col + m.n ELSE col END AS INTEGER) AS col, text FROM cells c LEFT JOIN m ON m.page = c.page""")
def merge_table_cells(spark, sf_dir):
    """The cells of two halves of one table side by side."""
    rows = page_tables(spark, sf_dir).withColumns({"expected": F.col("page") % 3 + 1, "page_width": F.lit(1000)})
    cells = rows.select("page", "ord", "l_linenumber", F.explode(F.sequence(F.lit(0), (F.col("l_linenumber") % 2).cast("int"))).alias("row")).select("*", F.explode(F.sequence(F.lit(0), F.col("l_linenumber").cast("int") - 1)).alias("col"))
    return repair.merge_cells(cells.select("page", "ord", "row", "col", F.concat_ws("-", "ord", "row", "col").alias("text")), rows, "page", "ord")


@query(f"""WITH {GRID_SQL}, s AS (SELECT tab, n, tab % 3 AS g FROM size), c AS (SELECT g, n, count(*) AS k FROM s GROUP BY 1, 2), m AS (SELECT g, n FROM c QUALIFY row_number() OVER (PARTITION BY g ORDER BY k DESC, n) = 1) SELECT tab, CAST(n AS INTEGER) AS n_cols FROM s SEMI JOIN m USING (g, n)""")
def common_widths(spark, sf_dir):
    """Tables of the most common width of their group."""
    sizes = _grids(spark, sf_dir)[0].groupBy("tab").agg((F.max("col") + 1).cast("int").alias("n_cols")).withColumn("g", F.col("tab") % 3)
    return predict.common_width(sizes, "g").select("tab", "n_cols")


# ---- predicates and evaluation -----------------------------------------------------------------

SAMPLES = ["", "12 345", "12.3-4/5", "-12", "12 Main", " 7 ", " - ", "-", "_", '"', ' " ', '""', "Do.", " d ", "Dox", "S", " s. ", "5", "5.", "?", "Anna ?", "é", "nan", "sm."]
SAMPLES_SQL = "(SELECT p_partkey, list_value(" + ", ".join(f"'{x}'" for x in SAMPLES) + ")[p_partkey % 24 + 1] AS a FROM part)"


def _samples(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", F.get(F.array(*map(F.lit, SAMPLES)), (F.col("p_partkey") % 24).cast("int")).alias("a"))


@query(f"""SELECT p_partkey, regexp_matches(regexp_replace(a, '\\s+', '', 'g'), '^[0-9.,/-]+$') AND regexp_matches(regexp_replace(a, '\\s+', '', 'g'), '^[0-9]') AS numeric, length(regexp_replace(a, '\\s+', '', 'g')) = 1 AND NOT regexp_matches(regexp_replace(a, '\\s+', '', 'g'), '[A-Za-z0-9_"é]') AS special,
  regexp_replace(a, '\\s+', '', 'g') IN ('"', 'D', 'D.', 'Do', 'Do.', 'd', 'd.', 'do', 'do.') AS narrow, trim(a) IN ('"', 'S', 's.', 's', '5', '5.') AS literal, contains(a, '?') AS unsure FROM {SAMPLES_SQL}""")
def text_predicates(spark, sf_dir):
    """Classes of annotated texts."""
    a = F.col("a")
    return _samples(spark, sf_dir).select("p_partkey", t.is_numeric(a).alias("numeric"), t.is_special_only(a).alias("special"), t.is_ditto_narrow(a).alias("narrow"), t.is_ditto_literal(a).alias("literal"), a.contains("?").alias("unsure"))


@query(f"""WITH s AS (SELECT trim(a) AS a, CASE p_partkey % 3 WHEN 0 THEN trim(a) WHEN 1 THEN 'x' ELSE trim(a) || '1' END AS p FROM {SAMPLES_SQL} WHERE NOT contains(a, '?') AND a <> 'é'), k AS (SELECT *, regexp_replace(a, '\\s+', '', 'g') AS z FROM s),
c AS (SELECT *, CASE WHEN a = '' THEN 'empty' WHEN regexp_matches(z, '^[0-9][0-9.,/-]*$') THEN 'numeric' WHEN length(z) = 1 AND NOT regexp_matches(z, '[A-Za-z0-9_"]') THEN 'special' WHEN z IN ('"', 'D', 'D.', 'Do', 'Do.', 'd', 'd.', 'do', 'do.') THEN 'same-as' ELSE 'text' END AS kind FROM k)
SELECT coalesce(kind, 'all') AS kind, round(sum(levenshtein(p, a)) / nullif(sum(length(a)), 0), 9) AS cer, round(avg(CAST(p = a AS INTEGER)), 9) AS exact, count(*) AS n FROM c GROUP BY GROUPING SETS ((kind), ())""")
def cer_report(spark, sf_dir):
    """Error rates of all pairs and of each class, without unsure ones."""
    a, k = t.strip("a"), F.col("p_partkey") % 3
    pairs = _samples(spark, sf_dir).filter(~F.col("a").contains("?") & (F.col("a") != "é")).select(a.alias("a"), F.when(k == 0, a).when(k == 1, "x").otherwise(F.concat(a, F.lit("1"))).alias("p"))
    out = stats.error_report(pairs, "p", "a", t.annotation_class(F.col("a")))
    return out.select("kind", F.round("cer", 9).alias("cer"), F.round("exact", 9).alias("exact"), "n")


TRUTH_SQL = f"""{GRID_SQL}, ann AS (SELECT tab, item, col, pos FROM (SELECT DISTINCT tab FROM cells), (VALUES ('person_name', 2, 0), ('person_name', 1, 1), ('parish', 0, 0), ('date', 9, 0)) v(item, col, pos)),
kept AS (SELECT tab, row, item, pos, CASE WHEN trim(text) <> '' AND lower(trim(text)) <> 'nan' THEN trim(text) END AS x FROM cells JOIN ann USING (tab, col)),
truth AS (SELECT tab, row, item, coalesce(string_agg(x, ' ' ORDER BY pos), '') AS truth FROM kept GROUP BY 1, 2, 3)"""


def _truths(spark, sf_dir):
    cells = _grids(spark, sf_dir)[0]
    listed = F.array(*[F.struct(F.lit(i).alias("item"), F.array(*map(F.lit, c)).alias("columns")) for i, c in (("person_name", [2, 1]), ("parish", [0]), ("date", [9]))])
    ann = cells.select("tab").distinct().select("tab", F.explode(listed).alias("x")).select("tab", "x.*")
    return extract.concat_columns(cells, ann, ["tab"])


@query(f"WITH {TRUTH_SQL} SELECT * FROM truth")
def annotated_truth(spark, sf_dir):
    """C17: the texts of the columns an annotation lists, without empty cells."""
    return _truths(spark, sf_dir)


SIM2 = "CASE WHEN len(string_split(e, ' ')) = 2 AND length({b}) > 3 AND ({b} = string_split(e, ' ')[1] OR {b} = string_split(e, ' ')[2]) THEN 1.0 ELSE 1 - CAST(levenshtein(lower(trim(e)), lower(trim({b}))) AS DOUBLE) / greatest(length(e), length({b}), 1) END"


@query(f"""WITH {TRUTH_SQL}, near AS (SELECT *, lag(truth) OVER w AS b, lead(truth) OVER w AS a FROM truth WINDOW w AS (PARTITION BY tab, item ORDER BY row)),
rec AS (SELECT tab, row, item, trim(CASE item WHEN 'person_name' THEN ' Anna ' || tab % 100 WHEN 'parish' THEN 'z ' ELSE '' END) AS e FROM truth WHERE item <> 'date'),
s AS (SELECT tab, near.row AS row, item, e, truth, b, a, {SIM2.format(b="truth")} AS s0, coalesce({SIM2.format(b="b")}, -1) AS s1, coalesce({SIM2.format(b="a")}, -1) AS s2 FROM near JOIN rec USING (tab, row, item)), g AS (SELECT *, greatest(s0, s1, s2) AS s FROM s)
SELECT item, count(*) AS n, round(avg(s), 9) AS avg_similarity, round(avg(CAST(s = 1 AS INTEGER)), 9) AS exact, round(avg(CAST(s >= 0.4 AS INTEGER)), 9) AS over_04, round(avg(CAST(s >= 0.75 AS INTEGER)), 9) AS over_075, round(avg(length(CASE WHEN s0 = s THEN truth WHEN s1 = s THEN b ELSE a END)), 9) AS truth_length FROM g GROUP BY item""")
def extraction_evaluation(spark, sf_dir):
    """C17, C18, D13, I1 to I3, M: records scored against the row and its neighbours."""
    cells, _ = _grids(spark, sf_dir)
    data = F.create_map(F.lit("person_name"), F.concat(F.lit("Anna "), (F.col("tab") % 100).cast("string")), F.lit("parish_from"), F.lit("z"), F.lit("parish_to"), F.lit("None"), F.lit("date_original"), F.lit(None).cast("string"))
    records = cells.select("tab", "row").distinct().withColumn("extracted_data", data)
    scores = extract.score_records(records, _truths(spark, sf_dir), ["tab"])
    share = lambda c: F.round(F.avg(F.col(c).cast("int")), 9).alias(c)
    return scores.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("similarity"), 9).alias("avg_similarity"), share("exact"), share("over_04"), share("over_075"), F.round(F.avg(F.length("truth")), 9).alias("truth_length"))


PRINTED_SQL = f"""{TEXTS_SQL.replace("l_linenumber AS n FROM", "l_linenumber AS n, count(*) OVER (PARTITION BY page, ord, r2.row) AS w, dense_rank() OVER (PARTITION BY page ORDER BY ord) AS nth FROM")},
lines AS (SELECT page, ord, row, nth, list(text ORDER BY col) AS texts FROM cells GROUP BY page, ord, row, nth), cnt AS (SELECT page, count(DISTINCT ord) AS k FROM lines GROUP BY page),
b AS (SELECT *, CASE WHEN page % 5 = 0 THEN 0 WHEN page % 5 = 1 THEN 1 ELSE 2 END AS na, page % 5 IN (2, 3) AS same FROM lines JOIN cnt USING (page)),
d AS (SELECT *, CASE WHEN na = 0 THEN 'not implemented' WHEN k = na THEN 'zip' WHEN na = 1 THEN 'one' WHEN same THEN 'first' ELSE 'wrong number of tables' END AS br FROM b),
h AS (SELECT *, CASE WHEN br IN ('zip', 'one', 'first') THEN CASE WHEN br = 'zip' AND nth = 2 AND NOT same THEN 2 ELSE 1 END END AS ai FROM d)"""


@query(f"""WITH {PRINTED_SQL} SELECT page, ord, row, CASE WHEN na = 0 THEN 'not implemented' WHEN ai IS NULL THEN 'wrong number of tables' WHEN len(texts) <> 3 THEN 'wrong number of columns' ELSE 'ok' END AS log,
  CASE WHEN na = 0 THEN 'unknown' WHEN ai IS NULL THEN 'unknown' WHEN ai = 2 THEN 'out' ELSE 'in' END AS direction, CASE WHEN ai = 1 AND len(texts) = 3 THEN texts[3] END AS moved_from, CASE WHEN ai = 2 AND len(texts) = 3 THEN texts[2] END AS moved_to FROM h
UNION ALL SELECT o_orderkey, NULL, NULL, 'no predicted tables', 'unknown', NULL, NULL FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def standardized_rows(spark, sf_dir):
    """Rows of pages in standard form, by the annotation that fits each table."""
    rows = page_tables(spark, sf_dir)
    cells = rows.select("page", "ord", "l_linenumber", F.explode(F.sequence(F.lit(0), (F.col("l_linenumber") % 2).cast("int"))).alias("row"))
    lines = cells.select("page", "ord", "row", F.transform(F.sequence(F.lit(0), F.col("l_linenumber").cast("int") - 1), lambda c: F.concat_ws("-", "ord", "row", c.cast("string"))).alias("texts"))
    one = lambda way, heads: F.struct(F.lit(way).alias("direction"), F.array(*map(F.lit, heads)).alias("headers"))
    first, second = one("in", ["nimi", "mp", "mistä"]), one("out", ["nimi", "mihin", "mp"])
    k = F.col("page") % 5
    annotations = F.when(k == 1, F.array(first)).when(k.isin(2, 3), F.array(first, first)).when(k == 4, F.array(first, second))
    pages = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page")).select("page", F.lit("x").alias("layout"), annotations.alias("annotations"))
    out = layout.standardize(lines, pages, "page", "ord")
    return out.select("page", "ord", "row", "log", "direction", "moved_from", "moved_to")


@query("SELECT doc_id % 7 AS run, CAST(sum(length(text)) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(CASE WHEN doc_id % 2 = 0 THEN 3 END), 0) AS BIGINT) AS completion_tokens FROM documents GROUP BY 1")
def token_usage(spark, sf_dir):
    """Tokens of model calls by run."""
    calls = load(spark, sf_dir, "documents").select((F.col("doc_id") % 7).alias("run"), F.length("text").alias("prompt_tokens"), F.when(F.col("doc_id") % 2 == 0, 3).alias("completion_tokens"))
    out = predict.token_usage(calls, "run")
    return out.select("run", *[F.col(c).cast("long").alias(c) for c in ("prompt_tokens", "completion_tokens")])


@query("SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY md5('42' || turn), turn) = 1")
def one_table_per_opening(spark, sf_dir):
    """One table of each opening."""
    return predict.one_table_per_opening(load(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], "turn")


@query("SELECT source, min(doc_id) AS first_doc, count(*) AS n FROM documents WHERE contains(lower(text), 'the') GROUP BY source")
def text_search(spark, sf_dir):
    """Documents that hold a text, and the first one."""
    hits = load(spark, sf_dir, "documents").filter(F.lower("text").contains("the"))
    return hits.groupBy("source").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n"))


@query("WITH d AS (SELECT text, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1) SELECT md5(text) AS digest, n FROM d")
def repeated_rows(spark, sf_dir):
    """H3: rows that occur more than once."""
    return grid.repeated(load(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.md5("text").alias("digest")), ["digest"])
