"""Queries of page geometry, regions and keypoints, bound to the driver's tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from ..operators import deskew, lines, predict, regions, straighten
from ..sources import files, records
from .archive import OVERLAP, RECTS_SQL, load, page_tables, query

IOU = OVERLAP.replace("{a}", "p").replace("{b}", "q")
BOXES_SQL = f"r AS ({RECTS_SQL}), a AS (SELECT page, ord, x, y, w, h FROM r WHERE ord % 2 = 1), b AS (SELECT page, ord, x, y, w, h FROM r WHERE ord % 2 = 0)"


def _two(spark, sf_dir):
    rows = page_tables(spark, sf_dir).select("page", "ord", "r")
    return rows.filter("ord % 2 = 1"), rows.filter("ord % 2 = 0")


@query(f"""WITH {BOXES_SQL}, pr AS (SELECT p.page AS page, p.ord AS i, q.ord AS j, CAST({IOU} AS DOUBLE) / (p.w * p.h + q.w * q.h - {IOU}) AS iou FROM a p JOIN b q ON p.page = q.page WHERE {IOU} > 0),
m AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY page, i ORDER BY iou DESC, j) = 1)
SELECT m.page AS page, CASE WHEN iou > 0.2 THEN 'both' ELSE 'first' END AS kind, CAST(i AS INTEGER) AS i, CAST(CASE WHEN iou > 0.2 THEN j END AS INTEGER) AS j, CASE WHEN iou > 0.2 THEN least(p.x, q.x) ELSE p.x END AS x, CASE WHEN iou > 0.2 THEN greatest(p.y + p.h, q.y + q.h) ELSE p.y + p.h END AS bottom
FROM m JOIN a p ON p.page = m.page AND p.ord = i JOIN b q ON q.page = m.page AND q.ord = j
UNION ALL SELECT page, 'second', NULL, CAST(ord AS INTEGER), x, y + h FROM b WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.page = b.page AND pr.j = b.ord)""")
def ensemble_boxes(spark, sf_dir):
    """Boxes of two detectors put together."""
    out = regions.ensemble(*_two(spark, sf_dir), "page", 0.2)
    return out.select("page", "kind", "i", "j", F.col("r.x").alias("x"), F.expr("r.y + r.h").alias("bottom"))


@query(f"""WITH {BOXES_SQL}, m AS (SELECT p.page AS page, p.ord AS line, q.ord AS region, {IOU} AS o FROM a p LEFT JOIN b q ON p.page = q.page)
SELECT page, CAST(line AS INTEGER) AS line, CAST(CASE WHEN o > 0 THEN region END AS INTEGER) AS region FROM m QUALIFY row_number() OVER (PARTITION BY page, line ORDER BY coalesce(o, 0) DESC, region) = 1""")
def line_regions(spark, sf_dir):
    """The region in which each line lies."""
    return regions.lines_in_regions(*_two(spark, sf_dir), "page")


@query(f"WITH r AS ({RECTS_SQL}) SELECT page, CAST(ord AS INTEGER) AS ord, CASE WHEN x < 450 AND x + w < 450 THEN 'left' ELSE 'right' END AS half FROM r")
def page_halves(spark, sf_dir):
    """The page of an opening on which a box lies."""
    return page_tables(spark, sf_dir).select("page", "ord", regions.page_half(F.col("r"), F.lit(901)).alias("half"))


@query(f"WITH r AS ({RECTS_SQL}) SELECT page, greatest(450, max(CASE WHEN x < 450 AND x + w >= 450 THEN x + w ELSE 0 END)) AS middle FROM r GROUP BY page")
def moved_middles(spark, sf_dir):
    """The middle moved to the end of boxes that cross it."""
    return regions.moved_middle(page_tables(spark, sf_dir).withColumn("page_width", F.lit(901)), "page")


@query(f"""WITH r AS ({RECTS_SQL}), k AS (SELECT page, ord, row_number() OVER (PARTITION BY page ORDER BY y, x, ord) AS k, count(*) OVER (PARTITION BY page) AS n FROM r)
SELECT page, CAST(ord AS INTEGER) AS ord, CASE n WHEN 3 THEN (['title', 'header', 'content'])[k] WHEN 4 THEN (['header', 'header', 'content', 'content'])[k] WHEN 6 THEN (['title', 'title', 'header', 'header', 'content', 'content'])[k] END AS category FROM k""")
def region_categories(spark, sf_dir):
    """Categories of regions by their place on the page."""
    return regions.categories(page_tables(spark, sf_dir).select("page", "ord", "y", "x"), "page").select("page", "ord", "category")


@query(f"""WITH r AS ({RECTS_SQL}) SELECT page, CAST(ord AS INTEGER) AS ord, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 END AS category_id, x || ',' || y || ',' || (x + w) || ',' || y || ',' || (x + w) || ',' || (y + h) || ',' || x || ',' || (y + h) AS segmentation, x || ',' || y || ',' || (x + w) || ',' || (y + h) AS bbox FROM r""")
def coco_annotations(spark, sf_dir):
    """Regions as flat outlines, boxes and class numbers."""
    rows = page_tables(spark, sf_dir).select("page", "ord", F.col("l_returnflag").alias("type"), regions.cell_corners(F.col("r")).alias("points"))
    out = regions.coco(rows, ["A", "N"])
    return out.select("page", "ord", "category_id", F.array_join("segmentation", ",").alias("segmentation"), F.array_join("bbox", ",").alias("bbox"))


@query("""WITH p AS (SELECT l_orderkey, CASE WHEN l_returnflag IN ('A', 'N') THEN l_returnflag ELSE 'unknown' END AS type, count(*) AS n FROM lineitem GROUP BY 1, 2), c AS (SELECT type, max(n) AS most, CAST(sum(n) AS BIGINT) AS total FROM p GROUP BY type)
SELECT type, most, total, CAST(coalesce(sum(most) OVER (ORDER BY type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS first FROM c""")
def region_type_counts(spark, sf_dir):
    """Regions of each type by document, and where the labels of each type begin."""
    counts = regions.type_counts(load(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("type")), "l_orderkey", ["A", "N"])
    return regions.label_offsets(counts.withColumn("ord", F.col("type"))).drop("ord").join(counts.select("type", "total"), "type")


@query("WITH o AS (SELECT unnest([1, 8, 8, 15]) AS f) SELECT p_partkey, p_size AS label, coalesce((SELECT max(f) FROM o WHERE f <= p_size), 1) AS first FROM part")
def label_lookup(spark, sf_dir):
    """Where the type of a label begins."""
    offsets = spark.createDataFrame([(1,), (8,), (8,), (15,)], "first int")
    return regions.first_of_label(load(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("label")), offsets)


CORNERS = {"tl": ("x % 50", "y % 40"), "tm": ("400 + x % 30", "y % 35"), "tr": ("900 + w % 40", "h % 50"), "bl": ("x % 45", "600 + y % 50"), "bm": ("410 + w % 30", "620 + h % 40"), "br": ("880 + x % 60", "610 + w % 45")}


def _openings(spark, sf_dir):
    """An opening of 1000 by 700 pixels for each rectangle, with six points from its numbers."""
    points = F.struct(*[F.struct(F.expr(x).cast("int").alias("x"), F.expr(y).cast("int").alias("y")).alias(n) for n, (x, y) in ((n, CORNERS[n]) for n in straighten.POINTS)])
    return page_tables(spark, sf_dir).select((F.col("page") * 100 + F.col("ord")).alias("opening"), F.lit(1000).alias("width"), F.lit(700).alias("height"), points.alias("points"))


def _cross(a, b, name):
    return f"{a}2 * {b}3 - {a}3 * {b}2 AS {name}1, {a}3 * {b}1 - {a}1 * {b}3 AS {name}2, {a}1 * {b}2 - {a}2 * {b}1 AS {name}3"


def _half_sql(names, wide, px, py, offset):
    """A point's place in the straightened half by its distances to the edges and to the line on which opposite edges meet, in homogeneous coordinates."""
    corner = ", ".join(f"CAST({CORNERS[n][0]} AS DOUBLE) AS {c}1, CAST({CORNERS[n][1]} AS DOUBLE) AS {c}2, 1.0 AS {c}3" for c, n in zip("abcd", names))
    dot = lambda line, x, y, z: f"({line}1 * {x} + {line}2 * {y} + {line}3 * {z})"
    place = lambda edge, c: f"{dot(edge, px, py, 1)} / {dot('o', px, py, 1)} * {dot('o', c + '1', c + '2', c + '3')} / {dot(edge, c + '1', c + '2', c + '3')}"
    high = f"({CORNERS['bm'][1]} - ({CORNERS['tm'][1]}))"
    return f"""SELECT page * 100 + ord AS opening, round({offset} + ({wide}) * {place("l", "b")}, 4) AS px, round({high} * {place("t", "d")}, 4) AS py FROM (SELECT *, {_cross("m", "n", "o")} FROM (SELECT *, {_cross("l", "r", "m")}, {_cross("t", "u", "n")} FROM
  (SELECT *, {_cross("a", "d", "l")}, {_cross("b", "c", "r")}, {_cross("a", "b", "t")}, {_cross("d", "c", "u")} FROM (SELECT page, ord, x, y, w, h, {corner} FROM r0))))"""


LEFT_WIDE, RIGHT_WIDE = f"({CORNERS['tm'][0]}) - ({CORNERS['tl'][0]})", f"({CORNERS['tr'][0]}) - ({CORNERS['tm'][0]})"


@query(f"""WITH r0 AS ({RECTS_SQL}), a AS ({_half_sql(("tl", "tm", "bm", "bl"), LEFT_WIDE, 300, 310, "0")}), b AS ({_half_sql(("tm", "tr", "br", "bm"), RIGHT_WIDE, 700, 320, LEFT_WIDE)})
SELECT a.opening AS opening, a.px AS left_x, a.py AS left_y, b.px AS right_x, b.py AS right_y FROM a JOIN b ON a.opening = b.opening""")
def straightened_points(spark, sf_dir):
    """Perspectives of both halves solved from six points, and a point of each half moved by them."""
    t = F.col("t")
    at = lambda x, y: deskew.deskewed_point(F.lit(float(x)), F.lit(float(y)), t["left_outline"], t["right_outline"], t["left"], t["right"], t["offset"])
    moved = _openings(spark, sf_dir).withColumn("t", straighten.transforms(F.col("points"))).select("opening", at(300, 310).alias("a"), at(700, 320).alias("b"))
    return moved.select("opening", *[F.round(F.col(p)[c], 4).alias(f"{side}_{c}") for p, side in (("a", "left"), ("b", "right")) for c in ("x", "y")])


ANGLE = "degrees(atan2({b} - ({t}), {bx} - ({tx}))) - 90"


@query(f"""WITH r AS ({RECTS_SQL}), p AS (SELECT page * 100 + ord AS opening, {", ".join(f"{x} AS {n}x, {y} AS {n}y" for n, (x, y) in CORNERS.items())}, x % 61 - 30 AS dx, y % 5 AS dy, w % 83 - 40 AS ex, page % 3 > 0 AS found FROM r),
a AS (SELECT *, found AND {ANGLE.format(b="bmy", t="tmy + dy", bx="bmx", tx="tmx + dx")} BETWEEN -3.733 AND 4.375 AS ok FROM p),
b AS (SELECT *, CASE WHEN ok THEN tmx + dx ELSE tmx END AS ux, CASE WHEN ok THEN tmy + dy ELSE tmy END AS uy FROM a),
c AS (SELECT *, found AND {ANGLE.format(b="bmy", t="uy", bx="bmx + ex", tx="ux")} BETWEEN -3.733 AND 4.375 AS low FROM b)
SELECT opening, CAST(ux AS INTEGER) AS top_x, CAST(uy AS INTEGER) AS top_y, CAST(CASE WHEN low THEN bmx + ex ELSE bmx END AS INTEGER) AS bottom_x, CASE WHEN NOT found THEN '' WHEN ok AND low THEN '' WHEN ok THEN 'bm' WHEN low THEN 'tm' ELSE 'tm,bm' END AS refused FROM c""")
def second_points(spark, sf_dir):
    """Points corrected by a second model, where the edge's angle allows it."""
    pages = _openings(spark, sf_dir).join(page_tables(spark, sf_dir).select((F.col("page") * 100 + F.col("ord")).alias("opening"), "page", "x", "y", "w"), "opening")
    asked = straighten.zooms(pages, "opening").join(pages.filter("page % 3 > 0").select("opening", F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("w").alias("_w")), "opening")
    # the lower square is mirrored: what it adds to y comes off
    dx = F.when(F.col("name") == "tm", F.col("_x") % 61 - 30).otherwise(F.col("_w") % 83 - 40)
    hits = asked.filter("name IN ('tm', 'bm')").select("opening", "name", F.lit(1).alias("ord"), F.lit("midpoint").alias("class"), (F.col("px") + dx).cast("double").alias("x"), (F.col("py") + F.when(F.col("name") == "tm", F.col("_y") % 5).otherwise(0)).cast("double").alias("y"))
    other = hits.select("opening", "name", F.lit(0).alias("ord"), F.lit("corner").alias("class"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    out = straighten.second_points(pages, hits.unionByName(other), "opening")
    return out.select("opening", F.col("points.tm.x").alias("top_x"), F.col("points.tm.y").alias("top_y"), F.col("points.bm.x").alias("bottom_x"), F.array_join("refused", ",").alias("refused"))


@query(f"""WITH r AS ({RECTS_SQL}), k AS (SELECT page, ord, w % 7 AS tl, 300 + x AS tm, 900 + w AS tr, h AS bm FROM r)
SELECT page, CAST(ord AS INTEGER) AS ord, round(CASE WHEN ord % 5 = 0 THEN 0 WHEN ord % 5 = 1 THEN 1 ELSE (tm - tl) / (tr - tl) END, 9) AS straight, round(CASE WHEN ord % 5 = 0 THEN 0 WHEN ord % 5 = 1 THEN 1 ELSE (tm + bm) / 2 / 2000 END, 9) AS original FROM k""")
def keypoint_middles(spark, sf_dir):
    """Middles of openings from keypoint lines with missing points."""
    point = lambda x: F.concat(x.cast("string"), F.lit(",5"))
    gone = lambda k, x: F.when(F.col("ord") % 5 == k, F.lit("None")).otherwise(point(x))
    tl, tm, tr, bm = F.col("w") % 7, 300 + F.col("x"), 900 + F.col("w"), F.col("h")
    words = F.concat_ws(" ", F.lit("DBG"), gone(0, tl), F.lit("None"), gone(9, F.lit(1)), point(tm), gone(1, tr), F.lit("-"), point(tl), point(tl), point(bm), F.lit("x,y"), point(tl), F.lit("None"))
    k = deskew.keypoints(F.concat(F.lit("#DBG names\n"), words, F.lit("\n")))
    rows = page_tables(spark, sf_dir).withColumn("k", k)
    return rows.select("page", "ord", F.round(deskew.mid_x_deskewed(F.col("k")), 9).alias("straight"), F.round(deskew.mid_x_original(F.col("k"), F.lit(2000)), 9).alias("original"))


@query(f"""WITH r AS ({RECTS_SQL}), k AS (SELECT page, ord, (['l', 'm', 'r', 'z'])[ord % 4 + 1] AS side, degrees(atan2(1000, x % 80 - 40)) - 90 AS a FROM r)
SELECT page, CAST(ord AS INTEGER) AS ord, CASE side WHEN 'l' THEN a BETWEEN -3.8158 AND 4.6798 WHEN 'm' THEN a BETWEEN -3.733 AND 4.375 WHEN 'r' THEN a BETWEEN -6.5118 AND 3.433 ELSE false END AS fits FROM k""")
def angle_limits(spark, sf_dir):
    """Edges whose angle lies within the limits of their side."""
    side = F.get(F.array(*map(F.lit, "lmrz")), (F.col("ord") % 4).cast("int"))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    a = deskew.edge_angle(point(F.lit(40), F.lit(0)), point(F.col("x") % 80, F.lit(1000)))
    return page_tables(spark, sf_dir).select("page", "ord", deskew.angle_fits(side, a).alias("fits"))


@query(f"""WITH r AS ({RECTS_SQL}), p AS (SELECT page, ord, [{{'y': 10.0 + x % 7, 'x': 90.0}}, {{'y': 80.0, 'x': 5.0 + x % 3}}, {{'y': 12.0, 'x': 2.0 + y % 5}}, {{'y': 85.0, 'x': 50.0}}, {{'y': 11.5, 'x': 45.0}}, {{'y': 82.0, 'x': 95.0}}] AS ps FROM r WHERE ord = 1),
s AS (SELECT page, list_sort(ps) AS d FROM p), q AS (SELECT page, list_sort(list_transform(d[1:3], lambda z: z.x)) AS top, list_sort(list_transform(d[4:6], lambda z: z.x)) AS low FROM s)
SELECT page, array_to_string(list_transform(list_concat(top, low), lambda v: CAST(CAST(v AS INTEGER) AS VARCHAR)), ' ') AS xs FROM q""")
def ordered_points(spark, sf_dir):
    """Six points in their order on the page."""
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x, y = F.col("x"), F.col("y")
    points = F.array(p(F.lit(90), 10 + x % 7), p(5 + x % 3, F.lit(80)), p(2 + y % 5, F.lit(12)), p(F.lit(50), F.lit(85)), p(F.lit(45), F.lit(11.5)), p(F.lit(95), F.lit(82)))
    rows = page_tables(spark, sf_dir).filter("ord = 1").select("page", deskew.ordered_keypoints(points).alias("p"))
    return rows.select("page", F.array_join(F.transform("p", lambda q: q["x"].cast("int").cast("string")), " ").alias("xs"))


@query(f"WITH r AS ({RECTS_SQL}) SELECT page, CAST(ord AS INTEGER) AS ord, greatest(x - 25, 0) AS x, greatest(y - 25, 0) AS y, least(x + w + 25, 1000) - greatest(x - 25, 0) AS w, least(y + h + 25, 800) - greatest(y - 25, 0) AS h, CAST(trunc(2000 * (x % 100) / 100) AS INTEGER) AS px, round(w * 100 / 2000, 9) AS perc FROM r")
def crop_bounds(spark, sf_dir):
    """Rectangles with a margin on the page, and percent against pixels."""
    r = deskew.with_margin(F.col("r"), 25, F.lit(1000), F.lit(800))
    rows = page_tables(spark, sf_dir).withColumn("m", r)
    return rows.select("page", "ord", "m.x", "m.y", "m.w", "m.h", deskew.to_pixels(F.col("x") % 100, F.lit(2000)).alias("px"), F.round(deskew.to_percent(F.col("w"), F.lit(2000)), 9).alias("perc"))


@query(f"WITH r AS ({RECTS_SQL}) SELECT page, l_returnflag AS class, CAST(min(ord) AS INTEGER) AS ord FROM r WHERE l_returnflag = 'N' GROUP BY page, l_returnflag")
def best_detections(spark, sf_dir):
    """The most confident detection of a class."""
    rows = page_tables(spark, sf_dir).select("page", F.col("l_returnflag").alias("class"), "ord")
    return deskew.best_detection(rows, ["page"], "N")


@query("WITH p AS (SELECT p_partkey, [p_size % 7, p_size % 5, p_size % 3] AS s FROM part) SELECT p_partkey, (['line', 'empty', 'misc'])[list_position(s, list_max(s))] AS label, CAST(list_max(s) AS INTEGER) AS score FROM p")
def best_classes(spark, sf_dir):
    """The most likely class."""
    shares = F.array(*[F.col("p_size") % k for k in (7, 5, 3)])
    label, score = predict.best_class(shares, F.array(*map(F.lit, ["line", "empty", "misc"])))
    return load(spark, sf_dir, "part").select("p_partkey", label.alias("label"), score.cast("int").alias("score"))


NAMES_SQL = "(SELECT o_orderkey, 'in/debug_coords_' || (o_orderkey % 90) || '_autods_' || CASE o_orderkey % 3 WHEN 0 THEN 'turku_' WHEN 1 THEN 'ylä_vieska_' ELSE '' END || 'muuttaneet_1900.x.jpg' AS path FROM orders)"


@query(f"""SELECT o_orderkey, regexp_replace(regexp_replace(split_part(path, '/', 2), '\\.[^.]*$', ''), '^(debug_)?(coords_)?', '') AS base, regexp_replace(regexp_replace(regexp_replace(split_part(path, '/', 2), '\\.[^.]*$', ''), '^(debug_)?(coords_)?', ''), '^\\d+_', '') AS bare,
  CASE o_orderkey % 3 WHEN 0 THEN 'turku' WHEN 1 THEN 'ylä_vieska' ELSE '' END AS parish FROM {NAMES_SQL}""")
def names_of_files(spark, sf_dir):
    """Names without folders, marks and numbers; the parish of a book."""
    k = F.col("o_orderkey")
    path = F.concat(F.lit("in/debug_coords_"), (k % 90).cast("string"), F.lit("_autods_"), F.when(k % 3 == 0, "turku_").when(k % 3 == 1, "ylä_vieska_").otherwise(""), F.lit("muuttaneet_1900.x.jpg"))
    base = t.clean_basename(path)
    return load(spark, sf_dir, "orders").select("o_orderkey", base.alias("base"), t.without_number(base).alias("bare"), t.book_parish(t.without_number(base)).alias("parish"))


@query("""WITH i AS (SELECT o_orderkey % 50 AS stem, count(*) AS k FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1), d AS (SELECT c_custkey % 60 AS stem, count(*) AS k FROM customer WHERE c_custkey % 5 <> 0 GROUP BY 1)
SELECT CAST(coalesce(i.stem, d.stem) AS VARCHAR) AS stem, CASE WHEN i.k IS NULL THEN 'no image' WHEN d.k IS NULL THEN 'no document' WHEN i.k > 1 OR d.k > 1 THEN 'several' ELSE 'pair' END AS status FROM i FULL JOIN d ON i.stem = d.stem""")
def image_pairs(spark, sf_dir):
    """Images and documents of one name."""
    images = load(spark, sf_dir, "orders").filter("o_orderkey % 4 <> 0").select((F.col("o_orderkey") % 50).cast("string").alias("stem"), F.lit("i").alias("path"))
    docs = load(spark, sf_dir, "customer").filter("c_custkey % 5 <> 0").select((F.col("c_custkey") % 60).cast("string").alias("stem"), F.lit("d").alias("path"))
    return files.pairs(images, docs).select("stem", "status")


@query("SELECT n_name AS parish, CASE WHEN n_nationkey % 4 <> 0 THEN 'autods_' || n_name || '_fold_' || n_nationkey END AS folder, CASE WHEN n_nationkey % 4 <> 0 THEN n_name END AS named FROM nation WHERE NOT contains(n_name, ' ')")
def parish_folders(spark, sf_dir):
    """The folder of a parish, and the parish of a folder."""
    nations = load(spark, sf_dir, "nation").filter(~F.col("n_name").contains(" "))
    folders = nations.filter("n_nationkey % 4 <> 0").select(F.concat(F.lit("autods_"), "n_name", F.lit("_fold_"), F.col("n_nationkey").cast("string")).alias("folder"))
    return files.folder_of_parish(nations.select(F.col("n_name").alias("parish")), folders).withColumn("named", files.parish_of_folder(F.col("folder")))


@query("""SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN event_id % 7 END AS INTEGER) AS k, event_id % 2 = 0 AS done FROM events""")
def literal_records(spark, sf_dir):
    """Records printed as dictionaries, read without evaluation."""
    k = F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 7).cast("string")).otherwise("None")
    line = F.concat(F.lit("{'k': "), k, F.lit(", 'name': 'None, True', 'done': "), F.when(F.col("event_id") % 2 == 0, "True").otherwise("False"), F.lit("}"))
    rows = load(spark, sf_dir, "events").select("event_id", F.from_json(records.literals(line), "k INT, name STRING, done BOOLEAN", {"allowSingleQuotes": "true"}).alias("r"))
    return rows.filter("r.name = 'None, True'").select("event_id", "r.k", "r.done")


# ---- lines of tables ---------------------------------------------------------------------------

UNIFORM = "(CAST('0x' || substr(md5('1:' || {0}), 1, 8) AS BIGINT) / 4294967296.0)"
GRID_SQL = f"""g AS (SELECT o_orderkey AS tab, CAST(o_orderkey % 4 + 3 AS INTEGER) AS rows, CAST(o_orderkey % 3 + 4 AS INTEGER) AS cols FROM orders),
gx AS (SELECT tab, row_number() OVER (PARTITION BY tab ORDER BY v, i) - 1 AS i, v FROM (SELECT tab, i, CAST(floor({UNIFORM.format("tab || ':x:' || i")} * 992 + 4) AS INTEGER) AS v FROM (SELECT tab, unnest(range(0, cols + 1)) AS i FROM g))),
gy AS (SELECT tab, i, CAST(floor(4 + i * 1492.0 / rows) AS INTEGER) AS v FROM (SELECT tab, rows, unnest(range(0, rows + 1)) AS i FROM g)),
gc AS (SELECT tab, r, c FROM (SELECT tab, r, unnest(range(0, cols)) AS c FROM (SELECT tab, cols, unnest(range(0, rows)) AS r FROM g)) WHERE {UNIFORM.format("tab || ':drop:' || r || ':' || c")} >= 0.1),
gk AS (SELECT tab, r, c, unnest([0, 1, 2, 3]) AS k, unnest([0, 0, 1, 1]) AS dx, unnest([0, 1, 1, 0]) AS dy FROM gc),
corners AS (SELECT gk.tab AS tab, r, c, k, gx.v + CAST(floor({UNIFORM.format("gk.tab || ':fx:' || r || ':' || c || ':' || k")} * 6) AS INTEGER) - 3 AS x, gy.v + CAST(floor({UNIFORM.format("gk.tab || ':fy:' || r || ':' || c || ':' || k")} * 6) AS INTEGER) - 3 AS y
  FROM gk JOIN gx ON gx.tab = gk.tab AND gx.i = c + dx JOIN gy ON gy.tab = gk.tab AND gy.i = r + dy)"""


def _grids(spark, sf_dir):
    k = F.col("o_orderkey")
    return load(spark, sf_dir, "orders").select(k.alias("tab"), (k % 4 + 3).cast("int").alias("rows"), (k % 3 + 4).cast("int").alias("cols"))


@query(f"WITH {GRID_SQL} SELECT tab, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, string_agg(x || ',' || y, ' ' ORDER BY k) AS points FROM corners GROUP BY tab, r, c")
def synthetic_grids(spark, sf_dir):
    """A grid for each order, with noise and lost cells."""
    cells = lines.grid_cells(_grids(spark, sf_dir), "tab", fuzz=3, drop=0.1)
    return cells.select("tab", "row", "col", g.points_text(F.col("corners")).alias("points"))


@query(f"WITH {GRID_SQL} SELECT tab, CAST(i AS INTEGER) AS line, v AS truth, true AS found FROM gy")
def recovered_rows(spark, sf_dir):
    """The lines between the rows of grids whose cells came loose, all tables in one pass, beside the lines of which they were made."""
    grids = _grids(spark, sf_dir)
    got = lines.lines_of(lines.grid_cells(grids, "tab", fuzz=3), ["tab"], most=12, axes=("y",)).select("tab", F.posexplode("lines").alias("line", "at"))
    truth = lines.grid_lines(grids, "tab", fuzz=3).select("tab", F.posexplode("ys").alias("line", "truth"))
    return truth.join(got, ["tab", "line"], "full").select("tab", "line", "truth", F.coalesce(F.abs(F.col("at") - F.col("truth")) <= 3, F.lit(False)).alias("found"))


@query(f"""WITH r AS ({RECTS_SQL}), b AS (SELECT page, ord, x, y, w, h, unnest([x + w // 3, x + w // 2, x - 5, x + w // 3]) AS cut FROM r),
c AS (SELECT DISTINCT page, ord, y, h, v FROM (SELECT page, ord, y, h, cut AS v FROM b WHERE cut > x AND cut < x + w UNION ALL SELECT page, ord, y, h, x FROM r UNION ALL SELECT page, ord, y, h, x + w FROM r))
SELECT page, CAST(ord AS INTEGER) AS ord, CAST(row_number() OVER (PARTITION BY page, ord ORDER BY v) - 1 AS INTEGER) AS part, round(CAST((u - v) * h AS DOUBLE), 6) AS area FROM (SELECT *, lead(v) OVER (PARTITION BY page, ord ORDER BY v) AS u FROM c) WHERE u IS NOT NULL""")
def split_regions(spark, sf_dir):
    """Regions split by borders, one after another; borders outside and repeated ones split nothing."""
    x, y, w, h = (F.col(c) for c in "xywh")
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    border = lambda v: F.struct(v.alias("x1"), y.alias("y1"), v.alias("x2"), (y + h).alias("y2"))
    third, middle = x + F.floor(w / 3), x + F.floor(w / 2)
    parts = lines.split_region(F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h)), F.array(border(middle), border(third), border(x - 5), border(third)))
    return page_tables(spark, sf_dir).select("page", "ord", F.posexplode(parts).alias("part", "p")).select("page", "ord", "part", F.round(lines.area(F.col("p")), 6).alias("area"))
