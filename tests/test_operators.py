import random

from pyspark.sql import functions as F

from folioframe.functions import geometry as g
from folioframe.functions import text as t
from folioframe.operators import extract, grid, layout, repair, tables


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_text(spark):
    assert one(spark, t.strip(F.lit(" \t a b\n"))) == "a b"
    assert one(spark, t.header_class(F.lit("Työmiehen NIMI"))) == "name"
    assert one(spark, t.header_class(F.lit("hvart flyttat"))) == "parish"
    assert one(spark, t.header_class(F.lit("nro"))) == "unknown"
    assert [one(spark, t.is_ditto(F.lit(x))) for x in ('"', '" "', "Do.", "sn", "Son", "")] == [True, True, True, True, False, False]
    assert one(spark, t.in_out(F.lit("Handrawn OUT/IN "))) == "out/in"
    assert one(spark, t.similarity(F.lit("Lahti Turku"), F.lit("Turku"))) == 1.0
    assert one(spark, t.similarity(F.lit("abc"), F.lit("abd"))) == 1 - 1 / 3
    assert one(spark, t.similarity(F.lit(""), F.lit(""))) == 1.0
    meta = one(spark, t.file_meta(F.lit("autods_kuopion_tuomiokirkkosrk_muuttaneet_1890-1899_mko1_2_17.xml")))
    assert (meta.parish, meta.doctype, meta.year_range, meta.source, meta.page_number) == ("kuopion_tuomiokirkkosrk", "muuttaneet", "1890-1899", "mko1_2", 17)
    assert one(spark, t.file_meta(F.lit("other.xml"))).parish is None
    assert one(spark, t.layout_known(F.lit("print 55"))) and not one(spark, t.layout_known(F.lit("print 56")))


def test_geometry(spark):
    assert one(spark, g.points_text(g.parse_points(F.lit("1,2  3,4")))) == "1,2 3,4"
    box = one(spark, g.bounds(g.parse_points(F.lit("5,2 1,9 3,4"))))
    assert (box.x, box.y, box.w, box.h) == (1, 2, 4, 7)
    square = g.parse_points(F.lit("0,0 10,0 10,10 0,10"))
    assert one(spark, g.in_polygon(F.lit(5), F.lit(5), square)) and not one(spark, g.in_polygon(F.lit(15), F.lit(5), square))
    assert one(spark, g.points_text(g.rotate(g.parse_points(F.lit("10,0")), 90, F.lit(0), F.lit(0)))) == "0,10"
    assert one(spark, g.points_text(g.project(g.parse_points(F.lit("3,4")), [1, 0, 2, 0, 1, 3, 0, 0]))) == "5,7"
    assert abs(one(spark, g.vertical_angle(F.lit(0), F.lit(0), F.lit(0), F.lit(5)))) < 1e-9


def same_as_brute(column):
    done = []
    for text, ditto in column:
        done.append((next((x for x, d in reversed(list(zip(done, [d for _, d in column]))) if not d), "") if ditto else text))
    return done


def test_same_as_against_brute_force(spark):
    rng = random.Random(3)
    columns = [[(rng.choice("abc"), rng.random() < 0.5) for _ in range(8)] for _ in range(50)]
    rows = [(i, j, text, ditto) for i, c in enumerate(columns) for j, (text, ditto) in enumerate(c)]
    df = spark.createDataFrame(rows, "tab int, row int, text string, ditto boolean")
    got = df.select("tab", "row", grid.resolve_same_as(F.col("text"), F.col("ditto"), F.lit(False), ["tab"], ["row"]).alias("v")).orderBy("tab", "row").collect()
    want = [v for c in columns for v in same_as_brute(c)]
    assert [r.v for r in got] == want


def test_columns(spark):
    rows = [["", "", "Anna Maria", "x", ""], ["", "", "Johan Erik", "y", ""]]
    cells = spark.createDataFrame([(1, i, j, v) for i, r in enumerate(rows) for j, v in enumerate(r)], "tab int, row int, col int, text string")
    name = grid.name_column(cells, ["tab"]).first()
    assert (name.name_col, name.name_score) == (2, 10.0)
    plan = lambda *headers: spark.createDataFrame([(1, list(headers))], "tab int, headers array<string>")
    gone = repair.surplus(cells, plan("nimi", "ikä"), ["tab"])
    assert sorted(r.col for r in gone.collect()) == [0, 1, 4]
    left = grid.to_rows(grid.remove_columns(cells, ["tab"], gone), ["tab"]).orderBy("row").collect()
    assert [r.texts for r in left] == [["Anna Maria", "x"], ["Johan Erik", "y"]]
    narrow = cells.filter("col in (2, 3)").withColumn("col", F.col("col") - 2)
    padded = grid.to_rows(repair.pad(narrow, plan("nro", "nimi", "ikä", "z"), ["tab"]), ["tab"]).orderBy("row").collect()
    assert padded[0].texts == ["", "Anna Maria", "x", ""]
    wider = grid.to_rows(repair.insert_empty_columns(cells, ["tab"], [1]), ["tab"]).orderBy("row").first()
    assert wider.texts == ["", "", "", "Anna Maria", "x", ""]


def test_dropped_tables_hide_nothing(spark):
    # the middle one goes under the largest; the smallest lies under the middle one alone and stays
    rects = [(1, 0, 0, 0, 100, 100), (1, 1, 5, 0, 99, 99), (1, 2, 98, 0, 6, 50)]
    df = spark.createDataFrame(rects, "page int, ord int, x int, y int, w int, h int")
    kept = tables.remove_overlapping(df, "page", "ord", g.rect(*map(F.col, "xywh")), 0.9)
    assert sorted(r.ord for r in kept.collect()) == [0, 2]


def test_ranges(spark):
    books = spark.createDataFrame([("b", "Print 21:1-50, print 22:51-60,Print 21:70-80, handrawn in")], "book string, spec string")
    ranges = layout.book_ranges(books, "book", F.col("spec"))
    assert [(r.name, r.start, r.end) for r in ranges.orderBy("ord").collect()] == [("print 21", 70, 80), ("print 22", 51, 60), ("handrawn in", 0, 999999)]
    pages = spark.createDataFrame([("b", 1, 55), ("b", 2, 75), ("c", 3, 1)], "book string, page int, opening int")
    got = {r.page: r.name for r in layout.type_of_opening(pages, ranges, "book", "page", "opening").collect()}
    assert got == {1: "print 22", 2: "print 21", 3: None}


def test_process_tables(spark):
    df = spark.createDataFrame([("in", ["nimi", "mistä"], 2, ["Anna", "Turku"]), ("out", ["nimi", "mistä"], 2, ["Anna", "Turku"]), ("in", ["nimi", "mistä"], 2, ["Anna"])], "direction string, headers array<string>, n_expected int, texts array<string>")
    assert [(r.log, r.moved_from, r.moved_to) for r in layout.process_tables(df).collect()] == [("ok", "Turku", None), ("not able to locate to/from columns", None, None), ("wrong number of columns", None, None)]


def test_extraction(spark):
    rows = spark.createDataFrame([("t", i, [f"n{i}", f"p{i}"]) for i in range(7)], "tab string, row int, texts array<string>")
    got = extract.extract_records(rows, ["tab"], batch=3).orderBy("row").collect()
    assert [(r.row, r.extracted_data["person_name"]) for r in got] == [(i, f"n{i}") for i in range(7)]

    def failing(batch):
        if batch[0][0] == "n3":
            raise ValueError
        return [{"x": "1"}]

    got = extract.extract_records(rows, ["tab"], failing, 3).orderBy("row").collect()
    assert [(r.row, r.error) for r in got] == [(0, None), (3, "ValueError: "), (4, "ValueError: "), (5, "ValueError: "), (6, None)]


def test_matching_without_pages_and_partners(spark):
    def of(*rows):
        return spark.createDataFrame(rows, "page int, ord int, x int, y int, w int, h int").select("page", "ord", g.rect(*map(F.col, "xywh")).alias("r"))

    truth = of((1, 0, 0, 0, 10, 10), (1, 1, 5, 0, 10, 10), (None, 0, 0, 0, 5, 5), (2, 0, 0, 0, 1, 1))
    predicted = of((1, 7, 4, 0, 10, 10), (None, 1, 0, 0, 5, 5), (3, 1, 0, 0, 1, 1))
    got = {(r.page, r.i): (r.j, round(r.iou, 6)) for r in tables.match_greedy(truth, predicted, "page").collect()}
    assert got == {(1, 0): (None, 0), (1, 1): (7, round(9 / 11, 6)), (2, 0): (None, 0), (None, 0): (None, 0)}
    assert not tables.match_greedy(truth.limit(0), predicted, "page").collect()


def test_ragged_tables(spark):
    """The first row says how wide a table is."""
    rows = spark.createDataFrame([(1, 0, 0, ["a", "b", "c"]), (1, 0, 1, ["d", "e"]), (1, 1, 0, ["f"]), (1, 1, 1, ["g", "h", "i"])], "page int, ord int, row int, texts array<string>")
    one = ("in", ["nimi", "mp", "mistä"])
    pages = spark.createDataFrame([(1, "x", [one])], "page int, layout string, annotations array<struct<direction:string,headers:array<string>>>")
    got = {(r.ord, r.row): (r.log, r.moved_from) for r in layout.standardize(rows, pages, "page", "ord").collect()}
    assert got == {(0, 0): ("ok", "c"), (0, 1): ("ok", None), (1, 0): ("wrong number of columns", None), (1, 1): ("wrong number of columns", None)}
