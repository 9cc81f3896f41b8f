"""Layouts of books: page ranges, headers, directions, labels, and the standard form of printed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

#: Range of a layout that names no pages.
OPEN_END = 999999


def book_ranges(books: DataFrame, key: str, spec: Column) -> DataFrame:
    """(key, name, start, end, ord) from `Print 21:1-50, print 22:50-661`; a name that repeats keeps its first place and takes the last range."""
    parts = books.select(key, F.posexplode(F.split(spec, ",")).alias("pos", "part"))
    name = F.lower(t.strip(F.get(F.split("part", ":"), F.lit(0))))
    span = t.strip(F.get(F.split("part", ":"), F.lit(1)))
    ends = [F.get(F.split(span, "-"), F.lit(i)).try_cast("int") for i in (0, 1)]
    rows = parts.select(key, "pos", name.alias("name"), F.coalesce(ends[0], F.lit(0)).alias("start"), F.coalesce(ends[1], F.lit(OPEN_END)).alias("end"))
    return rows.filter("name <> ''").groupBy(key, "name").agg(F.max_by("start", "pos").alias("start"), F.max_by("end", "pos").alias("end"), F.min("pos").alias("ord"))


def type_of_opening(openings: DataFrame, ranges: DataFrame, key: str, page: str, opening: str) -> DataFrame:
    """(key, page, opening, name): the first range of the book that holds the opening, else the one whose start is nearest (the end does
    not matter), the first of equals; null without ranges or opening. A book's ranges are one array, so the join adds no rows and nothing
    is grouped after it."""
    listed = ranges.groupBy(key).agg(F.collect_list(F.struct("start", "end", "ord", "name")).alias("_ranges"))

    def far(r):
        inside = (F.col(opening) >= r["start"]) & (F.col(opening) <= r["end"])
        return F.struct((~inside).alias("out"), F.when(inside, 0).otherwise(F.abs(r["start"] - F.col(opening))).alias("far"), r["ord"].alias("ord"), r["name"].alias("name"))

    nearest = F.when(F.col(opening).isNotNull(), F.array_min(F.transform("_ranges", far))["name"])
    return openings.join(listed, key, "left").select(key, page, opening, nearest.alias("name"))


def page_list(books: DataFrame, key: str, pages: Column) -> DataFrame:
    """One row for each page 1..n of a book."""
    return books.filter(pages > 0).select(key, F.explode(F.sequence(F.lit(1), pages.cast("int"))).alias("page"))


def pick_side(items: Column, side: Column) -> Column:
    """The first of a page's annotations for left and both, the last for right."""
    return F.when(side == "right", F.element_at(items, -1)).otherwise(F.element_at(items, 1))


def layout_label(n_tables: Column, expected_tables: Column, cols: Column, expected_cols: Column) -> Column:
    """How a page's tables (arrays of column counts by place) agree with its layout."""
    off = F.array_max(F.zip_with(cols, expected_cols, lambda a, b: F.abs(a - b)))
    return (
        F.when(n_tables > 2, "more than two tables")
        .when(n_tables != expected_tables, "wrong number of tables")
        .when(off == 0, "correct")
        .when(off < 2, "columns off by one")
        .otherwise("columns off by more than one")
    )


def moved_column(headers: Column, direction: Column, names: list[str], way: str) -> Column:
    """Place (from 0) of the last header in names, for tables of this direction or both; null without one."""
    places = F.filter(F.transform(headers, lambda h, i: F.when(h.isin(*names), i)), lambda i: i.isNotNull())
    return F.when(direction.isin(way, "both") & (F.size(places) > 0), F.array_max(places))


def process_tables(tables: DataFrame, width: Column | None = None) -> DataFrame:
    """tables(..., layout, direction, headers array, n_expected, texts array of one row): log, from, to for each row. width is that of the row's table, else the row's own; a row that
    ends before a place has null there."""
    fits = (F.size("texts") if width is None else width) == F.col("n_expected")
    at = {"from": moved_column(F.col("headers"), F.col("direction"), t.MOVE_FROM, "in"), "to": moved_column(F.col("headers"), F.col("direction"), t.MOVE_TO, "out")}
    log = F.when(~fits, "wrong number of columns").when(at["from"].isNull() & at["to"].isNull(), "not able to locate to/from columns").otherwise("ok")
    return tables.select("*", log.alias("log"), *[F.when(fits & a.isNotNull(), F.get("texts", a)).alias(f"moved_{way}") for way, a in at.items()])


def standard_branch(n_tables: Column, n_annotations: Column, same: Column) -> Column:
    """Which annotation a page's tables take: by place, one for all, or none."""
    return F.when(n_tables == n_annotations, "zip").when(n_annotations == 1, "one for all").when((n_annotations == 2) & same, "first for all").otherwise("wrong number of tables")


def standardize(rows: DataFrame, pages: DataFrame, page: str, table: str) -> DataFrame:
    """(page, table, row, layout, direction, log, moved_from, moved_to, original columns) of rows(page, table, row, texts) by pages(page, layout, annotations).

    annotations is an array of (direction, headers), null for layouts that are not printed: their rows are `not implemented`. As many tables as
    annotations meet by place; else one annotation, or two equal ones, hold for every table; else the rows say `wrong number of tables`, with a direction only
    if the annotations share one. Pages without any table, and pages without a file (has_file false in pages, where it is a column), have one
    row that says so. A table is as wide as its first row, so all rows of a ragged one have the same log.
    """
    listed = rows.groupBy(page).agg(F.sort_array(F.collect_set(table)).alias("_tables"))
    source = pages if "has_file" in pages.columns else pages.withColumn("has_file", F.lit(True))
    placed = source.join(listed, page, "left")
    a = F.col("annotations")
    same = (F.get(a, F.lit(0))["direction"] == F.get(a, F.lit(1))["direction"]) & (F.get(a, F.lit(0))["headers"] == F.get(a, F.lit(1))["headers"])
    branch = F.when(a.isNull(), "not implemented").otherwise(standard_branch(F.size("_tables"), F.size(a), same))
    agreed = F.when(F.size(F.array_distinct(F.transform(a, lambda x: x["direction"]))) == 1, F.get(a, F.lit(0))["direction"]).otherwise("unknown")
    found = placed.filter("has_file AND _tables IS NOT NULL").select(page, "layout", branch.alias("_branch"), agreed.alias("_agreed"), "annotations", "_tables").join(rows, page)
    own = F.when(F.col("_branch") == "zip", F.get("annotations", (F.array_position("_tables", F.col(table)) - 1).cast("int"))).when(F.col("_branch").isin("one for all", "first for all"), F.get("annotations", F.lit(0)))
    found = found.withColumn("_own", own).withColumns({"direction": F.col("_own.direction"), "headers": F.col("_own.headers"), "n_expected": F.size("_own.headers")})
    first = Window.partitionBy(page, table).orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    done = process_tables(found.withColumn("_width", F.first(F.size("texts")).over(first)), F.col("_width"))
    log = F.when(F.col("_own").isNull(), F.col("_branch")).otherwise(F.col("log"))
    way = F.when(F.col("_own").isNotNull(), F.col("direction")).when(F.col("_branch") == "not implemented", "unknown").otherwise(F.col("_agreed"))
    full = done.select(page, table, "row", "layout", way.alias("direction"), log.alias("log"), "moved_from", "moved_to", F.col("texts").alias("original columns"))
    bare = placed.filter("NOT has_file OR _tables IS NULL").select(page, F.lit(None).cast(rows.schema[table].dataType).alias(table), F.lit(None).cast(rows.schema["row"].dataType).alias("row"), "layout", F.lit("unknown").alias("direction"),
        F.when(F.col("has_file"), "no predicted tables").otherwise("predicted file missing").alias("log"), F.lit(None).cast("string").alias("moved_from"), F.lit(None).cast("string").alias("moved_to"), F.array().cast("array<string>").alias("original columns"))
    return full.unionByName(bare)


def run_counters(rows: DataFrame, page: str) -> DataFrame:
    """pages, pages_with_data and rows of standardised rows."""
    per = rows.groupBy(page).agg(F.count(F.lit(1)).alias("_n"), F.bool_or(F.size("original columns") > 0).alias("_d"))
    return per.agg(F.count(F.lit(1)).alias("pages"), F.count_if("_d").alias("pages_with_data"), F.sum("_n").alias("rows"))
