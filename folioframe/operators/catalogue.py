"""The catalogue of books: its sheets as dimensions, the layout of every page, and what a page's tables should look like.

Books, layouts and annotations are dimensions of some thousand rows; pages join them by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from . import layout

# Directions that an annotation may have, and the places (from 1) of the fields in a sheet's rows.
DIRECTIONS = ["in", "out", "both", "out abroad"]
BOOK_FIELDS = {"parish": 1, "images": 4, "label": 5, "url": 6, "years": 8, "source": 9, "doctype": 17, "older_spec": 18, "spec": 19}
TYPE_FIELDS = {"print_type": 1, "tables": 2, "direction": 3, "columns": 6}
FIRST_HEADER = 7


def _cell(i: int) -> Column:
    return F.nullif(t.strip(F.get("cells", F.lit(i - 1))), F.lit(""))


def books(sheet: DataFrame) -> DataFrame:
    """(book_id, parish, images, label, url, years, source, doctype, older_spec, spec) of sheet(row_no, cells array): the rows after the
    heading and before the first one without a parish. Of equal ids the last row counts, as in a lookup that is filled in order."""
    rows = sheet.filter("row_no > 1").select("row_no", *[_cell(i).alias(name) for name, i in BOOK_FIELDS.items()])
    end = rows.filter("parish IS NULL").agg(F.min("row_no").alias("_end"))
    rows = rows.join(end, F.lit(True)).filter("_end IS NULL OR row_no < _end").drop("_end")  # one row
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("none")))
    named = rows.withColumns({"source": low("source"), "doctype": low("doctype"), "images": F.col("images").try_cast("double").cast("int")})
    named = named.withColumn("book_id", F.concat_ws("_", "parish", "doctype", "years", "source"))
    last = Window.partitionBy("book_id").orderBy(F.desc("row_no"))
    return named.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r", "row_no")


def _direction(c: Column, unknown: str) -> Column:
    return F.when(c.isin(*DIRECTIONS), c).otherwise(unknown)


def print_types(sheet: DataFrame, unknown: str = "?") -> DataFrame:
    """(print_type, ord, page, direction, headers) of sheet(row_no, cells array), a row for each table of a printed layout: `one table` is
    one row of page `opening`, `two tables` takes the next row for its right page. Rows without a kind belong to the one before; unknown
    directions become `unknown`; headers that are empty read `None`; of a layout that repeats the last one counts; columns that
    are no number leave the layout out."""
    rows = sheet.filter("row_no > 1").select("row_no", *[_cell(i).alias(name) for name, i in TYPE_FIELDS.items()], "cells")
    count = F.regexp_replace("columns", "left|right", "").try_cast("double").cast("int")
    heads = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.coalesce(t.strip(F.get("cells", i + FIRST_HEADER - 1)), F.lit("None")))
    rows = rows.withColumn("n", count).select("row_no", F.lower(F.coalesce("print_type", F.lit("none"))).alias("print_type"), "tables", _direction(F.col("direction"), unknown).alias("direction"), F.when(F.col("n") > 0, heads).when(F.col("n") == 0, F.array().cast("array<string>")).alias("headers"))
    by_place = Window.orderBy("row_no")  # a sheet of some hundred rows
    both = rows.select("*", F.lead(F.struct("direction", "headers")).over(by_place).alias("right")).filter("tables IS NOT NULL")
    table = lambda i, page, d, h: F.struct(F.lit(i).alias("ord"), F.lit(page).alias("page"), d.alias("direction"), h.alias("headers"))
    one = F.array(table(0, "opening", F.col("direction"), F.col("headers")))
    two = F.array(table(0, "left", F.col("direction"), F.col("headers")), table(1, "right", F.col("right.direction"), F.col("right.headers")))
    found = both.select("row_no", "print_type", F.when(F.col("tables") == "one table", one).otherwise(two).alias("ts")).filter(F.forall("ts", lambda x: x["headers"].isNotNull()))
    last = Window.partitionBy("print_type").orderBy(F.desc("row_no"))
    return found.withColumn("_r", F.row_number().over(last)).filter("_r = 1").select("print_type", F.explode("ts").alias("x")).select("print_type", "x.*")


def _notes(books_: DataFrame, spec: str) -> DataFrame:
    """The parts of a book's annotation with name, start and end (null without a range) and their place."""
    part = F.split(F.col("part"), ":")
    span = F.split(F.get(part, F.lit(1)), "-")
    number = lambda i: t.strip(F.get(span, F.lit(i))).try_cast("int")
    parts = books_.select("*", F.posexplode(F.split(F.lower(spec), ",")).alias("note", "part"))
    return parts.select("*", t.strip(F.get(part, F.lit(0))).alias("layout"), number(0).alias("start"), number(1).alias("end"), (F.size(part) > 1).alias("ranged")).drop("part")


def page_layouts(books_: DataFrame, spec: str = "spec", missing: str = "unknown") -> DataFrame:
    """(book_id, page, layout, overlaps): every page 1..images of a book with its layout; pages that no range names are `missing`. Where
    ranges overlap the later note wins, and overlaps says so; the caller decides whether that is an error."""
    pages = layout.page_list(books_.select("book_id", "images", F.col(spec).alias("spec")).filter("images > 0"), "book_id", F.col("images"))
    notes = _notes(books_.select("book_id", F.col(spec).alias("spec")), "spec").filter("NOT ranged OR (start IS NOT NULL AND end IS NOT NULL)")
    listed = notes.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("note", "layout", F.coalesce("start", F.lit(1)).alias("start"), F.coalesce("end", F.lit(layout.OPEN_END)).alias("end")))).alias("ns"))
    hits = F.filter("ns", lambda n: (F.col("page") >= n["start"]) & (F.col("page") <= n["end"]))
    found = pages.join(listed, "book_id", "left").select("book_id", "page", hits.alias("hits"))
    return found.select("book_id", "page", F.coalesce(F.try_element_at("hits", F.lit(-1))["layout"], F.lit(missing)).alias("layout"), (F.coalesce(F.size("hits"), F.lit(0)) > 1).alias("overlaps"))


def statistics_pages(books_: DataFrame, spec: str = "older_spec") -> DataFrame:
    """(file, layout): the pages of all books for annotation statistics: notes of the four table layouts alone, the later note wins, a range
    that is none means all pages, pages without a layout are `other layout`."""
    kinds = F.col("layout").startswith("print ") | F.col("layout").startswith("handrawn") | F.col("layout").startswith("halfbook") | F.col("layout").startswith("free text")
    notes = _notes(books_.select("book_id", F.col(spec).alias("spec")), "spec").filter(kinds)
    ranged = F.col("start").isNotNull() & F.col("end").isNotNull()
    listed = notes.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("note", "layout", F.when(ranged, F.col("start")).otherwise(1).alias("start"), F.when(ranged, F.col("end")).otherwise(layout.OPEN_END).alias("end")))).alias("ns"))
    pages = layout.page_list(books_, "book_id", F.col("images")).join(books_.select("book_id", "parish", "label", "years", "source"), "book_id").join(listed, "book_id", "left")
    hits = F.filter("ns", lambda n: (F.col("page") >= n["start"]) & (F.col("page") <= n["end"]))
    name = F.concat(F.concat_ws("_", "parish", "label", "years", "source", F.col("page").cast("string")), F.lit(".xml"))
    return pages.select(name.alias("file"), F.coalesce(F.try_element_at(hits, F.lit(-1))["layout"], F.lit("other layout")).alias("layout"))


def pages_to_sample(books_: DataFrame, wanted: str, excluded: DataFrame | None = None, spec: str = "older_spec") -> DataFrame:
    """(file, note): images of one layout, or of `all printed` or `all handdrawn`, without those in excluded(name). A range begins after its
    first page, as the lists that were drawn so far have it; a note without a range means all images; the same image may occur twice."""
    fits = {"all printed": F.col("layout").startswith("print"), "all handdrawn": F.col("layout").startswith("handrawn")}.get(wanted, F.col("layout") == wanted)
    notes = _notes(books_.select("parish", "label", "years", "source", "images", F.col(spec).alias("spec")), "spec").filter(fits).filter("NOT ranged OR (start IS NOT NULL AND end IS NOT NULL)")
    first, last = F.when(F.col("ranged"), F.col("start") + 1).otherwise(1), F.when(F.col("ranged"), F.col("end")).otherwise(F.col("images"))
    pages = notes.withColumns({"_a": first, "_b": last}).filter("_a <= _b").select("*", F.explode(F.sequence("_a", "_b")).alias("page"))
    book = F.concat_ws("_", "label", "years", "source")
    path = F.concat(F.lit("images/"), F.col("parish"), F.lit("/"), book, F.lit("/"), F.concat_ws("_", "parish", book, F.col("page").cast("string")), F.lit(".jpg"))
    span = F.when(F.col("ranged"), F.concat(F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))).otherwise("")
    files = pages.select(path.alias("file"), F.concat("layout", span).alias("note"))
    return files if excluded is None else files.join(excluded.select(F.col("name").alias("file")), "file", "left_anti")


def page_expectations(openings: DataFrame, ranges: DataFrame, annotations: DataFrame, key: str, page: str, opening: str, side: Column | None = None, strict: bool = False) -> DataFrame:
    """(key, page, opening, layout, printed, known, n_expected, headers, direction, annotations): what the catalogue says of an opening. Printed layouts have
    as many tables as annotations, headers and direction of the table on `side` (the first for left and both, the last for right);
    others have one table, no headers and the direction at the end of their name. Unknown books and printed layouts without
    annotations have known false, and stop the query with strict."""
    extra = [side.alias("_side")] if side is not None else [F.lit("both").alias("_side")]
    sides = openings.select(key, page, *extra)
    typed = layout.type_of_opening(openings, ranges, key, page, opening)
    listed = annotations.groupBy(F.col("print_type").alias("name")).agg(F.sort_array(F.collect_list(F.struct("ord", "page", "direction", "headers"))).alias("annotations"))
    joined = typed.join(sides, [key, page]).join(listed, "name", "left")
    printed = F.coalesce(t.is_printed(F.col("name")), F.lit(False))
    one = layout.pick_side(F.col("annotations"), F.col("_side"))
    known = F.col("name").isNotNull() & (~printed | F.col("annotations").isNotNull())
    if strict:
        known = F.when(known, True).otherwise(F.raise_error(F.concat(F.lit("no annotation of "), F.coalesce("name", F.col(key).cast("string")))).cast("boolean"))
    return joined.select(
        key, page, opening, F.col("name").alias("layout"), printed.alias("printed"), known.alias("known"), F.when(printed, F.size("annotations")).when(F.col("name").isNotNull(), 1).alias("n_expected"),
        F.when(printed, one["headers"]).alias("headers"), F.when(printed, one["direction"]).otherwise(t.in_out(F.col("name"))).alias("direction"), F.when(printed, F.col("annotations")).alias("annotations"),
    )


def annotation_of_table(annotations: Column, place: Column) -> Column:
    """The annotation of a page's table at a place (from 0): the first for the first, else the last."""
    return F.when(place == 0, F.element_at(annotations, 1)).otherwise(F.element_at(annotations, -1))
