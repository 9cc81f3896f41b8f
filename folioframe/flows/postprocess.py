"""Postprocessing from documents to documents: recognised tables are read, repaired by the catalogue's annotations and written back, with a report.

What cannot be processed is named in the report and comes out as it was; the rest goes on. Printed openings should have their layout's tables: overlapping
ones go and halves are merged where there are too many, empty columns at the sides go, empty tables take their layout's width. On handwritten ones overlapping
tables go. Dittos are resolved on both. The repaired cells are written once; documents and report are made of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import catalogue, grid, layout, predict, repair, tables
from ..sources import page_xml, sinks

KEYS = ["file_name", "table_ord"]


def openings(docs: DataFrame, books: DataFrame, types: DataFrame) -> DataFrame:
    """(file_name, book_id, opening, layout, printed, n_expected, annotations, fault): what the catalogue says of each document, and why it says nothing."""
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    named = docs.select("file_name", F.col("meta.book_id").alias("book_id"), t.opening_of(stem).alias("opening")).distinct()
    known = named.join(books.select("book_id", F.lit(True).alias("_known")), "book_id", "left")
    ranges = layout.book_ranges(books, "book_id", F.col("spec"))
    said = catalogue.page_expectations(known.filter("_known"), ranges, types, "book_id", "file_name", "opening")
    found = known.join(said.select("file_name", "layout", "printed", "known", "n_expected", "annotations"), "file_name", "left")
    fault = F.when(F.col("book_id").isNull() | F.col("opening").isNull(), "no book and opening in the name").when(F.col("_known").isNull(), "unknown book").when(F.col("layout").isNull(), "no layout of the opening").when(~F.col("known"), "no annotation of the layout")
    return found.select("file_name", "book_id", "opening", "layout", "printed", "n_expected", "annotations", fault.alias("fault"))


def kept_tables(rects: DataFrame, pages: DataFrame) -> DataFrame:
    """rects(file_name, table_ord, x, y, w, h, ...) of the tables that stay, with printed, n_expected, annotations and `place`, a table's number on its page from 0.

    Overlapping tables go from handwritten pages, and from printed ones with more tables than expected; those pages then have their tables by area, the largest first.
    """
    joined = rects.join(pages.select("file_name", "printed", "n_expected", "annotations"), "file_name")
    of_page = Window.partitionBy("file_name")
    marked = joined.withColumn("_thin", ~F.col("printed") | (F.count(F.lit(1)).over(of_page) > F.col("n_expected")))
    stays = tables.remove_overlapping(marked.filter("_thin"), "file_name", "table_ord", F.struct("x", "y", "w", "h"))
    thinned = marked.filter("_thin").join(stays, KEYS, "left_semi").unionByName(marked.filter("NOT _thin"))
    order = of_page.orderBy(F.when(F.col("_thin"), -F.col("w") * F.col("h")).otherwise(0), "table_ord")
    return thinned.withColumn("place", F.row_number().over(order) - 1).drop("_thin")


def merged(cells: DataFrame, boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """cells and boxes after halves of one table are put together on printed pages that still have too many tables."""
    of_page = Window.partitionBy("file_name")
    over = boxes.withColumn("_n", F.count(F.lit(1)).over(of_page)).filter("printed AND _n > n_expected").withColumnRenamed("n_expected", "expected")
    # only the tables of these pages can change their name
    done = repair.merge_cells(cells, over, "file_name", "table_ord")
    left = done.select(*KEYS).distinct()
    whole = over.withColumn("_r", F.col("x") + F.col("w")).withColumn("_b", F.col("y") + F.col("h"))
    # both halves' outlines, for the one that is left of two
    outline = whole.groupBy("file_name").agg(F.min("x").alias("_x"), F.min("y").alias("_y"), F.max("_r").alias("_r"), F.max("_b").alias("_b"), F.max("_n").alias("_n"))
    now = boxes.join(left, KEYS, "left_semi").withColumn("_now", F.count(F.lit(1)).over(of_page)).join(outline, "file_name", "left")
    joined = F.coalesce(F.col("_now") < F.col("_n"), F.lit(False))
    corner = {"x": F.when(joined, F.col("_x")).otherwise(F.col("x")), "y": F.when(joined, F.col("_y")).otherwise(F.col("y")), "w": F.when(joined, F.col("_r") - F.col("_x")).otherwise(F.col("w")), "h": F.when(joined, F.col("_b") - F.col("_y")).otherwise(F.col("h"))}
    placed = {**corner, "place": F.when(joined, 0).otherwise(F.col("place"))}
    return done, now.withColumns(placed).select(*boxes.columns)


def keeper(spark: SparkSession, work: str) -> Callable[[DataFrame, str], DataFrame]:
    """Writes a table below `work`, which all tasks reach, and reads it again: what several later steps need is made once, and plans stay short."""

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{work}/{name}")
        return spark.read.schema(df.schema).parquet(f"{work}/{name}")

    return keep


def repaired(docs: DataFrame, books: DataFrame, types: DataFrame, keep: Callable[[DataFrame, str], DataFrame], correct: Callable | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, tables, pages) of scanned documents; steps are kept by keep(df, name), as keeper() does.

    cells(file_name, table_ord, table_id, table_rect, row, col, cell_id, cell_type, text, rect) as page_xml.updated_xml() takes them, tables(file_name, table_ord, table_id, n_rows, n_cols,
    expected, problematic), pages as openings() with the faults of documents too. `correct` is the model of predict.correct_tables(), for printed tables whose width is
    wrong. problematic: whether a printed table's width differed from its layout's when its empty columns had gone.
    """
    faults = page_xml.faults(docs)
    pages = openings(docs, books, types).join(faults.withColumnRenamed("fault", "_of_document"), "file_name", "left").withColumn("fault", F.coalesce("_of_document", "fault")).drop("_of_document")
    pages = keep(pages, "pages")
    right = pages.filter("fault IS NULL")
    good = docs.join(right.select("file_name"), "file_name", "left_semi")
    rects = keep(page_xml.table_rects(good), "rects")
    names = rects.select(*KEYS, "table_id")
    boxes = keep(kept_tables(rects, right), "boxes")
    cells = keep(page_xml.grids(good).drop("table_id").join(boxes.select(*KEYS), KEYS, "left_semi").select(*KEYS, "row", "col", "text", "cell_id", "cell_type", "rect"), "grids")
    cells, boxes = merged(cells, boxes)
    cells, boxes = keep(cells, "merged"), keep(boxes, "outlines")
    plans = boxes.filter("printed").select(*KEYS, catalogue.annotation_of_table(F.col("annotations"), F.col("place"))["headers"].alias("headers"))
    narrow = keep(repair.remove_surplus(cells, plans, KEYS), "narrow")
    state = repair.problematic(narrow, plans, KEYS)
    done = repair.match_empty(narrow, plans, KEYS)
    if correct is not None:
        done = keep(done, "uncorrected")
        # the model moves columns: what else a cell has stays with it where its text stays in its place
        changed = predict.correct_tables(done.select(*KEYS, "row", "col", "text"), plans.join(state.filter("problematic").select(*KEYS), KEYS, "left_semi"), KEYS, correct)
        done = changed.join(done.withColumnRenamed("text", "_t"), [*KEYS, "row", "col"], "left").withColumn("_same", F.col("text") == F.col("_t"))
        done = done.select(*KEYS, "row", "col", "text", *[F.when(F.col("_same"), F.col(c)).alias(c) for c in ("cell_id", "cell_type", "rect")])
    full = keep(grid.densify(keep(done, "done"), KEYS, kind="cell_type"), "full")
    sized = full.groupBy(*KEYS).agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"))
    report = sized.join(names, KEYS).join(state.select(*KEYS, "expected", "problematic"), KEYS, "left")
    outline = boxes.select(*KEYS, F.struct(*[F.col(c).cast("int").alias(c) for c in "xywh"]).alias("table_rect"))
    out = full.join(names, KEYS).join(outline, KEYS)
    return out.select(*KEYS, "table_id", "table_rect", "row", "col", "cell_id", "cell_type", "text", "rect"), report.select(*KEYS, "table_id", "n_rows", "n_cols", "expected", "problematic"), pages


def place_of(path: Column) -> Column:
    """Where a document goes: parish/book/pagePostprocessed/name for one below .../parish/book/pageTextClassified/, else its name."""
    parts = F.split(path, "/")
    part = lambda k: F.get(parts, F.size(parts) - k)
    return F.when(part(2) == "pageTextClassified", F.concat_ws("/", part(4), part(3), F.lit("pagePostprocessed"), part(1))).otherwise(part(1))


def postprocess(spark: SparkSession, path: str, books: DataFrame, types: DataFrame, out: str, work: str, correct: Callable | None = None) -> DataFrame:
    """Documents under `path` (a folder or pattern) repaired by the catalogue, written below `out`; returns the report.

    books and types are catalogue.books() and catalogue.print_types(). `work` is a folder for the repaired cells that all tasks reach; it is written anew. The report has a row
    for each table that is left, and one with null table_id for each document that has none: (file_name, book_id, opening, layout, printed, fault, table_id, n_rows,
    n_cols, expected, problematic). Documents with a fault are written as they were, repeated file names left out, and all appear when everything is written.
    """
    keep = keeper(spark, work)
    cells, tables_, pages = repaired(page_xml.scan(spark, path), books, types, keep, correct)
    cells, tables_ = keep(cells, "cells"), keep(tables_, "tables")
    files = spark.read.format("binaryFile").load(path).select("path", "content").withColumn("file_name", F.element_at(F.split("path", "/"), -1))
    files = files.join(pages.select("file_name", "fault"), "file_name").filter("fault IS NULL OR fault <> 'repeated file name'")
    new = page_xml.updated_xml(cells, files.select("file_name", "content"), pages.filter("fault IS NULL").select("file_name"), strict=False)
    new = keep(new, "xml")
    written = files.join(new.withColumnRenamed("fault", "_late"), "file_name").select(place_of(F.col("path")).alias("name"), F.coalesce("xml", F.col("content").cast("string")).alias("content"))
    sinks.write_files(written, out, overwrite=True)
    late = new.filter("fault IS NOT NULL").select("file_name", F.col("fault").alias("_late"))
    said = pages.join(late, "file_name", "left").withColumn("fault", F.coalesce("fault", "_late"))
    return said.join(tables_, "file_name", "left").select("file_name", "book_id", "opening", "layout", "printed", "fault", "table_id", "n_rows", "n_cols", "expected", "problematic")
