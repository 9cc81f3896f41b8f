"""Repair of recognised tables by their annotation: merging, surplus and missing columns, empty tables, edits; and the flow over a page.

Cells are long rows (keys..., row, col, text); plans(keys..., headers) says for each table which headers its layout has. Tables without a
plan stay as they are. Widths and places are columns, so tables of different layouts are repaired in one pass. Null texts
are empty, dense grids are assumed (grid.densify), repeated cells of one place are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from . import grid, tables

#: Least score of a column of names that other columns are placed by.
LEAST_SCORE = 2.0


def expectations(plans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, headers, expected, name_at): width and the first place of a header of names (null without one) of plans(keys, headers)."""
    name_at = F.array_position(F.transform("headers", t.header_class), "name")
    return plans.select(*keys, "headers", F.size("headers").alias("expected"), F.when(name_at > 0, (name_at - 1).cast("int")).alias("name_at"))


def _sized(cells: DataFrame, plans: DataFrame, keys: list[str]) -> DataFrame:
    size = cells.groupBy(*keys).agg((F.max("col") + 1).cast("int").alias("n"), F.every(F.coalesce("text", F.lit("")) == "").alias("blank"))
    return size.join(expectations(plans, keys), keys)


def _named(cells: DataFrame, plans: DataFrame, keys: list[str]) -> DataFrame:
    names = grid.name_column(cells, keys).filter(F.col("name_score") >= LEAST_SCORE)
    return _sized(cells, plans, keys).join(names, keys).filter("name_at IS NOT NULL")


def match_empty(cells: DataFrame, plans: DataFrame, keys: list[str]) -> DataFrame:
    """Tables of which every cell is empty and whose width is wrong become one empty row of the right width, with nulls in other columns."""
    wrong = _sized(cells, plans, keys).filter("blank AND n <> expected AND expected > 0")
    kept = cells.join(wrong.select(*keys), keys, "left_anti")
    blank = wrong.select(*keys, F.lit(0).alias("row"), F.explode(F.sequence(F.lit(0), F.col("expected") - 1)).alias("col"), F.lit("").alias("text"))
    return kept.unionByName(blank, allowMissingColumns=True)


def surplus(cells: DataFrame, plans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, col) to remove from tables that are too wide, with the column of names as anchor. Left of where it should stand, and at the right
    end, as many columns are looked at as are too many; of these the run of empty ones from the left edge goes."""
    placed = _named(cells, plans, keys).filter("n > expected").withColumn("_l", F.greatest(F.lit(0), F.col("name_col") - F.col("name_at")))
    placed = placed.select(*keys, "n", "_l", F.greatest(F.lit(0), F.col("n") - F.col("expected") - F.col("_l")).alias("_r"))
    empty = cells.groupBy(*keys, "col").agg(F.every(F.coalesce("text", F.lit("")) == "").alias("empty")).join(placed, keys)
    part = empty.withColumn("part", F.when(F.col("col") < F.col("_l"), "left").when(F.col("col") >= F.col("n") - F.col("_r"), "right")).filter("part IS NOT NULL")
    # where the windows meet, a column of the left one that also lies in the right one is looked at again
    again = empty.filter((F.col("col") < F.col("_l")) & (F.col("col") >= F.col("n") - F.col("_r"))).withColumn("part", F.lit("right"))
    run = Window.partitionBy(*keys, "part").orderBy("col").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return part.unionByName(again).withColumn("_run", F.every("empty").over(run)).filter("_run").select(*keys, "col").distinct()


def remove_surplus(cells: DataFrame, plans: DataFrame, keys: list[str]) -> DataFrame:
    return grid.remove_columns(cells, keys, surplus(cells, plans, keys))


def pad(cells: DataFrame, plans: DataFrame, keys: list[str]) -> DataFrame:
    """Tables that are too narrow get empty columns: left, until the names stand in their place, and right, up to the width of the layout. Those
    that would become too wide stay as they are."""
    fits = _named(cells, plans, keys).filter("n < expected AND name_col <= name_at AND n + name_at - name_col <= expected").select(*keys, (F.col("name_at") - F.col("name_col")).alias("_pad"), "expected", "n")
    moved = cells.join(fits, keys, "left").select(*keys, "row", (F.col("col") + F.coalesce("_pad", F.lit(0))).cast("int").alias("col"), "text")
    places = F.filter(F.sequence(F.lit(0), F.col("expected") - 1), lambda c: (c < F.col("_pad")) | (c >= F.col("_pad") + F.col("n")))
    blank = cells.select(*keys, "row").distinct().join(fits, keys).select(*keys, "row", F.explode(places).alias("col"), F.lit("").alias("text"))
    return moved.unionByName(blank)


def merge_cells(cells: DataFrame, boxes: DataFrame, page: str, table: str, gap: float = 0.2) -> DataFrame:
    """cells(page, table, row, col, text) with the cells of two tables side by side put together where a page should have one.

    boxes(page, table, x, w, page_width, expected): the right table's columns follow the left one's, rows meet by number, and what is missing
    stays missing; the left table's name stays. Pages with another number of tables, and tables too far apart, stay as they are. Equal places go by name; other columns stay.
    """
    pair = boxes.groupBy(page).agg(F.sort_array(F.collect_list(F.struct("x", table, "w"))).alias("ts"), F.max("page_width").alias("_w"), F.max("expected").alias("_e")).filter("size(ts) = 2 AND _e = 1")
    left, right = F.get("ts", F.lit(0)), F.get("ts", F.lit(1))
    near = pair.filter(F.abs(left["x"] + left["w"] - right["x"]) < gap * F.col("_w")).select(page, left[table].alias("_left"), right[table].alias("_right"))
    width = cells.join(near.select(page, F.col("_left").alias(table)), [page, table], "left_semi").groupBy(page).agg((F.max("col") + 1).alias("_n"))
    joined = cells.join(near.join(width, page, "left"), page, "left")
    second = F.coalesce(F.col(table) == F.col("_right"), F.lit(False))
    placed = {table: F.when(second, F.col("_left")).otherwise(F.col(table)), "col": (F.col("col") + F.when(second, F.coalesce("_n", F.lit(0))).otherwise(0)).cast("int")}
    return joined.withColumns(placed).select(*cells.columns)


def longest_column(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, col): the column with the longest text, the first of equals; -1 where all texts are empty."""
    longest = cells.groupBy(*keys, "col").agg(F.max(F.length(F.coalesce("text", F.lit("")))).alias("n"))
    best = longest.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("col")).alias("c"))).alias("b"))
    return best.select(*keys, F.when(F.col("b.n") > 0, -F.col("b.c")).otherwise(-1).cast("int").alias("col"))


def delete_columns(cells: DataFrame, keys: list[str], places: Column) -> DataFrame:
    """Without the columns at the places (an array); places beyond the table are ignored, the rest is numbered anew."""
    kept = cells.filter(~F.array_contains(places, F.col("col")))
    before = F.size(F.filter(F.array_distinct(places), lambda p: (p >= 0) & (p < F.col("col"))))
    return kept.withColumn("col", (F.col("col") - before).cast("int"))


def insert_empty_columns(cells: DataFrame, keys: list[str], places: list[int]) -> DataFrame:
    """Empty columns at places of the table as it is, from the last place on; places beyond its end are its end."""
    size = cells.groupBy(*keys).agg((F.max("col") + 1).cast("int").alias("_n"))
    wide = cells.join(size, keys)
    at = F.array(*[F.least(F.lit(p), F.col("_n")) for p in sorted(places)])
    moved = wide.select(*keys, "row", (F.col("col") + F.size(F.filter(at, lambda p: p <= F.col("col")))).cast("int").alias("col"), "text")
    new = wide.select(*keys, "row", "_n").distinct().select(*keys, "row", F.posexplode(at).alias("_i", "_p")).select(*keys, "row", (F.col("_p") + F.col("_i")).cast("int").alias("col"), F.lit("").alias("text"))
    return moved.unionByName(new)


def _bounded(cells: DataFrame, keys: list[str], at: int, axis: str, room: int) -> DataFrame:
    """cells, failing when read where `at` lies outside a table."""
    size = Window.partitionBy(*keys)
    n = F.max(axis).over(size) + 1
    return cells.withColumn(axis, F.when((F.lit(at) >= 0) & (F.lit(at) < n + room), F.col(axis)).otherwise(F.raise_error(F.lit(f"{axis} {at} lies outside the table")).cast("int")))


def insert_row(cells: DataFrame, keys: list[str], at: int, texts: list[str]) -> DataFrame:
    """A row of texts before row `at` (the end is allowed); an error where a table has another width or fewer rows."""
    wide = _bounded(cells, keys, at, "row", 1)
    size = Window.partitionBy(*keys)
    fits = F.when(F.max("col").over(size) + 1 == len(texts), F.col("col")).otherwise(F.raise_error(F.lit("row of another length")).cast("int"))
    moved = wide.withColumn("col", fits).withColumn("row", (F.col("row") + (F.col("row") >= at).cast("int")).cast("int")).select(*keys, "row", "col", "text")
    new = cells.select(*keys).distinct().select(*keys, F.lit(at).alias("row"), F.posexplode(F.array(*map(F.lit, texts))).alias("col", "text"))
    return moved.unionByName(new)


def remove_row(cells: DataFrame, keys: list[str], at: int) -> DataFrame:
    """Without row `at`; an error where a table has none."""
    wide = _bounded(cells, keys, at, "row", 0)
    return wide.filter(F.col("row") != at).withColumn("row", (F.col("row") - (F.col("row") > at).cast("int")).cast("int")).select(*keys, "row", "col", "text")


def cell_at(cells: DataFrame, keys: list[str], row: int, col: int) -> DataFrame:
    """(keys, text): each table's text at a place, null outside it."""
    return cells.groupBy(*keys).agg(F.max(F.when((F.col("row") == row) & (F.col("col") == col), F.col("text"))).alias("text"))


def set_cell(cells: DataFrame, row: int, col: int, text: str) -> DataFrame:
    return cells.withColumn("text", F.when((F.col("row") == row) & (F.col("col") == col), F.lit(text)).otherwise(F.col("text")))


def problematic(cells: DataFrame, plans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, expected, problematic): whether a table's width still differs from its layout's; tables without a plan are left out."""
    return _sized(cells, plans, keys).select(*keys, "n", "expected", (F.col("n") != F.col("expected")).alias("problematic"))


def postprocess(cells: DataFrame, boxes: DataFrame, plans: DataFrame, page: str = "page", table: str = "table", overlap: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """The flow for printed pages: tables that lie under others go, two halves of one table are merged, empty tables take their layout's width, empty columns
    at the sides go. Returns the cells and (page, table, n, expected, problematic).

    cells(page, table, row, col, text), boxes(page, table, x, y, w, h, page_width, expected), plans(page, table, headers).
    """
    rect = F.struct("x", "y", "w", "h")
    kept = tables.remove_overlapping(boxes, page, table, rect, overlap)
    cells, boxes = (df.join(kept, [page, table], "left_semi") for df in (cells.select(page, table, "row", "col", "text"), boxes))
    merged = merge_cells(cells, boxes, page, table)
    done = remove_surplus(match_empty(merged, plans, [page, table]), plans, [page, table])
    return done, problematic(done, plans, [page, table])
