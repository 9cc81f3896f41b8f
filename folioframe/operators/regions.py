"""Regions and lines of pages: ensembles of two detectors, halves of openings, categories of regions, counts over documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g

#: The categories of a page's regions from top left to bottom right, by how many there are.
CATEGORIES = {3: ["title", "header", "content"], 4: ["header", "header", "content", "content"], 6: ["title", "title", "header", "header", "content", "content"]}


def ensemble(first: DataFrame, second: DataFrame, page: str, threshold: float = 0.5, combine: str = "union") -> DataFrame:
    """(page, kind, i, j, r): boxes (page, ord, r) of two detectors put together. A first box whose best partner overlaps by more than the threshold
    becomes the box around both, or with `intersection` their common part (`both`), one with less overlap stays (`first`), one without any goes; second boxes that overlap none stay
    (`second`). The best partner is the one of the largest IoU, then the lowest ord. Boxes meet within a page only; a page's boxes are few."""
    a, b = first.select(page, F.col("ord").alias("i"), F.col("r").alias("a")), second.select(page, F.col("ord").alias("j"), F.col("r").alias("b"))
    pairs = a.join(b, page).withColumn("iou", g.iou(F.col("a"), F.col("b"))).filter("iou > 0")
    best = pairs.groupBy(page, "i").agg(F.max_by(F.struct("a", "b", "j", "iou"), F.struct("iou", (-F.col("j")).alias("n"))).alias("m"))
    outer, inner = (F.least, F.greatest) if combine == "union" else (F.greatest, F.least)
    x, y = outer("m.a.x", "m.b.x"), outer("m.a.y", "m.b.y")
    around = g.rect(x, y, inner(F.expr("m.a.x + m.a.w"), F.expr("m.b.x + m.b.w")) - x, inner(F.expr("m.a.y + m.a.h"), F.expr("m.b.y + m.b.h")) - y)
    strong = F.col("m.iou") > threshold
    found = best.select(page, F.when(strong, "both").otherwise("first").alias("kind"), "i", F.when(strong, F.col("m.j")).alias("j"), F.when(strong, around).otherwise(F.col("m.a")).alias("r"))
    alone = b.join(pairs.select(page, "j").distinct(), [page, "j"], "left_anti")
    return found.unionByName(alone.select(page, F.lit("second").alias("kind"), F.lit(None).cast(first.schema["ord"].dataType).alias("i"), "j", F.col("b").alias("r")))


def lines_in_regions(lines: DataFrame, regions: DataFrame, page: str) -> DataFrame:
    """(page, line, region): each line's region, the one that covers most of the line's box, the lowest ord of equals; null without any."""
    near = lines.select(page, F.col("ord").alias("line"), F.col("r").alias("a")).join(regions.select(page, F.col("ord").alias("region"), F.col("r").alias("b")), page, "left")
    common = F.coalesce(g.overlap_area(F.col("a"), F.col("b")), F.lit(0))
    return near.groupBy(page, "line").agg(F.max_by(F.when(common > 0, F.col("region")), F.struct(common.alias("c"), (-F.coalesce("region", F.lit(0))).alias("n"))).alias("region"))


def page_half(r: Column, width: Column) -> Column:
    """left where both ends of a box lie left of the middle, else right."""
    half = F.floor(width / 2)
    return F.when((r["x"] < half) & (r["x"] + r["w"] < half), "left").otherwise("right")


def moved_middle(boxes: DataFrame, page: str, width: str = "page_width") -> DataFrame:
    """(page, middle): the middle of each page, moved right to the furthest end of the boxes that cross it; a box then lies left if it begins at or before it."""
    half = F.floor(F.col(width) / 2)
    crossing = F.when((F.col("r.x") < half) & (F.col("r.x") + F.col("r.w") >= half), F.col("r.x") + F.col("r.w"))
    return boxes.groupBy(page).agg(F.greatest(F.max(half), F.max(crossing)).alias("middle"))


def categories(regions: DataFrame, page: str) -> DataFrame:
    """regions(page, x, y, ...) with category by place (top to bottom, then left to right, then by ord if there is one) on pages of three, four or six regions; null on others."""
    order = Window.partitionBy(page).orderBy("y", "x", *[c for c in ("ord",) if c in regions.columns])
    every = Window.partitionBy(page)
    placed = regions.select("*", F.row_number().over(order).alias("_r"), F.count(F.lit(1)).over(every).alias("_n"))
    out = None
    for n, names in CATEGORIES.items():
        name = F.element_at(F.array(*map(F.lit, names)), F.col("_r"))
        out = F.when(F.col("_n") == n, name) if out is None else out.when(F.col("_n") == n, name)
    return placed.withColumn("category", out).drop("_r", "_n")


def shares(points: Column, width: Column, height: Column) -> Column:
    """Points as shares of the page, x and y in turn."""
    return F.flatten(F.transform(points, lambda p: F.array(p["x"] / width, p["y"] / height)))


def cell_corners(r: Column) -> Column:
    """The four corners of a cell, from the upper left on."""
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(point(r["x"], r["y"]), point(r["x"] + r["w"], r["y"]), point(r["x"] + r["w"], r["y"] + r["h"]), point(r["x"], r["y"] + r["h"]))


def until_small(regions: DataFrame, doc: str) -> DataFrame:
    """regions(doc, ord, points, ...) before the first one of each document, by ord, with fewer than four points: there the older reader stops."""
    stop = regions.filter(F.size("points") < 4).groupBy(doc).agg(F.min("ord").alias("_stop"))
    return regions.join(stop, doc, "left").filter("_stop IS NULL OR ord < _stop").drop("_stop")


def coco(regions: DataFrame, classes: list[str]) -> DataFrame:
    """(keys..., category_id, segmentation, bbox): regions(..., ord, type, points) as COCO annotations: flat outlines, corners of the box, the class's place
    in the list (null for others). Outlines of fewer than four points are left out; until_small() leaves out all behind one too."""
    points = F.col("points")
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    place = F.array_position(F.array(*map(F.lit, classes)), F.col("type")).cast("int")
    flat = F.flatten(F.transform(points, lambda p: F.array(p["x"], p["y"])))
    return regions.filter(F.size("points") >= 4).select("*", F.when(place > 0, place - 1).alias("category_id"), flat.alias("segmentation"), F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)).alias("bbox")).drop("points")


def type_counts(regions: DataFrame, doc: str, known: list[str]) -> DataFrame:
    """(type, most, total): how many regions of each type a document has at most, and all together; other types and null are `unknown`."""
    kind = F.when(F.col("type").isin(*known), F.col("type")).otherwise("unknown")
    per = regions.groupBy(doc, kind.alias("type")).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("type").agg(F.max("n").alias("most"), F.sum("n").alias("total"))


def label_offsets(counts: DataFrame) -> DataFrame:
    """counts(ord, type, most) with first: where each type's labels begin, 1 and then after those of the types before it. A row for each type."""
    before = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("ord", "type", "most", (F.coalesce(F.sum("most").over(before), F.lit(0)) + 1).alias("first"))


def first_of_label(labels: DataFrame, offsets: DataFrame) -> DataFrame:
    """labels(label, ...) with the last place at or before it where a type's labels begin; 1 below all. offsets has a row for each type and becomes one array."""
    listed = offsets.agg(F.sort_array(F.collect_set("first")).alias("_o"))
    return labels.join(listed, F.lit(True)).select("*", F.coalesce(F.try_element_at(F.filter("_o", lambda o: o <= F.col("label")), F.lit(-1)), F.lit(1)).alias("first")).drop("_o")


def best_borders(alphas: DataFrame, region: str) -> DataFrame:
    """(region, alpha, borders): of alphas(region, alpha, borders array) the one with the most borders, the least alpha of equals, its borders in order."""
    best = alphas.groupBy(region).agg(F.max_by(F.struct("alpha", "borders"), F.struct(F.size("borders").alias("n"), (-F.col("alpha")).alias("a"))).alias("b"))
    return best.select(region, "b.alpha", F.sort_array("b.borders").alias("borders"))
