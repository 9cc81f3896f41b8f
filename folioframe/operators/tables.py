"""Order-dependent operators on the tables of a page: overlaps, merges and greedy matching.

A page's tables are few, so each page is one array that a higher-order function folds: one shuffle by page, no self-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g


def remove_overlapping(tables: DataFrame, page: str, ordinal: str, rect: Column, threshold: float = 0.9) -> DataFrame:
    """(page, ordinal) of tables that stay: from the largest area on, a table goes if more than `threshold` of it lies in one that stays.

    Equal areas keep their order. A table that has gone suppresses none.
    """
    row = F.struct((-g.area(rect)).alias("neg"), F.col(ordinal).alias("ord"), rect.alias("r"))
    listed = F.sort_array(F.collect_list(row))

    def keep(kept, t):
        size = g.area(t["r"])
        hidden = F.exists(kept, lambda k: F.when(size > 0, g.overlap_area(k["r"], t["r"]) / size).otherwise(0.0) > threshold)
        return F.when(hidden, kept).otherwise(F.concat(kept, F.array(t)))

    kept = F.aggregate("ts", F.slice("ts", 1, 0), keep)
    pages = tables.groupBy(page).agg(listed.alias("ts")).select(page, F.explode(kept).alias("t"))
    return pages.select(page, F.col("t.ord").alias(ordinal))


def match_greedy(truth: DataFrame, predicted: DataFrame, page: str) -> DataFrame:
    """(page, i, j, iou): over both tables (page, ord, r), the pair of the largest IoU above 0 first, each table once;
    truth without a partner has j null and iou 0. Ties go to the lower i, then j. Pairs exist within one page only, in one shuffle of both
    tables; those without a page have no partner."""
    rows = truth.select(page, F.struct("ord", "r").alias("_t"), F.lit(None).alias("_p")).unionByName(predicted.select(page, F.lit(None).alias("_t"), F.struct("ord", "r").alias("_p")))
    pages = rows.groupBy(page).agg(F.collect_list("_t").alias("_t"), F.collect_list("_p").alias("_p")).filter(F.size("_t") > 0)
    pairs = F.flatten(F.transform("_t", lambda a: F.transform("_p", lambda b: F.struct((-g.iou(a["r"], b["r"])).alias("neg"), a["ord"].alias("i"), b["ord"].alias("j")))))
    listed = pages.select(page, "_t", F.sort_array(F.filter(pairs, lambda p: (p["neg"] < 0) & F.col(page).isNotNull())).alias("_ps"))

    def take(done, p):
        used = F.exists(done, lambda d: (d["i"] == p["i"]) | (d["j"] == p["j"]))
        return F.when(used, done).otherwise(F.concat(done, F.array(p)))

    matched = listed.select(page, F.explode(F.transform("_t", lambda t: t["ord"])).alias("i"), F.aggregate("_ps", F.slice("_ps", 1, 0), take).alias("_m"))
    own = matched.select(page, "i", F.get(F.filter("_m", lambda m: m["i"] == F.col("i")), F.lit(0)).alias("_m"))
    return own.select(page, "i", F.col("_m.j").alias("j"), F.coalesce(-F.col("_m.neg"), F.lit(0.0)).alias("iou"))


def precision_recall(matches: DataFrame, n_truth: Column, n_predicted: Column, threshold: float) -> tuple[Column, Column, Column]:
    """Precision, recall and mean IoU (unmatched truth counts 0) as aggregates of matches."""
    hit = F.count_if(F.col("j").isNotNull() & (F.col("iou") >= threshold))
    mean = F.sum(F.when(F.col("iou") >= threshold, F.col("iou")).otherwise(0.0)) / F.count(F.lit(1))
    return F.coalesce(F.try_divide(hit, n_predicted), F.lit(0.0)), F.coalesce(F.try_divide(hit, n_truth), F.lit(0.0)), mean


def merge_separated(tables: DataFrame, page: str, expected: str, page_width: Column, gap: float = 0.2) -> DataFrame:
    """tables(page, ord, x, y, w, h, n_cols, expected): where one is expected and there are two side by side, closer than gap of
    the page width, one row with the rectangle around both, the columns of both and the ordinal of the left; else as they are.
    """
    listed = tables.groupBy(page).agg(F.sort_array(F.collect_list(F.struct("x", "ord", "y", "w", "h", "n_cols"))).alias("ts"), F.max(expected).alias("expected"), F.max(page_width).alias("_w"))
    a, b = F.get("ts", F.lit(0)), F.get("ts", F.lit(1))
    joins = (F.col("expected") == 1) & (F.size("ts") == 2) & (F.abs(a["x"] + a["w"] - b["x"]) < gap * F.col("_w"))
    right, low, top = F.greatest(a["x"] + a["w"], b["x"] + b["w"]), F.greatest(a["y"] + a["h"], b["y"] + b["h"]), F.least(a["y"], b["y"])
    merged = F.struct(a["x"].alias("x"), a["ord"].alias("ord"), top.alias("y"), (right - a["x"]).alias("w"), (low - top).alias("h"), (a["n_cols"] + b["n_cols"]).alias("n_cols"))
    return listed.select(page, F.explode(F.when(joins, F.array(merged)).otherwise(F.col("ts"))).alias("t"), joins.alias("merged")).select(page, "t.ord", "t.x", "t.y", "t.w", "t.h", "t.n_cols", "merged")


def boxes(cells: DataFrame, *keys: str) -> DataFrame:
    """The rectangle around the cells (x, y, w, h) of each group, and how many they are: groups of one cell too; page_xml.evaluation_boxes() leaves tables of one cell out."""
    return cells.groupBy(*keys).agg(
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"), F.count(F.lit(1)).alias("n_cells")
    )
