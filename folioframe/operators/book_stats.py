"""Descriptive statistics of books, parishes and the whole: how pages and tables agree with the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counts that are added up, in the order of the report.
COUNTS = [
    "num_xml_files", "num_tables_total", "num_tables_printed", "num_tables_handwritten", "num_columns_total", "num_rows_total", "num_pages_zero_tables",
    "num_pages_wrong_non_zero_table_count", "num_pages_more_tables_than_expected_non_zero", "num_pages_fewer_tables_than_expected_non_zero",
    "num_printed_tables_wrong_cols", "num_printed_tables_more_cols_than_expected", "num_printed_tables_fewer_cols_than_expected",
]
PAGE_RATIOS, TABLE_RATIOS = COUNTS[6:10], COUNTS[10:]


def _page_counts(tables: DataFrame, pages: DataFrame, page: str) -> DataFrame:
    """A row for each page with its counts; pages without a parsed opening count as files alone."""
    listed = tables.groupBy(page).agg(F.collect_list(F.struct("x", "ord", F.col("n_cols").cast("int").alias("n_cols"), F.col("n_rows").cast("long").alias("n_rows"))).alias("_ts"))
    joined = pages.join(listed, page, "left")
    usable = F.col("known") & F.col("opening").isNotNull()
    # two tables stand side by side: the left one first; else as they come
    by_x = F.array_sort("_ts")
    by_ord = F.array_sort("_ts", lambda a, b: F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0))
    ts = F.when(F.size("expected") == 2, by_x).otherwise(by_ord)
    joined = joined.withColumn("_ts", F.when(usable, F.coalesce(ts, F.array().cast(joined.schema["_ts"].dataType))).otherwise(F.array().cast(joined.schema["_ts"].dataType)))
    n, want = F.size("_ts"), F.when(usable, F.size("expected"))
    wrong = F.coalesce((n > 0) & (n != want), F.lit(False))
    # columns are compared where the page has the tables it should have
    diffs = F.when(want.isNotNull() & ~wrong, F.transform("_ts", lambda x, i: F.when(x["n_rows"] > 0, x["n_cols"] - F.get("expected", F.when(F.size("expected") == 1, 0).otherwise(i)))))
    off = lambda test: F.coalesce(F.size(F.filter(diffs, test)), F.lit(0))
    total = lambda field: F.aggregate("_ts", F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["n_rows"] > 0, x[field].cast("long")).otherwise(0))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    values = [
        F.col("known").cast("long"), n.cast("long"), F.when(want.isNotNull(), n).otherwise(0).cast("long"), F.when(want.isNull(), n).otherwise(0).cast("long"), total("n_cols"), total("n_rows"),
        flag((n == 0) & (want > 0)), flag(wrong), flag(wrong & (n > want)), flag(wrong & (n < want)),
        off(lambda d: d != 0).cast("long"), off(lambda d: d > 0).cast("long"), off(lambda d: d < 0).cast("long"),
    ]
    return joined.select("parish", "book_id", "_ts", *[v.alias(c) for c, v in zip(COUNTS, values)])


def _ratios(book: bool) -> list[Column]:
    pages = [F.try_divide(F.col(c), F.col("num_xml_files")).alias(c.replace("num_", "perc_", 1)) for c in PAGE_RATIOS]
    none = F.lit(0.0) if book else F.lit(None).cast("double")  # a book without printed tables has no wrong ones
    tables = [F.when(F.col("num_tables_printed") > 0, F.try_divide(F.col(c), F.col("num_tables_printed"))).when(F.col("num_xml_files") > 0, none).alias(c.replace("num_", "perc_", 1)) for c in TABLE_RATIOS]
    return pages + tables


def per_book(tables: DataFrame, pages: DataFrame, page: str = "page") -> DataFrame:
    """The 24 fields of every book: parish, book_id, 13 counts, 2 medians over tables, 7 ratios.

    tables(page, x, ord, n_cols, n_rows); pages(page, parish, book_id, opening, known, expected array of column counts by place, null for
    handwritten or unknown layouts). Books the catalogue does not know (known false) have zeros and null medians and ratios; tables
    without rows have no columns and count 0 in the medians. Pages are counted first, then books; medians come from counted values.
    """
    counted = _page_counts(tables, pages, page)
    sums = counted.groupBy("parish", "book_id").agg(*[F.sum(c).alias(c) for c in COUNTS])
    each = counted.select("parish", "book_id", F.explode("_ts").alias("t")).select("parish", "book_id", F.when(F.col("t.n_rows") > 0, F.col("t.n_cols")).otherwise(0).alias("c"), F.col("t.n_rows").alias("r"))

    def median(column: str, name: str) -> DataFrame:
        counts = each.groupBy("parish", "book_id", column).agg(F.count(F.lit(1)).alias("n"))
        return counts.groupBy("parish", "book_id").agg(F.percentile(column, 0.5, F.col("n")).alias(name))

    joined = sums.join(median("c", "median_columns_per_table"), ["parish", "book_id"], "left").join(median("r", "median_rows_per_table"), ["parish", "book_id"], "left")
    return joined.select("parish", "book_id", *COUNTS, "median_columns_per_table", "median_rows_per_table", *_ratios(True))


def per_level(books: DataFrame) -> DataFrame:
    """(level, parish, 13 counts, 7 ratios): parishes and the total of per_book rows, in one rollup."""
    sums = books.rollup("parish").agg(F.grouping("parish").alias("_g"), *[F.sum(c).alias(c) for c in COUNTS]).filter(~((F.col("_g") == 1) & F.col("num_xml_files").isNull()))
    return sums.select(F.when(F.col("_g") == 1, "Total").otherwise("Parish").alias("level"), "parish", *COUNTS, *_ratios(False))


def layout_shares(pages: DataFrame, layout: str, categories: list[str], n: int = 5) -> DataFrame:
    """(category, layout, n, percent, rank): pages of each category (layouts that begin with it), rank 0, and its n most frequent layouts,
    ties by name. Bare names of the drawn kinds count as their `misc`. Percent is of all pages, or of the category's."""
    from pyspark.sql import Window

    name = F.when(F.col(layout).isin("free text", "halfbook", "handrawn"), F.concat(F.col(layout), F.lit(" misc"))).otherwise(F.col(layout))
    counts = pages.groupBy(name.alias("layout")).agg(F.count(F.lit(1)).alias("n"))  # a row for each layout from here on
    total = counts.agg(F.sum("n").alias("_all"))
    each = counts.select("*", F.explode(F.array(*map(F.lit, categories))).alias("category")).filter(F.startswith("layout", F.col("category")))
    whole = each.groupBy("category").agg(F.sum("n").alias("_n"))
    order = Window.partitionBy("category").orderBy(F.desc("n"), "layout")
    top = each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).join(whole, "category")
    heads = whole.join(total, F.lit(True)).select("category", F.lit(None).cast("string").alias("layout"), F.col("_n").alias("n"), F.round(F.col("_n") / F.col("_all") * 100, 2).alias("percent"), F.lit(0).alias("rank"))
    return heads.unionByName(top.select("category", "layout", "n", F.round(F.col("n") / F.col("_n") * 100, 2).alias("percent"), "rank"))


def annotation_counts(pages: DataFrame, local: DataFrame, annotated: DataFrame) -> DataFrame:
    """(part, kind, n, percent): pages(file, layout) of the catalogue by kind of layout, then those of them in local(file) and in
    annotated(file). Percent is of the catalogue's pages for `all`, of the local ones for the others; a file listed twice counts once."""
    kind = F.when(F.col("layout").startswith("print"), "print").when(F.col("layout").startswith("handrawn"), "handrawn").when(F.col("layout").startswith("halfbook"), "halfbook").when(F.col("layout").startswith("free text"), "free text").otherwise("other")
    flagged = pages.select("file", kind.alias("kind")).join(local.select("file").distinct().withColumn("_l", F.lit(True)), "file", "left").join(annotated.select("file").distinct().withColumn("_a", F.lit(True)), "file", "left")
    parts = F.filter(F.array(F.lit("all"), F.when(F.col("_l"), "local"), F.when(F.col("_a"), "annotated")), lambda p: p.isNotNull())
    counts = flagged.select("kind", F.explode(parts).alias("part")).groupBy("part", "kind").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.sum(F.when(F.col("part") == "all", F.col("n"))).alias("_all"), F.sum(F.when(F.col("part") == "local", F.col("n"))).alias("_local"))
    share = F.col("n") / F.when(F.col("part") == "annotated", F.col("_local")).otherwise(F.col("_all")) * 100
    return counts.join(totals, F.lit(True)).select("part", "kind", "n", F.round(share, 2).alias("percent"))


def line_counts(lines: DataFrame) -> DataFrame:
    """text_lines and unclear_lines of lines(text): unclear is a line that is exactly a question mark; lines without text count for neither."""
    text = F.trim("text")
    has = F.coalesce(F.length("text") > 0, F.lit(False))
    return lines.agg(F.count_if(has & (text != "?")).alias("text_lines"), F.count_if(has & (text == "?")).alias("unclear_lines"))
