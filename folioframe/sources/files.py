"""Listings of folders and archives as rows: books, pages, images, and which belong together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, stem, folder, length) of the files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length")
    return with_names(files)


def with_names(files: DataFrame, path: str = "path") -> DataFrame:
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    return files.withColumns({"name": name, "stem": F.regexp_replace(name, r"\.[^.]*$", ""), "folder": F.get(parts, F.size(parts) - 2)})


def books(files: DataFrame, folder: str = "pageTextClassified") -> DataFrame:
    """(parish, book, path) of files below folders .../parish/book/folder/, by their path; files elsewhere are left out."""
    parts = F.split("path", "/")
    return files.filter(F.get(parts, F.size(parts) - 2) == folder).select(F.get(parts, F.size(parts) - 4).alias("parish"), F.get(parts, F.size(parts) - 3).alias("book"), "path")


def parish_of_folder(folder: Column) -> Column:
    """The parish in `autods_<parish>_fold_<n>`, null for other names."""
    return F.nullif(F.regexp_extract(folder, r"^autods_(.+?)_fold_\d+$", 1), F.lit(""))


def folder_of_parish(parishes: DataFrame, folders: DataFrame) -> DataFrame:
    """(parish, folder): for each parish the first folder (by name) `<word>_<parish>_...`; null without one. A folder meets the parishes that its own name can
    hold, word by word, so the join is by equality."""
    words = F.split("folder", "_")
    names = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 2, F.lit(1))), lambda n: F.array_join(F.slice(words, 2, n), "_"))
    able = folders.filter(F.size(words) > 2).select("folder", F.explode(names).alias("parish")).groupBy("parish").agg(F.min("folder").alias("folder"))
    return parishes.join(able, "parish", "left")


def pairs(images: DataFrame, documents: DataFrame, key: str = "stem") -> DataFrame:
    """(key, image, document, status): images and documents of one name: `pair`, `no document`, `no image`, or `several` where a name is not unique on a side."""
    a = images.groupBy(key).agg(F.min("path").alias("image"), F.count(F.lit(1)).alias("_i"))
    b = documents.groupBy(key).agg(F.min("path").alias("document"), F.count(F.lit(1)).alias("_d"))
    status = F.when(F.col("image").isNull(), "no image").when(F.col("document").isNull(), "no document").when((F.col("_i") > 1) | (F.col("_d") > 1), "several").otherwise("pair")
    return a.join(b, key, "full").select(key, "image", "document", status.alias("status"))


def checked(df: DataFrame, wrong: Column, message: str) -> DataFrame:
    """df, failing when read if a row is wrong."""
    return df.filter(F.when(wrong, F.raise_error(F.lit(message)).cast("boolean")).otherwise(True))


def latest_by_name(files: DataFrame) -> DataFrame:
    """One path for each file name, the last by path."""
    return files.groupBy("name").agg(F.max("path").alias("path"))


def labelled_by_folder(files: DataFrame) -> DataFrame:
    """(path, label): files that lie in a folder named after their class."""
    return files.select("path", F.col("folder").alias("label"))


def label_counts(labelled: DataFrame) -> DataFrame:
    """(label, n): how many files lie in the folder of each class."""
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def context_files(target: DataFrame, others: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(book_id, path): for each book of target(book_id) at most n of its files in others(book_id, path), by a seeded digest of the path."""
    from pyspark.sql import Window

    order = Window.partitionBy("book_id").orderBy(F.md5(F.concat(F.lit(str(seed)), F.col("path"))), "path")
    found = others.join(target.select("book_id").distinct(), "book_id", "left_semi")
    return found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).select("book_id", "path")


def evaluation_pairs(annotated: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, name, kind, status, actual, target) for each annotated document: the one classified document of the same parish, doctype, years, source and page, and
    where both go below an evaluation tree (the last six parts of the classified one's path).

    Both sides are (path, name). kind is the folder four levels up the annotated path. Status: `pair`; `no name` where the name has no such parts; `missing` and `several` by
    the number of classified documents; `no kind` where the folder is neither printed nor handdrawn.
    """
    parts = ["parish", "doctype", "year_range", "source", "page_number"]
    meta = t.file_meta(F.col("name"))
    keyed = lambda df: df.select("path", "name", *[meta[p].alias(p) for p in parts])
    folders = F.split("path", "/")
    classified = keyed(actual.filter((F.get(folders, F.size(folders) - 2) == "pageTextClassified") & F.startswith("name", F.lit("autods_"))))
    found = classified.filter("parish IS NOT NULL").groupBy(*parts).agg(F.min("path").alias("actual"), F.count(F.lit(1)).alias("_n"))
    joined = keyed(annotated).join(found, parts, "left")
    kind = F.get(folders, F.size(folders) - 4)
    status = F.when(F.col("parish").isNull(), "no name").when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "several").when(~kind.isin("printed", "handdrawn"), "no kind").otherwise("pair")
    target = F.array_join(F.slice(F.split("actual", "/"), -6, 6), "/")
    return joined.select("path", "name", kind.alias("kind"), status.alias("status"), "actual", target.alias("target"))


def evaluation_files(pairs_: DataFrame) -> DataFrame:
    """(name, source): the copies that make the evaluation tree of evaluation_pairs(), for sinks.write_files()."""
    found = pairs_.filter("status = 'pair'")
    place = lambda side: F.concat_ws("/", "kind", F.lit(side), "target").alias("name")
    return found.select(place("annotated"), F.col("path").alias("source")).unionByName(found.select(place("actual"), F.col("actual").alias("source")))


def free_name(wanted: str, taken: list[str]) -> str:
    """wanted, or with _1, _2 ... before its extension, so that it is not taken."""
    stem, dot, end = wanted.rpartition(".") if "." in wanted else (wanted, "", "")
    return next(n for n in (wanted, *(f"{stem}_{i}{dot}{end}" for i in range(1, len(taken) + 2))) if n not in taken)
