"""JSON lines, lists and tab-separated tables of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t

# The columns of the master table.
MASTER = ["book name", "url", "layout type", "log", "direction", "book parish", "from", "to"]


def column_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(xml_path, table_id, item_name, columns) from JSON lines or printed dictionaries; the last line of a key wins, files in the order of their names.
    Nothing is evaluated: the words None, True and False outside quotes are read as JSON's, lines that do not parse are left out."""
    schema = "xml_path STRING, table_id STRING, item_name STRING, columns ARRAY<INT>"
    # whole files, which are some thousand lines, so that a line's number is known
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("_f"), F.posexplode(F.split("value", r"\r?\n")).alias("_i", "value"))
    lines = files.select(F.struct("_f", "_i").alias("_n"), literals(F.col("value")).alias("value"))
    rows = lines.select("_n", F.from_json("value", schema, {"allowSingleQuotes": "true"}).alias("r")).filter("r.xml_path IS NOT NULL").select("_n", "r.*")
    latest = Window.partitionBy("xml_path", "table_id", "item_name").orderBy(F.desc("_n"))
    return rows.withColumn("_r", F.row_number().over(latest)).filter("_r = 1").drop("_n", "_r")


def literals(line: Column) -> Column:
    """A printed dictionary's None, True and False, where they stand as values, as JSON has them."""
    for word, plain in (("None", "null"), ("True", "true"), ("False", "false")):
        line = F.regexp_replace(line, rf"([:\[,]\s*){word}(?=\s*[,\]}}])", f"$1{plain}")
    return line


def prediction_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(prediction, annotation), stripped, of a JSON array of objects; pairs whose annotation holds a question mark are left out, null texts stop the query."""
    rows = spark.read.option("multiLine", "true").schema("annotation STRING, prediction STRING").json(path)
    known = lambda c: t.strip(F.coalesce(c, F.raise_error(F.lit(f"{c} is null")).cast("string"))).alias(c)
    return rows.select(known("prediction"), known("annotation")).filter(~F.col("annotation").contains("?"))


def crop_index(spark: SparkSession, path: str) -> DataFrame:
    """(number, file_name, text) of a JSON object of numbered crops."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, struct<file_name: string, text: string>>").alias("m"))
    return whole.select(F.explode("m").alias("number", "c")).select(F.col("number").cast("int").alias("number"), "c.*")


def viewer_cells(flat: DataFrame) -> DataFrame:
    """(file_name, json): the cells of each document (file_name, ord, coords, baseline, text) as one JSON array in their order. A document's cells are few."""
    listed = F.sort_array(F.collect_list(F.struct("ord", "coords", "baseline", "text")))
    return flat.groupBy("file_name").agg(F.to_json(F.transform(listed, lambda x: F.struct(x["coords"].alias("coords"), x["baseline"].alias("baseline"), x["text"].alias("text"))), {"ignoreNullFields": "false"}).alias("json"))


def stored_or(spark: SparkSession, path: str, build) -> DataFrame:
    """What was stored under path as JSON lines, or else what build() gives, stored there: state that a later run takes up again."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.json(path)
    except AnalysisException:
        build().write.json(path)
        return spark.read.json(path)


def name_list(spark: SparkSession, path: str) -> DataFrame:
    """The first word of every line that has one."""
    return spark.read.text(path).select(F.get(F.split(F.trim("value"), r"\s+"), F.lit(0)).alias("name")).filter("name <> ''")


def write_records(records: DataFrame, path: str, append: bool = True) -> None:
    records.write.mode("append" if append else "overwrite").json(path)


def master_lines(rows: DataFrame) -> DataFrame:
    """One column `value`: the fixed fields and then the array `original columns`, separated by tabs."""
    fields = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("None")) for c in MASTER]
    return rows.select(F.concat_ws("\t", *fields, F.concat_ws("\t", "`original columns`")).alias("value"))
