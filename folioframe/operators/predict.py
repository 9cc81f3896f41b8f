"""Hooks for external models. A predictor is a plain function that tasks call; here are the shapes in which rows reach it and how its answers are checked.

Every hook takes the predictor as an argument and has a deterministic stand-in, since models are not part of this library. Groups that
reach a predictor whole (a batch of cells, a table's head, a book's sample) are bounded by a parameter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import grid, repair


def read_cells(cells: DataFrame, image: str, predictor: Callable[[list[bytes]], list[str]], batch: int = 16, out: str = "text") -> DataFrame:
    """cells with the text that a recogniser reads from the image of each, in batches; null images are not sent and read null."""

    @F.pandas_udf(StringType())
    def recognise(images: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in images:
            answers = pd.Series([None] * len(series), dtype=object)
            known = [i for i, x in enumerate(series) if x is not None]
            for at in range(0, len(known), batch):
                places = known[at : at + batch]
                for i, text in zip(places, predictor([series.iloc[i] for i in places])):
                    answers.iloc[i] = text
            yield answers

    return cells.withColumn(out, recognise(image))


def classify_cells(cells: DataFrame, image: str, predictor: Callable[[list[bytes]], list[dict[str, float]]], batch: int = 50) -> DataFrame:
    """cells with label and score: the most likely class of each image, the first by name of equals; null images have none."""
    kind = StructType([StructField("label", StringType()), StructField("score", DoubleType())])

    @F.pandas_udf(kind)
    def classify(images: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in images:
            labels, scores = [None] * len(series), [None] * len(series)
            known = [i for i, x in enumerate(series) if x is not None]
            for at in range(0, len(known), batch):
                places = known[at : at + batch]
                for i, shares in zip(places, predictor([series.iloc[i] for i in places])):
                    labels[i], scores[i] = min(shares.items(), key=lambda x: (-x[1], x[0]))
            yield pd.DataFrame({"label": labels, "score": scores})

    return cells.withColumn("_c", classify(image)).select("*", "_c.label", "_c.score").drop("_c")


def best_class(shares: Column, names: Column) -> tuple[Column, Column]:
    """The name and share of the largest of an array of shares, the first of equals."""
    top = F.array_max(shares)
    return F.element_at(names, F.array_position(shares, top).cast("int")), top


def book_notes(samples: DataFrame, book: str, predictor: Callable[[list[str]], str], n: int = 15) -> DataFrame:
    """(book, notes): what a model says of at most n sample texts of each book, samples(book, ord, text), the first by ord."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({book: [pdf[book].iloc[0]], "notes": [predictor(pdf.sort_values("ord")["text"].tolist())]})

    kind = samples.schema[book].dataType.simpleString()
    return grid.head(samples, [book], ["ord"], n).groupBy(book).applyInPandas(run, f"{book} {kind}, notes string")


def generated_headers(rows: DataFrame, keys: list[str], predictor: Callable[[list[list[str]]], list[str]], n: int = 10) -> DataFrame:
    """(keys, headers): headers that a model gives for the first n rows of each table, rows(keys, row, texts); null where their number is not the table's width."""
    types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = [list(x) for x in pdf.sort_values("row")["texts"]]
        given = predictor(texts)
        out = pdf.head(1)[keys].copy()
        out["headers"] = pd.Series([list(given) if len(given) == len(texts[0]) else None], index=out.index, dtype=object)
        return out

    return grid.head(rows, keys, ["row"], n).groupBy(*keys).applyInPandas(run, f"{types}, headers array<string>")


def parish_columns(rows: DataFrame, keys: list[str], predictor: Callable[[list[list[str]]], int], n: int = 5) -> DataFrame:
    """(keys, col): the column that a model takes for the one of parishes, on seeing the first n rows of each table, rows(keys, row, texts); null where it finds none (-1) or one
    that the table does not have."""
    types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = [list(x) for x in pdf.sort_values("row")["texts"]]
        col = int(predictor(texts))
        out = pdf.head(1)[keys].copy()
        out["col"] = pd.array([col if 0 <= col < len(texts[0]) else None], dtype="Int32")
        return out

    return grid.head(rows, keys, ["row"], n).groupBy(*keys).applyInPandas(run, f"{types}, col int")


def common_width(tables: DataFrame, group: str) -> DataFrame:
    """tables(group, n_cols, ...) of the most common width of their group; of equally common widths the smallest."""
    counts = tables.groupBy(group, "n_cols").agg(F.count(F.lit(1)).alias("_n"))
    most = counts.groupBy(group).agg(F.max_by("n_cols", F.struct("_n", (-F.col("n_cols")).alias("s"))).alias("n_cols"))
    return tables.join(most, [group, "n_cols"], "left_semi")


def correct_tables(cells: DataFrame, plans: DataFrame, keys: list[str], predictor: Callable[[list[list[str]], list[str]], list[tuple[str, int]]], n: int = 8) -> DataFrame:
    """cells after the edits (`delete` or `insert` and a place) that a model asks for on seeing the first n rows and the headers of a table of the wrong width.
    Edits apply one after another; those of a table that then still has the wrong width stand all the same."""
    types = ", ".join(f"{k} {cells.schema[k].dataType.simpleString()}" for k in keys)
    wrong = repair.problematic(cells, plans, keys).filter("problematic").select(*keys)
    heads = grid.to_rows(cells.filter(F.col("row") < n).join(wrong, keys, "left_semi"), keys).join(plans, keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        edits = predictor([list(x) for x in pdf.sort_values("row")["texts"]], list(pdf["headers"].iloc[0]))
        out = pdf.head(1)[keys].copy()
        out["edits"] = pd.Series([[{"kind": k, "at": int(a)} for k, a in edits]], index=out.index, dtype=object)
        return out

    asked = heads.groupBy(*keys).applyInPandas(run, f"{types}, edits array<struct<kind: string, at: int>>")
    # where each old column goes: an edit moves the later ones; -1 is deleted
    step = lambda c, e: F.when(c < 0, c).when((e["kind"] == "delete") & (c == e["at"]), -1).when((e["kind"] == "delete") & (c > e["at"]), c - 1).when((e["kind"] == "insert") & (c >= e["at"]), c + 1).otherwise(c)
    moved = cells.join(asked, keys, "left").withColumn("col", F.coalesce(F.aggregate("edits", F.col("col").cast("int"), step), F.col("col").cast("int"))).filter("col >= 0").select(*keys, "row", "col", "text")
    dense = grid.densify(moved.join(asked.select(*keys), keys, "left_semi"), keys).select(*keys, "row", "col", "text")
    return moved.join(asked.select(*keys), keys, "left_anti").unionByName(dense)


def translated(headers: DataFrame, column: str, words: DataFrame) -> DataFrame:
    """headers with the translation of each header from words(term, meaning), the header itself where there is none."""
    return headers.join(words.select(F.col("term").alias(column), F.col("meaning").alias("_m")), column, "left").withColumn("translated", F.coalesce("_m", column)).drop("_m")


def one_table_per_opening(tables: DataFrame, opening: list[str], table: str, seed: int = 42) -> DataFrame:
    """One table of each opening by a seeded digest of its name, the same whatever the partitions."""
    order = Window.partitionBy(*opening).orderBy(F.md5(F.concat(F.lit(str(seed)), F.col(table).cast("string"))), table)
    return tables.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def token_usage(calls: DataFrame, *by: str) -> DataFrame:
    """Sums of prompt_tokens and completion_tokens over calls; null counts as none."""
    return calls.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("prompt_tokens", "completion_tokens")])
