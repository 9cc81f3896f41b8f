"""Record extraction with an injectable predictor, and its scoring against neighbouring rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from .grid import batches

Predictor = Callable[[list[list[str]]], list[dict[str, str]]]


def first_words(rows: list[list[str]]) -> list[dict[str, str]]:
    """A deterministic stand-in for an external model: the first text is the person's name, the last the parish."""
    return [{"person_name": r[0] if r else "", "parish_to": r[-1] if r else ""} for r in rows]


def extract_records(rows: DataFrame, keys: list[str], predictor: Predictor = first_words, batch: int = 15) -> DataFrame:
    """rows(keys, row, texts array) in batches of consecutive rows to the predictor; (keys, row, extracted_data map, error). Answers
    beyond the rows of a batch are dropped, missing ones give no row; of a batch whose call fails every row stays, without data and
    with the error."""
    types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        try:
            answers, error = predictor([list(x) for x in pdf["texts"]]), None
        except Exception as e:  # noqa: BLE001  an external model may fail in any way
            answers, error = [None] * len(pdf), f"{type(e).__name__}: {e}"
        out = pdf.head(len(answers))[[*keys, "row"]].copy()
        out["extracted_data"] = pd.Series(answers[: len(out)], index=out.index, dtype=object)
        out["error"] = error
        return out

    return batches(rows, keys, "row", batch).groupBy(*keys, "batch").applyInPandas(run, f"{types}, row int, extracted_data map<string,string>, error string")


def items(records: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each extracted item."""
    return records.select(*keys, "row", F.explode("extracted_data").alias("item", "extracted"))


def best_of_neighbours(extracted: Column, truth: Column, keys: list[str], order: str) -> Column:
    """The best similarity with the truth of the row, the one before and the one after (null neighbours count 0)."""
    w = Window.partitionBy(*keys).orderBy(order)
    near = [truth, F.lag(truth).over(w), F.lead(truth).over(w)]
    return F.greatest(*[F.coalesce(t.similarity(extracted, n), F.lit(0.0)) for n in near])


def concat_columns(cells: DataFrame, annotations: DataFrame, keys: list[str], skip_empty: bool = True) -> DataFrame:
    """(keys, row, item, truth): the stripped texts of the columns an annotation lists, in its order, joined by a space. Empty cells
    and the word `nan` are left out with skip_empty; without, empty cells keep their place and rows without any text have no truth.
    An annotation without columns gives no row, columns beyond the table are ignored; repeated columns are repeated."""
    placed = annotations.select(*keys, "item", F.posexplode("columns").alias("pos", "col"))
    text = t.strip(F.coalesce("text", F.lit("")))
    listed = F.sort_array(F.collect_list(F.struct("pos", text.alias("text"))))
    kept = F.transform(listed, lambda x: x["text"])
    if skip_empty:
        kept = F.filter(kept, lambda x: (x != "") & (F.lower(x) != "nan"))
    else:
        cells = cells.join(cells.filter(F.coalesce("text", F.lit("")) != "").select(*keys, "row").distinct().hint("merge"), [*keys, "row"], "left_semi")
    # by the size of their files both sides look small; with a row for each item of each table neither may pass through the driver
    return cells.join(placed.hint("merge"), [*keys, "col"]).groupBy(*keys, "row", "item").agg(F.array_join(kept, " ").alias("truth"))


#: Which fields of a record make up each scored item.
SCORED = {"person_name": ["occupation", "person_name"], "parish": ["parish_from", "parish_to"], "date": ["date_original"]}


def score_records(records: DataFrame, truths: DataFrame, keys: list[str], wrap_first: bool = False) -> DataFrame:
    """(keys, row, item, extracted, truth, similarity, exact, over_04, over_075): each item of records(keys, row, extracted_data map)
    against truths(keys, row, item, truth) of its row, the row before and the row after, whichever is most alike (the row itself, then
    the one before, on ties). Records of rows without truth are not scored; with wrap_first the row before the first one is the table's last.
    """
    scored = [F.struct(F.lit(item).alias("item"), t.cleaned_value(*[F.try_element_at("extracted_data", F.lit(f)) for f in fields]).alias("extracted")) for item, fields in SCORED.items()]
    asked = records.select(*keys, "row", F.explode(F.array(*scored)).alias("x")).select(*keys, "row", "x.item", "x.extracted")
    w = Window.partitionBy(*keys, "item").orderBy("row")
    at = lambda c, step: F.when((F.lead("row", step).over(w) if step > 0 else F.lag("row", -step).over(w)) == F.col("row") + step, F.lead(c, step).over(w) if step > 0 else F.lag(c, -step).over(w))
    before = at("truth", -1)
    if wrap_first:
        whole = Window.partitionBy(*keys, "item").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        before = F.when(F.col("row") == 0, F.last("truth").over(whole)).otherwise(before)
    near = truths.select("*", before.alias("_before"), at("truth", 1).alias("_after"))
    joined = asked.join(near.hint("merge"), [*keys, "row", "item"])  # never through the driver: rows of all tables on both sides
    s = [F.coalesce(t.similarity(F.col("extracted"), F.col(c)), F.lit(-1.0)) for c in ("truth", "_before", "_after")]
    best = F.greatest(*s)
    truth = F.when(s[0] == best, F.col("truth")).when(s[1] == best, F.col("_before")).otherwise(F.col("_after"))
    return joined.select(*keys, "row", "item", "extracted", truth.alias("truth"), best.alias("similarity"), (best == 1.0).alias("exact"), (best >= 0.4).alias("over_04"), (best >= 0.75).alias("over_075"))


def result_view(records: DataFrame, rows: DataFrame) -> DataFrame:
    """(source_xml, table_id, row_idx, texts, extracted_data): what was extracted beside the row of its table, records(source_xml, table_id, row_idx, extracted_data) and
    rows(file_name, table_id, row, texts). Files meet by name, whatever folders and prefixes (`mands-`) a record names; rows without a record have null data, records
    without a row are left out."""
    bare = lambda c: F.regexp_replace(F.element_at(F.split(c, "/"), -1), "^mands-", "")
    said = records.select(bare("source_xml").alias("_f"), "source_xml", "table_id", F.col("row_idx").alias("row"), "extracted_data")
    shown = rows.select(bare("file_name").alias("_f"), "table_id", "row", "texts")
    of_table = said.select("_f", "table_id", F.col("source_xml").alias("_s")).distinct()
    return shown.join(of_table, ["_f", "table_id"]).join(said.drop("source_xml"), ["_f", "table_id", "row"], "left").select(F.col("_s").alias("source_xml"), "table_id", F.col("row").alias("row_idx"), "texts", "extracted_data")
