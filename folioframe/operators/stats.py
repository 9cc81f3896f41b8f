"""Statistics of books, parishes and layouts, and scores of predictions, as one- or two-level aggregations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page_stats(tables: DataFrame, pages: DataFrame, page: str) -> DataFrame:
    """pages(page, expected, n_expected_cols, ...) with n_tables, n_rows, col_diff and a bucket; pages without a table stay."""
    per = tables.groupBy(page).agg(F.count(F.lit(1)).alias("n_tables"), F.sum("n_rows").alias("n_rows"), F.max("n_cols").alias("n_cols"))
    joined = pages.join(per, page, "left").withColumn("n_tables", F.coalesce("n_tables", F.lit(0)))
    bucket = F.when(F.col("n_tables") == 0, "zero").when(F.col("n_tables") > F.col("expected"), "more").when(F.col("n_tables") < F.col("expected"), "fewer").otherwise("as expected")
    return joined.withColumn("bucket", bucket)


def count_buckets() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("pages"), F.sum("n_tables").cast("long").alias("tables"),
        *[F.count_if(F.col("bucket") == b).alias(f"pages_{b.replace(' ', '_')}") for b in ("zero", "more", "fewer", "as expected")],
    ]


def ratio(part: str | Column, whole: str | Column) -> Column:
    """Null where the whole is 0."""
    return F.try_divide(part if isinstance(part, Column) else F.col(part), whole if isinstance(whole, Column) else F.col(whole))


def top_per_group(rows: DataFrame, group: str, item: str, n: int) -> DataFrame:
    """(group, item, count, rank): the n most frequent items, ties by name."""
    counts = rows.groupBy(group, item).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(group).orderBy(F.desc("n"), item)
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def cumulative(rows: DataFrame, item: str) -> DataFrame:
    """(item, n, running, share): counts from the most frequent on. Windows run over the distinct items only."""
    counts = rows.groupBy(item).agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.desc("n"), item).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    running = F.sum("n").over(order)
    return counts.select(item, "n", running.alias("running"), (running / F.sum("n").over(every)).alias("share"))


def error_rates(pairs: DataFrame, prediction: str, reference: str, *by: str) -> DataFrame:
    """Character error rate (edit distance over reference length), exact match and pairs for each group; null without reference text."""
    return pairs.groupBy(*by).agg(
        ratio(F.sum(F.levenshtein(prediction, reference)), F.sum(F.length(reference))).alias("cer"), F.avg((F.col(prediction) == F.col(reference)).cast("double")).alias("exact"), F.count(F.lit(1)).alias("n")
    )


def error_report(pairs: DataFrame, prediction: str, reference: str, kind: Column) -> DataFrame:
    """(kind, cer, exact, n) of each class of pairs and of `all`, in one pass; the rate is null without reference text."""
    measured = pairs.select(kind.alias("kind"), F.levenshtein(prediction, reference).alias("_e"), F.length(reference).alias("_l"), (F.col(prediction) == F.col(reference)).cast("double").alias("_x"))
    out = measured.rollup("kind").agg(F.grouping("kind").alias("_g"), ratio(F.sum("_e"), F.sum("_l")).alias("cer"), F.avg("_x").alias("exact"), F.count(F.lit(1)).alias("n"))
    return out.select(F.when(F.col("_g") == 1, "all").otherwise(F.col("kind")).alias("kind"), "cer", "exact", "n")


def macro_mean(summary: DataFrame, *columns: str) -> DataFrame:
    """The plain mean of summary rows, each item counting once."""
    return summary.agg(*[F.avg(c).alias(c) for c in columns])


def class_report(rows: DataFrame, truth: str, predicted: str, classes: list) -> DataFrame:
    """Precision, recall, F1 and support of each class; classes is a short list."""
    counts = rows.select(F.explode(F.array(*map(F.lit, classes))).alias("class"), truth, predicted).groupBy("class").agg(
        F.count_if((F.col(truth) == F.col("class")) & (F.col(predicted) == F.col("class"))).alias("tp"), F.count_if(F.col(predicted) == F.col("class")).alias("n_predicted"), F.count_if(F.col(truth) == F.col("class")).alias("support")
    )
    p, r = F.coalesce(ratio("tp", "n_predicted"), F.lit(0.0)), F.coalesce(ratio("tp", "support"), F.lit(0.0))
    return counts.select("class", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), "support")


def item_summary(scores: DataFrame, item: str, similarity: str) -> DataFrame:
    """Mean similarity, and the shares that are exact, at least 0.4 and at least 0.75."""
    s = F.col(similarity)
    share = lambda c: F.avg(c.cast("double"))
    return scores.groupBy(item).agg(F.avg(s).alias("avg_similarity"), share(s == 1.0).alias("exact"), share(s >= 0.4).alias("over_04"), share(s >= 0.75).alias("over_075"), F.count(F.lit(1)).alias("n"))


def mixtures(values: DataFrame, column: str, most: int, seed: int = 1) -> DataFrame:
    """(k, aic, bic, means) of one-dimensional Gaussian mixtures of 1 to `most` components. Values are counted first, once, and every round of a fit reads the
    distinct values with their counts as weights."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    known = values.filter(F.col(column).isNotNull())
    value = F.col(column).cast("double")
    counted = known.groupBy(value.alias("v")).agg(F.count(F.lit(1)).cast("double").alias("w")).orderBy(F.xxhash64("v")).persist()  # the order decides where a fit begins: by digests it is the same for all partitions
    n, mean = counted.agg(F.coalesce(F.sum("w"), F.lit(0.0)), F.sum(F.col("v") * F.col("w")) / F.sum("w")).first()
    variance = counted.agg(F.sum(F.col("w") * (F.col("v") - F.lit(mean)) ** 2)).first()[0] / n if n else None
    # one component has a closed form
    fits = [(1, -n / 2 * (math.log(2 * math.pi * max(variance, 1e-12)) + 1), [mean])] if n else []
    data = VectorAssembler(inputCols=["v"], outputCol="features").transform(counted).select("features", "w")
    for k in range(2, most + 1 if n else 0):
        model = GaussianMixture(k=k, seed=seed, maxIter=50, weightCol="w").fit(data)
        fits.append((k, model.summary.logLikelihood, sorted(float(g.mean[0]) for g in model.gaussians)))
    counted.unpersist()
    rows = [(k, 2.0 * (3 * k - 1) - 2 * fit, (3 * k - 1) * math.log(n) - 2 * fit, means) for k, fit, means in fits]
    return values.sparkSession.createDataFrame(rows, "k int, aic double, bic double, means array<double>")


def elbow(fits: DataFrame, score: str = "aic") -> DataFrame:
    """The row of fits(k, score, ...) at the elbow of a falling score: the k whose point lies furthest below the line from the first to the last one; the least k of equals."""
    ends = fits.agg(F.min("k").alias("_k0"), F.max("k").alias("_k1"), F.min_by(score, "k").alias("_s0"), F.max_by(score, "k").alias("_s1"))  # a row for each k, so a few
    below = F.coalesce(F.try_divide(F.col("k") - F.col("_k0"), F.col("_k1") - F.col("_k0")), F.lit(0.0)) - F.coalesce(F.try_divide(F.col("_s0") - F.col(score), F.abs(F.col("_s0") - F.col("_s1"))), F.lit(0.0))
    ranked = fits.join(ends, F.lit(True)).withColumn("_d", below)
    return ranked.orderBy("_d", "k").limit(1).drop("_k0", "_k1", "_s0", "_s1", "_d")
