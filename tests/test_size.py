"""What a query reads, shuffles and parses: by its plan, since tables of the size at which it counts do not fit a test."""

import re

import pytest
from folioframe.plans import registry

SMOKE = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"\bExchange (?:hash|range|single|Round)", plan(df)))


def parses(df):
    # an expression may fill a node of its own, and each evaluation names it once
    return len(re.findall(r"from_xml\(", df._jdf.queryExecution().optimizedPlan().toString()))


def test_documents_are_assembled_in_one_shuffle(spark):
    assert exchanges(registry.QUERIES["assembled_documents"](spark, SMOKE)) == 1


@pytest.mark.parametrize("name", ["nested_pages", "flat_documents", "scanned_boxes", "scanned_cells", "scanned_grids", "scanned_rects"])
def test_documents_are_parsed_once(spark, name):
    df = registry.QUERIES[name](spark, SMOKE)
    assert exchanges(df) == 1 and parses(df) == 1


def test_rows_of_all_tables_do_not_pass_through_the_driver(spark):
    df = registry.QUERIES["extraction_evaluation"](spark, SMOKE)
    assert "Broadcast" not in plan(df)
    df.collect()
    assert "Broadcast" not in plan(df)  # nor as they turn out to be small while the query runs


def test_updated_documents_are_shuffled_once_and_by_name(spark):
    found = re.findall(r"\bExchange hashpartitioning\((\w+)#\d+, \d+\)", plan(registry.QUERIES["updated_documents"](spark, SMOKE)))
    # before the plan adapts, a shuffle that is used again stands twice; the names alone are shuffled apart
    assert set(found) == {"file_name"} and exchanges(registry.QUERIES["updated_documents"](spark, SMOKE)) <= 4


def test_rounds_of_a_mixture_read_distinct_values(spark, monkeypatch):
    from folioframe.operators import stats
    from pyspark.ml.clustering import GaussianMixture

    read, fit = [], GaussianMixture.fit
    monkeypatch.setattr(GaussianMixture, "fit", lambda self, data, *a: read.append(data.count()) or fit(self, data, *a))
    values = spark.range(3000).selectExpr("CAST(IF(id % 2 = 0, 10, 80) + (id % 100) / 25 AS DOUBLE) AS x")
    one = stats.mixtures(values, "x", 2).orderBy("k").first()
    assert read == [100] and one.means == [pytest.approx(46.98, abs=0.01)]


def test_tables_are_fitted_at_once_and_only_along_the_axis_asked_for(spark, monkeypatch):
    import numpy as np
    from folioframe.operators import lines

    rng = np.random.default_rng(3)
    lists = [np.unique(np.concatenate([y + rng.integers(-3, 3, 12) for y in range(10, 10 + 90 * n, 90)]), return_counts=True) for n in (1, 2, 4)]
    width = max(len(v) for v, _ in lists)
    values = np.array([np.pad(v.astype(float), (0, width - len(v)), "edge") for v, _ in lists])
    counts = np.array([np.pad(n.astype(float), (0, width - len(n))) for _, n in lists])
    for k in (1, 3, 5):
        fits, means = lines.mixtures_of(values, counts, k)
        for i, (v, n) in enumerate(lists):
            fit, mean = lines.mixture(v.astype(float), n.astype(float), k)
            assert fits[i] == pytest.approx(fit, abs=1e-6) and means[i] == pytest.approx(mean, abs=1e-6)
    cells = lines.grid_cells(spark.createDataFrame([(k, 3, 2) for k in range(5)], "tab long, rows int, cols int"), "tab", fuzz=2)
    only = lines.lines_of(cells, ["tab"], 6, axes=("y",)).collect()
    assert {r.axis for r in only} == {"y"} and {(r.tab, len(r.lines)) for r in only} == {(k, 4) for k in range(5)}
