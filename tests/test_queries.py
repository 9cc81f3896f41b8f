"""Every registered query against its SQL twin on the small tables."""

import os

import duckdb
import pytest

from folioframe.operators import stats
from folioframe.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(rows):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain(map(tuple, got.select(*columns).collect())) == plain(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_mixtures(spark):
    rows = registry.QUERIES["gmm_lines"](spark, SF).collect()
    assert [r.k for r in rows] == [1, 2, 3, 4] and all(len(r.means) == r.k for r in rows)
    # two narrow lines: the elbow is at two, and the means and the likelihood are those of the two groups fitted apart
    import math

    import numpy as np

    rng = np.random.default_rng(1)
    parts = [rng.normal(100, 2, 300), rng.normal(500, 2, 300)]
    values = spark.createDataFrame([(float(v),) for p in parts for v in p], "x double")
    fits = stats.mixtures(values, "x", 4)
    best = stats.elbow(fits).first()
    assert best.k == 2 and np.allclose(best.means, [p.mean() for p in parts], atol=0.05)
    likelihood = sum(-len(p) / 2 * (math.log(2 * math.pi * p.var()) + 1) + len(p) * math.log(0.5) for p in parts)
    assert abs(best.aic - (2 * 5 - 2 * likelihood)) < 1


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
