"""Every stage of the pipeline against its operator or brute force on its own input."""

import numpy as np
import pytest

import corpus_pipeline
from folioframe.llm import simhash, toxicity
from folioframe.llm.common import written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), name))
    return out


def test_columns_and_rows(stages):
    docs = stages[0]
    assert all(s.columns == docs.columns for s in stages[1:4])
    counts = [s.count() for s in stages]
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] == counts[4] > 0
    assert stages[4].filter("round_trip").count() == counts[4]


def test_toxicity_stage(spark, stages):
    model = toxicity.train(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.doc_id for r in toxicity.score(stages[0], model).filter("score < 0.5").collect()}
    assert kept == {r.doc_id for r in stages[1].collect()}


def test_dedup_stage(stages):
    docs = sorted((r.doc_id, r.text) for r in stages[1].collect())
    fps, root = np.array([simhash.fingerprint(t) for _, t in docs], np.uint64), list(range(len(docs)))
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3):
            a, b = sorted((root[i], root[int(j)]))
            root = [a if r == b else r for r in root]
    assert {docs[i][0] for i in set(root)} == {r.doc_id for r in stages[2].collect()}


def test_decontamination_stage(spark, stages):
    from test_llm_operators import brute_contamination

    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    docs = [(r.doc_id, r.text) for r in stages[2].collect()]
    bad = {r[0] for r in brute_contamination(docs, items, 13) if r[-1]}
    assert {d for d, _ in docs} - bad == {r.doc_id for r in stages[3].collect()}
