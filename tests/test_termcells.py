"""Sparse scores in cells against the plain join by term."""

import random

import pytest
from pyspark.sql import functions as F

from matchloom.operators import scoring, termcells, topn
from matchloom.plans import registry


@pytest.fixture(scope="module")
def weights(spark):
    """Copies, repeated rows, negative weights and sums of zero, null terms, documents that share nothing, a document of only other terms."""
    rng = random.Random(9)
    rows = [(f"x{i % 70}", rng.choice("abcdefghijkl"), rng.choice([0.5, 0.25, 0.125, -0.25])) for i in range(400)]
    rows += [("x1", None, 0.5), ("x80", "z", 1.0), ("x5", "p", 0.5), ("x81", "p", 0.25), ("x5", "q", 0.5), ("x81", "q", -0.25)]
    return spark.createDataFrame(rows, "doc_id string, term string, weight double").repartition(4).cache()


def same(a, b, cols=("reference_id", "paired_id", "score")):
    assert sorted(map(repr, a.select(*cols).collect())) == sorted(map(repr, b.select(*cols).collect())) != []


def test_sparse_rows_equal_the_join(spark, weights):
    ids = weights.where("doc_id LIKE 'x%5'").select("doc_id").distinct()
    plain = scoring.sparse_scores(weights.join(ids, "doc_id", "left_semi"), weights)
    found = lambda **kw: termcells.sparse_rows(weights, ids, rows=3, cols=5, **kw)
    same(found(), plain)
    same(found(terms=weights.select("term")), plain)
    names = weights.select("doc_id").distinct()
    same(found(zeros=True, places=2), scoring.with_zeros(plain, ids.toDF("reference_id"), names.toDF("paired_id")).withColumn("score", F.round("score", 2)))
    few = names.where("doc_id < 'x4'")
    same(scoring.TopN(4)(found(best=4, pair_ids=few)), scoring.TopN(4)(plain.where("paired_id < 'x4'")))
    groups = names.select(F.col("doc_id").alias("paired_id"), F.substring("doc_id", 2, 1).alias("grp")).where("grp <> '6'")
    same(topn.best(found(best=2, groups=groups), 2), scoring.TopNByGroup(2, groups)(plain))
    assert termcells.sparse_rows(weights, ids.limit(0)).count() == termcells.sparse_rows(weights.limit(0), ids).count() == 0


@pytest.mark.parametrize("name", ["zero_scores_kept", "pruned_top5", "pruned_top3_by_lang", "select_then_filter"])
def test_postings_are_not_joined(spark, monkeypatch, name):
    for module, step in ((scoring, "sparse_scores"), (scoring, "with_zeros"), (topn, "pruned_top")):
        monkeypatch.setattr(module, step, lambda *a, **kw: pytest.fail("a table of the postings that meet"))
    assert "FlatMapGroupsInArrow" in registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
