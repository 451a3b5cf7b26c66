"""Scores with centroids in blocks against the plain joins by term."""

import random

import pytest
from pyspark.sql import functions as F

from matchloom.operators import scoring, termblocks, tfidf, vectors
from matchloom.plans import registry


@pytest.mark.parametrize(("tokens", "pairs"), [(40, 7), (1 << 21, 1 << 18)])
def test_blocks_equal_the_joins(spark, monkeypatch, tokens, pairs):
    """Repeated ids in several groups, a null id, documents without tokens or group, a null token, a group named like a document."""
    monkeypatch.setattr(termblocks, "TOKENS", tokens)
    monkeypatch.setattr(termblocks, "PAIRS", pairs)
    monkeypatch.setattr(termblocks, "MET", 9)
    rng = random.Random(tokens)
    rows = [(f"x{i % 50}", [rng.choice("abcdefghijkl") + rng.choice("12") for _ in range(rng.randint(0, 9))], [rng.choice(["g", "h", "x3", None])]) for i in range(70)]
    rows += [(None, ["a1", "z"], ["g"]), ("x1", ["a1", None], []), ("y", [], ["h"]), ("z", ["only"], ["own", "g"]), ("n", ["a1"], None)]
    data = spark.createDataFrame(rows, "doc_id string, tokens array<string>, grps array<string>").repartition(3).cache()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 8)
    try:
        got = {(r[0], r[1]): r[2] for r in termblocks.centroid_scores(data).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    corpora = data.select(F.lit(0).alias("corpus_id"), "doc_id", "tokens")
    weights = tfidf.calc_tfidf(corpora)[1]
    center = vectors.centroids(weights, data.select(F.explode("grps").alias("grp"), "doc_id").where("grp IS NOT NULL"))
    plain = scoring.sparse_scores(center.withColumnRenamed("grp", "doc_id"), weights)
    want = {(r[0], r[1]): r[2] for r in plain.collect()}
    assert got.keys() == want.keys() and len(got) > 100 and ("x3", "x3") in got and ("g", None) in got
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_no_documents_and_no_groups(spark):
    data = spark.createDataFrame([("a", ["t"], ["g"]), ("b", [], ["g"])], "doc_id string, tokens array<string>, grps array<string>")
    assert termblocks.centroid_scores(data.limit(0)).count() == termblocks.centroid_scores(data.where("doc_id = 'b'")).count() == 0
    assert termblocks.centroid_scores(data.withColumn("grps", F.array(F.lit(None)))).count() == 0
    assert [tuple(r) for r in termblocks.centroid_scores(data).collect()] == [("g", "a", 0.5)]


def test_postings_are_not_shuffled(spark, monkeypatch):
    for name in ("term_counts", "calc_tfidf"):
        monkeypatch.setattr(tfidf, name, lambda *a, **kw: pytest.fail("a table of postings"))
    assert registry.QUERIES["centroid_scores"](spark, "/root/testdata/sf0.001").count()
