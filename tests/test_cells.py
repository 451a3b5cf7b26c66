"""Scores and ranks in cells against the plain path over all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.functions import stats
from matchloom.operators import cells, distribution, evaluation, joins, ranking, vectors
from matchloom.plans import registry

SIDES = "doc_id long, label int, grp long, vec array<float>"


@pytest.fixture(scope="module")
def both(spark):
    """(references and partners, all pairs): copies, opposites, zero scores, repeated ids, null groups and classes of one reference."""
    rng = random.Random(3)
    few = [[float(rng.randrange(-2, 3)) for _ in range(4)] for _ in range(12)]
    rows = [(i, rng.randrange(3), i % 4, rng.choice(few)) for i in range(120)]
    rows += [(10, 1, 2, few[0]), (10, 1, 2, few[1]), (20, 2, None, few[2]), (500, 7, 1, few[3]), (7, 0, 3, [0.0] * 4)]
    v = vectors.normalize_doc_vectors(spark.createDataFrame(rows, SIDES)).cache()
    r = v.where("doc_id % 5 = 0").select(F.col("label").alias("cls"), F.col("doc_id").alias("ref_id"), F.col("grp").alias("ref_group"), "vec")
    p = v.select(F.col("doc_id").alias("pair_id"), F.col("grp").alias("pair_group"), "vec")
    pairs = p.withColumnRenamed("vec", "pv").crossJoin(r.withColumnRenamed("vec", "rv")).withColumn("score", stats.dot(F.col("rv"), F.col("pv")))
    free = ranking.extract_pairable_pairs(pairs.drop("rv", "pv"), "ref_id", "pair_id", "ref_group", "pair_group", "cls")
    return ranking.pairable_sides(r, p), evaluation.assign_true_pairing(free, "ref_id", "pair_id", ["cls"]).cache()


@pytest.mark.parametrize("by_group", [False, True])
def test_best_values_and_reports(both, by_group):
    sides, plain = both
    ranked = ranking.rank_scores(plain, "score", "ref_id", "pair_group" if by_group else None)
    found = cells.top_values(*sides, 10, by_group, rows=5, cols=17)
    kw = {"group": "ref_group", "paired_group": "pair_group", "multiple_correction": by_group}
    want = evaluation.calc_accuracy(ranked, "ref_id", "cls", "score_rank", **kw)
    got = evaluation.calc_accuracy(found, "ref_id", "cls", "score_rank", counts=("n", "n_true", "n_ranked"), **kw)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*got.columns).collect())) != []
    flagged = ranked.withColumn("hit", F.coalesce(F.col("score_rank") <= 3, F.lit(False)))
    want = evaluation.class_recall_precision(flagged, "cls", "true_pairing", "hit").collect()
    assert sorted(evaluation.class_recall_precision_counted(found, "cls", "score_rank", 3).collect()) == sorted(want)


def test_sums_and_rounding_are_those_of_the_column_expressions(spark):
    x = [0.00000000005, -0.00000000005, 0.12345678905, 0.12345678915, 1e-12, -0.3, 0.99999999995, float("nan")]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 10)).collect()]
    assert np.array_equal(cells.rounded(np.array(x)), np.array(want), equal_nan=True)
    a, b = np.random.default_rng(1).normal(size=(2, 64))
    want = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>").select(stats.dot(F.col("a"), F.col("b"))).first()[0]
    assert cells.dots(a[None], b[:, None])[0, 0] == want


@pytest.mark.parametrize("name", ["accuracy_totals", "accuracy_var", "predictions_var", "class_recall_precision", "accuracy_per_class", "accuracy_differences", "accuracy_set", "predictions_set"])
def test_reports_form_no_table_of_pairs(spark, monkeypatch, name):
    monkeypatch.setattr(registry, "vector_pairs", lambda s, d: pytest.fail("all pairs"))
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count()


@pytest.mark.parametrize("by_group", [False, True])
def test_ranks_of_all_pairs(both, by_group):
    sides, plain = both
    by = ["ref_id", *(["pair_group"] if by_group else [])]
    ranked = ranking.rank_scores(plain, "score", "ref_id", "pair_group" if by_group else None)
    ranked = ranking.correct_match_max_rank(ranked, by, "true_pairing", "score_rank")
    cols = ["ref_id", "pair_id", "pair_group", "true_pairing", "score", "score_rank", "max_rank"]
    got = cells.pair_ranks(*sides, by_group, cols, {"score": None}, rows=5)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, ranked.select(*cols).collect())) != []
    near = cells.pair_ranks(*sides, by_group, cols, {"score": None}, cutoff=2, rows=5)
    assert sorted(map(repr, near.collect())) == sorted(map(repr, ranked.where("score_rank <= 2").select(*cols).collect()))


@pytest.mark.parametrize("name", ["rank_scores", "rank_scores_by_group", "best_rank_filter", "correct_match_max_rank", "ecdf", "pct_top", "top_flags", "top_ratio"])
def test_ranks_form_no_table_of_pairs(spark, monkeypatch, name):
    monkeypatch.setattr(registry, "vector_pairs", lambda s, d: pytest.fail("all pairs"))
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count()


@pytest.mark.parametrize("name", ["dist_scores", "dist_scaled"])
def test_summaries_are_parsed_before_they_are_paired(spark, name):
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "Window" not in plan


def test_best_rows_with_ties(both):
    sides, plain = both
    found = cells.top_rows(*sides, 4, True, rows=5, cols=17).withColumnsRenamed({"reference_id": "ref_id", "paired_id": "pair_id"})
    best = lambda df: sorted(map(repr, ranking.top_with_ties(df, ["ref_id"], "score", 4).select("ref_id", "pair_id", "score").collect()))
    assert best(found) == best(plain) != []


def test_dense_rows_equal_the_plain_scores(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.5, 0.1, 0.0, 2.0, 1e-6]) for _ in range(4)]) for i in range(60)]
    rows += [(3, [1.0, 1.0, 1.0, 1.0]), (None, [0.5] * 4), (61, None), (62, [1.0, None, 1.0, 1.0]), (65, [1.0]), (66, []), (70, [float("nan")] * 4)]
    v = spark.createDataFrame(rows, "doc_id long, vec array<float>").repartition(3)
    r = v.where("doc_id IS NULL OR doc_id % 3 = 0 OR doc_id > 60")
    plain = v.select(F.col("doc_id").alias("paired_id"), F.col("vec").alias("pv")).crossJoin(r.select(F.col("doc_id").alias("reference_id"), F.col("vec").alias("rv")))
    plain = plain.select("reference_id", "paired_id", stats.dot(F.col("rv"), F.col("pv")).alias("score"))
    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.collect())) != []
    assert same(cells.dense_rows(r, v, rows=7, cols=5), plain)
    six = F.round("score", 6).alias("score")
    assert same(cells.dense_rows(r, v, places=6, positive=True, rows=7, cols=5), plain.where(F.round("score", 10) > 0).select("reference_id", "paired_id", six))
    back = joins.scores_with_reverse(r, v, lambda a, b: cells.dense_rows(a, b, places=6, rows=7, cols=5))
    assert same(back, joins.with_reverse(plain.select("reference_id", "paired_id", six)))
    assert cells.dense_rows(r.limit(0), v).count() == cells.dense_rows(r, v.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["embed_cosine", "symmetry"])
def test_all_scores_come_from_cells(spark, name):
    """No join of vectors with vectors and no join of all pairs: what is joined are scores of references with each other."""
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Join Inner" not in plan and "aggregate(" not in plan.split("FlatMapGroupsInArrow")[0]


@pytest.mark.parametrize("rows", [7, 1000])
def test_swapped_pairs_equal_the_join(spark, rows):
    """Repeated ids on both sides, null ids, references that are no partners, vectors of other lengths and with nulls."""
    rng = random.Random(rows)
    make = lambda ids: spark.createDataFrame([(i, [rng.choice([-1.5, 0.1, 0.0, 2.0]) for _ in range(3)]) for i in ids] + [(None, [1.0] * 3), (8, None), (9, [1.0, None, 2.0]), (10, [1.0])], "doc_id long, vec array<float>").repartition(3).cache()
    r, p = make([*range(0, 60, 4), 4, 4, 8, 900, 901, 901]), make([*range(50), 4, 8, 8])
    score = lambda a, b: cells.dense_rows(a, b, places=6, rows=5, cols=9)
    want = joins.with_reverse(score(r, p))
    got = joins.scores_with_reverse(r, p, score, lambda a, b: cells.dense_rows_with_reverse(a, b, places=6, rows=rows))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) != []
    assert cells.dense_rows_with_reverse(r.limit(0), p).count() == cells.dense_rows_with_reverse(r, p.limit(0)).count() == 0


def test_symmetry_joins_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(joins, "with_reverse", lambda *a, **kw: pytest.fail("a join of pairs"))
    assert registry.QUERIES["symmetry"](spark, "/root/testdata/sf0.001").where("score_reverse IS NOT NULL").count()


def test_rows_are_sent_to_few_cells():
    """A row of 615,384 partners and 12,308 references (6 GB) went to 7 and 301 cells."""
    for refs, pairs in ((12_308, 615_384), (205, 10_256), (61_538, 3_076_920)):
        rows, cols = cells.cells_out(refs, pairs)
        assert -(-refs // rows) <= 4 and (-(-pairs // cols) <= 64 or cols == cells.SIDES_OUT[1]) and rows * cols <= 1 << 28


def test_distances_in_cells_equal_the_column_expressions(spark):
    """Missing statistics, summaries with too few of them, zeros, infinite and large values, rows that are repeated."""
    rng = random.Random(12)
    number = lambda: rng.choice(["0", "-1.5", "2.25", "7.123457", "1e999", "-1e999", "123456789012.34567", "1e30", str(rng.random())])
    rows = [(i, "; ".join(f"{k}={number()}" for k in ("min", "max", "median", "sd") if rng.random() < 0.85)) for i in range(60)] + [(3, None), (4, "min=1; max=2; sd=0")] * 2
    one = distribution.with_parsed(spark.createDataFrame(rows, "id long, dist string"), "dist", "x")
    refs, pairs = one.where("id % 4 = 0").select(F.col("id").alias("ref_id"), F.col("x").alias("ref_x")), one.select(F.col("id").alias("pair_id"), (F.col("id") % 3).alias("grp"), F.col("x").alias("pair_x"))
    differ = F.col("ref_id") % 3 != F.col("grp")
    plain = distribution.parsed_scores(distribution.calc_pairings_data(pairs, refs, differ), "ref_x", "pair_x")
    names = ["ref_id", "pair_id", "grp", "euclidean", "relative"]
    listed = lambda df: sorted(map(repr, df.select("ref_id", "pair_id", "grp", *[F.round(c, 9).alias(c) for c in names[3:]]).collect()))
    got = distribution.pair_scores(pairs, refs, "pair_x", "ref_x", differ, rows=5, cols=11)
    assert got.columns == names and listed(got) == listed(plain) != []
    six = plain.select(*names[:3], *[F.round(c, 6).alias(c) for c in names[3:]])
    assert sorted(map(repr, distribution.pair_scores(pairs, refs, "pair_x", "ref_x", differ, 6).collect())) == sorted(map(repr, six.collect()))
    assert distribution.pair_scores(pairs, refs.limit(0), "pair_x", "ref_x").count() == distribution.pair_scores(pairs.limit(0), refs, "pair_x", "ref_x").count() == 0


@pytest.mark.parametrize("name", ["dist_scores", "dist_scaled"])
def test_distances_come_from_cells(spark, name):
    """As column expressions of a join they took some 20 microseconds a pair."""
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "pow(" not in plan.lower()
