import random
import statistics

import pytest
from pyspark.sql import functions as F

from matchloom.functions import predicates, stats, text
from matchloom.operators import combine, distribution, evaluation, joins, profile, ranking, scoring


@pytest.fixture(scope="module")
def weights(spark):
    rows = [("a", "x", 0.6), ("a", "y", 0.8), ("b", "x", 1.0), ("c", "y", 1.0), ("d", "z", 1.0)]
    return spark.createDataFrame(rows, "doc_id string, term string, weight double").cache()


def scores(df):
    return sorted((r["reference_id"], r["paired_id"], round(r["score"], 4)) for r in df.collect())


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "doc_id string")


def test_default_predicate_drops_self_and_zeros(spark, weights):
    out = scoring.VariableSimilarityCalculator(ids(spark, "a")).score_variables(weights)
    assert scores(out) == [("a", "b", 0.6), ("a", "c", 0.8)]


def test_always_keeps_self_and_zeros(spark, weights):
    out = scoring.VariableSimilarityCalculator(ids(spark, "a"), predicates.always).score_variables(weights)
    assert scores(out) == [("a", "a", 1.0), ("a", "b", 0.6), ("a", "c", 0.8), ("a", "d", 0.0)]


def test_unknown_and_repeated_references(spark, weights):
    out = scoring.VariableSimilarityCalculator(ids(spark, "b", "b", "nope")).score_variables(weights)
    assert scores(out) == [("b", "a", 0.6), ("b", "a", 0.6)]
    once = scoring.VariableSimilarityCalculator(ids(spark, "b", "b"), distinct_refs=True).score_variables(weights)
    assert scores(once) == [("b", "a", 0.6)]
    with pytest.raises(ValueError):
        scoring.VariableSimilarityCalculator(ids(spark, "b")).score_variables(weights, ids(spark, "nope"), strict=True)


def test_selector_runs_before_the_predicate(spark, weights):
    calc = scoring.VariableSimilarityCalculator(ids(spark, "a"), select_scores=scoring.TopN(2))
    assert scores(calc.score_variables(weights)) == [("a", "c", 0.8)]


def test_top_by_group_and_names(spark, weights):
    groups = spark.createDataFrame([("b", "g"), ("c", "g"), ("a", "h")], "paired_id string, grp string")
    calc = scoring.VariableSimilarityCalculator(ids(spark, "a"), select_scores=scoring.TopNByGroup(1, groups), score_cols=["ref", "pair", "s"])
    assert [tuple(r)[:2] for r in calc.score_variables(weights).collect()] == [("a", "c")]


def test_group_and_column_predicates(spark, weights):
    about = spark.createDataFrame([("a", "s1", 1), ("b", "s1", 2), ("c", "s2", 1), ("d", None, 3)], "doc_id string, study string, n int")
    run = lambda p: scores(scoring.VariableSimilarityCalculator(ids(spark, "a"), p, attributes=about).score_variables(weights))
    assert run(predicates.pairable_by_group("study")) == [("a", "c", 0.8)]
    assert run(predicates.vals_differ_in_col("n")) == [("a", "b", 0.6)]
    assert run(predicates.vals_differ_in_all_cols(["study", "n"])) == []


def test_dense_scores(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("c", [-1.0, 0.0])], "doc_id string, vec array<double>")
    out = scoring.VariableSimilarityCalculator(ids(spark, "a")).score_variables(v, dense=True)
    assert scores(out) == [("a", "b", 0.6)]


def test_one_vs_all(weights):
    out = {r["paired_id"]: round(r["score"], 4) for r in scoring.calculate_similarity(weights, "a").collect()}
    assert out == {"b": 0.6, "c": 0.8, "d": 0.0}


def test_parsed_stats_and_distances(spark):
    rows = [("min=0; max=10; median=4; sd=1.5", "max=10; min=0; median=4; sd=1.5"), ("min=0; max=10; median=4", "min=1; max=3; median=2; sd=1"), ("min=0; max=10", "min=1; max=3; median=2; sd=1"), (None, "min=1; max=3; median=2; sd=1"), ("min=x; max=1; median=2; sd=3", "min=0; max=0; median=0; sd=0")]
    df = spark.createDataFrame(rows, "a string, b string")
    out = distribution.distribution_scores(df, "a", "b").collect()
    assert (out[0]["euclidean"], out[0]["relative"]) == (0, 1)
    assert out[1]["euclidean"] == pytest.approx(((1 + 49 + 4 + 64) * 5 / 4) ** 0.5)
    assert out[1]["relative"] == pytest.approx(1 - (1 + 0.7 + 0.5 + 0.8) / 4)
    assert [out[i]["euclidean"] for i in (2, 3)] == [None, None]
    assert out[4]["relative"] == pytest.approx(1 - (1 + 1 + 1) / 3)


def test_scaled_similarity(spark):
    df = spark.createDataFrame([("r", "s", 1.0), ("r", "s", 3.0), ("r", "s", None), ("r", "t", 5.0)], "r string, s string, d double")
    assert [x["scaled"] for x in distribution.scaled_similarity(df, "d", ["r", "s"]).orderBy("s", "d").collect()] == [None, 1.0, 0.0, None]


def test_self_pairing_names(spark):
    df = spark.createDataFrame([(1, 2)], "a_1 int, b_1 int")
    assert distribution.as_partner(df).columns == ["a_2", "b_2"]
    with pytest.raises(ValueError):
        distribution.as_partner(df.toDF("a_1", "b"))


def test_noisy_or(spark):
    df = spark.createDataFrame([(0.5, 0.5, 0.2, 0.1), (0.0, 1.0, 1.0, 1.0), (0.5, None, 0.2, 0.1)], "a double, b double, c double, d double")
    out = combine.calc_combined_scores(df, {"two": ["a", "b"], "three": ["a", "b", "c"], "four": ["a", "b", "c", "d"]}).collect()
    assert out[0]["two"] == pytest.approx(1 - 0.5**1.25)
    assert out[0]["three"] == pytest.approx(1 - 0.5 ** (1 + 0.25 + 0.008))
    assert out[0]["four"] == pytest.approx(1 - 0.5 ** (1 + 0.25 + 0.125 + 0.008))
    assert out[1]["two"] == 0 and out[2]["two"] == pytest.approx(0.5)
    other = combine.calc_combined_scores(df, {"four": ["a", "b", "c", "d"]}, variant="documented").first()["four"]
    assert other == pytest.approx(1 - 0.5 ** (1 + 0.25 + 0.008 + 0.001))


def test_fold_of_joins(spark):
    width, length = [3.5, 3.0, 3.2, 3.1, 3.6, 3.9], [5.1, 4.9, 4.7, 4.6, 5.0, 5.4, 4.6, 5.0, 4.4, 4.9]
    frame = lambda v: spark.createDataFrame([(f"setosa{i + 1}", x) for i, x in enumerate(v)], "Species string, score double")
    cols = [{"id": "Species", f"score{i}": "score"} for i in (1, 2, 3)]
    left = joins.reduce_join(frame(width), [frame(length), frame(width[:5])], cols).orderBy("id").collect()
    assert len(left) == 6 and [r["score3"] for r in left] == [*width[:5], None]
    full = joins.reduce_join(frame(width), [frame(length), frame(width[:5])], cols, "full").collect()
    assert len(full) == 10 and sum(r["score1"] is None for r in full) == 4 and sum(r["score3"] is None for r in full) == 5
    with pytest.warns(UserWarning):
        assert joins.reduce_join(frame(width), [frame(length)], cols, on=["Species"]).count() == 6


def test_null_keys_match_in_natural_joins(spark):
    a, b = spark.createDataFrame([(None, 1), ("k", 2)], "k string, a int"), spark.createDataFrame([(None, 5)], "k string, b int")
    assert {(r["k"], r["a"], r["b"]) for r in joins.natural_join(a, b).collect()} == {(None, 1, 5), ("k", 2, None)}


def test_membership_and_reverse(spark):
    a = spark.createDataFrame([("c", "x"), ("c", "y"), ("e", "x")], "concept string, v string")
    k = spark.createDataFrame([("c", "x")], "concept string, w string")
    assert joins.keep_known_in_group(a, "concept", "v", k, "w").count() == 1
    assert joins.keep_known(a, "v", k, "w").count() == 2
    s = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("a", "c", 2.0)], "reference_id string, paired_id string, score double")
    assert {(r["reference_id"], r["paired_id"]): r["score_reverse"] for r in joins.with_reverse(s).collect()} == {("a", "b"): 1.0, ("b", "a"): 1.0, ("a", "c"): None}


def test_ranks(spark):
    df = spark.createDataFrame([("r", "a", 0.9), ("r", "b", 0.9), ("r", "c", 0.5), ("r", "d", 0.0), ("r", "e", None), ("r", "f", -0.1)], "ref string, p string, s double")
    out = {r["p"]: r["s_rank"] for r in ranking.rank_scores(df, "s", "ref").collect()}
    assert out == {"a": 1, "b": 1, "c": 2, "d": None, "e": None, "f": 4}
    two = df.withColumn("t", F.col("s") * -1)
    assert {r["p"] for r in ranking.calc_ranks_all_scores(two, ["s", "t"], "ref", rank_cutoff=1).collect()} == {"a", "b", "f"}


def test_pairable_pairs(spark):
    rows = [("k", "a", "g1", "a", "g1"), ("k", "a", "g1", "b", "g1"), ("k", "a", "g1", "c", "g2"), ("k", "b", "g1", "c", "g2"), ("m", "a", "g1", "c", "g2"), ("z", "a", "g1", "c", "g2"), ("z", "b", "g1", "c", "g2")]
    df = spark.createDataFrame(rows, "cls string, ref string, rg string, pair string, pg string")
    out = ranking.extract_pairable_pairs(df, "ref", "pair", "rg", "pg", "cls", ["z"])
    assert sorted((r["cls"], r["ref"], r["pair"]) for r in out.collect()) == [("k", "a", "c"), ("k", "b", "c")]
    assert ranking.extract_pairable_pairs(df, "ref", "pair", "rg", "pg", "cls", ["z"], keep_single_ref_class=True).count() == 3


# Rows of a published report: counts and the rates that follow from them.
REPORT = [
    (9, 2, 3, 0.222222222, 0.666666667, 0.333333333),
    (13, 3, 3, 0.230769231, 1.0, 0.375),
    (29, 8, 10, 0.275862069, 0.8, 0.41025641),
    (37, 10, 10, 0.27027027, 1.0, 0.425531915),
    (2, 0, 2, 0.0, 0.0, 0.0),
    (0, 0, 0, 0.0, 0.0, 0.0),
]


def test_rates_of_known_counts(spark):
    df = spark.createDataFrame([r[:3] for r in REPORT], "p long, t long, a long")
    out = df.select(stats.precision(F.col("t"), F.col("p")), stats.recall(F.col("t"), F.col("a")), stats.f1(F.col("t"), F.col("p"), F.col("a"))).collect()
    assert [tuple(r) for r in out] == [pytest.approx(r[3:], abs=1e-6) for r in REPORT]


def evaluation_data(spark):
    """Four references of one concept in three data sets, with a fifth candidate that is none."""
    group = {"a": 1, "b": 2, "c": 2, "e": 3, "x": 3}
    rows = [("AF", r, group[r], p, group[p], i + 1 if p != "x" or r != "a" else None) for r in "abce" for i, p in enumerate(q for q in "abcex" if group[q] != group[r])]
    return spark.createDataFrame(rows, "concept string, ref string, rg int, pair string, pg int, rank int")


def test_actual_pairings_in_all_modes(spark):
    data = evaluation_data(spark)
    got = lambda **kw: {r["ref"]: (r["actual_pairings"], r["n_actual_pairings"]) for r in evaluation.summarize_actual_pairings(data, "ref", "concept", **kw).collect()}
    assert got() == dict.fromkeys("abce", (3, 12))
    assert got(group="rg") == {"a": (3, 10), "b": (2, 10), "c": (2, 10), "e": (3, 10)}
    assert got(group="rg", multiple_correction=True) == dict.fromkeys("abce", (2, 8))
    with pytest.raises(ValueError):
        evaluation.summarize_actual_pairings(data, "ref", "concept", multiple_correction=True)


def test_accuracy_report(spark):
    data = evaluation.assign_true_pairing(evaluation_data(spark), "ref", "pair", ["concept"])
    assert data.where("NOT true_pairing").select("pair").distinct().collect()[0][0] == "x"
    kw = dict(group="rg", paired_group="pg", cutoffs=(1, 5))
    var = {r["ref"]: r for r in evaluation.calc_accuracy(data, "ref", "concept", "rank", **kw).collect()}
    both = {r["ref"]: r for r in evaluation.calc_accuracy(data, "ref", "concept", "rank", multiple_correction=True, **kw).collect()}
    total = var[None]
    assert total["concept"] == "All concept (N = 1)" and total["n_ref"] == 4
    refs = [r for k, r in var.items() if k]
    for c in ("top1_pred", "top5_pred", "top5_true_pred", "actual_pairings"):
        assert sum(r[c] for r in refs) == total[c] == refs[0][f"n_{c}"]
    assert all(both[r]["top5_pred"] <= var[r]["top5_pred"] and var[r]["top1_recall"] <= var[r]["top5_recall"] for r in "abce")
    assert var["a"]["top5_pred"] == 3 and var["b"]["top5_pred"] == 3 and both["b"]["top5_true_pred"] == 2
    stacked = evaluation.combine_accuracy_results({"s": evaluation.calc_accuracy(data, "ref", "concept", "rank", **kw)}, True, "concept")
    assert stacked.count() == 1
    per_class = evaluation.calc_accuracy(data, "ref", "concept", "rank", per_ref=False, **kw)
    assert per_class.count() == 2 and "n_top1_F1" in per_class.columns


def test_profiles(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, None, 2.0), (3, "a", None), (4, "b", 4.0)], "id int, g string, x double")
    assert {r["column"]: (r["nulls"], r["rows"]) for r in profile.null_profile(df).collect()} == {"id": (0, 4), "g": (1, 4), "x": (1, 4)}
    assert profile.crosstab(df, "g", "id").count() == 4
    assert [r["bin"] for r in profile.quantile_bins(df, "x", 2).orderBy("id").collect()] == [1, 1, None, 2]
    assert [(r["value"], r["n"], round(r["density"], 3)) for r in profile.ecdf(df, F.col("x")).orderBy("value").collect()] == [(1.0, 1, 0.333), (2.0, 1, 0.667), (4.0, 1, 1.0)]
    r = df.select(profile.tags({"p": F.col("id") > 2, "q": F.col("x") > 3}).alias("t"), profile.rank_bucket(F.col("id")).alias("b"), profile.value_map(F.col("g"), {"a": "A"}).alias("m"), "id").orderBy("id").collect()
    assert [x["t"] for x in r] == ["", "", "p", "p_q"] and [x["b"] for x in r] == ["1", "2-5", "2-5", "2-5"] and [x["m"] for x in r] == ["A", None, "A", "b"]
    assert profile.matching_columns(df.toDF("score_a", "b", "score_c"), "^score_") == ["score_a", "score_c"]
    assert [x["id"] for x in profile.head_and_tail(df, "id", 1).collect()] == [1, 4]
    assert profile.sample_rows(df, "id", 2).collect() == profile.sample_rows(df, "id", 2).collect()
    assert profile.gather(df.select("id", "x"), ["id"], ["x"]).columns == ["id", "key", "value"]
    assert profile.spread(df, ["id"], "g", "x", ["a", "b"]).columns == ["id", "a", "b"]


def test_ratios_to_the_top(spark):
    df = spark.createDataFrame([("r", 0.8, 1), ("r", 0.4, 2), ("s", 0.5, 1)], "g string, s double, k int")
    assert {r["g"]: r["ratio"] for r in combine.top_scores_ratio(df, "s", "k", ["g"]).collect()} == {"r": 2.0, "s": None}
    assert sorted(r["percent"] for r in combine.percent_of_top(df, "s", "k", ["g"]).collect()) == [0.5, 1.0, 1.0]


@pytest.mark.parametrize("exact_rows", [1 << 16, 40])
def test_quantiles_are_exact(spark, exact_rows):
    rng = random.Random(8)
    rows = [(g, x) for g in ("a", "b", None) for x in [rng.choice([rng.random(), 0.5, 0.5, rng.gauss(0, 100)]) for _ in range(700)]] + [("one", 3.0), ("same", 7.0), ("same", 7.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r["g"], r["share"]): r["value"] for r in profile.quantiles(df, "x", shares, ["g"], exact_rows).collect()}
    want = {}
    for g in ("a", "b", None, "one", "same"):
        v = sorted(x for h, x in rows if h == g)
        for p in shares:
            k = int((len(v) - 1) * p)
            want[g, p] = v[k] + (v[min(k + 1, len(v) - 1)] - v[k]) * ((len(v) - 1) * p - k)
    assert got == pytest.approx(want)
    whole = {r["share"]: r["value"] for r in profile.quantiles(df, "x", [0.5], exact_rows=exact_rows).collect()}
    assert whole[0.5] == pytest.approx(statistics.median(x for _, x in rows if x is not None))
    assert profile.quantiles(df.limit(0), "x", shares, ["g"]).collect() == []


def test_rows_are_numbered_over_ranges(spark):
    rng = random.Random(9)
    keys = [rng.randint(0, 50) for _ in range(400)] + [None] * 3
    out = ranking.numbered_rows(spark.createDataFrame([(k,) for k in keys], "k int").repartition(5), "k", "i").collect()
    assert sorted(r["i"] for r in out) == list(range(1, 404))
    assert [r["k"] for r in sorted(out, key=lambda r: r["i"])] == sorted(keys, key=lambda k: (k is not None, k or 0))
    a, b = spark.createDataFrame([(3, "c"), (1, "a")], "k int, x string"), spark.createDataFrame([(9, "z")], "j int, y string")
    assert sorted(map(tuple, joins.bind_columns(a, b, "k", "j").collect())) == [(1, "a", 9, "z"), (3, "c", None, None)]


def test_names_by_pattern():
    assert text.pattern_renamed(["score_units", "other"], "^score_(.+)$", r"\1") == ["units", "other"]
    with pytest.raises(ValueError, match="distinct"):
        text.pattern_renamed(["a1", "a2"], "[0-9]", "")
