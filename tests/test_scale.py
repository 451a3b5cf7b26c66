"""Forms made for hot groups and large sides: equal to the plain ones, with the plans they are made for."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.operators import balls, distinct, evaluation, grid, joins, profile, ranking, scan, scoring, topn


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def weights(rng, names, terms, hot=3):
    rows = []
    for name in names:
        own = set(rng.sample(range(terms), rng.randint(1, 25))) | set(rng.sample(range(hot), rng.randint(0, hot)))
        w = np.array([rng.random() * (0.2 if t < hot else 1) + 0.01 for t in own])
        rows += [(name, f"t{t}", float(x)) for t, x in zip(own, w / np.sqrt((w * w).sum()), strict=True)]
    return rows


@pytest.fixture(scope="module")
def postings(spark):
    rng = random.Random(4)
    refs = weights(rng, [f"b{i}" for i in range(12)], 60)
    pairs = weights(rng, [f"d{i:03}" for i in range(300)], 60)
    leaked = [r for r in refs if r[0] in ("b1", "b2")]
    pairs += [(f"x{r[0]}{k}", r[1], r[2]) for r in leaked for k in range(6)] + [(None, "t1", 0.5), ("null", None, 0.5)]
    make = lambda rows: spark.createDataFrame(rows, "doc_id string, term string, weight double")
    return make(refs + [("alone", "nowhere", 1.0)]), make(pairs)


def rows(df):
    return sorted((r["reference_id"], r["paired_id"], round(r["score"], 9)) for r in df.collect())


@pytest.mark.parametrize(("n", "first"), [(1, 1), (5, 4), (5, 48), (400, 8)])
def test_pruned_top_equals_ranking_all_sharers(postings, n, first):
    refs, pairs = postings
    want = scoring.TopN(n)(scoring.sparse_scores(refs, pairs.where("doc_id IS NOT NULL")))
    assert rows(topn.pruned_top(refs, pairs, n, first=first).scores) == rows(want)


def test_pruned_top_by_group_and_its_edges(spark, postings):
    refs, pairs = postings
    groups = pairs.select(F.col("doc_id").alias("paired_id")).distinct().where("paired_id <> 'd001'").withColumn("grp", F.crc32("paired_id") % 3)
    want = scoring.TopNByGroup(4, groups)(scoring.sparse_scores(refs, pairs))
    assert rows(topn.pruned_top(refs, pairs, 4, groups).scores) == rows(want)
    assert topn.pruned_top(refs.limit(0), pairs, 3).scores.count() == 0 and topn.pruned_top(refs, pairs.limit(0), 3).scores.count() == 0
    with pytest.raises(ValueError):
        topn.pruned_top(refs, pairs.withColumn("weight", -F.col("weight")), 3)


def test_pruned_top_joins_fewer_postings(spark):
    rng = random.Random(8)
    refs = weights(rng, [f"b{i}" for i in range(20)], 3000, 8)
    pairs = weights(rng, [f"d{i}" for i in range(1500)], 3000, 8)
    pairs += [(f"{r[0]}x{k}", r[1], r[2]) for r in refs for k in range(5)]
    make = lambda x: spark.createDataFrame(x, "doc_id string, term string, weight double")
    out = topn.pruned_top(make(refs), make(pairs), 5, first=4)
    work = {r["step"]: r["postings"] for r in out.work.collect()}
    assert rows(out.scores) == rows(scoring.TopN(5)(scoring.sparse_scores(make(refs), make(pairs))))
    assert sum(v for k, v in work.items() if k != "all") < work["all"] / 3


def clustered(n, dims, seed):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(12, dims))
    x = middle[rng.integers(0, 12, n)] + 0.05 * rng.normal(size=(n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_balls_give_the_best_vectors_and_skip_blocks(spark):
    x = clustered(1500, 16, 2)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(5000, x[3].tolist()), (5001, None)], "doc_id long, vec array<double>")
    refs = v.where("doc_id % 50 = 0")
    out = balls.ball_top(refs, v, 7, centres=24, rows=16)
    want = scoring.TopN(7)(scoring.dense_scores(refs.where("vec IS NOT NULL"), v.where("vec IS NOT NULL")))
    assert rows(out.scores) == rows(want)
    work = {r["step"]: r["blocks"] for r in out.work.collect()}
    assert work["first"] + work["later"] < work["all"] / 3
    assert "CartesianProduct" not in plan_of(out.scores) and "NestedLoop" not in plan_of(out.scores)
    assert balls.ball_top(refs, v.limit(0), 7).scores.count() == 0 and balls.ball_top(refs.limit(0), v, 7).scores.count() == 0


@pytest.mark.parametrize("area", [4, 64, 1 << 20])
def test_grid_join_equals_the_theta_join(spark, area):
    rng = random.Random(area)
    a = spark.createDataFrame([(i, rng.randint(0, 9) if i % 7 else None, i % 3) for i in range(60)], "ida long, xa int, ga int")
    b = spark.createDataFrame([(i, rng.randint(3, 15), i % 3) for i in range(45)] + [(7, 9, 1)] * 5, "idb long, xb int, gb int")
    met = grid.grid_join(a, b, F.col("ga") != F.col("gb"), ("xa", "xb"), area)
    assert "CartesianProduct" not in plan_of(met) and "NestedLoop" not in plan_of(met)
    plain = a.crossJoin(b).where("ga <> gb AND xa < xb")
    assert sorted(map(tuple, met.collect())) == sorted(map(tuple, plain.collect()))
    every = grid.grid_join(a, b, area=area)
    assert sorted(map(str, every.collect())) == sorted(map(str, a.crossJoin(b).collect()))
    assert grid.grid_join(a.limit(0), b, None, ("xa", "xb")).count() == 0
    with pytest.raises(ValueError):
        grid.grid_join(a, a)


def test_grid_sends_a_row_to_few_cells(spark, monkeypatch):
    """With 360,000 rows a side (6 GB) a row went to up to 2,046 cells, whatever the input."""
    for n in (1000, 60_000, 360_000, 1_000_000):
        assert -(-n // grid.side_of(n, n, 1 << 14)) <= grid.CELLS and grid.side_of(n, n, 1 << 14) <= grid.SIDE
    assert grid.side_of(1 << 30, 5, 1 << 14) == grid.SIDE and grid.side_of(1000, 1000, 1 << 14) == 128 and grid.side_of(0, 0, 0) == 1
    a = spark.range(70).select(F.col("id").alias("ida"), (F.col("id") * 7 % 31).alias("xa"))
    b = spark.range(50).select(F.col("id").alias("idb"), (F.col("id") * 5 % 29).alias("xb"))
    want = sorted(map(tuple, a.crossJoin(b).where("xa < xb AND ida <> idb").collect()))
    for name, value in (("CELLS", 3), ("TASK", 40)):
        monkeypatch.setattr(grid, name, value)
        met = grid.grid_join(a, b, F.col("ida") != F.col("idb"), ("xa", "xb"), 4)
        assert sorted(map(tuple, met.collect())) == want and "CartesianProduct" not in plan_of(met) and "NestedLoop" not in plan_of(met)
        sent = {n["_j"] for n in grid.stretched(b, "xb", 50, grid.side_of(70, 50, 4), "_j").select("_j").collect()}
        assert len(sent) <= 3


def test_one_shuffle_joins_any_number_of_score_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "reference_id string, paired_id long, score double")
    tables = {
        "a": make([("x", 1, 0.1), ("x", 1, 0.2), ("y", 2, None), (None, 1, 0.3)]),
        "b": make([("x", 1, 0.4), ("x", 1, 0.5), ("x", 1, 0.5), (None, 1, 0.6)]),
        "c": make([("z", 3, 0.7), ("y", 2, 0.8)]),
        "d": make([("w", None, 0.9)]),
    }
    got = joins.merge_scores(tables)
    want = None
    for k, t in tables.items():
        t = t.withColumnRenamed("score", f"score_{k}")
        want = t if want is None else want.join(t, ["reference_id", "paired_id"], "full")
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert plan_of(got).split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1


def test_ranks_and_shares_of_one_reference_that_has_all_rows(spark):
    data = spark.range(3000).select(F.lit("r").alias("ref"), F.when(F.col("id") % 97 == 0, None).when(F.col("id") % 11 == 0, 0.0).otherwise((F.col("id") % 500 - 100) / 7).alias("score"), "id")
    plain = ranking.rank_scores(data, "score", "ref")
    spread = ranking.rank_scores(data, "score", "ref", spread=True)
    assert "Window" not in plan_of(spread).replace("Window [sum(_n", "").replace("Window [coalesce(sum(_n", "") or "_part" in plan_of(spread)
    assert sorted(map(str, spread.collect())) == sorted(map(str, plain.collect()))
    two = data.withColumns({"other": -F.col("score"), "grp": F.col("id") % 2})
    several = lambda spread: sorted(map(str, ranking.calc_ranks_all_scores(two, ["score", "other"], "ref", "grp", spread=spread).collect()))
    assert several(True) == several(False)
    shares = profile.ecdf(data, F.col("score"))
    counts = data.where("score IS NOT NULL").groupBy(F.col("score").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    want = counts.withColumn("density", F.sum("n").over(w) / F.lit(data.where("score IS NOT NULL").count()))
    assert "SinglePartition" not in plan_of(shares).split("HashAggregate")[0]
    assert sorted(map(str, shares.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("parts", [3, 7])
def test_places_and_running_sums_do_not_depend_on_the_partitions(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        data = spark.range(400).select((F.col("id") * 37 % 11).alias("k"), (F.col("id") % 5).alias("v"), F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("g")).repartition(parts)
        out = scan.scanned(data, [F.col("k"), F.col("v")], ["g"], "p", "v", "s", "n").collect()
        plain = {}
        for r in sorted(data.collect(), key=lambda r: (str(r["g"]), r["k"], r["v"])):
            plain.setdefault(r["g"], []).append((r["k"], r["v"]))
        for g, own in plain.items():
            got = sorted((r["p"], r["k"], r["v"], r["s"], r["n"]) for r in out if r["g"] == g)
            sums = np.cumsum([v for _, v in own])
            assert [(p, k, v) for p, k, v, _, _ in got] == [(i + 1, *kv) for i, kv in enumerate(own)]
            assert [(s, n) for *_, s, n in got] == [(int(s), len(own)) for s in sums]
        numbered = ranking.numbered_rows(data.withColumn("text", F.concat(F.lit("x"), "v")), "text", "i")
        assert sorted(r["i"] for r in numbered.collect()) == list(range(1, 401))
        kept = sorted((r["text"], r["k"], r["v"], str(r["g"])) for r in numbered.where("i <= 100").collect())
        assert hash_of(kept) == test_places_and_running_sums_do_not_depend_on_the_partitions.__dict__.setdefault("kept", hash_of(kept))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def hash_of(rows):
    return str(rows)


def test_columns_glued_by_repeated_keys_are_the_same_every_time(spark):
    a = spark.range(90).select((F.col("id") % 4).alias("k"), F.col("id").alias("a"))
    b = spark.range(90).select((F.col("id") % 3).alias("q"), F.col("id").alias("b"))
    first = sorted(map(str, joins.bind_columns(a.repartition(3), b.repartition(7), "k", "q").collect()))
    assert first == sorted(map(str, joins.bind_columns(a.repartition(7), b.repartition(2), "k", "q").collect()))


def test_bitmaps_add_up_over_levels(spark):
    rng = random.Random(6)
    data = spark.createDataFrame([(rng.choice("abc"), rng.choice([1, 2, None]), rng.choice([None, *range(40)]) if i % 3 else i) for i in range(900)], "g string, h int, v long")
    maps = distinct.bitmaps(data, "v", ["g", "h"])
    plain = lambda by: sorted(map(str, data.groupBy(*by).agg((F.count_distinct("v") + F.max(F.col("v").isNull().cast("int"))).alias("n")).collect()))
    for by in (["g", "h"], ["g"], ["h"], []):
        assert sorted(map(str, distinct.distinct_counts(maps, by).collect())) == plain(by)


def test_totals_come_with_the_report_in_one_pass(spark):
    rng = random.Random(2)
    rows = [(c, r, g, *(rng.randint(0, 9) for _ in range(7))) for c in (1, 2) for r, g in ((f"r{c}{i}", i % 3) for i in range(5))]
    counts = ["top1_pred", "top1_true_pred", "top5_pred", "top5_true_pred", "top10_pred", "top10_true_pred", "actual_pairings"]
    report = spark.createDataFrame(rows, "concept int, ref string, grp int, " + ", ".join(f"{c} long" for c in counts))
    report = report.join(report.groupBy("concept").agg(*[F.sum(c).alias(f"n_{c}") for c in counts], F.count("*").alias("n_ref"), F.count_distinct("grp").alias("n_grp")), "concept")
    report = report.unionAll(report.where("ref = 'r11'"))
    both = evaluation.with_totals(report, "ref", "concept", "grp").collect()
    total = evaluation.class_totals(report, "ref", "concept", "grp").first()
    (last,) = [r for r in both if r["concept"].startswith("All ")]
    assert last["concept"] == "All concept (N = 2)" == total["concept"] and all(last[c] == total[c] for c in total.asDict()) and last["ref"] is None
    details = sorted(str(tuple(r)) for r in both if r is not last)
    assert details == sorted(str(tuple(r)) for r in report.select(*[F.col(c).cast("string") if c == "concept" else c for c in report.columns]).collect())


def test_many_references_meet_all_candidates_without_a_cartesian_product(spark, monkeypatch):
    monkeypatch.setattr(scoring, "BROADCAST_ROWS", 3)
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "doc_id long, vec array<double>")
    out = scoring.dense_scores(v.where("doc_id < 9"), v)
    assert "CartesianProduct" not in plan_of(out) and "NestedLoop" not in plan_of(out)
    assert sorted((r["reference_id"], r["paired_id"], r["score"]) for r in out.collect()) == [(i, j, i * j + 1.0) for i in range(9) for j in range(30)]
