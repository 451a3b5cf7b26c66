import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brute import components as brute_components
from brute import language_probabilities, line_dedup
from matchloom.llm import langid, pieces, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations sale_lines".split()
WORDS = {"en": "the of and to in that is was for on are as with his they at be this have from", "fr": "de la le et les des en un du une que est pour qui dans par plus pas sur"}
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, h string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    at = tmp_path_factory.mktemp("tables")
    say = lambda lang, n: " ".join(rng.choice(WORDS[lang].split()) + rng.choice(["", "", str(rng.randint(0, 999))]) for _ in range(n))
    item = "quick brown foxes jump over seven lazy dogs while nine grey owls watch them from far away trees"
    rows = [(i, say(lang := ("en", "fr")[i % 2], rng.randint(30, 60)), lang, f"s{i % 3}") for i in range(90)]
    rows = [(i, t + "\nShared footer line" if s == "s1" else t, lang, s) for i, t, lang, s in rows]
    near = rows[4][1].split(" ")
    near[0] = "odd"
    rows += [(200, rows[2][1], "en", "s2"), (201, " ".join(near), "en", "s2"), (202, None, "en", "s0"), (203, "1234 !!", "en", "s0"), (204, "the of " + item + " and to in that is", "en", "s0"), (None, rows[6][1], "en", "s0"), (205, rows[8][1], "en", None)]
    rows += [rows[0]]
    spark.createDataFrame([(*r, len(r[1] or ""), "x") for r in rows], COLUMNS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), rows


def test_stages_against_plain_steps(spark, folder):
    at, rows = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, at)
        if name != "SentencePiece":
            assert made.columns == docs.columns
        path = f"{at}/out-{len(out)}"
        made.write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs.collect()
    first = out["language ID"]
    assert {r["doc_id"] for r in first} >= set(range(90)) and not {202, 203} & {r["doc_id"] for r in first}
    lines = out["line dedup"]
    assert len(lines) == len(first) and not any("Shared footer" in r["text"] for r in lines if r["source"] == "s1")
    assert all(r["n_chars"] == len(r["text"]) for r in lines)
    kept = out["n-gram Jaccard join"]
    number = [(i, r["text"]) for i, r in enumerate(lines)]
    groups = {c for _, n, c in brute_components(number) if n}
    assert len(kept) == len(groups) and {r["doc_id"] for r in lines} - {r["doc_id"] for r in kept} == {200, 201, 6, 205}
    clean = out["benchmark decontamination"]
    assert {r["doc_id"] for r in kept} - {r["doc_id"] for r in clean} == {204}
    last = {r["doc_id"]: r for r in out["SentencePiece"]}
    text = {r["doc_id"]: r["text"] for r in clean}
    assert set(last) == set(text) and all(r["round_trip"] for r in last.values())
    back = pieces.decode(docs.select("doc_id", "ids"), ["doc_id"]).collect()
    assert {r["doc_id"]: r["text"] for r in back} == text


def test_first_stages_agree_with_plain_versions(spark):
    rng = random.Random(21)
    say = lambda lang, n: " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))
    rows = []
    for i in range(160):
        lang = ("en", "fr")[i % 2]
        text = say(lang, rng.randint(1, 12)) if i % 5 else say("en", 6) + " " + say("fr", 6)
        rows.append((i if i % 17 else None, text + rng.choice(["", "\nshared line a", "\nshared line b\n\nown"]), lang, f"s{i % 3}" if i % 11 else None))
    rows += [rows[7]] * 3 + [(900, say("fr", 40_000) + "\nshared line a", "fr", "s1"), (901, None, "en", "s1"), (902, "12 !!", None, "s1"), (903, "", "fr", None)] + [(910 + i, f"qqqq zzqz {i} zzzz qz", None, "s2") for i in range(8)]
    df = spark.createDataFrame([(*r, 0, "x", 1, "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, h string, column_0 int, lang_pred string").repartition(4)
    known = df.select("doc_id", "text", "lang").where(~langid.held_out(F.col("doc_id")))
    model = langid.train(known)
    first = corpus_pipeline.language_id(spark, df, "")
    assert first.columns == df.columns
    kept = sorted((tuple(r) for r in first.collect()), key=repr)
    sure, vague = [], []
    for r in rows:
        if any(c.isalpha() for c in r[1] or ""):
            two = np.sort(language_probabilities(r[1], model))[-2:]
            (vague if abs(two[1] - two[0] - langid.GAP) < 4e-3 else sure if two[1] - two[0] >= langid.GAP else []).append((*r, 0, "x", 1, "y"))
    assert set(sure) <= set(kept) <= set(sure) | set(vague) and len(sure) <= len(rows) - 3
    second = corpus_pipeline.line_dedup(spark, first, "")
    assert second.columns == df.columns
    want = line_dedup([(i, r[3], r[1]) for i, r in enumerate(kept)], corpus_pipeline.LINE_RATIO)
    out = sorted((tuple(r) for r in second.collect()), key=repr)
    assert out == sorted(((r[0], want[i][0], *r[2:4], len(want[i][0]), *r[5:]) for i, r in enumerate(kept)), key=repr)
    assert sum(w[2] for w in want.values()) > 20


def test_ties_and_clashing_names_in_the_later_stages(spark, tmp_path):
    rng = random.Random(22)
    say = lambda n: " ".join(rng.choice(WORDS["en"].split()) + str(rng.randint(0, 99)) for _ in range(n))
    item, long = say(20), say(20_000)
    rows = [(i, say(40)) for i in range(20)] + [(5, "same text of two rows with one id")] * 2 + [(None, "same text of two rows with one id"), (30, long), (31, long + " end"), (32, say(30) + " " + item), (33, ""), (34, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 0, "q", "z") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, component_id string, column_1 string")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    near = corpus_pipeline.near_dedup(spark, df, "")
    assert near.columns == df.columns
    ids = sorted((r["doc_id"] for r in near.collect()), key=repr)
    assert ids == sorted([*range(20), None, 30, 32, 33], key=repr) or ids == sorted([*range(20), None, 30, 32, 33, 34], key=repr)
    clean = corpus_pipeline.decontaminate(spark, near, str(tmp_path))
    assert clean.columns == df.columns and {r["doc_id"] for r in near.collect()} - {r["doc_id"] for r in clean.collect()} == {32}


def test_run_leaves_one_table(spark, folder):
    at, _ = folder
    before = set(os.listdir(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")))
    corpus_pipeline.run(spark, at).count()
    after = set(os.listdir(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")))
    assert len([x for x in after - before if x.startswith("table-") and os.listdir(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:") + "/" + x)]) <= 3


def test_run_and_empty_table(spark, folder, tmp_path):
    at, _ = folder
    assert corpus_pipeline.run(spark, at).count() == 90
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{at}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_one_of_a_group_of_copies_keeps_its_text(spark):
    rng = random.Random(3)
    say = lambda: "\n".join(" ".join(rng.choice(WORDS["en"].split()) + str(rng.randint(0, 999)) for _ in range(12)) for _ in range(3))
    copy = say()
    rows = [(i, copy if i % 3 == 0 else say(), "en", "s", 0, "x") for i in range(60)]
    lines = corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, COLUMNS), "")
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.near_dedup(spark, lines, "").collect()}
    assert kept == {i: t for i, t, *_ in rows if i % 3 or i == 0}


def test_a_line_in_a_tenth_of_a_source_is_dropped(spark):
    rows = [(i, f"own line {i}" + ("\nShared footer line" if i % 10 == 0 else "\nrare line" if i % 30 == 1 else ""), "en", "s", 0, "x") for i in range(100)]
    lines = corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, COLUMNS), "").collect()
    assert {r["doc_id"]: r["text"] for r in lines} == {i: t.replace("\nShared footer line", "") for i, t, *_ in rows}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    if name not in queries.ORACLES:
        assert df.count()
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cols = sorted(df.columns)
    r = con.sql(queries.ORACLES[name])
    at = [r.columns.index(c) for c in cols]
    assert sorted((tuple(x[c] for c in cols) for x in df.collect()), key=repr) == sorted((tuple(x[i] for i in at) for x in r.fetchall()), key=repr)


def test_quality_cutoffs_certified_in_two_strata(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for i in range(3400):
        words = [rng.choice("abcdefgh") + str(rng.randint(0, 9999)) for _ in range(60)]
        if i >= 3200:
            words[:20] = ["#"] * 10 + [f"{j}#" for j in range(10)]
        rows.append((i, " ".join(words), ("en", "fr")[i % 2]))
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(3200)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    df = queries.QUERIES["op8_quality_rules"](spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    r = con.sql(queries.ORACLES["op8_quality_rules"])
    got = df.select(*r.columns).collect()
    assert sorted(map(tuple, got)) == sorted(r.fetchall())
    failed = {x["doc_id"] for x in got if x["rules_failed"] > 0}
    assert {i % 2 for i in failed} == {0, 1} and failed >= set(range(3200, 3400))
