import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchloom.functions import text
from matchloom.operators import corpus, scoring, tfidf, vectors

ROWS = [
    ("race is a variable describing a group of individuals having certain characteristics in common, owing to a common inheritance.", "1", "race"),
    ("gender is a variable describing the self-identified category on the basis of sex.", "2", "gender"),
    ("sex as a variable is descriptive of the biological characterization based on the gametes or gonads of an individual.", "1 2", "sex"),
    ("The affiliation due to shared cultural background.", "2 1", "ethnicity"),
]
TOKENS = {
    "race": "race variable describing group individual certain characteristic common owing common inheritance",
    "gender": "gender variable describing self identified category basis sex",
    "sex": "sex variable descriptive biological characterization based gamete gonad individual",
    "ethnicity": "affiliation due shared cultural background",
}


@pytest.fixture(scope="module")
def docs(spark):
    data = spark.createDataFrame(ROWS, "documentation string, `alt documentation` string, id string")
    return corpus.lemmatize(corpus.build_corpus(data, ["documentation"], "id")).cache()


def test_tokens_of_the_document_set(docs):
    assert {r["doc_id"]: " ".join(r["tokens"]) for r in docs.collect()} == TOKENS


def test_one_text(spark):
    assert corpus.lemmatize_variable_documentation(["hey there little lady"], spark) == ["hey", "little", "lady"]


def test_null_cells_and_several_columns(spark):
    df = spark.createDataFrame([("a", None, "x1 z"), ("b", "Blood", None)], "id string, p string, q string")
    out = {r["doc_id"]: r["tokens"] for r in corpus.build_corpus(df, ["p", "q"], "id").collect()}
    assert out == {"a": ["nan", "x1", "z"], "b": ["blood", "nan"]}
    clean = {r["doc_id"]: r["tokens"] for r in corpus.build_corpus(df, ["p", "q"], "id", null_token="").collect()}
    assert clean == {"a": ["x1", "z"], "b": ["blood"]}


def test_non_ascii_tokens_go_whole_and_stop_words_stay_if_alone(spark):
    df = spark.createDataFrame([("a", "Café the table"), ("b", "the and of"), ("c", "")], "id string, t string")
    out = {r["doc_id"]: r["tokens"] for r in corpus.build_corpus(df, ["t"], "id").collect()}
    assert out == {"a": ["table"], "b": ["the", "and", "of"], "c": []}
    assert {r["doc_id"]: r["tokens"] for r in corpus.lemmatize(corpus.build_corpus(df, ["t"], "id")).collect()}["c"] == []


def test_lemmas(spark):
    words = spark.createDataFrame([(w,) for w in "boxes wives children masses women basis describing identified based studies glass branches".split()], "word string")
    got = {r["word"]: r["lemma"] for r in corpus.lemma_table(words).collect()}
    assert got == {"boxes": "box", "wives": "wife", "children": "child", "masses": "mass", "women": "woman", "studies": "study", "branches": "branch"}


def test_cosines_of_the_document_set(docs, spark):
    vocab, weights = tfidf.calc_tfidf(docs)
    assert vocab.count() == 27
    ids = spark.createDataFrame([("race",)], "doc_id string")
    out = {r["paired_id"]: r["score"] for r in scoring.VariableSimilarityCalculator(ids).score_variables(weights).collect()}
    assert out == pytest.approx({"gender": 0.11689940812532476, "sex": 0.1089920848026968})
    race = sorted(round(r["weight"], 2) for r in weights.where("doc_id = 'race'").collect())
    assert race == [0.19, 0.23, 0.23] + [0.29] * 6 + [0.59]
    assert sorted(round(r["weight"], 2) for r in weights.where("doc_id = 'ethnicity'").collect()) == [0.45] * 5


def test_scores_are_symmetric_and_rows_have_length_one(docs):
    weights = tfidf.calc_tfidf(docs)[1]
    lengths = weights.groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("n")).collect()
    assert all(r["n"] == pytest.approx(1) for r in lengths)
    s = {(r["reference_id"], r["paired_id"]): r["score"] for r in scoring.sparse_scores(weights, weights).collect()}
    assert all(s[b, a] == pytest.approx(x) for (a, b), x in s.items())


def brute_idf(corpora):
    terms = {t for c in corpora for d in c for t in d}
    return {t: math.log(len(corpora) / sum((sum(t in d for d in c) + 1) / (len(c) + 1) for c in corpora)) + 1 for t in terms}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.lists(st.sampled_from("abcde"), max_size=5), min_size=1, max_size=4), min_size=1, max_size=3))
def test_idf_over_several_corpora(spark, corpora):
    rows = [(i, f"{i}-{j}", d) for i, c in enumerate(corpora) for j, d in enumerate(c)]
    df = spark.createDataFrame(rows, "corpus_id int, doc_id string, tokens array<string>")
    assert {r["term"]: r["idf"] for r in tfidf.idf(df).collect()} == pytest.approx(brute_idf(corpora))


def test_given_vocabulary_and_repeats(spark):
    df = spark.createDataFrame([(0, "a", ["x", "x", "y"]), (0, "b", ["z"])], "corpus_id int, doc_id string, tokens array<string>")
    words = spark.createDataFrame([("x",), ("q",)], "term string")
    assert [(r["doc_id"], r["term"], r["tf"]) for r in tfidf.term_counts(df, words).collect()] == [("a", "x", 2)]


def test_corpora_from_frames_and_by_column(spark):
    df = spark.createDataFrame([("a", "x", "one"), ("b", "y", "two"), ("c", None, "three")], "id string, g string, t string")
    assert corpus.build_corpora([df, df], ["t"], "id").select("corpus_id").distinct().count() == 2
    assert sorted(r["doc_id"] for r in corpus.build_corpora(df, ["t"], "id", by="g").collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        corpus.assert_row_count(df.limit(1), df)


def test_document_embedding(spark):
    vecs = {
        "race": (0.43838999, -0.30252999, 0.87002999), "describing": (0.27838001, -0.33434999, -0.086761), "gender": (0.66943002, -0.54661, 0.87055999),
        "self": (0.63867998, 0.041965, 0.22407), "sex": (0.51067001, 0.56326002, 0.75374001), "individual": (-0.15588, 0.16461, -0.20387), "or": (0.12931, -0.19647001, 0.30704001),
    }
    words = spark.createDataFrame([(w, list(v)) for w, v in vecs.items()], "word string, vec array<float>")
    w0 = {"race": 0.6316672, "describing": 0.44943642, "individual": 0.6316672}
    w1 = {"describing": 0.30321606, "gender": 0.4261596, "self": 0.4261596, "sex": 0.4261596, "individual": 0.4261596, "gend1": 0.4261596}
    rows = [(0, d, t, x) for d, w in (("0", w0), ("1", w1)) for t, x in w.items()] + [(0, "2", "unknown", 1.0)]
    out = {r["doc_id"]: r["vec"] for r in vectors.calc_doc_embeddings(spark.createDataFrame(rows, "corpus_id int, doc_id string, term string, weight double"), words).collect()}
    assert sorted(out) == ["0", "1"] and round(out["0"][0], 4) == 0.7763
    assert sum(x * x for x in out["1"]) == pytest.approx(1)


def test_centroid_top_words_cohesion(spark):
    w = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 0.6), ("b", "y", 0.8), ("c", "z", 1.0)], "doc_id string, term string, weight double")
    g = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "c")], "grp string, doc_id string")
    center = vectors.centroids(w, g)
    assert {(r["grp"], r["term"]): r["weight"] for r in center.collect()} == pytest.approx({("g", "x"): 0.8, ("g", "y"): 0.4, ("h", "z"): 1.0})
    assert [(r["grp"], r["term"]) for r in vectors.top_words(center, 1).orderBy("grp").collect()] == [("g", "x"), ("h", "z")]
    assert {r["grp"]: r["cohesion"] for r in vectors.group_cohesion(w, g).collect()} == {"g": pytest.approx(0.6), "h": None}


def test_text_columns(spark):
    df = spark.createDataFrame([("a; b.c; d", "b.c", "bxc", "hello", "yellow")], "l string, i string, j string, p string, q string")
    r = df.select(text.listed(F.col("l"), F.col("i")).alias("i"), text.listed(F.col("l"), F.col("j")).alias("j"), text.char_overlap(F.col("p"), F.col("q")).alias("o"), text.id_concat("i", F.lit(None)).alias("n"), text.id_concat("i", F.lit(None), null="NA").alias("m")).first()
    assert (r["i"], r["j"], r["o"], r["n"], r["m"]) == (True, False, 4 - 1, None, "b.c.NA")
    assert text.suffix_renamed(["study_1", "var_1", "n_10"]) == ["study_2", "var_2", "n_10"]


def test_counter_agrees(docs):
    counts = {(r["doc_id"], r["term"]): r["tf"] for r in tfidf.term_counts(docs).collect()}
    assert counts == {(d, t): n for d, words in TOKENS.items() for t, n in Counter(words.split()).items()}
