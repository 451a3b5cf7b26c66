import random
import struct

import pytest
from pyspark.sql import functions as F

from matchloom.functions import predicates
from matchloom.operators import corpus, joins, tfidf
from matchloom.plans import pipelines
from matchloom.sources import csvlines, files, lexicon, ontology, scratch, vectors
from matchloom.streaming import scores as streaming


def test_csv_round_trip(spark, tmp_path):
    rows = [("a,b", 'say "hi"', None), ("line\nbreak", "x", "1"), (None, "", "2")]
    files.write_csv(spark.createDataFrame(rows, "p string, q string, r string"), str(tmp_path / "t"))
    got = files.read_csv(spark, str(tmp_path / "t")).collect()
    assert {tuple(r) for r in got} == {("a,b", 'say "hi"', None), ("line\nbreak", "x", "1"), (None, None, "2")}


def test_ragged_rows_and_na_texts(spark, tmp_path):
    (tmp_path / "r.csv").write_text("a,b,c\n1,NA,3\n4\n")
    out = files.read_csv(spark, str(tmp_path / "r.csv"), "a string, b string, c string", extra_nulls=True).collect()
    assert [tuple(r) for r in out] == [("1", None, "3"), ("4", None, None)]


def test_path_or_frame(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "id int, t string")
    df.write.parquet(str(tmp_path / "d.parquet"))
    assert files.read_data_if_needed(df) is df
    assert files.read_data_if_needed(str(tmp_path / "d.parquet"), spark).count() == 1
    with pytest.raises(ValueError):
        files.read_data_if_needed(3)
    assert joins.load_join_data(str(tmp_path / "d.parquet"), df.withColumnRenamed("t", "u"), spark=spark).columns == ["id", "t", "u"]


def test_score_file_appends(spark, tmp_path):
    s = spark.createDataFrame([("a,1", "b", 0.5)], "reference_id string, paired_id string, score double")
    files.write_scores(s, str(tmp_path / "s"))
    files.write_scores(s, str(tmp_path / "s"), append=True)
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "s")).collect()] == [("a,1", "b", "0.5")] * 2


def test_names_and_top_words(spark, tmp_path):
    assert files.output_name("fhs", "vars", True, True, "desc", "v1") == "fhs_vars_multtfcdf_embed_desc_v1.csv"
    assert files.output_name(kind="vars") == "vars_tfidf.csv"
    tops = spark.createDataFrame([("AF", "beat", 2), ("AF", "heart", 1)], "grp string, term string, rank int")
    files.write_top_words(tops, str(tmp_path / "w"))
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "w")).collect()] == [("AF", "heart beat")]


def test_word2vec_file(spark, tmp_path):
    path = tmp_path / "v.bin"
    words = {"race": (1.0, 2.0), "été": (0.5, -1.0), "x": (0.0, 0.0)}
    path.write_bytes(b"3 2\n" + b"".join(w.encode() + b" " + struct.pack("<2f", *v) + b"\n" for w, v in words.items()))
    assert {r["word"]: tuple(r["vec"]) for r in vectors.load_word2vec(spark, str(path)).collect()} == words
    assert vectors.load_word2vec(spark, str(path), limit=1).count() == 1
    vectors.convert_to_keyed_vectors(spark, str(path), str(tmp_path / "v.parquet"))
    assert vectors.load_keyed_vectors(spark, str(tmp_path / "v.parquet")).count() == 3
    (tmp_path / "bad.bin").write_bytes(b"2 2\nrace " + b"\0" * 4)
    with pytest.raises(EOFError):
        list(vectors.read_word2vec(str(tmp_path / "bad.bin")))


def test_ontology(spark, tmp_path):
    (tmp_path / "CONCEPT.csv").write_text("concept_id\tconcept_name\tdomain_id\tvocabulary_id\tconcept_class_id\tstandard_concept\tconcept_code\tvalid_start_date\tvalid_end_date\tinvalid_reason\n1\tHeart \"rate\"\tM\tS\tObservable\tS\tc1\t20000101\t20991231\t\n2\tOld\tM\tS\tObservable\tS\tc2\t20000101\t20201231\tD\n")
    (tmp_path / "DOMAIN.csv").write_text("domain_id\tdomain_name\tdomain_concept_id\nM\tMeasurement\t9\n")
    c = ontology.load_concepts(spark, str(tmp_path))
    assert [(r["concept_name"], r["domain_name"]) for r in c.orderBy("concept_id").collect()] == [('Heart "rate"', "Measurement"), ("Old", "Measurement")]
    d = spark.createDataFrame([(1, 7, "heart", ontology.SYNONYM), (1, 8, "cardiac", 5), (2, 9, "old", 5)], "conceptId long, id long, term string, typeId long")
    ids = spark.createDataFrame([(1,), (4,)], "conceptId long")
    assert sorted((r["conceptId"], r["term"] or "") for r in ontology.description(d, ids).collect()) == [(1, "cardiac"), (4, "")]
    assert ontology.description(d, ids, True).count() == 3 and ontology.valid_descriptions(d, ids).count() == 2
    assert ontology.concept_lookup(d, spark.createDataFrame([("old",)], "term string")).first()["conceptId"] == 2
    d.createOrReplaceTempView("text_definition_test")
    assert ontology.term_by_id(spark, "text_definition_test", 2).first()["term"] == "old"
    assert ontology.as_dictionary(c).first()["dbGaP_study_id"] == "SNOMED" and ontology.first_concepts(c, 1).count() == 1


DATA = [("v1", "heart rate", "bpm", "s1"), ("v2", "rate of heart beats", None, "s2"), ("v3", "age in years", "years", "s1"), ("v4", "years of age", "years", "s2"), ("v5", "heart", None, "s2")]


@pytest.fixture(scope="module")
def variables(spark):
    return spark.createDataFrame(DATA, "id string, description string, units string, study string").cache()


def test_text_similarity_of_several_column_sets(spark, variables):
    refs = spark.createDataFrame([("v1",), ("v3",)], "doc_id string")
    out = pipelines.calc_scores_doc_cols(variables, refs, {"desc": ["description"], "units": ["units"]}, "id", null_token="")
    rows = {(r["reference_id"], r["paired_id"]): r for r in out.collect()}
    assert {k for k, r in rows.items() if r["score_desc"]} == {("v1", "v2"), ("v1", "v5"), ("v3", "v4")}
    assert rows["v3", "v4"]["score_units"] == pytest.approx(1)
    by_study = predicates.pairable_by_group("study")
    kept = pipelines.doc_similarity(variables, refs, doc_cols=["units"], id_col="id", corpora_col="study", pairable=by_study, attributes=variables.select(F.col("id").alias("doc_id"), "study"), null_token="")
    assert [(r["reference_id"], r["paired_id"]) for r in kept.collect()] == [("v3", "v4")]


def test_embedding_runs_score_the_embeddings(spark, variables):
    words = spark.createDataFrame([("heart", [1.0, 0.0]), ("rate", [0.9, 0.1]), ("age", [0.0, 1.0]), ("year", [0.0, 1.0])], "word string, vec array<double>")
    refs = spark.createDataFrame([("v1",)], "doc_id string")
    out = {r["paired_id"]: r["score"] for r in pipelines.doc_similarity(variables, refs, doc_cols=["description"], id_col="id", word_vectors=words).collect()}
    assert set(out) == {"v2", "v3", "v4", "v5"} and out["v5"] > 0.95 > 0.2 > out["v3"]


def test_concept_vectors(spark, variables):
    groups = spark.createDataFrame([("HR", "v1"), ("HR", "v2"), ("AGE", "v3"), ("AGE", "v4")], "grp string, doc_id string")
    tops, scores, cohesion = pipelines.concept_vectors(variables, groups, doc_cols=["description"], id_col="id", n=2)
    assert {r["grp"]: set() for r in tops.collect()}.keys() == {"HR", "AGE"}
    best = {r["reference_id"]: r["paired_id"] for r in scores.orderBy("score").collect()}
    assert best["AGE"] in ("v3", "v4") and best["HR"] in ("v1", "v2")
    assert {r["grp"]: round(r["cohesion"], 6) for r in cohesion.collect()}["AGE"] == 1.0


def test_evaluation_chain(spark):
    rows = [("c", r, int(r[1]), p, int(p[1]), 1.0 / (1 + abs(ord(r[0]) - ord(p[0]))), 0.5) for r in ("a1", "a2", "a3") for p in ("a1", "a2", "a3", "z1", "z2", "z3")]
    df = spark.createDataFrame(rows, "concept string, ref string, rg int, pair string, pg int, s double, t double")
    out = pipelines.evaluate_scores(df, score_cols=["s"], ref="ref", paired="pair", class_col="concept", group="rg", paired_group="pg", combine_cols={"both": ["s", "t"]}, cutoffs=(1, 5))
    total = {r["score"]: r for r in out.where("concept LIKE 'All %'").collect()}
    assert total["s"]["n_top1_recall"] == 1.0 and total["both"]["n_top1_precision"] == 1.0


def test_stream(spark, variables, tmp_path):
    variables.select(F.col("id").alias("doc_id"), F.col("description").alias("text")).write.parquet(str(tmp_path / "in"))
    docs = corpus.build_corpus(variables, ["description"], "id")
    model = tfidf.CorporaTfidfVectorizer().fit(docs)
    refs = model.transform(docs).where("doc_id = 'v1'")
    q = streaming.stream_scores(spark.readStream.schema("doc_id string, text string").parquet(str(tmp_path / "in")), model, refs, str(tmp_path / "out"), str(tmp_path / "cp"), n=2)
    q.awaitTermination()
    assert sorted(r["paired_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["v1", "v2"] or spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_word2vec_folder(spark, tmp_path):
    words = [(f"w{i}", [float(i), i / 2]) for i in range(50)] + [("été", [0.0, -1.0])]
    df = spark.createDataFrame(words, "word string, vec array<float>").repartition(4)
    vectors.save_word2vec(df, str(tmp_path / "v"))
    got = vectors.load_word2vec(spark, str(tmp_path / "v"))
    assert sorted((r["word"], list(r["vec"])) for r in got.collect()) == sorted(words)
    assert {r["word"]: r["vec"] for r in vectors.load_word2vec(spark, f"file://{tmp_path}/v").collect()}["w7"] == [7.0, 3.5]
    assert list(vectors.read_word2vec(vectors.files_of(str(tmp_path / "v"))[0], block=3))


def test_lexicon_files(spark, tmp_path):
    (tmp_path / "index.noun").write_text("  1 licence text\nglass n 2 0 00001740\nglasses n 1 0 00001741\nhot_dog n 1 0 00001742\nwoman n 1 0 00001743\n")
    (tmp_path / "noun.exc").write_text("feet foot\nmice mouse\naxes ax axis\n")
    nouns, odd = lexicon.load_lexicon(spark, str(tmp_path / "index.noun")), lexicon.load_exceptions(spark, str(tmp_path / "noun.exc"))
    assert {r["word"] for r in nouns.collect()} == {"glass", "glasses", "hot dog", "woman"}
    words = spark.createDataFrame([(w,) for w in ("glasses", "feet", "axes", "women", "unknowns", "woman")], "word string")
    assert {r["word"]: r["lemma"] for r in corpus.lemma_table(words, nouns, odd).collect()} == {"glasses": "glass", "feet": "foot", "axes": "ax", "women": "woman"}


def test_a_cluster_session_must_name_its_shared_folder(spark):
    class Missing:
        def isEmpty(self):  # noqa: N802  as the JVM names it
            return True

    class Fake:
        master = "spark://host:7077"
        conf = {}

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            class _jsc:
                @staticmethod
                def sc():
                    return type("Sc", (), {"getCheckpointDir": lambda self: Missing()})()

    with pytest.raises(ValueError, match="share"):
        scratch.shared_folder(Fake)


def test_csv_with_line_breaks_is_read_by_splits(spark, tmp_path):
    import csv

    rng = random.Random(5)
    rows = [["id", "about", "more"]]
    for i in range(3000):
        text = "".join(rng.choice(["word ", "\n", '"', ",", "é", "\r\n" if i % 50 == 0 else "x"]) for _ in range(rng.randint(0, 12)))
        rows.append([str(i), text.strip() or "-", "long\n" * 400 if i in (700, 701, 2000) else "b"])
    for name in ("a.csv", "b.csv"):
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as f:
            csv.writer(f, lineterminator="\n").writerows(rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for kw in ({"schema": "id string, about string, more string"}, {}):
            out = files.read_csv(spark, [str(tmp_path / n) for n in ("a.csv", "b.csv")], multi_line=True, **kw)
            got = sorted((r["id"], r["about"], r["more"]) for r in out.collect())
            assert got == sorted(tuple(r) for r in 2 * rows[1:])
        raw = csvlines.logical_lines(spark, str(tmp_path / "a.csv"))
        assert raw.rdd.getNumPartitions() > 3 and raw.where("first").count() == 1 and raw.count() == 3001
        assert files.read_csv(spark, str(tmp_path / "a.csv"), "id string, about string, more string").count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_empty_and_headless_csv_by_splits(spark, tmp_path):
    (tmp_path / "e.csv").write_text("id,about\n")
    assert files.read_csv(spark, str(tmp_path / "e.csv"), "id string, about string", multi_line=True).collect() == []
    (tmp_path / "h.csv").write_text('1,"a\nb"\n2\n')
    got = files.read_csv(spark, str(tmp_path / "h.csv"), "id int, about string", header=False, multi_line=True).collect()
    assert sorted(map(tuple, got)) == [(1, "a\nb"), (2, None)]


def test_an_append_that_broke_off_and_ran_again_leaves_each_row_once(spark, tmp_path):
    path = str(tmp_path / "scores")
    make = lambda rows: spark.createDataFrame(rows, "reference_id string, paired_id string, score double")
    assert files.read_appended(spark, path).count() == 0
    files.append_scores(make([("a", "x,1", 0.5)]), path, "first")
    broken = make([("b", "y", 0.25), ("b", "z", 0.5)]).repartition(2).withColumn("score", F.when(F.col("paired_id") == "z", F.raise_error(F.lit("stop")).cast("double")).otherwise(F.col("score")))
    with pytest.raises(Exception, match="stop"):
        files.append_scores(broken, path, "second")
    assert [tuple(r) for r in files.read_appended(spark, path).collect()] == [("a", "x,1", 0.5)]
    for _ in range(2):
        files.append_scores(make([("b", "y", 0.25), ("b", "z", 0.5)]), path, "second")
    assert sorted(map(tuple, files.read_appended(spark, path).collect())) == [("a", "x,1", 0.5), ("b", "y", 0.25), ("b", "z", 0.5)]
    with pytest.raises(ValueError, match="name"):
        files.append_scores(make([]), path, "../x")


def test_one_word2vec_file_is_read_by_ranges(spark, tmp_path):
    rng = random.Random(3)
    words = [f"w{'é' * rng.randint(0, 9)}{i}" for i in range(1000)]
    with open(tmp_path / "v.bin", "wb") as f:
        f.write(b"1000 5\n")
        for i, w in enumerate(words):
            f.write(w.encode() + b" " + struct.pack("<5f", *[i + k for k in range(5)]) + (b"\n" if i % 2 else b""))
    path = str(tmp_path / "v.bin")
    whole = sorted((r["word"], r["vec"]) for r in vectors.load_word2vec(spark, path).collect())
    assert vectors.index_word2vec(spark, path, every=250) == 1000
    out = vectors.load_word2vec(spark, path)
    assert out.rdd.getNumPartitions() == 4 and sorted((r["word"], r["vec"]) for r in out.collect()) == whole
    assert [r["word"] for r in vectors.load_word2vec(spark, path, limit=260).collect()] == words[:260]
    assert vectors.load_word2vec(spark, str(tmp_path)).count() == 1000
    with open(path, "r+b") as f:
        f.write(b"0003 5\n")
        f.truncate(200)
    assert vectors.load_word2vec(spark, path).rdd.getNumPartitions() == 1  # the index is of another file


def test_a_task_writes_files_of_bounded_size(spark, tmp_path, monkeypatch):
    writer = vectors._Writer(str(tmp_path / "w"))
    monkeypatch.setattr(vectors, "FILE_BYTES", 100)
    done = writer.write(iter([{"word": f"w{i}", "vec": [1.0, float(i)]} for i in range(40)]))
    writer.commit([done, vectors._Written([])])
    got = [x for f in vectors.files_of(str(tmp_path / "w")) for x in vectors.read_word2vec(f)]
    assert len(done.names) > 3 and sorted(got) == sorted((f"w{i}", [1.0, float(i)]) for i in range(40))
