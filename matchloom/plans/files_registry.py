"""Registered queries that write a driver table to the shared folder and read it back, and those of small table steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.functions import text
from matchloom.operators import corpus, joins, profile, ranking, scoring
from matchloom.plans import sql
from matchloom.plans.registry import query, scored, table, unit_vectors
from matchloom.sources import files, lexicon, vectors
from matchloom.sources.scratch import scratch_path

# Files ---------------------------------------------------------------------------------------------------------------


def odd_customers(s, d):
    """Texts with quotes and commas, some null."""
    quoted = F.concat("c_name", F.lit(', called "'), "c_mktsegment", F.lit('", '), F.col("c_nationkey").cast("string"))
    return table(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, quoted).alias("about"), "c_acctbal")


@query("csv_round_trip", """SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_name || ', called "' || c_mktsegment || '", ' || c_nationkey END AS about, c_acctbal FROM customer""")
def csv_round_trip(s, d):
    path = scratch_path(s, "csv")
    files.write_csv(odd_customers(s, d), path)
    return files.read_csv(s, path, "c_custkey long, about string, c_acctbal double")


@query("csv_line_breaks", "SELECT item_id, replace(text, ' ', chr(10)) AS text FROM benchmark")
def csv_line_breaks(s, d):
    path = scratch_path(s, "csv")
    files.write_csv(table(s, d, "benchmark").select("item_id", F.replace("text", F.lit(" "), F.lit("\n")).alias("text")), path)
    return files.read_csv(s, path, "item_id long, text string", multi_line=True)


@query("scores_appended", "SELECT s_suppkey::VARCHAR AS reference_id, 'n' || s_nationkey AS paired_id, s_acctbal AS score FROM supplier")
def scores_appended(s, d):
    path = scratch_path(s, "scores")
    rows = table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("reference_id"), F.concat(F.lit("n"), "s_nationkey").alias("paired_id"), F.col("s_acctbal").alias("score"))
    for run, part in (("even", "s_suppkey % 2 = 0"), ("odd", "s_suppkey % 2 = 1"), ("even", "s_suppkey % 2 = 0")):
        files.append_scores(rows.where(part.replace("s_suppkey", "reference_id::BIGINT")), path, run)
    return files.read_appended(s, path)


@query("csv_ragged", "SELECT p_partkey, p_brand AS brand, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS size FROM part")
def csv_ragged(s, d):
    path = scratch_path(s, "csv")
    short = F.concat_ws(",", F.col("p_partkey").cast("string"), "p_brand")
    table(s, d, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(",", short, F.col("p_size").cast("string"))).otherwise(short).alias("value")).write.text(path)
    return files.read_csv(s, path, "p_partkey long, brand string, size int", header=False)


@query("csv_missing_values", "SELECT p_partkey::VARCHAR AS p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_type END AS type FROM part")
def csv_missing_values(s, d):
    path, k = scratch_path(s, "csv"), F.col("p_partkey")
    files.write_csv(table(s, d, "part").select(k, F.when(k % 4 == 0, F.col("p_type")).when(k % 4 == 1, "NA").when(k % 4 == 2, "#N/A").otherwise("null").alias("type")), path)
    return files.read_csv(s, path, extra_nulls=True)


@query("tsv_round_trip", "SELECT n_nationkey, n_name || ' \"x' AS n_name, n_regionkey FROM nation")
def tsv_round_trip(s, d):
    path = scratch_path(s, "tsv")
    row = F.concat_ws("\t", F.col("n_nationkey").cast("string"), F.concat("n_name", F.lit(' "x')), F.col("n_regionkey").cast("string"))
    table(s, d, "nation").select(row.alias("value")).write.text(path)
    return files.read_tsv(s, path, "n_nationkey int, n_name string, n_regionkey int", header=False)


@query("frame_or_path", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def frame_or_path(s, d):
    left = files.read_data_if_needed(f"{d}/nation.parquet", s)
    right = files.read_data_if_needed(table(s, d, "region"))
    return joins.join_different(left, right, {"n_regionkey": "r_regionkey"}, "inner").select("n_nationkey", "n_name", "r_name")


@query("score_file", "WITH x AS (SELECT o_orderkey AS reference_id, 'c,' || o_custkey AS paired_id, o_totalprice AS score FROM orders) SELECT * FROM x UNION ALL SELECT * FROM x WHERE score > 100000")
def score_file(s, d):
    path = scratch_path(s, "scores")
    scores = table(s, d, "orders").select(F.col("o_orderkey").alias("reference_id"), F.concat(F.lit("c,"), "o_custkey").alias("paired_id"), F.col("o_totalprice").alias("score"))
    files.write_scores(scores, path)
    files.write_scores(scores.where("score > 100000"), path, append=True)
    return files.read_csv(s, path, "reference_id long, paired_id string, score double")


def embedded_words(s, d):
    e = table(s, d, "embeddings")
    return e.select(F.concat(F.lit("wörd"), F.col("vec_id").cast("string")).alias("word"), F.col("embedding").alias("vec"))


WORD_ENDS = "SELECT 'wörd' || vec_id AS word, len(embedding)::INT AS size, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[-1]::DOUBLE, 6) AS last FROM embeddings"


def word_ends(df):
    return df.select("word", F.size("vec").alias("size"), *[F.round(F.element_at("vec", i).cast("double"), 6).alias(n) for i, n in ((1, "first"), (-1, "last"))])


@query("word2vec_round_trip", WORD_ENDS)
def word2vec_round_trip(s, d):
    path = scratch_path(s, "word2vec")
    vectors.save_word2vec(embedded_words(s, d), path)
    vectors.index_word2vec(s, path)
    return word_ends(vectors.load_word2vec(s, path))


@query("keyed_vectors", WORD_ENDS)
def keyed_vectors(s, d):
    path, target = scratch_path(s, "word2vec"), scratch_path(s, "vectors")
    vectors.save_word2vec(embedded_words(s, d), path)
    vectors.convert_to_keyed_vectors(s, path, target)
    return word_ends(vectors.load_keyed_vectors(s, target))


@query("lemmas_from_files", f"WITH {sql.tokens('SELECT 0 AS corpus_id, p_partkey AS doc_id, p_name AS text FROM part')} SELECT doc_id, array_to_string(tokens, ' ') AS tokens FROM toks")
def lemmas_from_files(s, d):
    """Plurals of the words of part names go back to the words of a lexicon file."""
    nouns, odd = scratch_path(s, "nouns"), scratch_path(s, "exceptions")
    parts = corpus.build_corpus(table(s, d, "part"), ["p_name"], "p_partkey")
    words = parts.select(F.explode("tokens").alias("word")).distinct()
    words.select(F.concat("word", F.lit(" n 1 0 @ 00001740"))).union(s.createDataFrame([("  1 a line of the licence",)], "value string")).write.text(nouns)
    words.where("word LIKE '%e%'").select(F.concat("word", F.lit("zz "), "word", F.lit(" zz"))).write.text(odd)
    plural = F.transform("tokens", lambda t: F.concat(t, F.when(t.contains("e"), "zz").otherwise("s")))
    lemmas = corpus.lemma_table(parts.select(F.explode(plural).alias("word")), lexicon.load_lexicon(s, nouns), lexicon.load_exceptions(s, odd))
    return corpus.lemmatize(parts.withColumn("tokens", plural), lemmas).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@query("output_names", "SELECT c_custkey, concat_ws('_', lower(c_mktsegment), CASE WHEN c_custkey % 3 > 0 THEN 'vocab' END, CASE WHEN c_custkey % 2 = 0 THEN 'multtfcdf' ELSE 'tfidf' END, CASE WHEN c_nationkey > 9 THEN 'embed' END, c_nationkey) || '.csv' AS name FROM customer")
def output_names(s, d):
    key = F.col("c_custkey")
    name = files.output_names(F.lower("c_mktsegment"), F.when(key % 3 > 0, "vocab").otherwise(""), key % 2 == 0, F.col("c_nationkey") > 9, F.col("c_nationkey"))
    return table(s, d, "customer").select("c_custkey", name.alias("name"))


@query(
    "frames_in_memory",
    "SELECT k, x::DOUBLE AS score_1, y::DOUBLE AS score_2, z::DOUBLE AS score_3 FROM (SELECT n_name AS k, n_nationkey AS x FROM nation WHERE n_regionkey < 3) FULL JOIN (SELECT n_name AS k, n_regionkey AS y FROM nation WHERE n_regionkey > 1) USING (k) FULL JOIN (SELECT n_name AS k, n_nationkey / 2 AS z FROM nation WHERE n_nationkey % 2 = 0) USING (k)",
)
def frames_in_memory(s, d):
    """Frames made from rows that the caller holds: those of the 25 nations."""
    held = table(s, d, "nation").collect()
    rows = [[(r["n_name"], float(r["n_nationkey"])) for r in held if r["n_regionkey"] < 3], [(r["n_name"], float(r["n_regionkey"])) for r in held if r["n_regionkey"] > 1], [(r["n_name"], r["n_nationkey"] / 2) for r in held if r["n_nationkey"] % 2 == 0]]
    frames = [s.createDataFrame(r, "k string, score double") for r in rows]
    return joins.merge_scores({str(i): f for i, f in enumerate(frames, 1)}, ["k"])


# Columns and rows ----------------------------------------------------------------------------------------------------


@query("drop_columns", "SELECT c_custkey, c_acctbal, c_nationkey FROM customer")
def drop_columns(s, d):
    return profile.drop_matching(table(s, d, "customer"), "^c_(name|mkt)")


@query("matching_columns", "SELECT p_partkey, p_size, p_type FROM part")
def matching_columns(s, d):
    p = table(s, d, "part")
    return p.select("p_partkey", *profile.matching_columns(p, "_(size|type)$"))


@query("renamed_columns", "SELECT n_nationkey AS nation_nationkey, n_name AS nation_name, n_regionkey AS nation_regionkey FROM nation")
def renamed_columns(s, d):
    return profile.rename_matching(table(s, d, "nation"), "^n_(.+)$", r"nation_\1").select("nation_nationkey", "nation_name", "nation_regionkey")


@query("replaced_names", r"SELECT c_custkey, regexp_replace(c_name, '([A-Za-z]+)#0*([0-9]+)', 'c|\2', 'g') AS short, nullif(regexp_extract(c_name, '#0*([0-9]+)$', 1), '') AS number FROM customer")
def replaced_names(s, d):
    name = F.col("c_name")
    return table(s, d, "customer").select("c_custkey", text.replaced(name, "([A-Za-z]+)#0*([0-9]+)", "c|$2").alias("short"), text.extracted(name, "#0*([0-9]+)$").alias("number"))


@query("fill_nulls", "SELECT doc_id, coalesce(lang, '') AS lang, coalesce(quality, 0) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def fill_nulls(s, d):
    x = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").select("doc_id", "lang", "quality")
    return profile.filled(profile.filled(x, ["lang"], ""), ["quality"])


@query("row_count_guard", f"WITH {sql.tokens(sql.DOCS)} SELECT doc_id, len(tokens)::INT AS n FROM toks")
def row_count_guard(s, d):
    source = table(s, d, "documents")
    return corpus.assert_row_count(corpus.build_corpus(source, ["text"], "doc_id"), source).select("doc_id", F.size("tokens").alias("n"))


@query("flatten_corpora", f"WITH {sql.tokens('SELECT 0 AS corpus_id, p_partkey AS doc_id, p_name AS text FROM part UNION ALL SELECT 1, s_suppkey, s_name FROM supplier')} SELECT doc_id, array_to_string(tokens, ' ') AS tokens FROM toks")
def flatten_corpora(s, d):
    parts = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    suppliers = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("text"))
    return corpus.all_docs(corpus.build_corpora([parts, suppliers], ["text"], "id")).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@query("stated_candidates", f"WITH {sql.UNIT} SELECT r.vec_id AS reference_id, p.vec_id AS paired_id, round(list_dot_product(r.v, p.v), 6) AS score FROM u r, u p WHERE r.vec_id % 50 = 0 AND p.label = 1")
def stated_candidates(s, d):
    """Candidates are a stated set, each of which must be known."""
    v = unit_vectors(s, d)
    calc = scoring.VariableSimilarityCalculator(v.where("doc_id % 50 = 0"), scoring.always)
    return scored(calc.score_variables(v, v.where("label = 1").select("doc_id"), strict=True, dense=True))


@query("inner_join_different_keys", "SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def inner_join_different_keys(s, d):
    return joins.join_different(table(s, d, "supplier"), table(s, d, "nation"), {"s_nationkey": "n_nationkey"}, "inner").select("s_suppkey", "s_name", "n_name")


@query("arranged", "SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id)::INT AS place FROM documents")
def arranged(s, d):
    return ranking.row_numbers(table(s, d, "documents"), ["lang"], [F.desc("n_chars"), "doc_id"], "place").select("doc_id", "lang", "place")


@query("sorted_places", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders")
def sorted_places(s, d):
    return ranking.numbered_rows(table(s, d, "orders").select("o_orderkey"), "o_orderkey", "place")


@query(
    "bound_columns",
    "WITH a AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS i FROM customer), b AS (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier) SELECT c_custkey, c_name, s_suppkey, s_name FROM a FULL JOIN b USING (i)",
)
def bound_columns(s, d):
    a, b = table(s, d, "customer").select("c_custkey", "c_name"), table(s, d, "supplier").select("s_suppkey", "s_name")
    return joins.bind_columns(a, b, "c_custkey", "s_suppkey")
