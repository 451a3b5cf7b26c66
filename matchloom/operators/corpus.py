"""Documents and corpora: (corpus_id, doc_id, tokens)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions.lexicon import NOUN_EXCEPTIONS, NOUNS, STOP_WORDS
from matchloom.functions.text import clean_tokens, doc_text, lemma_candidates


def spread_out(data: DataFrame) -> DataFrame:
    """Rows read from fewer splits than there are cores are dealt to all of them, since tokenising costs far more than moving so
    little. Anything that a shuffle made is left alone."""
    if data.isStreaming:
        return data
    plan = data._jdf.queryExecution().executedPlan()
    if plan.nodeName().startswith("Adaptive"):
        return data
    cores = data.sparkSession.sparkContext.defaultParallelism
    return data.repartition(cores) if plan.execute().getNumPartitions() < cores else data


def build_corpus(data: DataFrame, doc_cols: list[str], id_col: str, stop_words: Iterable[str] = STOP_WORDS, null_token: str = "nan", corpus: Column | None = None) -> DataFrame:
    """(corpus_id, doc_id, tokens) of every row: a map, without a shuffle unless the rows come from a few splits."""
    data = spread_out(data.select(*dict.fromkeys([*doc_cols, id_col]), *([] if corpus is None else [corpus.alias("_corpus")])))
    corpus = None if corpus is None else F.col("_corpus")
    tokens = clean_tokens(doc_text(doc_cols, null_token), stop_words)
    return data.select((F.lit(0) if corpus is None else corpus).alias("corpus_id"), F.col(id_col).alias("doc_id"), tokens.alias("tokens"))


def build_corpora(data: DataFrame | list[DataFrame], doc_cols: list[str], id_col: str, by: str | None = None, **kw) -> DataFrame:
    """One corpus per frame of a list, or per value of `by` (rows with a null value are left out)."""
    if isinstance(data, list):
        out = [build_corpus(d, doc_cols, id_col, corpus=F.lit(i), **kw) for i, d in enumerate(data)]
        first = out[0]
        for d in out[1:]:
            first = first.unionByName(d)
        return first
    return build_corpus(partition(data, by), doc_cols, id_col, corpus=F.col(by), **kw)


def partition(data: DataFrame, by: str) -> DataFrame:
    """Rows that belong to a partition; the partition stays a column."""
    return data.where(F.col(by).isNotNull())


def all_docs(corpora: DataFrame) -> DataFrame:
    return corpora.select("doc_id", "tokens")


def noun_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in NOUNS], "word string")


def noun_exceptions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NOUN_EXCEPTIONS.items()), "word string, lemma string")


def lemma_table(words: DataFrame, lexicon: DataFrame | None = None, exceptions: DataFrame | None = None) -> DataFrame:
    """(word, lemma) of the distinct words whose lemma differs: an exception, or the shortest of the word and the rules' forms
    that the lexicon has; of equally short ones the word itself, then the first rule's form.
    """
    spark = words.sparkSession
    lexicon = (noun_lexicon(spark) if lexicon is None else lexicon).select(F.col("word").alias("known")).distinct()
    exceptions = noun_exceptions(spark) if exceptions is None else exceptions
    distinct = words.select("word").distinct()
    forms = distinct.select("word", F.posexplode(lemma_candidates(F.col("word"))).alias("pos", "form"))
    order = F.struct(F.length("form"), (F.col("form") != F.col("word")).cast("int"), "pos")
    found = forms.join(lexicon, forms["form"] == lexicon["known"]).groupBy("word").agg(F.min_by("form", order).alias("rule"))
    out = distinct.join(exceptions, "word", "left").join(found, "word", "left")
    return out.select("word", F.coalesce("lemma", "rule").alias("lemma")).where("lemma IS NOT NULL AND lemma <> word")


def lemmatize(corpora: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """Corpora with nouns replaced by their lemmas; order and repeats of tokens stay."""
    words = corpora.select("corpus_id", "doc_id", F.posexplode_outer("tokens").alias("pos", "word"))
    lemmas = lemma_table(words) if lemmas is None else lemmas
    joined = words.join(lemmas, "word", "left").withColumn("word", F.coalesce("lemma", "word"))
    pairs = F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "word"))))
    return joined.groupBy("corpus_id", "doc_id").agg(F.transform(pairs, lambda x: x["word"]).alias("tokens"))


def lemmatize_variable_documentation(texts: list[str], spark: SparkSession) -> list[str]:
    """Tokens of one document given as a list of texts."""
    df = spark.createDataFrame([(0, " ".join(texts))], "id int, text string")
    return lemmatize(build_corpus(df, ["text"], "id")).first()["tokens"]


def assert_row_count(processed: DataFrame, source: DataFrame) -> DataFrame:
    """`processed`, after checking that no row was lost."""
    a, b = processed.count(), source.count()
    if a != b:
        raise ValueError(f"{a} of {b} rows ({100 * a / max(b, 1):.1f} %) were processed")
    return processed
