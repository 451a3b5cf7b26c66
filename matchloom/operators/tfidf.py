"""TF-IDF over one or several corpora in long form (corpus_id, doc_id, term, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tokens_long(corpora: DataFrame) -> DataFrame:
    return corpora.select("corpus_id", "doc_id", F.explode("tokens").alias("term"))


def vocabulary(corpora: DataFrame) -> DataFrame:
    """Distinct terms of all corpora."""
    return tokens_long(corpora).select("term").distinct()


def term_counts(corpora: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    """(corpus_id, doc_id, term, tf); terms outside a given vocabulary are left out."""
    terms = tokens_long(corpora)
    if vocab is not None:
        terms = terms.join(vocab.select("term"), "term", "left_semi")
    return terms.groupBy("corpus_id", "doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(counts: DataFrame) -> DataFrame:
    """(corpus_id, term, df). Counting by `tf` keeps that column, so a plan that also weighs the counts shares their shuffle."""
    return counts.groupBy("corpus_id", "term").agg(F.count_if(F.col("tf") > 0).alias("df"))


def idf(corpora: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(term, idf) with idf = ln(M / sum over corpora of (df + 1) / (N + 1)) + 1.

    Corpora without a term add 1 / (N + 1) each; their sum over all corpora is one number, so only the corpora that hold
    a term are joined, never corpora x terms.
    """
    counts = term_counts(corpora) if counts is None else counts
    sizes = corpora.groupBy("corpus_id").agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.agg(F.count(F.lit(1)).alias("m"), F.sum(1 / (F.col("n") + 1)).alias("k"))
    shares = document_frequency(counts).join(sizes, "corpus_id").groupBy("term").agg(F.sum(F.col("df") / (F.col("n") + 1)).alias("share"))
    return shares.crossJoin(whole).select("term", (F.ln(F.col("m") / (F.col("k") + F.col("share"))) + 1).alias("idf"))  # `whole` is one row


class CorporaTfidfVectorizer:
    """Inverse document frequencies of corpora, and weights of documents by them."""

    def __init__(self, vocab: DataFrame | None = None) -> None:
        self.vocab, self.idf = vocab, None

    def fit(self, corpora: DataFrame, counts: DataFrame | None = None) -> CorporaTfidfVectorizer:
        self.idf = idf(corpora, term_counts(corpora, self.vocab) if counts is None else counts)
        return self

    def transform(self, corpora: DataFrame, counts: DataFrame | None = None) -> DataFrame:
        """(corpus_id, doc_id, term, weight): raw counts by idf, rows scaled to length one. Unknown terms are left out."""
        counts = term_counts(corpora, self.vocab) if counts is None else counts
        raw = counts.join(self.idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
        length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("corpus_id", "doc_id")))
        return raw.select("corpus_id", "doc_id", "term", (F.col("w") / length).alias("weight"))


def calc_tfidf(corpora: DataFrame, vocab: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, weights), from one table of term counts."""
    counts = term_counts(corpora, vocab)
    v = CorporaTfidfVectorizer(vocab).fit(corpora, counts)
    return v.idf.select("term"), v.transform(corpora, counts)
