"""Corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next one.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of documents. Columns are
renamed by position inside a stage, so extra columns pass through whatever their names. Rows are told apart by doc_id
and a hash of the text, so null and repeated ids are no problem. A stage's table is deleted when the next one is written; the
last one stays in the shared folder.

Defined results: rows with a null text or one without a letter leave at the first stage; a text may be very long anywhere, each
stage reads it whole; of a group of copies or near copies with equal ids one row stays; an empty table passes through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import decontam, langid, linededup, ngramjoin, pieces
from matchloom.llm._spark import cut, drop, numbered, written

#: Share of a source's distinct texts above which, beyond doubt, a line is boilerplate; repeated lines of the test tables stand in 9 % to 30 % of each source.
LINE_RATIO = 0.05


def renamed(df: DataFrame, like: DataFrame) -> DataFrame:
    """The numbered columns of `df` under the names of `like`."""
    return df.select(*[F.col(f"column_{i}").alias(n) for i, n in enumerate(like.columns)])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose two nearest languages are too close to tell."""
    own, (doc_id, text, lang) = numbered(docs, "doc_id", "text", "lang")
    known = own.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    model = langid.train(known.where(~langid.held_out(F.col("doc_id"))))
    judged = langid.predict(own, model, own.columns, text=text)
    return renamed(judged.where("lang_pred <> 'und' AND NOT ambiguous"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that stand in too many documents of their source out of the texts; n_chars follows."""
    out = linededup.dedup_lines(docs, "source", "text", LINE_RATIO)
    own, (text, n_chars) = numbered(out, "text", "n_chars")
    kind = dict(own.dtypes)[n_chars]
    return renamed(own.withColumn(n_chars, F.coalesce(F.length(text).cast(kind), F.col(n_chars))), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group, the one with the smallest doc_id (a null id comes first)."""
    own, (doc_id, text) = numbered(docs, "doc_id", "text")
    own = own.withColumn("h", F.xxhash64(F.col(text)))
    linked = ngramjoin.link(own.select(F.col("h").alias("doc_id"), F.col(text).alias("text"))).select(F.col("doc_id").alias("h"), "n_shingles", "component_id").distinct()
    ids = own.groupBy(F.col(doc_id).alias("id"), "h").agg(F.count(F.lit(1)).alias("copies")).join(linked, "h")
    first = ids.where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct("id", "h", "copies")).alias("x")).select("x.*")
    alone = ids.where("n_shingles = 0").select("id", "h", F.lit(1).cast("long").alias("copies"))
    keep = cut(first.unionByName(alone))

    def chosen(part: DataFrame) -> DataFrame:
        return own.join(part, own[doc_id].eqNullSafe(part["id"]) & (own["h"] == part["h"]), "left_semi")

    out, repeated = chosen(keep.where("copies = 1")), keep.where("copies > 1")
    if not repeated.isEmpty():  # rows with an id and a text that stand there several times
        out = out.unionByName(chosen(repeated).dropDuplicates([doc_id, "h"]))
    return renamed(out, docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, copied or edited."""
    own, (text,) = numbered(docs, "text")
    own = own.withColumn("h", F.xxhash64(F.col(text)))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontam.contaminated(own.select(F.col("h").alias("doc_id"), F.col(text).alias("text")), items)
    return renamed(own.join(found.select(F.col("doc_id").alias("h")).distinct(), "h", "left_anti"), docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, round_trip of every document that is left."""
    slim = docs.select("doc_id", "text", "lang", "source")
    return pieces.encode(slim, ["doc_id", "lang", "source"])


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("n-gram Jaccard join", near_dedup), ("benchmark decontamination", decontaminate), ("SentencePiece", tokenize)]

#: Language models, similarity links and alignments are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
        if last is not None:
            drop(last)
        last = docs
    return docs
