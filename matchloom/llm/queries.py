"""The queries opN_<name> and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import decontam, itemsets, langid, linededup, merkle, ngramjoin, pieces, pii, quality, secretscan, sharding, sql, suffixdedup, tokencount
from matchloom.llm._spark import drop, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document on the bounded-load ring."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its host, lines, dropped boilerplate lines and a digest of the text that stays."""
    pages = table(spark, sf_dir, "pages").select("page_id", linededup.url_host(F.col("url")).alias("host"), linededup.visible_text(F.col("html")).alias("text"))
    kept = written(pages)
    out = linededup.dedup_lines(kept, "host", "text", stats=True)
    result = written(out.select("page_id", "host", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5")))
    drop(kept)
    return result


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality statistics and verdict of every document."""
    out = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("rules_failed").cast("int").alias("rules_failed"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.find(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secretscan.scan(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with their alignment scores."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether decoding them gives the text back."""
    return pieces.encode(table(spark, sf_dir, "documents"), ["doc_id"])


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    return ngramjoin.link(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without repeated 200-byte strings."""
    return suffixdedup.dedup(table(spark, sf_dir, "documents"))


def op11_closed_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed frequent itemsets of the sales, each with its rules."""
    return itemsets.rule_digest(itemsets.itemsets(table(spark, sf_dir, "sale_lines"), "sale_id", "item_id"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether it still verifies after tampering."""
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and how many characters fit into the limit."""
    import public_tokenizers

    path = spark.conf.get("spark.matchloom.byte_tokenizer", None) or public_tokenizers.path(tokencount.FILE)
    return tokencount.counted(table(spark, sf_dir, "documents"), ["doc_id"], path)


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_sentencepiece, op3_suffix_dedup, op4_line_dedup, op5_language_id, op6_ring_shards, op7_pii, op8_quality_rules, op9_decontaminate, op10_secret_scan, op11_closed_itemsets, op12_merkle_manifest, op13_token_counts)}
ORACLES = {k: v for k, v in sql.ORACLES.items() if k in QUERIES}
