"""Noun lexica: plain word lists, and the public dictionary files `index.noun` and `noun.exc`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(word) of a file with one entry a line: its first field, `_` standing for a space. Lines that start with a space, as
    the licence at the head of `index.noun` does, are left out. The result is what `corpus.lemmatize` takes as a lexicon."""
    lines = spark.read.text(path).where((F.col("value") != "") & ~F.col("value").startswith(" "))
    return lines.select(F.lower(F.translate(F.substring_index("value", " ", 1), "_", " ")).alias("word")).distinct()


def load_exceptions(spark: SparkSession, path: str) -> DataFrame:
    """(word, lemma) of a file of irregular forms, "form lemma [lemma ...]" a line; the first lemma counts, and of several
    lines with one form the smallest lemma."""
    parts = spark.read.text(path).select(F.split(F.lower(F.trim("value")), " +").alias("p")).where(F.size("p") > 1)
    clean = parts.select(*[F.translate(F.col("p")[i], "_", " ").alias(n) for i, n in enumerate(("word", "lemma"))])
    return clean.groupBy("word").agg(F.min("lemma").alias("lemma"))
