"""Word and document vectors, group centroids, cohesion, top words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.stats import norm


def unit(vec: Column) -> Column:
    """A vector scaled to length one in double; null if its length is zero. The length is bound once, not taken for each element."""
    scaled = lambda n: F.when(n > 0, F.transform(vec, lambda x: x.cast("double") / n))
    return F.get(F.transform(F.array(norm(vec)), scaled), F.lit(0))


def normalize_doc_vectors(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """Rows with a vector of length one; zero vectors go with their ids."""
    return vectors.where(norm(F.col(vec)) > 0).withColumn(vec, unit(F.col(vec)))


def calc_doc_embeddings(weights: DataFrame, word_vectors: DataFrame, key: tuple[str, ...] = ("corpus_id", "doc_id")) -> DataFrame:
    """Unit document vectors: the weighted sum of the unit vectors of a document's terms; unknown words count as zero.

    Sums are taken per dimension, with map-side combination, and put back into arrays.
    """
    unit_words = normalize_doc_vectors(word_vectors).select("word", "vec")
    parts = weights.join(unit_words, weights["term"] == unit_words["word"]).select(*key, "weight", F.posexplode("vec").alias("dim", "x"))
    sums = parts.groupBy(*key, "dim").agg(F.sum(F.col("weight") * F.col("x")).alias("x"))
    rows = sums.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias("vec"))
    return normalize_doc_vectors(rows)


def centroids(weights: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, term, weight): the mean of the members' vectors, not scaled. Terms a member lacks count as 0, so sums are
    divided by the number of members. `groups`: (grp, doc_id)."""
    members = groups.select("grp", "doc_id").distinct()
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    sums = weights.join(members, "doc_id").groupBy("grp", "term").agg(F.sum("weight").alias("w"))
    return sums.join(sizes, "grp").select("grp", "term", (F.col("w") / F.col("n")).alias("weight"))


def dense_centroids(vectors: DataFrame, group: str, vec: str = "vec") -> DataFrame:
    """(group, vec): element-wise mean of a group's vectors."""
    dims = vectors.select(group, F.posexplode(vec).alias("dim", "x")).groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return dims.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias(vec))


def as_documents(centroid: DataFrame, corpus: Column | None = None) -> DataFrame:
    """Centroids as weights of pseudo-documents named by their group."""
    return centroid.select((F.lit(None).cast("string") if corpus is None else corpus).alias("corpus_id"), F.col("grp").cast("string").alias("doc_id"), "term", "weight")


def append_documents(weights: DataFrame, more: DataFrame) -> DataFrame:
    return weights.unionByName(more)


def top_words(weights: DataFrame, n: int, key: tuple[str, ...] = ("grp",), places: int = 10) -> DataFrame:
    """The n largest positive weights of each key with their rank; ties by term."""
    w = Window.partitionBy(*key).orderBy(F.round("weight", places).desc(), "term")
    return weights.where("weight > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(*key, "term", "weight", "rank")


def group_cohesion(weights: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, n, cohesion): mean dot product over a group's pairs; null for a single member.

    Uses |sum of members|^2 = sum of squares + twice the sum over pairs, so no pairs are formed.
    """
    members = groups.select("grp", "doc_id").distinct()
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    mine = weights.join(members, "doc_id")
    whole = mine.groupBy("grp", "term").agg(F.sum("weight").alias("s"), F.sum(F.col("weight") * F.col("weight")).alias("q"))
    twice = whole.groupBy("grp").agg(F.sum(F.col("s") * F.col("s") - F.col("q")).alias("t"))
    pairs = F.col("n") * (F.col("n") - 1)
    return sizes.join(twice, "grp", "left").select("grp", "n", F.when(F.col("n") > 1, F.coalesce("t", F.lit(0.0)) / pairs).alias("cohesion"))


def dense_cohesion(vectors: DataFrame, group: str, vec: str = "vec") -> DataFrame:
    """As group_cohesion, for arrays."""
    long = vectors.select(F.col(group).alias("grp"), F.posexplode(vec).alias("dim", "x"))
    sums = long.groupBy("grp", "dim").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count(F.lit(1)).alias("n"))
    out = sums.groupBy("grp").agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s") - F.col("q")).alias("t"))
    return out.select("grp", "n", F.when(F.col("n") > 1, F.col("t") / (F.col("n") * (F.col("n") - 1))).alias("cohesion"))
