"""Ontology files: concepts, domains, descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.sources.files import read_tsv

CONCEPT = "concept_id long, concept_name string, domain_id string, vocabulary_id string, concept_class_id string, standard_concept string, concept_code string, valid_start_date string, valid_end_date string, invalid_reason string"
DOMAIN = "domain_id string, domain_name string, domain_concept_id long"
DESCRIPTION = "id long, effectiveTime string, active string, moduleId long, conceptId long, languageCode string, typeId long, term string, caseSignificanceId long"
SYNONYM = 900000000000013009  # fixed value: the type id of synonyms in description files


def load_concepts(spark: SparkSession, folder: str) -> DataFrame:
    """Concepts with their domain names."""
    concepts, domains = read_tsv(spark, f"{folder}/CONCEPT.csv", CONCEPT), read_tsv(spark, f"{folder}/DOMAIN.csv", DOMAIN)
    return concepts.join(domains, "domain_id", "left")


def load_descriptions(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, DESCRIPTION).where("active = '1'")


def concept_lookup(descriptions: DataFrame, terms: DataFrame) -> DataFrame:
    """Concept ids of exact terms (terms: term)."""
    return descriptions.select("conceptId", "term").join(terms.select("term"), "term")


def description(descriptions: DataFrame, ids: DataFrame, include_synonyms: bool = False) -> DataFrame:
    """Terms of concepts (ids: conceptId); unknown ids have none."""
    rows = descriptions if include_synonyms else descriptions.where(F.col("typeId") != SYNONYM)
    return ids.select("conceptId").join(rows.select("conceptId", "term"), "conceptId", "left")


def valid_descriptions(descriptions: DataFrame, ids: DataFrame) -> DataFrame:
    """As description, without unknown ids."""
    return description(descriptions, ids, True).where("term IS NOT NULL")


def first_concepts(concepts: DataFrame, n: int = 3, key: str = "concept_id") -> DataFrame:
    """n distinct concepts in id order."""
    return concepts.dropDuplicates([key]).orderBy(key).limit(n)


def term_by_id(spark: SparkSession, table: str, concept_id: int) -> DataFrame:
    """The term of one concept, by a parameterised statement."""
    return spark.sql(f"SELECT term FROM {table} WHERE conceptId = ?", args=[concept_id])


def as_dictionary(concepts: DataFrame, study: str = "SNOMED") -> DataFrame:
    """Concepts under the names of a variable dictionary."""
    return concepts.select(F.col("concept_id").cast("string").alias("variable_id"), F.col("concept_name").alias("variable_description"), F.col("domain_id").alias("dbGaP_dataset_label"), F.lit(study).alias("dbGaP_study_id"))
