"""Library pipelines: text similarity of documentation, concept vectors, evaluation, distribution similarity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.predicates import Predicate, default_pairable
from matchloom.operators import combine, corpus, distribution, evaluation, joins, ranking, tfidf, vectors
from matchloom.operators.scoring import VariableSimilarityCalculator, all_scores
from matchloom.sources.files import write_scores


def doc_similarity(data: DataFrame, ref_ids: DataFrame, *, doc_cols: list[str], id_col: str, corpora_col: str | None = None, pairable: Predicate = default_pairable, select_scores=all_scores, attributes: DataFrame | None = None, word_vectors: DataFrame | None = None, pair_ids: DataFrame | None = None, lemmatise: bool = True, null_token: str = "nan", path: str | None = None) -> DataFrame:
    """Scores of documented variables against references; with word vectors, of their document embeddings."""
    docs = corpus.build_corpora(data, doc_cols, id_col, by=corpora_col, null_token=null_token) if corpora_col else corpus.build_corpus(data, doc_cols, id_col, null_token=null_token)
    if lemmatise:
        docs = corpus.lemmatize(docs)
    _, weights = tfidf.calc_tfidf(docs)
    matrix = vectors.calc_doc_embeddings(weights, word_vectors) if word_vectors is not None else weights
    calc = VariableSimilarityCalculator(ref_ids, pairable, select_scores, attributes=attributes)
    out = calc.score_variables(matrix, pair_ids, dense=word_vectors is not None)
    if path:
        write_scores(out, path)
    return out


def calc_scores_doc_cols(data: DataFrame, ref_ids: DataFrame, doc_cols: dict[str, list[str]], id_col: str, **kw) -> DataFrame:
    """One score column for each named set of documentation columns, merged by full joins."""
    return joins.merge_scores({k: doc_similarity(data, ref_ids, doc_cols=cols, id_col=id_col, **kw) for k, cols in doc_cols.items()})


def concept_vectors(data: DataFrame, groups: DataFrame, *, doc_cols: list[str], id_col: str, n: int = 5, corpora_col: str | None = None, pair_ids: DataFrame | None = None, lemmatise: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(top words, concept x candidate scores, cohesion) of groups (grp, doc_id) of variables."""
    docs = corpus.build_corpora(data, doc_cols, id_col, by=corpora_col) if corpora_col else corpus.build_corpus(data, doc_cols, id_col)
    if lemmatise:
        docs = corpus.lemmatize(docs)
    _, weights = tfidf.calc_tfidf(docs)
    center = vectors.centroids(weights, groups)
    pseudo = vectors.as_documents(center)
    everything = vectors.append_documents(weights.select(F.col("corpus_id").cast("string").alias("corpus_id"), F.col("doc_id").cast("string").alias("doc_id"), "term", "weight"), pseudo)
    candidates = pair_ids if pair_ids is not None else docs.select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
    scores = VariableSimilarityCalculator(groups.select(F.col("grp").cast("string").alias("doc_id")).distinct()).score_variables(everything, candidates)
    return vectors.top_words(center, n), scores, vectors.group_cohesion(weights, groups)


def evaluate_scores(scores: DataFrame, *, score_cols: Sequence[str], ref: str, paired: str, class_col: str, group: str, paired_group: str, cutoffs: Sequence[int] = evaluation.CUTOFFS, multiple_correction: bool = True, combine_cols: dict[str, list[str]] | None = None) -> DataFrame:
    """Combination, pairable pairs, truth, ranks, and the stacked accuracy reports of all scores."""
    if combine_cols:
        scores = combine.calc_combined_scores(scores, combine_cols)
        score_cols = [*score_cols, *combine_cols]
    pairs = ranking.extract_pairable_pairs(scores, ref, paired, group, paired_group, class_col)
    truth = evaluation.assign_true_pairing(pairs, ref, paired, [class_col])
    ranked = ranking.calc_ranks_all_scores(truth, list(score_cols), ref, paired_group if multiple_correction else None, filter_ranks=False)
    reports = {s: evaluation.calc_accuracy(ranked, ref, class_col, f"{s}_rank", group=group, paired_group=paired_group, multiple_correction=multiple_correction, cutoffs=cutoffs) for s in score_cols}
    return evaluation.combine_accuracy_results(reports)


def distribution_similarity(pair_data: DataFrame, ref_data: DataFrame, *, stats_1: str, stats_2: str, condition: Column, by: list[str]) -> DataFrame:
    """Relative and min-max scaled Euclidean similarity of candidates to a stated reference set."""
    pairs = distribution.distribution_scores(distribution.calc_pairings_data(pair_data, ref_data, condition), stats_1, stats_2)
    return distribution.scaled_similarity(pairs, "euclidean", by, "euclidean_scaled")
