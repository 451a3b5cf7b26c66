"""Combined scores and ratios to the top score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.stats import overall_similarity


def coalesce_scores(data: DataFrame, new: dict[str, tuple[str, str]]) -> DataFrame:
    """New columns from the first value that is known of a pair of columns."""
    return data.withColumns({name: F.coalesce(*cols) for name, cols in new.items()})


def calc_combined_scores(data: DataFrame, combine: dict[str, list[str]], replace_na: dict[str, tuple[str, str]] | None = None, variant: str = "coded", path: str | None = None) -> DataFrame:
    """Coalesced columns, missing scores as 0, and one combined score for each named list of score columns."""
    out = coalesce_scores(data, replace_na) if replace_na else data
    used = sorted({c for cols in combine.values() for c in cols})
    out = out.fillna(0, subset=used)
    out = out.withColumns({name: overall_similarity(*[F.col(c) for c in cols], variant=variant) for name, cols in combine.items()})
    if path:
        from matchloom.sources.files import write_csv

        write_csv(out, path)
    return out


def top_scores_ratio(data: DataFrame, score: str, rank: str, by: list[str]) -> DataFrame:
    """Score at rank 1 divided by the score at rank 2 in each group; null without both."""
    at = lambda k: F.max(F.when(F.col(rank) == k, F.col(score)))
    return data.groupBy(*by).agg(F.try_divide(at(1), at(2)).alias("ratio"))


def percent_of_top(data: DataFrame, score: str, rank: str, by: list[str], name: str = "percent") -> DataFrame:
    """Each score divided by its group's score at rank 1."""
    top = F.max(F.when(F.col(rank) == 1, F.col(score))).over(Window.partitionBy(*by))
    return data.withColumn(name, F.try_divide(F.col(score), top))
