"""Evaluation of ranked pairings against a known mapping: top-k precision, recall and F1.

"set" counts the variables of one partner data set once, "var" counts each variable. All counts are two-level
aggregations; distinct flags are taken per reference, so no window with DISTINCT is needed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.stats import f1, precision, recall

CUTOFFS = (1, 5, 10)


def assign_true_pairing(data: DataFrame, ref: str, paired: str, class_cols: Sequence[str], name: str = "true_pairing") -> DataFrame:
    """Flags pairs whose partner is itself a reference of the same class."""
    members = data.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(class_cols)], F.col(ref).alias("_ref")).distinct()
    cond = reduce(lambda a, b: a & b, [data[c].eqNullSafe(members[f"_c{i}"]) for i, c in enumerate(class_cols)], data[paired] == members["_ref"])
    joined = data.join(members, cond, "left")
    return joined.select(*[data[c] for c in data.columns if c != name], F.col("_ref").isNotNull().alias(name))


def summarize_actual_pairings(data: DataFrame, ref: str, class_col: str, group: str | None = None, multiple_correction: bool = False) -> DataFrame:
    """Per reference: actual_pairings, and of its class n_<ref>, n_<group>, n_actual_pairings."""
    if multiple_correction and not group:
        raise ValueError("the correction for multiple variables needs the group column")
    keys = [class_col, ref] + ([group] if group else [])
    refs = data.select(*keys).distinct()
    if not group:
        per_class = refs.groupBy(class_col).agg(F.count(F.lit(1)).alias(f"n_{ref}"))
        out = refs.join(per_class, class_col).withColumn("actual_pairings", F.col(f"n_{ref}") - 1)
        return out.withColumn("n_actual_pairings", F.col(f"n_{ref}") * (F.col(f"n_{ref}") - 1))
    in_group = refs.groupBy(class_col, group).agg(F.count(F.lit(1)).alias("_in"))
    per_class = in_group.groupBy(class_col).agg(F.sum("_in").alias(f"n_{ref}"), F.count(F.lit(1)).alias(f"n_{group}"), F.sum(F.col("_in") * (F.col("_in") - 1)).alias("_same"))
    out = refs.join(in_group, [class_col, group]).join(per_class, class_col)
    if multiple_correction:
        out = out.withColumns({"actual_pairings": F.col(f"n_{group}") - 1, "n_actual_pairings": F.col(f"n_{ref}") * (F.col(f"n_{group}") - 1)})
    else:
        out = out.withColumns({"actual_pairings": F.col(f"n_{ref}") - F.col("_in"), "n_actual_pairings": F.col(f"n_{ref}") * (F.col(f"n_{ref}") - 1) - F.col("_same")})
    return out.select(*keys, f"n_{ref}", f"n_{group}", "actual_pairings", "n_actual_pairings")


def summarize_predictions(data: DataFrame, ref_cols: Sequence[str], true_pairing: str, rank: str, cutoffs: Sequence[int] = CUTOFFS, multiple_correction: bool = False, paired_group: str | None = None, class_col: str | None = None, counts: tuple[str, str, str] | None = None) -> DataFrame:
    """Per reference: <rank>_pairs, top<k>_pred, top<k>_true_pred; with `class_col` also the class sums n_*. `counts`: columns of the
    numbers of pairs, true pairs and ranked pairs, for rows that stand for several pairs (`cells.top_values`)."""
    if multiple_correction and not paired_group:
        raise ValueError("the correction for multiple variables needs the partner's group column")
    keys = list(dict.fromkeys([*ref_cols, *([class_col] if class_col else [])]))
    pairs, true, met = counts or (None, None, None)
    aggs = [(F.sum(met) if counts else F.count(rank)).alias(f"{rank}_pairs")]
    flagged = F.col(true) > 0 if counts else F.coalesce(F.col(true_pairing), F.lit(False))
    for k in cutoffs:
        top = F.coalesce(F.col(rank) <= k, F.lit(False))
        for name, flag, n in ((f"top{k}_pred", top, pairs), (f"top{k}_true_pred", top & flagged, true)):
            number = F.sum(F.when(flag, F.col(n)).otherwise(F.lit(0))) if counts else F.count_if(flag)
            aggs.append((F.count_distinct(F.when(flag, F.col(paired_group))) if multiple_correction else number).alias(name))
    out = data.groupBy(*keys).agg(*aggs)
    if class_col:
        names = [f"top{k}{t}_pred" for k in cutoffs for t in ("", "_true")]
        sums = out.groupBy(class_col).agg(*[F.sum(n).alias(f"n_{n}") for n in names], F.sum(f"{rank}_pairs").alias(f"n_{rank}_pairs"))
        out = out.join(sums, class_col)
    return out


def with_rates(data: DataFrame, cutoffs: Sequence[int] = CUTOFFS, prefixes: Sequence[str] = ("", "n_")) -> DataFrame:
    """Adds precision, recall and F1 of each cutoff, 0 where undefined."""
    new = {}
    for p in prefixes:
        actual = F.col(f"{p}actual_pairings")
        for k in cutoffs:
            true, pred = F.col(f"{p}top{k}_true_pred"), F.col(f"{p}top{k}_pred")
            new |= {f"{p}top{k}_precision": precision(true, pred), f"{p}top{k}_recall": recall(true, actual), f"{p}top{k}_F1": f1(true, pred, actual)}
    return data.withColumns(new)


def total_columns(ref: str, group: str | None, cutoffs: Sequence[int]) -> tuple[list[str], list[str]]:
    """Columns summed over references, and those that count once a class."""
    counts = [f"top{k}{t}_pred" for k in cutoffs for t in ("", "_true")] + ["actual_pairings"]
    return counts, [f"n_{c}" for c in counts] + [f"n_{ref}"] + ([f"n_{group}"] if group else [])


def total_label(class_col: str, classes: Column) -> Column:
    return F.concat(F.lit(f"All {class_col} (N = "), classes.cast("string"), F.lit(")"))


def class_totals(report: DataFrame, ref: str, class_col: str, group: str | None, cutoffs: Sequence[int] = CUTOFFS) -> DataFrame:
    """One row "All <class> (N = k)": sums over references, and over classes for n_*; classes are summed up first."""
    counts, once = total_columns(ref, group, cutoffs)
    classes = report.groupBy(class_col, *once).agg(*[F.sum(c).alias(c) for c in counts])
    return classes.agg(*[F.sum(c).alias(c) for c in [*counts, *once]], F.count(F.lit(1)).alias("_k")).withColumn(class_col, total_label(class_col, F.col("_k"))).drop("_k")


def with_totals(report: DataFrame, ref: str, class_col: str, group: str | None, cutoffs: Sequence[int] = CUTOFFS) -> DataFrame:
    """The report with the row of `class_totals`, in one pass: grouping sets of all columns and of none, over rows of which the first
    of each class is marked, so n_* are summed once a class."""
    counts, once = total_columns(ref, group, cutoffs)
    own = report.columns
    first = F.row_number().over(Window.partitionBy(class_col, *once).orderBy(*[c for c in (ref, group) if c])) == 1
    marked = report.withColumn("_first", first)
    sums = [F.sum(c).alias(f"_sum_{c}") for c in counts] + [F.sum(F.when(F.col("_first"), F.col(c))).alias(f"_sum_{c}") for c in once]
    both = marked.withColumn("_row", F.monotonically_increasing_id()).groupingSets([[*own, "_row"], []], *own, "_row").agg(F.grouping("_row").alias("_total"), *sums, F.count_if("_first").alias("_k"))
    total = F.col("_total") == 1
    new = {c: F.when(total, F.col(f"_sum_{c}")).otherwise(F.col(c)) for c in [*counts, *once]}
    new[class_col] = F.when(total, total_label(class_col, F.col("_k"))).otherwise(F.col(class_col).cast("string"))
    return both.select(*[(new[c] if c in new else F.col(c)).alias(c) for c in own])


def calc_accuracy(data: DataFrame, ref: str, class_col: str, rank: str, true_pairing: str = "true_pairing", group: str | None = None, paired_group: str | None = None, multiple_correction: bool = False, cutoffs: Sequence[int] = CUTOFFS, per_ref: bool = True, counts: tuple[str, str, str] | None = None) -> DataFrame:
    """Counts and rates per reference (or per class) with a row of totals. `counts`: see `summarize_predictions`."""
    ref_cols = [ref] + ([group] if group else [])
    predicted = summarize_predictions(data, ref_cols, true_pairing, rank, cutoffs, multiple_correction, paired_group, class_col, counts)
    actual = summarize_actual_pairings(data, ref, class_col, group, multiple_correction)
    report = predicted.join(actual, [class_col, *ref_cols]).drop(f"{rank}_pairs", f"n_{rank}_pairs")
    if per_ref:
        return with_rates(with_totals(report, ref, class_col, group, cutoffs), cutoffs)
    total = class_totals(report, ref, class_col, group, cutoffs)
    sums = [c for c in report.columns if c.startswith("n_")]
    return with_rates(report.select(class_col, *sums).distinct().unionByName(total.select(class_col, *sums)), cutoffs, ("n_",))


def combine_accuracy_results(reports: dict[str, DataFrame], totals_only: bool = False, totals_col: str | None = None, totals_regex: str = "^All ") -> DataFrame:
    """Reports one below the other with their names in `score`; with `totals_only` just the rows of totals."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("score", F.lit(name)) for name, df in reports.items()])
    return out.where(F.col(totals_col).rlike(totals_regex)) if totals_only else out


def calc_cols_differences(data: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Each later column minus the first: diff_<later>_<first>."""
    return data.withColumns({f"diff_{c}_{cols[0]}": F.col(c) - F.col(cols[0]) for c in cols[1:]})


def class_recall_precision(data: DataFrame, class_col: str, flag: str, predicted: str) -> DataFrame:
    """Plain recall and precision of a class: shares of true pairs that are predicted and of predicted pairs that are true."""
    both = F.count_if(F.col(flag) & F.col(predicted))
    return with_class_rates(data.groupBy(class_col).agg(both.alias("hits"), F.count_if(flag).alias("true_pairs"), F.count_if(predicted).alias("predicted_pairs")))


def class_recall_precision_counted(data: DataFrame, class_col: str, rank: str, cutoff: int, top: str = "top", pairs: str = "n", true: str = "n_true") -> DataFrame:
    """The same from rows of `cells.top_values`, with the ranks up to a cutoff as predicted."""
    predicted = lambda c: F.coalesce(F.sum(F.when(F.col(rank) <= cutoff, F.col(c))), F.lit(0))
    whole = F.coalesce(F.sum(F.when(F.col(top).isNull(), F.col(true))), F.lit(0))
    return with_class_rates(data.groupBy(class_col).agg(predicted(true).alias("hits"), whole.alias("true_pairs"), predicted(pairs).alias("predicted_pairs")))


def with_class_rates(counts: DataFrame) -> DataFrame:
    return counts.withColumns({"recall": recall(F.col("hits"), F.col("true_pairs")), "precision": precision(F.col("hits"), F.col("predicted_pairs"))})
