"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each document gets text statistics and four rule scores in thousandths. A rule rejects a document whose score is above
a cutoff, and cutoffs are chosen per stratum (language) on documents labelled good (`quality = 1`): a cutoff is
certified when the exact binomial test rejects "more than `risk` of the stratum's good documents would be dropped",
that is, when P(Binomial(n, risk / rules) <= dropped) <= confidence error / number of tests. Dividing by all tests
(strata x rules x grid) is the Bonferroni correction, so with probability 1 - error every chosen cutoff holds at once and
a stratum loses at most `risk` of its good documents over all rules. The strictest certified cutoff is used; a rule
without one rejects nothing in that stratum.

Distribution: statistics are one map over the text, without a shuffle of text. Counts for all cutoffs are one partial
aggregation by stratum over labelled rows; the thresholds are a table of strata x rules rows joined back by stratum.

Repeated windows are found in the row: hashes of the 3-word windows, packed with their positions into 64 bits, are
sorted, and equal neighbours are compared word by word. Of a hash 64 - b bits are kept, b being the bits of a position; a
window of another text with the same bits that stands between two equal ones would hide them, which at 20,000 words (49 bits)
asks for a chance of less than one in a million texts.

Defined results: null or empty text has zero counts and fails the base rule; a null stratum is a stratum of its own;
several labels for a document count once as good if any is; a score equal to a cutoff passes, and of cutoffs certified alike
the strictest counts; a very long text is one row, read whole; repeated rows are all returned; an empty table gives an empty
result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm._spark import cut

RISK = 0.02
ERROR = 0.05
#: Score columns and their grids of cutoffs, in thousandths.
GRIDS: dict[str, list[int]] = {
    "s_symbols": [0, 5, 10, 20, 30, 50, 75, 100, 150, 200, 300, 500, 750, 1000],
    "s_dup_lines": [0, 50, 100, 150, 200, 250, 300, 400, 500, 600, 700, 800, 900],
    "s_repeats": [0, 10, 20, 30, 50, 75, 100, 150, 200, 250, 300, 400, 450],
    "s_word_len": [4500, 5000, 5500, 6000, 6500, 7000, 7500, 8000, 9000, 10000, 12000, 15000, 20000],
}
EXACT_TERMS = 1000
SPACE = "[\\\\x20\\\\x09-\\\\x0D]+"


def text_statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """`keep` columns with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    base = docs.select(*[F.col(c) for c in keep], F.coalesce(F.col(text), F.lit("")).alias("_t"))
    step = base.selectExpr(*keep, "_t", f"filter(split(_t, '{SPACE}'), w -> w != '') AS _w", "filter(split(_t, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]') AS _l")
    step = step.selectExpr(
        *keep, "_w", "size(_w) AS _n",
        "length(array_join(_w, '')) AS word_chars", "length(_t) - length(translate(_t, '#*$%&|<>', '')) AS n_symbols",
        "size(_l) AS n_lines", "size(_l) - size(array_distinct(_l)) AS n_dup_lines",
    )
    step = step.selectExpr("*", "cast(ceil(log2(_n + 2)) AS int) AS _b")
    step = step.selectExpr("*", "CASE WHEN _n >= 4 THEN sort_array(transform(sequence(0, _n - 3), i -> shiftleft(xxhash64(_w[i], _w[i + 1], _w[i + 2]), _b) | i)) END AS _s", "shiftleft(1L, _b) - 1 AS _m")
    same = "(shiftrightunsigned(x, _b) = shiftrightunsigned(_s[{j}], _b) AND _w[int(x & _m)] = _w[int(_s[{j}] & _m)] AND _w[int(x & _m) + 1] = _w[int(_s[{j}] & _m) + 1] AND _w[int(x & _m) + 2] = _w[int(_s[{j}] & _m) + 2])"
    step = step.selectExpr("*", f"sort_array(transform(filter(_s, (x, i) -> (i > 0 AND {same.format(j='i - 1')}) OR (i < _n - 3 AND {same.format(j='i + 1')})), x -> x & _m)) AS _d")
    covered = "CASE WHEN size(_d) > 0 THEN aggregate(_d, named_struct('n', 0L, 'e', 0L), (a, p) -> named_struct('n', a.n + p + 3 - greatest(p, a.e), 'e', p + 3), a -> a.n) ELSE 0L END"
    return step.selectExpr(*keep, "cast(_n AS long) AS n_words", "cast(word_chars AS long) AS word_chars", "cast(n_symbols AS long) AS n_symbols", "cast(n_lines AS long) AS n_lines", "cast(n_dup_lines AS long) AS n_dup_lines", f"{covered} AS n_repeat_words")


def with_scores(stats: DataFrame) -> DataFrame:
    """Adds base_failed and the four scores; a text without words scores 0."""
    def ratio(top: str, bottom: str, unit: int = 1000) -> str:
        return f"CASE WHEN {bottom} > 0 THEN {unit} * {top} div {bottom} ELSE 0L END"

    return stats.selectExpr(
        "*", "n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed",
        ratio("n_symbols", "n_words") + " AS s_symbols", ratio("n_dup_lines", "n_lines") + " AS s_dup_lines",
        ratio("n_repeat_words", "n_words") + " AS s_repeats", ratio("word_chars", "n_words") + " AS s_word_len",
    )


def log_factorial(x: str) -> str:
    """SQL for ln(x!) of x from EXACT_TERMS on, by Stirling's series."""
    x = f"cast(greatest({x}, 1L) AS double)"
    return f"({x} * ln({x}) - {x} + 0.5D * ln({2 * math.pi!r}D * {x}) + 1D / (12D * {x}) - 1D / (360D * pow({x}, 3)))"


def binomial_tail(n: str, k: str, p: float) -> str:
    """SQL for P(Binomial(n, p) <= k) when k <= n * p, else 1: a running sum of terms, each from the one before in logs. It
    starts 40 standard deviations below k, or with the first term if that is one of the first EXACT_TERMS, so the number of
    terms grows with the root of n."""
    low = f"({k} - cast(40 * sqrt({n} * {p * (1 - p)!r}D) AS bigint))"  # what stands below is far beyond the digits of the sum
    low = f"(CASE WHEN {low} < {EXACT_TERMS} THEN 0L ELSE {low} END)"
    choose = f"({log_factorial(n)} - {log_factorial(low)} - {log_factorial(f'({n} - {low})')})"
    first = f"CASE WHEN {low} = 0 THEN cast({n} AS double) * ln(1 - {p!r}D) ELSE {choose} + {low} * ln({p!r}D) + ({n} - {low}) * ln(1 - {p!r}D) END"
    step = f"named_struct('l', a.l + ln(cast({n} - i + 1 AS double) / i) + ln({p!r}D / (1 - {p!r}D)), 's', a.s + exp(a.l + ln(cast({n} - i + 1 AS double) / i) + ln({p!r}D / (1 - {p!r}D))))"
    return f"CASE WHEN {k} > {n} * {p!r}D THEN 1D WHEN {k} = 0 THEN exp({first}) ELSE aggregate(sequence({low} + 1, {k}), named_struct('l', {first}, 's', exp({first})), (a, i) -> {step}, a -> a.s) END"


def thresholds(good: DataFrame, stratum: str, risk: float = RISK, error: float = ERROR, grids: dict[str, list[int]] = GRIDS) -> DataFrame:
    """One row per stratum with a cutoff for each rule (null: none certified). `good` holds rows labelled good, with scores."""
    sums = [F.sum((F.col(s) > c).cast("long")).alias(f"{s}__{c}") for s, grid in grids.items() for c in grid]
    counts = good.groupBy(F.col(stratum).alias("stratum")).agg(F.count(F.lit(1)).alias("n"), *sums)
    cells = ", ".join(f"named_struct('rule', '{s}', 'cutoff', {c}, 'k', {s}__{c})" for s, grid in grids.items() for c in grid)
    tests = counts.selectExpr("stratum", "n", f"inline(array({cells}))")
    strata = counts.agg(F.count(F.lit(1)).alias("strata"))
    m = sum(map(len, grids.values()))
    held = tests.crossJoin(strata).where(F.expr(binomial_tail("n", "k", risk / len(grids))) <= F.lit(error) / (F.col("strata") * m))  # `strata` is one row
    return held.groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == s, F.col("cutoff"))).alias(f"c_{s}") for s in grids])


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Statistics, scores, cutoffs and `kept` of every document."""
    scored = cut(with_scores(text_statistics(docs, [key, stratum])))
    good = labels.where(F.col("quality") == 1).select(F.col(key).alias("_k")).distinct()
    limits = thresholds(scored.join(good, F.col(key) == F.col("_k"), "left_semi"), stratum, risk, error)
    out = scored.join(limits, scored[stratum].eqNullSafe(limits["stratum"]), "left")
    over = " + ".join(f"CASE WHEN {s} > c_{s} THEN 1 ELSE 0 END" for s in GRIDS)
    return out.drop("stratum").withColumn("rules_failed", F.expr(over)).withColumn("kept", ~F.col("base_failed") & (F.col("rules_failed") == 0))
