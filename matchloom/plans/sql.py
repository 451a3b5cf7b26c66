"""DuckDB SQL with the results of the registered queries, from shared parts."""

from __future__ import annotations

from matchloom.functions.lexicon import NOUN_EXCEPTIONS, NOUN_RULES, NOUNS, STOP_WORDS


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def tokens(rows: str) -> str:
    """CTE toks (corpus_id, doc_id, tokens) from rows (corpus_id, doc_id, text)."""
    return f"""
  ascii AS (SELECT corpus_id, doc_id, [x FOR x IN regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') IF length(x) = strlen(x)] AS a FROM ({rows})),
  toks AS (SELECT corpus_id, doc_id, CASE WHEN len(k) = 0 THEN a ELSE k END AS tokens
    FROM (SELECT *, [x FOR x IN a IF NOT list_contains([{quoted(STOP_WORDS)}], x)] AS k FROM ascii))"""


def idf(rows: str) -> str:
    return f"""{tokens(rows)},
  tf AS (SELECT corpus_id, doc_id, term, count(*) AS tf FROM (SELECT corpus_id, doc_id, unnest(tokens) AS term FROM toks) GROUP BY ALL),
  sizes AS (SELECT corpus_id, count(*) AS n FROM toks GROUP BY corpus_id),
  df AS (SELECT corpus_id, term, count(*) AS df FROM tf GROUP BY ALL),
  idf AS (SELECT term, ln((SELECT count(*) FROM sizes) / ((SELECT sum(1.0 / (n + 1)) FROM sizes) + sum(df / (n + 1)))) + 1 AS idf
    FROM df JOIN sizes USING (corpus_id) GROUP BY term)"""


def weights(rows: str) -> str:
    """CTE w (corpus_id, doc_id, term, weight)."""
    return f"""{idf(rows)},
  raw AS (SELECT corpus_id, doc_id, term, tf * idf AS x FROM tf JOIN idf USING (term)),
  w AS (SELECT corpus_id, doc_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY corpus_id, doc_id)) AS weight FROM raw)"""


DOCS = "SELECT 0 AS corpus_id, doc_id, coalesce(text, 'nan') AS text FROM documents"
BY_LANG = "SELECT lang AS corpus_id, doc_id, coalesce(text, 'nan') AS text FROM documents WHERE lang IS NOT NULL"
BY_SOURCE = "SELECT source AS corpus_id, doc_id, coalesce(text, 'nan') AS text FROM documents WHERE source IS NOT NULL"
BOTH = "SELECT 0 AS corpus_id, 'd' || doc_id AS doc_id, coalesce(text, 'nan') AS text FROM documents UNION ALL SELECT 0, 'b' || item_id, coalesce(text, 'nan') FROM benchmark"
PARTS = "SELECT 0 AS corpus_id, p_partkey AS doc_id, coalesce(p_name, 'nan') || ' ' || coalesce(p_type, 'nan') AS text FROM part"

SCORES = f"""{weights(BOTH)},
  scores AS (SELECT r.doc_id AS reference_id, p.doc_id AS paired_id, sum(r.weight * p.weight) AS score FROM w r JOIN w p USING (term)
    WHERE r.doc_id LIKE 'b%' GROUP BY ALL)"""

LEMMAS = f"""{tokens(DOCS)},
  words AS (SELECT DISTINCT unnest(tokens) AS word FROM toks),
  forms AS (SELECT word, unnest([{", ".join(f"struct_pack(pos := {i}, form := CASE WHEN ends_with(word, '{e}') THEN left(word, length(word) - {len(e)}) || '{n}' END)" for i, (e, n) in enumerate(NOUN_RULES))}, struct_pack(pos := {len(NOUN_RULES)}, form := word)], recursive := true) FROM words),
  found AS (SELECT word, form AS rule FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY length(form), form <> word, pos) AS k FROM forms WHERE form IN ({quoted(NOUNS)})) WHERE k = 1),
  odd(word, lemma) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in NOUN_EXCEPTIONS.items())}),
  lemmas AS (SELECT words.word, coalesce(odd.lemma, rule, words.word) AS lemma FROM words LEFT JOIN odd USING (word) LEFT JOIN found USING (word)),
  places AS (SELECT doc_id, unnest(tokens) AS word, generate_subscripts(tokens, 1) AS pos FROM toks)"""

UNIT = """
  u AS (SELECT vec_id, label, [x::DOUBLE / n FOR x IN embedding] AS v FROM (SELECT *, sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding])) AS n FROM embeddings) WHERE n > 0)"""

PAIRS = f"""{UNIT},
  pairs AS (SELECT r.label % 3 AS concept, r.vec_id AS ref_id, r.vec_id % 4 AS ref_group, p.vec_id AS pair_id, p.vec_id % 4 AS pair_group,
      list_dot_product(r.v, p.v) AS score, list_dot_product(r.v[1:8], p.v[1:8]) AS score_head
    FROM u r, u p WHERE r.vec_id % 50 = 0)"""

PAIRABLE = f"""{PAIRS},
  free AS (SELECT * FROM pairs WHERE ref_id <> pair_id AND ref_group <> pair_group),
  pairable AS (SELECT * FROM free WHERE concept IN (SELECT concept FROM free GROUP BY concept HAVING count(DISTINCT ref_id) > 1)),
  truth AS (SELECT f.*, m.ref_id IS NOT NULL AS true_pairing FROM pairable f LEFT JOIN (SELECT DISTINCT concept, ref_id FROM pairable) m ON f.concept = m.concept AND f.pair_id = m.ref_id)"""


def ranked(by_group: bool) -> str:
    by = "ref_id, pair_group" if by_group else "ref_id"
    return f"""{PAIRABLE},
  ranked AS (SELECT *, CASE WHEN round(score, 10) <> 0 THEN dense_rank() OVER (PARTITION BY {by} ORDER BY round(score, 10) DESC NULLS LAST) END AS score_rank FROM truth)"""


def predictions(correct: bool) -> str:
    count = (lambda c: f"count(DISTINCT CASE WHEN {c} THEN pair_group END)") if correct else (lambda c: f"count(*) FILTER (WHERE {c})")
    cols = ", ".join(f"{count(f'score_rank <= {k}')} AS top{k}_pred, {count(f'score_rank <= {k} AND true_pairing')} AS top{k}_true_pred" for k in (1, 5, 10))
    sums = ", ".join(f"sum({c}) OVER (PARTITION BY concept)::BIGINT AS n_{c}" for k in (1, 5, 10) for c in (f"top{k}_pred", f"top{k}_true_pred"))
    return f"""{ranked(correct)},
  pred AS (SELECT concept, ref_id, ref_group, count(score_rank) AS score_rank_pairs, {cols} FROM ranked GROUP BY ALL),
  predicted AS (SELECT *, {sums}, sum(score_rank_pairs) OVER (PARTITION BY concept)::BIGINT AS n_score_rank_pairs FROM pred)"""


def actual(mode: str) -> str:
    per_ref, per_class = {"none": ("n_ref_id - 1", "n_ref_id * (n_ref_id - 1)"), "var": ("n_ref_id - same_group", "n_ref_id * (n_ref_id - 1) - same"), "set": ("n_ref_group - 1", "n_ref_id * (n_ref_group - 1)")}[mode]
    return f"""
  refs AS (SELECT DISTINCT concept, ref_id, ref_group FROM pairable),
  grouped AS (SELECT concept, ref_group, count(*) AS same_group FROM refs GROUP BY ALL),
  classes AS (SELECT concept, sum(same_group)::BIGINT AS n_ref_id, count(*) AS n_ref_group, sum(same_group * (same_group - 1))::BIGINT AS same FROM grouped GROUP BY concept),
  actual AS (SELECT concept, ref_id, ref_group, n_ref_id, n_ref_group, ({per_ref})::BIGINT AS actual_pairings, ({per_class})::BIGINT AS n_actual_pairings
    FROM refs JOIN grouped USING (concept, ref_group) JOIN classes USING (concept))"""


def rates(prefix: str) -> str:
    out = []
    for k in (1, 5, 10):
        t, p, a = f"{prefix}top{k}_true_pred", f"{prefix}top{k}_pred", f"{prefix}actual_pairings"
        pr, re = f"coalesce({t}::DOUBLE / nullif({p}, 0), 0)", f"coalesce({t}::DOUBLE / nullif({a}, 0), 0)"
        out += [f"round({pr}, 6) AS {prefix}top{k}_precision", f"round({re}, 6) AS {prefix}top{k}_recall", f"round(coalesce(2 * {pr} * {re} / nullif({pr} + {re}, 0), 0), 6) AS {prefix}top{k}_F1"]
    return ", ".join(out)


def accuracy(correct: bool) -> str:
    counts = [f"top{k}{t}_pred" for k in (1, 5, 10) for t in ("", "_true")] + ["actual_pairings"]
    once = [f"n_{c}" for c in counts] + ["n_ref_id", "n_ref_group"]
    return f"""{predictions(correct)}, {actual("set" if correct else "var")},
  report AS (SELECT predicted.* EXCLUDE (score_rank_pairs, n_score_rank_pairs), n_ref_id, n_ref_group, actual_pairings, n_actual_pairings FROM predicted JOIN actual USING (concept, ref_id, ref_group)),
  total AS (SELECT (SELECT 'All concept (N = ' || count(DISTINCT concept) || ')' FROM report) AS concept, NULL::BIGINT AS ref_id, NULL::BIGINT AS ref_group, a.*, b.*
    FROM (SELECT {", ".join(f"sum({c})::BIGINT AS {c}" for c in counts)} FROM report) a,
      (SELECT {", ".join(f"sum({c})::BIGINT AS {c}" for c in once)} FROM (SELECT DISTINCT concept, {", ".join(once)} FROM report)) b),
  stacked AS (SELECT concept::VARCHAR AS concept, * EXCLUDE (concept) FROM report UNION ALL BY NAME SELECT * FROM total),
  full_report AS (SELECT *, {rates("")}, {rates("n_")} FROM stacked)"""


STATS_ROWS = """
  stats AS (SELECT l_suppkey AS id, 'min=' || min(l_quantity)::DECIMAL(18,2) || '; max=' || max(l_quantity)::DECIMAL(18,2) || '; median=' || round(median(l_quantity), 2)::DECIMAL(18,2)
      || CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE '; sd=' || round(stddev_samp(l_quantity), 2)::DECIMAL(18,2) END AS dist FROM lineitem GROUP BY l_suppkey),
  one AS (SELECT id, dist, try_cast(nullif(regexp_extract(dist, '(?:^|; )min=(-?[0-9.]+)', 1), '') AS DOUBLE) AS mi, try_cast(nullif(regexp_extract(dist, '(?:^|; )max=(-?[0-9.]+)', 1), '') AS DOUBLE) AS ma,
      try_cast(nullif(regexp_extract(dist, '(?:^|; )median=(-?[0-9.]+)', 1), '') AS DOUBLE) AS me, try_cast(nullif(regexp_extract(dist, '(?:^|; )sd=(-?[0-9.]+)', 1), '') AS DOUBLE) AS sd FROM stats),
  parsed AS (SELECT *, ma - mi AS ra FROM one)"""


def _each(make) -> list[str]:
    return [make(f"a.{c}", f"b.{c}") for c in ("mi", "ma", "me", "sd", "ra")]


DISTANCES = f"""{STATS_ROWS},
  dist AS (SELECT a.id AS ref_id, b.id AS pair_id, b.id % 5 AS pair_group,
      sqrt(({" + ".join(_each(lambda x, y: f"coalesce(power({x} - {y}, 2), 0)"))}) * 5 / ({" + ".join(_each(lambda x, y: f"({x} - {y} IS NOT NULL)::INT"))})) AS euclidean,
      1 - ({" + ".join(_each(lambda x, y: f"coalesce(CASE WHEN {x} - {y} IS NULL THEN NULL WHEN {x} = {y} THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, abs({x} - {y}) / greatest(abs({x}), abs({y}))) END, 0)"))}) / ({" + ".join(_each(lambda x, y: f"({x} - {y} IS NOT NULL)::INT"))}) AS relative
    FROM parsed a, parsed b WHERE a.id % 50 = 0 AND a.id % 5 <> b.id % 5 + 1 AND a.id <> b.id)"""

PART_SCORES = """
  ps AS (SELECT p_partkey AS id, (p_size % 11) / 10.0::DOUBLE AS s1, (p_partkey % 7) / 6.0::DOUBLE AS s2, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE (p_partkey % 13) / 12.0::DOUBLE END AS s3, (p_partkey % 17) / 16.0::DOUBLE AS s4 FROM part)"""
