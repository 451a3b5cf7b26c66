"""Scores of sparse vectors (doc_id, term, weight) in cells, without a table of the postings that meet.

The terms of the references are numbered, and the weights are read once. A document becomes one row with the numbers and weights of the terms it shares with any reference, so its
other terms go no further. A cell has a batch of references and a stretch of documents, both bounded; its task expands the postings
that meet for a few documents at a time, adds them up into a small matrix, and passes on what was asked for: pairs that share a
term, all pairs, or the best n of the stretch with those that tie with the last.

Distribution: a stretch has some COLS documents and a batch some ROWS references, so only the number of tasks grows with the input. No
shuffle has a term as its key once the numbers are there, so frequent terms make no task hot.

Defined results: (doc, term) rows of one id add up, also over corpora; a null term meets nothing; null ids count as one id, except
that groups leave them out; weights must not be null; an empty side gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators.cells import best_places, dealt, rounded
from matchloom.sources.scratch import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the library

ROWS, COLS = 2048, 2048
#: Scores held at a time, and postings expanded at a time (more only for a single document).
HELD, MET = 1 << 17, 1 << 19
#: Largest number of numbered terms that is broadcast.
BROADCAST_TERMS = 500_000


def gathered(weights: DataFrame, numbers: DataFrame) -> DataFrame:
    """(doc_id, terms): one row of each document (and corpus) with the numbered terms it has as struct(t, w); empty without any."""
    key = ["doc_id", *(["corpus_id"] if "corpus_id" in weights.columns else [])]
    found = weights.join(numbers, "term", "left")
    return found.groupBy(*key).agg(F.collect_list(F.when(F.col("_t").isNotNull(), F.struct(F.col("_t").alias("t"), F.col("weight").cast("double").alias("w")))).alias("terms")).drop("corpus_id")


def flat(rows: pa.Table, key: list[str]) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """(one row of each key, in order; place in it, term number and weight of each posting)."""
    code = np.zeros(rows.num_rows, np.int64)
    for k in key:
        one = pc.dictionary_encode(rows.column(k).combine_chunks(), null_encoding="encode")
        code = code + np.asarray(one.indices).astype(np.int64) * (int(code.max(initial=0)) + 1)
    _, first, place = np.unique(code, return_index=True, return_inverse=True)
    terms = rows.column("_terms").combine_chunks()
    values = terms.flatten()
    owner = np.repeat(place, np.asarray(pc.list_value_length(terms)))
    return rows.take(pa.array(first)), owner, np.asarray(values.field("t")), np.asarray(values.field("w"))


def sparse_rows(weights: DataFrame, ref_ids: DataFrame, best: int | None = None, zeros: bool = False, places: int | None = None, groups: DataFrame | None = None, pair_ids: DataFrame | None = None, terms: DataFrame | None = None, rows: int = ROWS, cols: int = COLS) -> DataFrame:
    """(reference_id, paired_id, score) of the documents of `ref_ids` (doc_id) with those of `pair_ids` (default: all): pairs that share
    a term, with `zeros` all pairs, with `best` a set that has the n best sharers of each reference (and group), ties of the last
    included. `groups`: (paired_id, grp), documents without a group are left out, and `grp` is one more column. Scores are rounded if
    `places` is given. `terms`: (term), the references' terms or more, which saves a reading of the weights."""
    known = ref_ids.select("doc_id").distinct()
    if terms is None:
        terms = weights.join(F.broadcast(known) if known.count() <= BROADCAST_TERMS else known, "doc_id", "left_semi")
    numbers = cut(terms.where("term IS NOT NULL").select("term").distinct().withColumn("_t", F.monotonically_increasing_id()))
    numbers = F.broadcast(numbers) if numbers.count() <= BROADCAST_TERMS else numbers
    every = cut(gathered(weights, numbers))
    refs, docs = every.join(known, "doc_id", "left_semi"), every
    if pair_ids is not None:
        docs = docs.join(pair_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    if not zeros:
        docs = docs.where(F.size("terms") > 0)
    if groups is not None:
        docs = docs.join(groups.select(F.col("paired_id").alias("doc_id"), "grp").distinct(), "doc_id")
    docs = docs.select("doc_id", "terms", (F.lit(0) if groups is None else F.col("grp")).alias("_grp"))
    kind = {"r": dict(refs.dtypes)["doc_id"], "p": dict(docs.dtypes)["doc_id"], "g": dict(docs.dtypes)["_grp"]}
    null = {k: F.lit(None).cast(t) for k, t in kind.items()}
    r = refs.select(F.lit(True).alias("_first"), F.col("doc_id").alias("_ref"), null["p"].alias("_pair"), null["g"].alias("_grp"), F.col("terms").alias("_terms"), F.col("doc_id").alias("_id"))
    p = docs.select(F.lit(False).alias("_first"), null["r"].alias("_ref"), F.col("doc_id").alias("_pair"), "_grp", F.col("terms").alias("_terms"), F.col("doc_id").alias("_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(list(batches))
        r, p = both.filter(both.column("_first")), both.filter(pc.invert(both.column("_first")))
        if not (r.num_rows and p.num_rows):
            return
        (r, r_at, r_t, r_w), (p, p_at, p_t, p_w) = flat(r, ["_ref"]), flat(p, ["_grp", "_pair"])
        order = np.argsort(r_t, kind="stable")
        r_at, r_t, r_w = r_at[order], r_t[order], r_w[order]
        order = np.argsort(p_at, kind="stable")
        p_at, p_t, p_w = p_at[order], p_t[order], p_w[order]
        low, high = np.searchsorted(r_t, p_t, "left"), np.searchsorted(r_t, p_t, "right")
        own = np.concatenate([[0], np.cumsum(np.bincount(p_at, high - low, p.num_rows))])  # postings that meet, up to each document
        ends = np.searchsorted(p_at, np.arange(p.num_rows + 1))
        n, ids, kinds = r.num_rows, (r.column("_ref").combine_chunks(), p.column("_pair").combine_chunks()), p.column("_grp").combine_chunks()
        of = np.asarray(pc.dictionary_encode(kinds, null_encoding="encode").indices)
        held: list[tuple] = []

        def given(row: np.ndarray, col: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
            score = score if places is None else rounded(score, places)
            return pa.RecordBatch.from_arrays([ids[0].take(pa.array(row)), ids[1].take(pa.array(col)), pa.array(score), kinds.take(pa.array(col))], names=["reference_id", "paired_id", "score", "grp"])

        a = 0
        while a < p.num_rows:
            b = max(a + 1, min(p.num_rows, a + max(1, HELD // n), int(np.searchsorted(own, own[a] + MET, "right")) - 1))
            s = slice(ends[a], ends[b])
            size = high[s] - low[s]
            to = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low[s], size)
            pair = np.repeat(p_at[s] - a, size) * n + r_at[to]
            score = np.bincount(pair, np.repeat(p_w[s], size) * r_w[to], (b - a) * n)
            at = np.arange(len(score)) if zeros else np.flatnonzero(np.bincount(pair, minlength=len(score)))
            col, row = np.divmod(at, n)
            if best is None:
                yield given(row, col + a, score[at])
            else:
                held.append((row, col + a, score[at]))
            a = b
        if best is not None:
            row, col, score = (np.concatenate([h[i] for h in held]) for i in range(3))
            kept = []
            order = np.lexsort((of[col], row))
            cuts = np.flatnonzero(np.diff(row[order] * (int(of.max(initial=0)) + 1) + of[col[order]])) + 1
            for places_ in np.split(order, cuts):
                if len(places_):
                    kept.append(places_[best_places(score[places_], best)])
            if kept:
                at = np.concatenate(kept)
                yield given(row[at], col[at], score[at])

    out = dealt(r, p, rows, cols).drop("_id").groupBy("_i", "_j").applyInArrow(run, f"reference_id {kind['r']}, paired_id {kind['p']}, score double, grp {kind['g']}")
    return out if groups is not None else out.drop("grp")
