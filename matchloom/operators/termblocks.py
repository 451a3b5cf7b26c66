"""Scores of documents with the centroids of groups in blocks of documents, without a table of postings.

A block is one row with the counted terms of many documents: its distinct terms once, and for each document their numbers and counts. What
a document needs from the others is little a term: how many documents have it, and its sums over the groups. So a block sends its
distinct terms to buckets, a hash of the term; a bucket adds up what all blocks sent and answers each of them. Weights are formed in the
block, twice, and never leave it.

Distribution: a block has some TOKENS tokens (or one batch of long documents) and a bucket some PAIRS terms of blocks, so only their
numbers grow with the input. What travels are compressed columns: the blocks twice, their distinct terms, and the sums of those by group. A block gets
the sums of its terms in all groups, so groups should be far fewer than documents.

Defined results: rows of one id are one document, in the groups of all of them; a null id is a document that is scored and counts as a
member, but adds nothing to a sum; a null token or group is none; a document without tokens counts as a member and has no scores; an empty input
gives an empty result.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators.scoring import BROADCAST_ROWS
from matchloom.sources.scratch import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the library

TOKENS, PAIRS = 1 << 21, 1 << 18
#: Scores held at a time, and products formed at a time (more only for a single document).
HELD, MET = 1 << 20, 1 << 20


def packed(**columns) -> bytes:
    table, sink = pa.table(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all()


def arrays(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


def listed(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """(row, value) of the elements of lists that are not null."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    values, row = lists.flatten(), np.repeat(np.arange(len(lists)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
    known = values.is_valid()
    return row[np.asarray(known)], values.filter(known)


def block(rows: pa.Table) -> dict[str, bytes | int]:
    """The columns of a block from (doc_id, tokens, grps)."""
    at, words = listed(rows.column("tokens"))
    words = words.dictionary_encode()
    n = max(1, len(words.dictionary))
    key, tf = np.unique(at * n + np.asarray(words.indices), return_counts=True)
    doc, term = np.divmod(key, n)
    df = np.bincount(term, minlength=len(words.dictionary))
    order = np.argsort(-df, kind="stable")  # frequent terms get small numbers
    number = np.empty(len(order), np.int32)
    number[order] = np.arange(len(order))
    return {
        "docs": packed(doc_id=rows.column("doc_id"), grps=rows.column("grps"), n=np.bincount(doc, minlength=rows.num_rows).astype(np.int32)),
        "terms": packed(term=words.dictionary.take(pa.array(order)), df=df[order].astype(np.int32)),
        "posts": packed(term=number[term], tf=tf.astype(np.int32)),
        "n_terms": len(order),
    }


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size, number = 0, TaskContext.get().partitionId() << 32

    def given() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"_b": number} | block(pa.Table.from_batches(held))], pa.schema([("_b", pa.int64()), ("docs", pa.binary()), ("terms", pa.binary()), ("posts", pa.binary()), ("n_terms", pa.int64())]))

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += pc.sum(pc.list_value_length(batch.column("tokens"))).as_py() or 0
        if size >= TOKENS:
            yield given()
            held, size, number = [], 0, number + 1
    if held:
        yield given()


def repeated(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each place, so many as its size."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)


def summed(which: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(which, values, n).astype(np.float64)  # of nothing, numpy's are whole numbers


class Block:
    """The weights of a block: (doc, term, w) of its postings."""

    def __init__(self, docs: bytes, posts: bytes, term: np.ndarray, df: np.ndarray, rows: int) -> None:
        self.docs, posted = unpacked(docs), unpacked(posts)
        (n,), (self.term, tf) = arrays(self.docs, "n"), arrays(posted, "term", "tf")
        self.doc = np.repeat(np.arange(len(n)), n)
        idf = np.zeros(int(term.max(initial=-1)) + 1)
        idf[term] = np.log(1 / (1 / (rows + 1) + df / (rows + 1))) + 1
        x = tf * idf[self.term]
        self.w = x / np.sqrt(summed(self.doc, x * x, len(n)))[self.doc]

    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """(term, place of the group, sum of weights) over the documents of each group, and the groups."""
        at, names = listed(self.docs.column("grps"))
        names = names.dictionary_encode()
        known = ~np.asarray(self.docs.column("doc_id").is_null())[at]
        at, grp = at[known], np.asarray(names.indices)[known]
        size = np.bincount(at, minlength=self.docs.num_rows)
        own = size[self.doc]
        key = np.repeat(self.term, own).astype(np.int64) * max(1, len(names.dictionary)) + grp[repeated((np.cumsum(size) - size)[self.doc], own)]
        key, which = np.unique(key, return_inverse=True)
        return *np.divmod(key, max(1, len(names.dictionary))), summed(which, np.repeat(self.w, own), len(key)), names.dictionary


def split(by: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, its places)."""
    order = np.argsort(by, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(by[order])) + 1):
        if len(at):
            yield int(by[at[0]]), at


def blobs(rows: pa.Table, name: str) -> list[pa.Table]:
    return [unpacked(x) for x in rows.column(name).drop_null().to_pylist()]


def stacked(tables: list[pa.Table], *names: str) -> list[np.ndarray]:
    return arrays(pa.concat_tables(tables), *names) if tables else [np.empty(0, np.int64)] * len(names)


def centroid_scores(rows: DataFrame) -> DataFrame:
    """(reference_id, paired_id, score) of every document with the mean of each group's TF-IDF vectors, where they share a term. The documents
    are one corpus; means are taken over the members and not scaled. rows: (doc_id, tokens, grps), grps an array of the groups' names."""
    rows = rows.select("doc_id", "tokens", F.array_distinct(F.col("grps").cast("array<string>")).alias("grps"))
    total = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    n_rows, most = total.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    if most > 1:
        more = total.where("_n > 1").select(F.col("doc_id").alias("_id"))
        same = F.col("doc_id").eqNullSafe(F.col("_id"))
        joined = rows.join(more, same, "left_semi").groupBy("doc_id").agg(F.flatten(F.collect_list("tokens")).alias("tokens"), F.array_distinct(F.flatten(F.collect_list("grps"))).alias("grps"))
        rows = rows.join(more, same, "left_anti").unionByName(joined)
    sizes = rows.select(F.explode("grps").alias("grp")).where("grp IS NOT NULL").groupBy("grp").agg(F.count(F.lit(1)).alias("_n"))
    blocks = cut(rows.mapInArrow(pack, "_b long, docs binary, terms binary, posts binary, n_terms long"))
    n_buckets = max(1, -(-(blocks.agg(F.sum("n_terms")).first()[0] or 0) // PAIRS))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, blob in zip(*(batch.column(c).to_pylist() for c in ("_b", "terms")), strict=True):
                terms = unpacked(blob)
                h = np.array([zlib.crc32(x.encode()) for x in terms.column("term").to_pylist()], np.int64) % n_buckets
                out = [(i, b, packed(k=at.astype(np.int32), **{c: terms.column(c).take(pa.array(at)) for c in ("term", "df")})) for i, at in split(h)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["_h", "_b", "asked"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The terms of a bucket numbered, and the documents that have them."""
        got = pa.Table.from_batches(list(batches))
        tables = blobs(got, "asked")
        code = np.asarray(pa.concat_tables(tables).column("term").combine_chunks().dictionary_encode().indices)
        df = np.bincount(code, stacked(tables, "df")[0]).astype(np.int64)
        ends = np.cumsum([t.num_rows for t in tables])
        out = [packed(k=t.column("k"), code=(own := code[e - t.num_rows : e]), df=df[own]) for t, e in zip(tables, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([got.column("_h").combine_chunks(), got.column("_b").combine_chunks(), pa.array(out, pa.binary())], names=["_h", "_b", "asked"])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums of a block by term and group, to the buckets of the terms."""
        got = pa.Table.from_batches(list(batches))
        one, answers = got.filter(got.column("docs").is_valid()).to_pylist()[0], got.filter(got.column("asked").is_valid())
        tables = blobs(answers, "asked")
        k, code, df = stacked(tables, "k", "code", "df")
        term, grp, s, names = Block(one["docs"], one["posts"], k, df, n_rows).sums()
        bucket, number = np.zeros((2, int(k.max(initial=-1)) + 1), np.int64)
        bucket[k], number[k] = np.repeat(np.arange(len(tables)), [t.num_rows for t in tables]), code
        found = {i: packed(code=number[term[at]], grp=pa.DictionaryArray.from_arrays(pa.array(grp[at], pa.int32()), names), s=s[at]) for i, at in split(bucket[term])}
        own = [answers.column(c).combine_chunks() for c in ("_h", "_b", "asked")]
        yield pa.RecordBatch.from_arrays([*own, pa.array([found.get(i) for i in range(len(tables))], pa.binary())], names=["_h", "_b", "asked", "found"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums of a bucket's terms over all blocks, and of these what each block asked for."""
        got = pa.Table.from_batches(list(batches))
        sent = [t.set_column(1, "grp", t.column("grp").cast(pa.string())) for t in blobs(got, "found")]
        names = (pa.concat_tables(sent).column("grp").combine_chunks() if sent else pa.array([], pa.string())).dictionary_encode()
        key = stacked(sent, "code")[0].astype(np.int64) * max(1, len(names.dictionary)) + np.asarray(names.indices)
        key, which = np.unique(key, return_inverse=True)
        s = summed(which, stacked(sent, "s")[0], len(key))
        of, grp = np.divmod(key, max(1, len(names.dictionary)))
        for b, asked in zip(got.column("_b").to_pylist(), blobs(got, "asked"), strict=True):
            k, code = arrays(asked, "k", "code")
            low, high = np.searchsorted(of, code, "left"), np.searchsorted(of, code, "right")
            at = repeated(low, high - low)
            found = packed(k=np.repeat(k, high - low), grp=pa.DictionaryArray.from_arrays(pa.array(grp[at], pa.int32()), names.dictionary), s=s[at])
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((b, pa.int64()), (packed(k=k, df=asked.column("df")), pa.binary()), (found, pa.binary()))], names=["_b", "asked", "found"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches))
        one = got.filter(got.column("docs").is_valid()).to_pylist()[0]
        own = Block(one["docs"], one["posts"], *stacked(blobs(got, "asked"), "k", "df"), n_rows)
        sent = [t.set_column(1, "grp", t.column("grp").cast(pa.string())) for t in blobs(got, "found")]
        if not sent or not len(own.doc):
            return
        k, s = stacked(sent, "k", "s")
        names = pa.concat_tables(sent).column("grp").combine_chunks().dictionary_encode()
        order, n = np.argsort(k, kind="stable"), max(1, len(names.dictionary))
        k, s, grp = k[order], s[order], np.asarray(names.indices)[order]
        low, high = np.searchsorted(k, own.term, "left"), np.searchsorted(k, own.term, "right")
        ends = np.searchsorted(own.doc, np.arange(own.docs.num_rows + 1))
        met = np.concatenate([[0], np.cumsum(high - low)])[ends]  # products, up to each document
        a, ids = 0, own.docs.column("doc_id").combine_chunks()
        while a < own.docs.num_rows:
            b = max(a + 1, min(own.docs.num_rows, a + max(1, HELD // n), int(np.searchsorted(met, met[a] + MET, "right")) - 1))
            p = slice(ends[a], ends[b])
            size = high[p] - low[p]
            to = repeated(low[p], size)
            pair = np.repeat(own.doc[p] - a, size) * n + grp[to]
            total = summed(pair, np.repeat(own.w[p], size) * s[to], (b - a) * n)
            at = np.flatnonzero(np.bincount(pair, minlength=len(total)))
            doc, of = np.divmod(at, n)
            yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(of)), ids.take(pa.array(doc + a)), pa.array(total[at])], names=["reference_id", "paired_id", "score"])
            a = b

    def met(answers: DataFrame, *columns: str) -> DataFrame:
        """Blocks with what was sent to them."""
        void = [F.lit(None).cast("binary").alias(c) for c in ("docs", "posts")]
        none = {"_h": F.lit(None).cast("long"), "asked": F.lit(None).cast("binary"), "found": F.lit(None).cast("binary")}
        return blocks.select("_b", "docs", "posts", *[none[c].alias(c) for c in columns]).unionByName(answers.select("_b", *void, *columns))

    answers = blocks.select("_b", "terms").mapInArrow(ask, "_h long, _b long, asked binary").groupBy("_h").applyInArrow(answer, "_h long, _b long, asked binary")
    sent = met(answers, "_h", "asked").groupBy("_b").applyInArrow(weigh, "_h long, _b long, asked binary, found binary")
    found = sent.groupBy("_h").applyInArrow(add, "_b long, asked binary, found binary")
    scores = met(found, "asked", "found").groupBy("_b").applyInArrow(score, f"reference_id string, paired_id {dict(rows.dtypes)['doc_id']}, score double")
    members = cut(sizes.select(F.col("grp").alias("reference_id"), "_n"))
    members = F.broadcast(members) if members.count() <= BROADCAST_ROWS else members
    return scores.join(members, "reference_id").select("reference_id", "paired_id", (F.col("score") / F.col("_n")).alias("score")).where("score > 0")
