"""Merkle manifest of a data set: a leaf for each row, a tree of threes for each source, a tree over the sources.

Block engine: leaves are numbered in their source's order and cut into aligned blocks of 3^DEPTH, so a block is a subtree. A task
hands whole blocks as Arrow tables to DuckDB, whose level queries (ordered string_agg, sha256) reduce each to its top digest.
Those tops are the nodes of the next tier, cut into blocks in the same way, until one node a source is left, and then one
node over all sources. Back down, the same level queries give each node its siblings, and Spark joins the steps of the tiers
above to each block, so a row's proof is its own block's siblings followed by its block's steps.

Every level of a source hashes all its runs, one-node runs too, so all leaves of a source have the same number of steps; blocks of
a source with several blocks all take DEPTH levels.

Distribution: leaves are hashed where the rows are read; only ids and digests travel. Places come from a range-sorted scan, so a
source with any share of the rows is spread over many tasks and a block is the largest thing in one. Two shuffles of digests
by block follow. Only the largest number of nodes of a tier reaches the driver.

Defined results: nulls are `-` in a leaf (a null text stays null when tampered with); a null source is a source, the first one;
an empty text is `0:`; a very long text is hashed whole; rows with equal or null ids are ordered by leaf, repeated rows are leaves
of their own (equal ones may swap places); a null id is not tampered with; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from matchloom.llm._spark import Steps
from matchloom.operators.scan import scanned

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DEPTH = 6
ROWS = 1 << 14
STEP = "array<struct<l:string,r:string>>"
#: Powers of three below 2^63.
POWERS = [3**i for i in range(40)]


def leaf_digest(*values: Column) -> Column:
    """sha256 of the values as text, each with its number of bytes."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(key, id, leaf, tampered) of every row; key is `-` for a null source, else `s` and the source; tampered is null where nothing changes."""
    own = docs.select(*[F.col(c).alias(c) for c in FIELDS])
    changed = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    even = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n"))
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-"))
    return own.select(key.alias("key"), F.col("doc_id").alias("id"), leaf_digest(*map(F.col, FIELDS)).alias("leaf"), F.when(even, leaf_digest(*map(F.col, FIELDS[:-1]), changed)).alias("tampered"))


def blocked(nodes: DataFrame, depth: int) -> DataFrame:
    """Nodes (key, pos, n, ...) with their block, place in it, and the levels that the block takes."""
    height = F.size(F.filter(F.array(*map(F.lit, POWERS)), lambda p: p < F.col("n")))
    width = F.lit(3**depth)
    return nodes.withColumns({"blk": F.concat_ws("/", "key", F.floor(F.col("pos") / width).cast("string")), "i": (F.col("pos") % width).cast("int"), "h": F.least(height, F.lit(depth))})


def whole_blocks(batches, rows: int = ROWS):
    """Arrow tables of about `rows` rows that end with a block; blk (the first column) becomes a number."""
    held, size = [], 0
    for b in chained(batches):
        if b is not None:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.num_rows
        if size and (b is None or size >= rows):
            t = pa.Table.from_batches(held)
            names = t.column(0).combine_chunks()
            codes = np.asarray(names.dictionary_encode().indices)
            end = t.num_rows if b is None else int(np.flatnonzero(codes != codes[-1])[-1] + 1) if (codes != codes[-1]).any() else 0
            if end:
                yield t.slice(0, end).append_column("b", pa.array(codes[:end]))
            held, size = (t.slice(end).to_batches(), t.num_rows - end) if b is not None else ([], 0)


def chained(batches):
    yield from batches
    yield None


def engine():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "preserve_insertion_order": False})


def build_levels(con, depth: int, digest: str) -> None:
    """Tables run0.. (b, r, run: the digests of each run of three) and top (b, d) of the blocks in `rows` (b, i, h, digest)."""
    con.execute(f"CREATE OR REPLACE TEMP TABLE level AS SELECT b, i, h, {digest} AS d FROM rows WHERE i IS NOT NULL")
    for k in range(depth):
        con.execute(f"CREATE OR REPLACE TEMP TABLE run{k} AS SELECT b, i // 3 AS r, any_value(h) AS h, string_agg(d, '' ORDER BY i) AS run FROM level WHERE h > {k} GROUP BY b, i // 3")
        con.execute(f"CREATE OR REPLACE TEMP TABLE level AS SELECT b, r AS i, h, sha256(run) AS d FROM run{k} UNION ALL SELECT b, i, h, d FROM level WHERE h <= {k}")


def block_tops(depth: int):
    def run(batches):
        con = engine()
        for t in whole_blocks(batches):
            con.register("rows", t)
            build_levels(con, depth, "d")
            top = con.sql("SELECT r.blk, l.d FROM level l JOIN (SELECT DISTINCT b, blk FROM rows) r USING (b)").to_arrow_table()
            yield from top.cast(pa.schema([("blk", pa.string()), ("d", pa.string())])).to_batches()

    return run


def dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("blk").sortWithinPartitions("blk")


def tops(nodes: DataFrame, depth: int) -> DataFrame:
    """(key, pos, n, d) of the next tier."""
    found = dealt(blocked(nodes, depth).select("blk", "i", "h", "d")).mapInArrow(block_tops(depth), "blk string, d string")
    at = F.substring_index("blk", "/", -1)
    named = found.select(F.expr("left(blk, length(blk) - length(substring_index(blk, '/', -1)) - 1)").alias("key"), at.cast("long").alias("pos"), "d")
    sizes = nodes.where("pos = 0").select(F.col("key").alias("_k"), F.ceil(F.col("n") / F.lit(3**depth)).cast("long").alias("n"))
    return named.join(sizes, F.col("key") == F.col("_k")).select("key", "pos", "n", "d")


def own_steps(depth: int):
    """Steps of each node: what stands left and right of it in its run, level by level, then the steps of its block."""

    def run(batches):
        con = engine()
        for t in whole_blocks(batches):
            con.register("rows", t)
            build_levels(con, depth, "d")
            con.execute("CREATE OR REPLACE TEMP TABLE state AS SELECT b, blk, i, i AS first, [] :: STRUCT(l VARCHAR, r VARCHAR)[] AS steps FROM rows WHERE i IS NOT NULL")
            for k in range(depth):
                con.execute(
                    "CREATE OR REPLACE TEMP TABLE state AS SELECT s.b, blk, i // 3 AS i, first, "
                    f"CASE WHEN run IS NULL THEN steps ELSE list_append(steps, {{'l': left(run, 64 * (i % 3)), 'r': substr(run, 64 * (i % 3) + 65)}}) END AS steps FROM state s LEFT JOIN run{k} u ON u.b = s.b AND u.r = s.i // 3"
                )
            out = con.sql("SELECT blk, first AS i, s.steps || coalesce(o.steps, []) AS steps, coalesce(o.top, l.d) AS top FROM state s JOIN level l USING (b) LEFT JOIN (SELECT b, steps, top FROM rows WHERE i IS NULL) o USING (b)").to_arrow_table()
            kind = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))
            yield from out.cast(pa.schema([("blk", pa.string()), ("i", pa.int32()), ("steps", kind), ("top", pa.string())])).to_batches()

    return run


def climbed(nodes: DataFrame, steps: Steps, depth: int) -> DataFrame:
    """(key, pos, steps, top): the way of each node (key, pos, n, d) to its key's top digest."""
    rows = blocked(nodes, depth).select("blk", "i", "h", "d", F.lit(None).cast(STEP).alias("steps"), F.lit(None).cast("string").alias("top"))
    if (nodes.agg(F.max("n").alias("n")).first()["n"] or 0) > 3**depth:
        over = climbed(steps.keep(tops(nodes, depth)), steps, depth)
        rows = rows.unionByName(over.select(F.concat_ws("/", "key", F.col("pos").cast("string")).alias("blk"), F.lit(None).cast("int").alias("i"), F.lit(None).cast("int").alias("h"), F.lit(None).cast("string").alias("d"), "steps", "top"))
    found = dealt(rows).mapInArrow(own_steps(depth), f"blk string, i int, steps {STEP}, top string")
    at = F.substring_index("blk", "/", -1)
    return steps.keep(found.select(F.expr("left(blk, length(blk) - length(substring_index(blk, '/', -1)) - 1)").alias("key"), (at.cast("long") * 3**depth + F.col("i")).alias("pos"), "steps", "top"))


def proved(depth: int, id_type: pa.DataType):
    """Proof digest and refolded root of each leaf."""

    def run(batches):
        con = engine()
        for t in whole_blocks(batches):
            con.register("rows", t)
            build_levels(con, depth, "leaf")
            con.execute("CREATE OR REPLACE TEMP TABLE state AS SELECT b, i, id, leaf, coalesce(tampered, leaf) AS f, '' AS proof FROM rows WHERE i IS NOT NULL")
            for k in range(depth):
                con.execute(
                    "CREATE OR REPLACE TEMP TABLE state AS SELECT s.b, i // 3 AS i, id, leaf, CASE WHEN run IS NULL THEN f ELSE sha256(left(run, 64 * (i % 3)) || f || substr(run, 64 * (i % 3) + 65)) END AS f, "
                    f"proof || coalesce(left(run, 64 * (i % 3)) || substr(run, 64 * (i % 3) + 65), '') AS proof FROM state s LEFT JOIN run{k} u ON u.b = s.b AND u.r = s.i // 3"
                )
            most = con.execute("CREATE OR REPLACE TEMP TABLE over AS SELECT b, steps, subroot, root FROM rows WHERE i IS NULL; SELECT coalesce(max(len(steps)), 0) FROM over").fetchall()[0][0]
            for k in range(1, most + 1):
                con.execute(f"CREATE OR REPLACE TEMP TABLE state AS SELECT s.b, i, id, leaf, CASE WHEN len(steps) < {k} THEN f ELSE sha256(steps[{k}].l || f || steps[{k}].r) END AS f, CASE WHEN len(steps) < {k} THEN proof ELSE proof || steps[{k}].l || steps[{k}].r END AS proof FROM state s JOIN over USING (b)")
            out = con.sql("SELECT id AS doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root FROM state JOIN over USING (b)").to_arrow_table()
            yield from out.cast(pa.schema([("doc_id", id_type), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]])).to_batches()

    return run


def manifest(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row."""
    steps = Steps()
    placed = scanned(steps.keep(leaves(docs)), [F.col("id"), F.col("leaf")], ["key"], "pos", size="n")
    nodes = steps.keep(placed.select("key", (F.col("pos") - 1).alias("pos"), "n", "id", "leaf", "tampered"))
    firsts = steps.keep(tops(nodes.select("key", "pos", "n", F.col("leaf").alias("d")), depth))
    within = climbed(firsts, steps, depth)
    sources = scanned(within.where("pos = 0").select("key", "top"), [F.col("key")], place="pos", size="n")
    over = climbed(steps.keep(sources.select(F.lit("all").alias("key"), (F.col("pos") - 1).alias("pos"), "n", F.col("top").alias("d"), F.col("key").alias("source"))), steps, depth)
    named = sources.select("key", (F.col("pos") - 1).alias("pos"), F.col("top").alias("subroot")).join(over.select("pos", F.col("steps").alias("up"), F.col("top").alias("root")), "pos").drop("pos")
    blocks = within.join(named, "key").select(F.concat_ws("/", "key", F.col("pos").cast("string")).alias("blk"), F.concat("steps", "up").alias("steps"), "subroot", "root")
    rows = blocked(nodes, depth).select("blk", "i", "h", "id", "leaf", "tampered").unionByName(blocks, allowMissingColumns=True)
    kind = dict(rows.dtypes)["id"]
    out = dealt(rows).mapInArrow(proved(depth, to_arrow_type(rows.schema["id"].dataType)), f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return steps.done(out.withColumn("verified", F.col("folded_root") == F.col("root")))
