"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `vnodes` points of a ring of hash values. A row's key hashes to a point and belongs to the shard whose
virtual node comes next clockwise. A shard takes rows up to its capacity; rows of a full shard continue clockwise to the
next virtual node of a shard with room. Capacities are `ceil((1 + slack) * rows / shards)`; `slack=0` gives exact
capacities that sum to the row count, so counts differ by at most one.

Distribution: ring arcs are cut into equal cells, whose number is set by parameters and not by the data. One aggregation
counts rows per cell; the walk around the ring runs over those counts and yields, for each cell, runs of ranks with
their shard and first slot. Rows get their rank within a cell from one window and look up their run. Different keys spread
evenly over the cells; a cell of more than `cell_rows` rows, as of one key that a third of all rows have, is split into parts
by a hash of the whole row, counted and ranked apart. Only rows equal in every column stay together. Runs are broadcast:
at most parts + shards * vnodes of them, and there are at most cells + rows / cell_rows parts.

Defined results: a null key hashes like the text 'null'; a null or empty text has size `overhead` and crc 0; rows of one
point are in the order of key and row hash, so ties fall alike whenever a task is run again; repeated rows are placed as
separate rows; a very long text enters by its size and checksum only; an empty table gives an empty result; extra columns
are ignored by `shard_documents` and kept by `shard_rows`, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.llm._spark import numbered

RING = 1 << 32
CELLS = 1 << 12
CELL_ROWS = 1 << 20
VNODES = 160
RUN_SCHEMA = "cell int, part int, lo long, hi long, shard int, slot0 long"


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(point, shard) of every virtual node in clockwise order."""
    return sorted((int(hashlib.md5(f"shard-{s}/vnode-{v}".encode()).hexdigest()[:8], 16), s) for s in range(shards) for v in range(vnodes))


def key_point(key: Column) -> Column:
    """A key's point on the ring, 0 to 2**32 - 1: the first 32 bits of its MD5, as for the virtual nodes."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 8), 16, 10).cast("long")


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    if slack <= 0:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [-(-int(rows * (1 + slack)) // shards)] * shards


def walk(counts: dict[tuple[int, int], int], shards: int, vnodes: int = VNODES, slack: float = 0.0, cells: int = CELLS) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (cell, part, first rank, last rank exclusive, shard, first slot). Cells are served in clockwise order; parts and ranks in order."""
    nodes = ring(shards, vnodes)
    points = [p for p, _ in nodes]
    room = capacities(sum(counts.values()), shards, slack)
    used = [0] * shards
    skip = list(range(1, len(nodes) + 1))  # next node that may have room, path-compressed

    def find(i: int) -> int:
        path = []
        while not room[nodes[i % len(nodes)][1]]:
            path.append(i % len(nodes))
            i = skip[i % len(nodes)]
        for p in path:
            skip[p] = i
        return i % len(nodes)

    runs = []
    for cell, part in sorted(counts):
        at, rank, n = bisect_left(points, cell * (RING // cells)), 0, counts[cell, part]
        while rank < n:
            at = find(at % len(nodes))
            s = nodes[at][1]
            take = min(room[s], n - rank)
            runs.append((cell, part, rank, rank + take, s, used[s]))
            room[s] -= take
            used[s] += take
            rank += take
    return runs


def part_counts(placed: DataFrame, cell_rows: int) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """`placed` with the part of each row's cell, and the rows of each part."""
    per_cell = {r["own_cell"]: r["n"] for r in placed.groupBy("own_cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `cells` rows
    hot = {c: -(-n // cell_rows) for c, n in per_cell.items() if n > cell_rows}
    if not hot:
        return placed.withColumn("own_part", F.lit(0)), {(c, 0): n for c, n in per_cell.items()}
    parts = F.create_map(*[F.lit(x) for c, n in hot.items() for x in (c, n)])[F.col("own_cell")]
    placed = placed.withColumn("own_part", F.when(parts.isNotNull(), F.pmod(F.xxhash64("own_hash", F.lit(3)), parts)).otherwise(0).cast("int"))
    split = placed.where(F.col("own_cell").isin(*hot)).groupBy("own_cell", "own_part").agg(F.count(F.lit(1)).alias("n")).collect()  # rows / cell_rows of them
    return placed, {(c, 0): n for c, n in per_cell.items() if c not in hot} | {(r["own_cell"], r["own_part"]): r["n"] for r in split}


def shard_rows(rows: DataFrame, key: str, shards: int, vnodes: int = VNODES, slack: float = 0.0, cells: int = CELLS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """`rows` with `shard int, slot long`; slots of a shard run from 0 without gaps. Other columns are kept as they are."""
    spark: SparkSession = rows.sparkSession
    names = rows.columns
    rows, (key,) = numbered(rows, key)
    point = key_point(F.col(key))
    hashed = [c for c, kind in rows.dtypes if "map<" not in kind and kind != "variant"]
    placed = rows.withColumns({"point": point, "own_cell": (point / F.lit(RING // cells)).cast("int"), "own_hash": F.xxhash64(*hashed)})
    placed, counts = part_counts(placed, cell_rows)
    runs = spark.createDataFrame(walk(counts, shards, vnodes, slack, cells), RUN_SCHEMA)
    w = Window.partitionBy("own_cell", "own_part").orderBy("point", F.col(key), "own_hash")
    ranked = placed.withColumn("place", F.row_number().over(w).cast("long") - 1)
    on = (ranked["own_cell"] == runs["cell"]) & (ranked["own_part"] == runs["part"]) & (ranked["place"] >= runs["lo"]) & (ranked["place"] < runs["hi"])
    return ranked.join(F.broadcast(runs), on).select(*rows.columns, "shard", (F.col("slot0") + F.col("place") - F.col("lo")).alias("slot")).toDF(*names, "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = 24, overhead: int = 8, slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document; law `rows`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text).cast("long") + F.lit(overhead)).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = shard_rows(slim, "doc_id", shards, slack=slack)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
