"""Connected components of a table of links: by union-find in one task while the links are counted to be few, else by
alternating large-star and small-star steps. Both give the same result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm._spark import cut

#: Links are few next to the rows they come from; steps use a task for so many counted ones, not a task per shuffle partition.
ROWS_PER_TASK = 100_000
#: Counted links that one task may join; 16 bytes each.
LINKS_AT_ONCE = 1 << 20


def both_ways(links: DataFrame) -> DataFrame:
    return links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def smallest(edges: DataFrame) -> DataFrame:
    """For each u the smallest of u and its neighbours."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of each one's component) of the links, by hooking larger roots under smaller ones."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    up = np.arange(len(nodes))
    while len(a):
        x, y = up[a], up[b]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while True:
            higher = up[up]
            if np.array_equal(higher, up):
                break
            up = higher
        apart = up[a] != up[b]
        a, b = a[apart], b[apart]
    return nodes, nodes[up]


def in_one_task(links: DataFrame) -> DataFrame:
    def run(batches):
        held = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches]
        if held:
            nodes, comp = joined(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(comp)], names=["node", "comp"])

    return cut(links.where("u <> v").select("u", "v").repartition(1).mapInArrow(run, "node long, comp long"))


def components(links: DataFrame, at_once: int = LINKS_AT_ONCE) -> DataFrame:
    """(node, comp) of every node of the links (u, v); comp is the component's smallest node.

    More than `at_once` links take distributed steps. Each step is an aggregation with map-side combination and a join, so a node with many links is no bottleneck beyond
    what the adaptive skew join splits; the links of each step are kept in the shared folder.
    """
    if links.count() <= at_once:
        return in_one_task(links)
    edges = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    tasks = edges.count() // ROWS_PER_TASK + 1
    seen = None
    while True:
        two = both_ways(edges.coalesce(tasks))
        large = two.join(smallest(two).coalesce(tasks), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(tasks).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").coalesce(tasks)
        least = down.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")
        edges = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).coalesce(tasks).distinct().coalesce(tasks))
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % F.lit(1 << 31))).first()
        if state == seen:
            break
        seen = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
