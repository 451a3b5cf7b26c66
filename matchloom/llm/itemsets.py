"""Closed frequent itemsets of baskets and their rules: close-by-one over the iceberg lattice of formal concepts.

Baskets are the objects and items the attributes of a formal context; a closed itemset is the intent of a concept. Items
get codes in the order of their support, rarest first. From a concept with intent B, made by adding item y, each item k > y
outside B makes one test: the closure of B and k must hold no item below k that B lacks, else the concept is made elsewhere. A
test that failed leaves the items below k that its closure holds; below B, k is skipped without a closure as long as one of these is
still missing (inherited failed canonicity tests). The items between are not closed over at all: a concept's table only keeps items
that are frequent in its extent, and the closure is read from their counts.

Breadth phase: the first level, in DataFrame steps. Baskets become sorted arrays of frequent codes, equal ones are merged to one
row with a weight, and counts of item pairs give the closures and tests of all single items. Each such item is a seed: its
table holds the baskets with it, cut to items frequent beside it, merged again, and only those with a later item, so the most
frequent item, however many baskets hold it, has no table. A seed whose table has more than CELLS cells is taken down a level
by the same steps, until all tables are small. Depth phase: one task a seed, a numpy table and a stack.

Long baskets: the longest ones, whose number is at most half the least support, take no part in the counting of pairs. A pair
frequent in all baskets reaches half the least support without them, so only such candidates are looked up in them.

Rules need supports of sets that need not be closed. Each asked set goes to the seed of its rarest item, whose table, in blocks of
at most CELLS cells, counts it; the counts of the blocks are summed.

Distribution: nothing but counts (baskets, size classes, whether large seeds are left) reaches the driver, nothing is broadcast by
hand. An array of a basket or of a seed's neighbours holds at most all frequent items, `per` times the mean basket size.

Defined results: rows with a null basket or item do not count; repeated rows count once; an item in every basket belongs to
every closed set; ties of support are ordered by item; an empty table gives an empty result; extra columns are ignored,
whatever their names. Very long texts do not occur: ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm._spark import Steps

MIN_COUNT = 5
PER = 20_000
CELLS = 1 << 22


def basket_items(lines: DataFrame, basket: str, item: str) -> DataFrame:
    own = lines.select(F.col(basket).alias("basket"), F.col(item).cast("long").alias("item"))
    return own.where("basket IS NOT NULL AND item IS NOT NULL").distinct()


def frequent_items(entries: DataFrame, least: int) -> DataFrame:
    """(item, support, code): codes ascend with support, then item."""
    counts = entries.groupBy("item").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= least)
    return counts.orderBy("support", "item").withColumn("code", F.monotonically_increasing_id())


def merged_baskets(entries: DataFrame, items: DataFrame) -> DataFrame:
    """(codes, n): distinct arrays of two or more frequent codes, with the number of baskets."""
    coded = entries.join(items.select("item", "code"), "item").groupBy("basket").agg(F.sort_array(F.collect_list("code")).alias("codes"))
    return coded.where(F.size("codes") > 1).groupBy("codes").agg(F.count(F.lit(1)).alias("n"))


def long_limit(baskets: DataFrame, least: int) -> tuple[int, int]:
    """(size beyond which baskets are long, number of long ones): the smallest power of two that leaves at most least / 2."""
    sizes = baskets.groupBy(F.ceil(F.log2(F.size("codes"))).cast("int").alias("c")).agg(F.sum("n").alias("n")).collect()  # a row for each power of two
    above, limit = 0, max((r["c"] for r in sizes), default=0)
    for r in sorted(sizes, key=lambda r: -r["c"]):
        if above + r["n"] > least // 2:
            break
        above, limit = above + r["n"], r["c"] - 1
    return 1 << limit, above


def pair_counts(short: DataFrame) -> DataFrame:
    """(a, b, n) of code pairs a < b in baskets of bounded size, summed in each task before the shuffle."""
    first = short.select("codes", "n", F.posexplode("codes").alias("i", "a"))
    return first.select("a", F.explode(F.slice("codes", F.col("i") + 2, F.size("codes"))).alias("b"), "n").groupBy("a", "b").agg(F.sum("n").alias("n"))


def in_long(candidates: DataFrame, long: DataFrame) -> DataFrame:
    """(a, b, ref, w): candidate pairs in the long baskets (ref, code, w)."""
    first = candidates.select("a", "b").join(long.withColumnRenamed("code", "a"), "a")
    return first.join(long.select("ref", F.col("code").alias("b")), ["ref", "b"])


def both_ways(pairs: DataFrame, *more: str) -> DataFrame:
    return pairs.select(F.col("a").alias("seed"), F.col("b").alias("k"), *more).unionByName(pairs.select(F.col("b").alias("seed"), F.col("a").alias("k"), *more))


def merged_rows(rows: DataFrame, y: Column) -> DataFrame:
    """Rows that can still be extended, equal ones merged."""
    return rows.where(F.element_at("items", -1) > y).groupBy("path", "items").agg(F.sum("n").alias("n"))


def seed_rows(short: DataFrame, hits: DataFrame, near: DataFrame) -> DataFrame:
    """(path, items, n): the table of each seed that has a later frequent neighbour. near: (seed, k)."""
    sets = near.groupBy("seed").agg(F.collect_list("k").alias("near")).where(F.array_max("near") > F.col("seed"))
    own = short.select(F.explode("codes").alias("seed"), "codes", "n").join(sets, "seed").select("seed", F.array_intersect("codes", "near").alias("items"), "n")
    far = hits.groupBy("seed", "ref").agg(F.sort_array(F.collect_list("k")).alias("items"), F.first("w").alias("n")).select("seed", "items", "n")
    rows = own.where(F.size("items") > 0).unionByName(far).select(F.array("seed").alias("path"), "items", "n")
    return merged_rows(rows, F.element_at("path", -1))


def large_paths(rows: DataFrame, cells: int) -> DataFrame:
    """(path, blocks) of the tables with more than `cells` cells, and the blocks of that many that each one makes."""
    sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("r"), F.sum(F.size("items")).alias("m")).where(F.col("r") * F.col("m") > cells)
    width = rows.join(sizes.select("path"), "path", "left_semi").select("path", F.explode("items").alias("k")).distinct().groupBy("path").agg(F.count(F.lit(1)).alias("width"))
    return sizes.join(width, "path").select("path", F.ceil(F.col("r") * F.col("width") / cells).alias("blocks")).where("blocks > 1")


def expanded(nodes: DataFrame, rows: DataFrame, fails: DataFrame, least: int, steps: Steps) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One level down: (nodes, rows, fails) of the children of the nodes (path, intent, support)."""
    dead = fails.join(nodes.select("path", "intent"), "path").where(F.size(F.array_except("smaller", "intent")) > 0).select("path", "k")
    later = F.filter(F.array_except("items", "intent"), lambda k: k > F.element_at("path", -1))
    child = rows.join(nodes.select("path", "intent"), "path").select("path", "intent", "items", "n", F.explode(later).alias("k")).join(dead, ["path", "k"], "left_anti")
    counts = child.select("path", "k", "n", F.explode(F.array_except("items", "intent")).alias("m")).groupBy("path", "k", "m").agg(F.sum("n").alias("c"))
    made = counts.groupBy("path", "k").agg(F.collect_list(F.struct("m", "c")).alias("x"), F.max(F.when(F.col("m") == F.col("k"), F.col("c"))).alias("support"))
    closure = F.transform(F.filter("x", lambda x: x["c"] == F.col("support")), lambda x: x["m"])
    near = F.transform(F.filter("x", lambda x: (x["c"] >= least) & (x["c"] < F.col("support"))), lambda x: x["m"])
    made = steps.keep(made.select("path", "k", "support", closure.alias("closure"), near.alias("near")).withColumn("smaller", F.filter("closure", lambda m: m < F.col("k"))))
    good = made.where("size(smaller) = 0")
    down = F.concat("path", F.array("k"))
    kids = good.join(nodes.select("path", "intent"), "path").select(down.alias("path"), F.sort_array(F.concat("intent", "closure")).alias("intent"), "support")
    cut = child.join(good.select("path", "k", "near"), ["path", "k"]).select(down.alias("path"), F.array_intersect("items", "near").alias("items"), "n")
    new = fails.unionByName(made.where("size(smaller) > 0").select("path", "k", "smaller"))
    passed = good.select("path", F.col("k").alias("j")).join(new, "path").where("k > j").select(F.concat("path", F.array("j")).alias("path"), "k", "smaller")
    return steps.keep(kids), steps.keep(merged_rows(cut.where("size(items) > 0"), F.element_at("path", -1))), steps.keep(passed)


def summed(table: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted column sums, in blocks of rows."""
    out = np.zeros(table.shape[1], np.int64)
    step = max(1, (1 << 20) // max(table.shape[1], 1))
    for i in range(0, len(w), step):
        out += w[i : i + step] @ table[i : i + step]
    return out


def boolean_table(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, one boolean row for each array over them)."""
    size = np.array([len(r) for r in rows])
    codes, at = np.unique(np.concatenate(rows), return_inverse=True)
    table = np.zeros((len(rows), len(codes)), bool)
    table[np.repeat(np.arange(len(rows)), size), at] = True
    return codes, table


def descendants(intent: list[int], y: int, rows: list[np.ndarray], w: np.ndarray, fails: dict[int, list[int]], least: int):
    """(intent, support) of all closed sets below a concept, without it; `rows` hold its extent's items outside the intent."""
    codes, table = boolean_table(rows)
    known = {int(c): i for i, c in enumerate(codes)}
    base = np.isin(codes, intent)
    missing = {known[k]: np.array([known.get(m, -1) for m in ms if m not in intent], np.int64) for k, ms in fails.items() if k in known}
    stack = [(np.arange(len(w)), base, int(np.searchsorted(codes, y, "right")), missing)]
    while stack:
        own, held, first, failed = stack.pop()
        part = table[own]
        counts = summed(part, w[own])
        below, kids = dict(failed), []
        for k in first + np.flatnonzero((counts[first:] >= least) & ~held[first:]):
            if (ms := failed.get(k)) is not None and (np.any(ms < 0) or not held[ms].all()):
                continue  # the same item still stands in the way
            extent = part[:, k]
            closed = summed(part[extent], w[own[extent]]) == counts[k]
            if len(new := np.flatnonzero(closed[:k] & ~held[:k])):
                below[k] = new
            else:
                kids.append((own[extent], closed, k + 1, int(counts[k])))
        for extent, closed, at, support in kids:
            yield sorted({*intent, *codes[closed].tolist()}), support
            if at < len(codes):
                stack.append((extent, closed, at, below))


def list_column(parts: list[list[int]]) -> pa.Array:
    return pa.array(parts, pa.list_(pa.int64()))


def arrays_of(col: pa.Array) -> list[np.ndarray]:
    flat, offs = np.asarray(col.values), np.asarray(col.offsets)
    return [flat[a:b] for a, b in zip(offs[:-1], offs[1:], strict=True)]


def searched(least: int):
    """Depth phase: closed sets below a node, from its rows of kinds 0 (intent, support), 1 (failed test: k, smaller items) and 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, fails, rows, w, path = None, {}, [], [], None
        for b in batches:
            for kind, items, n in zip(b.column(1).to_pylist(), arrays_of(b.column(2)), b.column(3).to_pylist(), strict=True):
                if kind == 0:
                    node = (items.tolist(), n)
                elif kind == 1:
                    fails[int(items[0])] = items[1:].tolist()
                else:
                    rows.append(items)
                    w.append(n)
            path = b.column(0)[0].as_py() if path is None and len(b) else path
        codes, support = [], []
        for intent, n in descendants(node[0], path[-1], rows, np.array(w, np.int64), fails, least) if node and rows else ():
            codes.append(intent)
            support.append(n)
            if len(codes) == 4096:
                yield pa.RecordBatch.from_arrays([list_column(codes), pa.array(support, pa.int64())], names=["codes", "support"])
                codes, support = [], []
        yield pa.RecordBatch.from_arrays([list_column(codes), pa.array(support, pa.int64())], names=["codes", "support"])

    return run


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Support, in one block of a seed's rows (kind 2), of the sets asked there (kind 0; without the seed)."""
    rows, w, asked, full = [], [], [], []
    for b in batches:
        for kind, items, n, codes in zip(b.column(3).to_pylist(), arrays_of(b.column(4)), b.column(5).to_pylist(), b.column(6).to_pylist(), strict=True):
            if kind == 0:
                asked.append(items)
                full.append(codes)
            else:
                rows.append(items)
                w.append(n)
    out = np.zeros(len(asked), np.int64)
    if rows and asked:
        codes, table = boolean_table(rows)
        w = np.array(w, np.int64)
        for i, items in enumerate(asked):
            at = np.minimum(np.searchsorted(codes, items), len(codes) - 1)
            if np.array_equal(codes[at], items):
                out[i] = w[table[:, at].all(1)].sum()
    yield pa.RecordBatch.from_arrays([list_column(full), pa.array(out)], names=["codes", "n"])


def supports(asked: DataFrame, rows: DataFrame, large: DataFrame | None, at_once: int = 1 << 14) -> DataFrame:
    """(codes, a): support of each asked set of two or more codes, counted in the table of its first code.

    A large table is split into blocks; sets asked of one seed go in parts of about `at_once`, each to all blocks.
    """
    sets = asked.select(F.array(F.element_at("codes", 1)).alias("path"), F.slice("codes", 2, F.size("codes")).alias("items"), "codes")
    parts = sets.groupBy("path").agg(F.ceil(F.count(F.lit(1)) / at_once).alias("parts"))
    if large is not None:
        parts = parts.join(large, "path", "left")
    parts = parts.select("path", "parts", (F.coalesce("blocks", F.lit(1)) if large is not None else F.lit(1)).cast("long").alias("blocks"))
    own = sets.join(parts, "path").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("items"), "parts").alias("part"), F.lit(0).alias("kind"), "items", F.lit(0).cast("long").alias("n"), "codes")
    held = rows.join(parts, "path").select("path", F.pmod(F.xxhash64("items"), "blocks").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(2).alias("kind"), "items", "n", F.lit(None).cast("array<long>").alias("codes"))
    found = own.unionByName(held).groupBy("path", "block", "part").applyInArrow(counted, "codes array<long>, n long")
    return found.groupBy("codes").agg(F.sum("n").alias("a"))


def itemsets(lines: DataFrame, basket: str, item: str, min_count: int = MIN_COUNT, per: int = PER, confidence: int = 60, cells: int = CELLS) -> DataFrame:
    """(items, support, rules) of every closed itemset with support >= min_count and support x per >= baskets.

    items: ascending ids. rules: array of (item, rest, own), ascending by item: the item follows from the others, which have
    support `rest`, in `confidence` percent of their baskets or more and more often than it occurs (support `own`).
    """
    steps = Steps()
    entries = steps.keep(basket_items(lines, basket, item))
    total = entries.select("basket").distinct().count()
    least = max(min_count, -(-total // per))
    items = steps.keep(frequent_items(entries, least))
    baskets = steps.keep(merged_baskets(entries, items))
    limit, above = long_limit(baskets, least)
    short = baskets.where(F.size("codes") <= limit)
    long = steps.keep(baskets.where(F.size("codes") > limit).withColumn("ref", F.monotonically_increasing_id()).select("ref", F.explode("codes").alias("code"), F.col("n").alias("w")))
    candidates = steps.keep(pair_counts(short).where(F.col("n") >= least - above))
    hits = steps.keep(in_long(candidates, long))
    more = hits.groupBy("a", "b").agg(F.sum("w").alias("more"))
    pairs = steps.keep(candidates.join(more, ["a", "b"], "left").select("a", "b", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")).where(F.col("n") >= least))
    near = both_ways(pairs, "n")
    rows = steps.keep(seed_rows(short, both_ways(hits.join(pairs.select("a", "b"), ["a", "b"], "left_semi"), "ref", "w"), near.select("seed", "k")))

    single = items.select(F.col("code").alias("seed"), "support")
    always = near.join(single, "seed").where("n = support").groupBy("seed").agg(F.sort_array(F.collect_list("k")).alias("ks"))
    first = single.where(F.col("support") < total).join(always, "seed", "left").withColumn("ks", F.coalesce("ks", F.array().cast("array<long>"))).withColumn("smaller", F.filter("ks", lambda k: k < F.col("seed")))
    first = steps.keep(first)
    nodes = first.where("size(smaller) = 0").select(F.array("seed").alias("path"), F.sort_array(F.concat(F.array("seed"), "ks")).alias("intent"), "support")
    root = single.where(F.col("support") == total).groupBy("support").agg(F.sort_array(F.collect_list("seed")).alias("codes")).select("codes", "support")
    failed = near.join(first.where("size(smaller) > 0").select(F.col("seed").alias("k"), "smaller"), "k").where("k > seed").select(F.array("seed").alias("path"), "k", "smaller")
    fails = steps.keep(failed.select("path", "k", F.filter("smaller", lambda m: m != F.element_at("path", 1)).alias("smaller")).where("size(smaller) > 0"))

    large = large_paths(rows, cells)
    many = not large.isEmpty()
    closed = root.unionByName(nodes.select(F.col("intent").alias("codes"), "support"))
    level_nodes, level_rows, level_fails, wide = nodes, rows, fails, large
    while True:
        deep = wide is not None and not wide.isEmpty()
        wide = steps.keep(wide.select("path")) if deep else None
        small = [x.join(wide, "path", "left_anti") if deep else x for x in (level_nodes, level_fails, level_rows)]
        table = small[0].select("path", F.lit(0).alias("kind"), F.col("intent").alias("items"), F.col("support").alias("n"))
        table = table.unionByName(small[1].select("path", F.lit(1).alias("kind"), F.concat(F.array("k"), "smaller").alias("items"), F.lit(0).cast("long").alias("n")))
        table = table.unionByName(small[2].select("path", F.lit(2).alias("kind"), "items", "n"))
        closed = closed.unionByName(table.groupBy("path").applyInArrow(searched(least), "codes array<long>, support long"))
        if not deep:
            break
        level_nodes, level_rows, level_fails = expanded(level_nodes.join(wide, "path", "left_semi"), level_rows, level_fails.join(wide, "path", "left_semi"), least, steps)
        closed = closed.unionByName(level_nodes.select(F.col("intent").alias("codes"), "support"))
        wide = large_paths(level_rows, cells)
    closed = steps.keep(closed)
    flat = closed.withColumn("code", F.explode("codes")).withColumn("rest", F.when(F.size("codes") > 1, F.filter("codes", lambda x: x != F.col("code"))))
    asked = flat.where(F.size("rest") > 1).select(F.col("rest").alias("codes")).distinct()
    known = supports(asked, rows, large if many else None).unionByName(items.select(F.array("code").alias("codes"), F.col("support").alias("a")))
    told = flat.join(items.select("code", "item", F.col("support").alias("own")), "code").join(known.withColumnRenamed("codes", "rest"), "rest", "left")
    follows = (F.lit(100) * F.col("support") >= F.lit(confidence) * F.col("a")) & (F.col("support") * F.lit(total) > F.col("a") * F.col("own"))
    rule = F.when(follows, F.struct("item", F.col("a").alias("rest"), "own"))
    out = told.groupBy("codes", "support").agg(F.sort_array(F.collect_list("item")).alias("items"), F.sort_array(F.collect_list(rule)).alias("rules"))
    return steps.done(out.select("items", "support", "rules"))


def rule_digest(found: DataFrame) -> DataFrame:
    """(items, n_items, support, n_rules, best_item, rules_sha256): the rules as text, hashed."""
    best = F.array_min(F.transform("rules", lambda r: F.struct(r["rest"], r["item"])))["item"]
    text = F.array_join(F.transform("rules", lambda r: F.concat_ws(":", *[r[c].cast("string") for c in ("item", "rest", "own")])), ";")
    return found.select(F.array_join(F.col("items").cast("array<string>"), ",").alias("items"), F.size("items").cast("long").alias("n_items"), "support", F.size("rules").cast("long").alias("n_rules"), best.alias("best_item"), F.sha2(text, 256).alias("rules_sha256"))
