import random
from collections import defaultdict
from itertools import combinations

import pytest

from matchloom.llm import itemsets

LINES = "sale_id long, item_id long, codes string, k int"


def brute(pairs, least):
    """{items: (support, rules)} of the closed frequent itemsets, from all subsets of the baskets' frequent items."""
    baskets = defaultdict(set)
    for b, i in pairs:
        if b is not None and i is not None:
            baskets[b].add(i)
    counts = defaultdict(int)
    for items in baskets.values():
        for n in range(1, len(items) + 1):
            for c in combinations(sorted(items), n):
                counts[c] += 1
    freq = {c: n for c, n in counts.items() if n >= least}
    out = {}
    for c, n in freq.items():
        if any(freq.get(tuple(sorted((*c, i)))) == n for i in {x for y in freq for x in y} - set(c)):
            continue
        rules = [(i, freq[rest], freq[(i,)]) for i in c if (rest := tuple(x for x in c if x != i))]
        out[c] = n, [r for r in rules if 100 * n >= 60 * r[1] and n * len(baskets) > r[1] * r[2]]
    return out


def found(spark, pairs, **more):
    df = spark.createDataFrame([(b, i, "x", 1) for b, i in pairs], LINES)
    return {tuple(r["items"]): (r["support"], [tuple(x) for x in r["rules"]]) for r in itemsets.itemsets(df, "sale_id", "item_id", **more).collect()}


def corpus(seed, baskets=60, items=9, hot=True):
    rng = random.Random(seed)
    pairs = []
    for b in range(baskets):
        own = {i for i in range(items) if rng.random() < 0.15 + 0.08 * (i % 4)}
        if rng.random() < 0.3:
            own |= {1, 3, 5, 7}
        pairs += [(b, i) for i in own]
    pairs += [(b, 100) for b in range(0, baskets, 2)] if hot else []
    return pairs + pairs[:20] + [(None, 1), (3, None)]


@pytest.mark.parametrize("cells", [itemsets.CELLS, 40])
def test_closed_sets_and_rules_equal_brute_force(spark, cells):
    pairs = corpus(1)
    assert found(spark, pairs, cells=cells) == brute(pairs, 5)


def test_ties_make_failed_tests_that_descendants_inherit(spark):
    pairs = [(b, i) for b in range(30) for i in ((1, 2, 3) if b % 3 else (4, 5))] + [(b, 6) for b in range(0, 30, 4)] + [(b, 7) for b in range(1, 30, 2)]
    assert found(spark, pairs) == brute(pairs, 5)
    assert found(spark, pairs, cells=6) == brute(pairs, 5)


def test_an_item_in_every_basket_is_in_every_set(spark):
    pairs = corpus(2, baskets=40, items=5) + [(b, 50) for b in range(40)]
    got = found(spark, pairs)
    assert got == brute(pairs, 5)
    assert all(50 in items for items in got)


def test_long_baskets_are_counted_without_listing_their_pairs(spark):
    pairs = corpus(3, items=7, hot=False)
    long = [(b, i) for b in (900, 901) for i in [*range(7), *range(200, 205)]]
    pairs = pairs + long + [(b, i) for b in range(5) for i in (200, 201)]
    assert found(spark, pairs) == brute(pairs, 5)


def test_empty_tables_and_rare_items_give_nothing(spark):
    assert found(spark, []) == {}
    assert found(spark, [(1, 1), (1, 2), (None, None)]) == {}


def test_the_search_itself_equals_subsets_on_random_tables():
    import numpy as np

    for seed in range(20):
        rng = np.random.default_rng(seed)
        rows = [np.flatnonzero(rng.random(8) < 0.6) for _ in range(25)]
        rows = [r for r in rows if len(r)]
        w = rng.integers(1, 4, len(rows))
        got = dict((tuple(i), n) for i, n in itemsets.descendants([], -1, rows, w, {}, 6))
        want = {}
        for n in range(1, 9):
            for c in combinations(range(8), n):
                own = [set(r.tolist()) >= set(c) for r in rows]
                support = int(w[own].sum())
                shared = set.intersection(*[set(r.tolist()) for r, o in zip(rows, own, strict=True) if o]) if any(own) else set()
                if support >= 6 and shared == set(c):
                    want[c] = support
        assert got == want
