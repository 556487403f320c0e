"""Rounds of greedy choices and chains against the one-by-one procedures they stand for."""

import random

import pytest

from wayfold.operators import matching


def one_by_one(pairs):
    used, out = set(), []
    for d, lo, hi in sorted({(d, min(a, b), max(a, b)) for a, b, d in pairs if a != b}):
        if lo not in used and hi not in used:
            used |= {lo, hi}
            out.append((lo, hi, d))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_pairs_equal_the_sequential_choice(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(60), rng.randrange(60), float(rng.randrange(12))) for _ in range(300)]
    got = matching.greedy_pairs(spark.createDataFrame(pairs, "lo long, hi long, d double"))
    assert sorted(map(tuple, got.collect())) == one_by_one(pairs)


def test_pairs_of_a_falling_line_and_of_nothing(spark):
    """Each pair waits for the next one: the slowest case still ends, without a bound on rounds."""
    pairs = [(i, i + 1, float(20 - i)) for i in range(20)]
    assert sorted(map(tuple, matching.greedy_pairs(spark.createDataFrame(pairs, "lo long, hi long, d double")).collect())) == one_by_one(pairs)
    none = spark.createDataFrame([(1, None, 1.0), (2, 2, 0.0)], "lo long, hi long, d double")
    assert matching.greedy_pairs(none).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_keep_equals_the_sequential_choice(spark, seed):
    rng = random.Random(seed)
    items = [(i, rng.randrange(9)) for i in range(80)]
    conflicts = [(rng.randrange(85), rng.randrange(85)) for _ in range(160)]
    near = {i: set() for i in range(85)}
    for a, b in conflicts:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    kept, want = set(), []
    order = {i: (r, i) for i, r in items}
    for i, _ in sorted(items, key=lambda x: order[x[0]]):
        before = [k for k in near[i] if k in kept]
        want.append((i, min(before, key=order.get) if before else None))
        if not before:
            kept.add(i)
    got = matching.greedy_keep(spark.createDataFrame(items, "id long, rank int"), spark.createDataFrame(conflicts, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def walk(items, links):
    """Follow links from free ends, then round rings, one item at a time."""
    to = {}
    for a, s, b, t in links:
        to[a, s], to[b, t] = (b, t), (a, s)
    seen, out = set(), []

    def follow(item, side):
        chain, pos = [], 0
        while item not in seen:
            seen.add(item)
            chain.append((item, pos, side == 1))
            pos += 1
            if (item, 1 - side) not in to:
                break
            item, side = to[item, 1 - side]
        least = min(c[0] for c in chain)
        out.extend((least, *c) for c in chain)

    for item, side in sorted((i, s) for i in items for s in (0, 1) if (i, s) not in to):
        if item not in seen:
            follow(item, side)
    for item in sorted(items):
        if item not in seen:
            follow(item, 0)
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_chains_equal_a_walk(spark, seed):
    rng = random.Random(seed)
    items = list(range(50, 110))
    ends = [(i, s) for i in items for s in (0, 1)]
    rng.shuffle(ends)
    links = [(*ends.pop(), *ends.pop()) for _ in range([10, 40, 55, 60][seed])]
    links = [x for x in links if x[0] != x[2]]
    df = spark.createDataFrame([(i, i * 2) for i in items], "item long, km long")
    got = matching.ordered_chains(df, spark.createDataFrame(links, "a long, a_side int, b long, b_side int"), ("km",))
    rows = sorted(map(tuple, got.collect()))
    want = walk(items, links)
    assert [r[:4] for r in rows] == want
    at = {(c, p): i for c, i, p, _ in want}
    assert all(r[4] == sum(2 * at[r[0], p] for p in range(r[2])) for r in rows)


def test_a_chain_of_thousands(spark):
    n = 3000
    links = [(i, 1, i + 1, 0) for i in range(n - 1)]
    df = spark.createDataFrame([(i,) for i in range(n)], "item long")
    got = matching.ordered_chains(df, spark.createDataFrame(links, "a long, a_side int, b long, b_side int"))
    assert sorted(map(tuple, got.collect())) == [(0, i, i, False) for i in range(n)]
