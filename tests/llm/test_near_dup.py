"""Near duplicates and components against brute force."""

import random
import re

import numpy as np
import pytest

from wayfold.llm import near_dup
from wayfold.operators.graph import components


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def brute(rows, percent):
    sets = [(d, brute_set(t)) for d, t in rows]
    up = {d: d for d, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                up[hi] = lo
    return {d: (len(s), find(d)) for d, s in sets}


def corpus(seed=1, groups=30, hot=150):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeàé") for _ in range(rng.randint(1, 6)))
    rows = []
    for g in range(groups):
        base = [word() for _ in range(rng.choice([3, 5, 6, 12, 40, 200]))]
        for _ in range(hot if g == 0 else rng.randint(1, 6)):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                text[rng.randrange(len(text))] = word()
            rows.append(rng.choice([" ", "\n", " \t"]).join(text))
    rows += ["", " \n ", "one", "ONE", "one two three four", "a b c d e f", "x " * 9000]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_shingles_are_exact():
    rows = corpus(groups=8, hot=3)
    for words in (5,):
        got = near_dup.shingle_sets([t.encode() for _, t in rows], words)
        assert [len(s) for s in got] == [len(brute_set(t)) for _, t in rows]
    assert np.array_equal(near_dup.shingle_sets([b"A b C d E f"])[0], near_dup.shingle_sets([b"zz", b" a B\x0bc  d e\tf "])[1])
    assert near_dup.shingle_sets([]) == [] and len(near_dup.shingle_sets([b""])[0]) == 0


@pytest.mark.parametrize("percent,block", [(85, 512), (80, 16)])
def test_groups(spark, monkeypatch, percent, block):
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", block)
    rows = corpus(percent)
    extra = [(10_000, None), (3, rows[3][1])]
    df = spark.createDataFrame([(*r, r[0]) for r in rows + extra], "doc_id long, text string, digest long").repartition(5)
    out = near_dup.near_duplicates(df, percent).collect()
    assert len(out) == len(rows) + len(extra)
    want = brute([*rows, extra[0]], percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    one = near_dup.one_of_each(df, percent)
    assert one.columns == df.columns
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(d for d, (_, c) in want.items() if c == d)


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f"), (None, None)], "doc_id long, text string")
    out = sorted(map(tuple, near_dup.op7_near_dup(df).collect()), key=str)
    assert (1, 2, 1, True) in out and (2, 2, 1, False) in out and (None, 2, None, True) in out and (None, 0, None, True) in out
    assert near_dup.one_of_each(df).count() == 3
    assert near_dup.op7_near_dup(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        near_dup.near_duplicates(df, 50)


def test_signature_join_finds_all_pairs_within_its_bound():
    """Pigeonhole: signatures that differ in at most 13 of the 35 keyed slots share a key."""
    rng = random.Random(9)
    keyed = near_dup.CHUNKS * near_dup.CHUNK_SLOTS
    for _ in range(2000):
        wrong = set(rng.sample(range(keyed), 2 * near_dup.CHUNKS - 1))
        assert any(sum(c * 5 + i in wrong for i in range(5)) <= 1 for c in range(near_dup.CHUNKS))


def test_connected_loses_no_link_across_blocks(spark):
    """Chains, where nearly no row is near the pivot: every link between blocks must be found; a star needs the first step alone."""
    rng = random.Random(5)
    ids = list(range(200))
    chain = ids[:]
    rng.shuffle(chain)
    place = {n: (i if i < 120 else i + 1) for i, n in enumerate(chain)}  # one gap: two chains
    rows = [(1, 0, 200, 9, n, place[n]) for n in ids] + [(2, 1000, 40, 3, 1000 + i, 0) for i in range(40)] + [(3, 2000, 2, 1, 2000, 0), (3, 2000, 2, 1, 2001, 5)]
    members = spark.createDataFrame([r[:5] for r in rows], "group long, pivot long, rows long, blocks long, node long")
    data = spark.createDataFrame([(r[4], r[5].to_bytes(8, "little")) for r in rows], "node long, data binary")

    def compare(data, role):
        at = [int.from_bytes(d, "little") for d in data]
        pairs = [(i, j) for i in range(len(at)) for j in range(i) if abs(at[i] - at[j]) <= 1]
        return [(i, j) for i, j in pairs if not role.any() or role[i] != role[j]]

    edges = near_dup.connected(members.join(data, "node"), compare, "t")
    got = dict(map(tuple, components(edges, "a", "b").collect()))
    low = {n: min(m for m in ids if (place[m] < 120) == (place[n] < 120)) for n in ids}
    assert got == low | {1000 + i: 1000 for i in range(40)}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(0, 60) * 1000, rng.randint(0, 60) * 1000) for _ in range(50)] + [(-5, 7), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()))
    up = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert got == {x: r for x, r in up.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def just_similar(seed):
    """Two texts of 180 shingles that share 160: 160 / 200 is 0.80."""
    rng = random.Random(seed)
    base = [f"{rng.randrange(10**6)}w" for _ in range(184)]
    other = list(base)
    for at in (20, 60, 100, 140):
        other[at] = f"{rng.randrange(10**6)}v"
    return " ".join(base), " ".join(other)


def test_isolated_pairs_at_the_limit_are_linked(spark):
    """Of the first 24,000 seeds, those that 7 chunks over 35 of 64 slots and a distance of 24 missed."""
    seeds = [2448, 3993, 6381, 8429, 9980, 12704, 14920, 19063, 19897, 19938, 22337]
    rows = [(2 * i + k, t) for i, seed in enumerate(seeds) for k, t in enumerate(just_similar(seed))]
    out = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == {d: d - d % 2 for d, _ in rows}


@pytest.mark.parametrize("percent", [70, 75, 80, 85, 90, 100])
def test_keys_cover_the_whole_distance(percent):
    """Signatures as far apart as are compared, their differences spread evenly over the chunks, share a key."""
    chunks, most = near_dup.chunk_slots(percent), near_dup.most_differing(percent)
    assert sorted(i for c in chunks for i in c) == list(range(near_dup.SLOTS)) and len(chunks) * 2 > most
    differ = 1 - percent / 100
    rng = np.random.default_rng(percent)
    assert (rng.binomial(near_dup.SLOTS, differ, 200_000) > most).sum() <= 3
    spread = sorted(i for i in range(near_dup.SLOTS) for c in chunks if i in c[:2])[:most]
    assert min(sum(i in spread for i in c) for c in chunks) <= 1
    a = np.zeros(near_dup.SLOTS, "<u2")
    b = a.copy()
    b[spread] = 1
    assert near_dup.near_signatures(percent)([a.tobytes(), b.tobytes()], np.zeros(2, np.int8)) == [(0, 1)]


def pairs_at(percent, n, seed):
    """Make n pairs of texts that are just similar enough, and n that just are not."""
    import random

    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    out, nr = [], 0
    while nr < 2 * n:
        words = [word() for _ in range(rng.randint(60, 200))]
        other = list(words)
        # A changed word at either end costs few shingles, so the share can be set finely.
        cut = 0
        near = nr < n
        def share():
            a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (words, other))
            return len(a & b), len(a | b)
        while True:
            both, either = share()
            if 100 * both < percent * either:
                break
            kept = list(other)
            other = other[1:] if cut % 2 else other[:-1]
            cut += 1
        out.append((" ".join(words), " ".join(kept if near else other)))
        nr += 1
    return out


@pytest.mark.parametrize("percent", [70, 80, 85])
def test_recall_of_pairs_at_the_limit(spark, percent):
    """Of 300 pairs just over the limit all are linked, of 300 just under it none."""
    pairs = pairs_at(percent, 300, percent)
    rows = [(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)]
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()}
    linked = [got[2 * i] == got[2 * i + 1] for i in range(len(pairs))]
    assert sum(linked[:300]) >= 299 and not any(linked[300:])
