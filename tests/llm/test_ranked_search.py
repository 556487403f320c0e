"""Ranked search against a plain scan of all documents."""

import math
import random
import re

import numpy as np
import pytest

from wayfold.llm import ranked_search as rs

TERM = re.compile(rs.TERM)
DOCS, ITEMS = "doc_id long, text string, item string, term string, score double", "item_id long, text string, doc_id string"


def plain_terms(text):
    return [t for t in TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]


def brute(docs, items, k=10):
    counted = [(d, plain_terms(t)) for d, t in docs]
    full = [(d, t) for d, t in counted if t]
    n_docs, length = len(full), sum(len(t) for _, t in full)
    df = {}
    for _, t in full:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    by_item = {}
    for i, t in items:
        if i is not None:
            by_item.setdefault(i, set()).update(plain_terms(t))
    out = []
    for i, wanted in by_item.items():
        found = []
        for d, t in full:
            m = 100 - 90 + (90 * len(t) * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * t.count(x)) // (1000 * t.count(x) + 8 * m)) for x in wanted if x in t)
            if s > 0 and d is not None:
                found.append((-s, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "x", "y", 0.5) for i, t in docs], DOCS)
    q = spark.createDataFrame([(i, t, "z") for i, t in items], ITEMS)
    return sorted(map(tuple, rs.ranked_search(d, q, **kw).select("item_id", "rank", "doc_id", "score").collect()))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["Été", "ÉTÉ", "naïve", "日本", "A1", "a1"]
    docs = [(i * 7 % 1009, " ".join(rng.choices(words, k=rng.choice([1, 3, 20, 200])))) for i in range(400)]
    copies = [(5000 + i, docs[5][1]) for i in range(60)]
    odd = [(None, "w1 w2"), (9000, None), (9001, ""), (9002, " \t-_@[`{~"), (9003, "w1" * 30_000 + " w2"), (9004, "w3 " * 40_000), (9005, "w7 w7"), (9005, "w7 w7"), (9005, "w8"), (-4, "w1\x00w2")]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 12])))) for i in range(40)] + [(99, docs[5][1]), (100, None), (101, ""), (102, "nowhere"), (None, "w1"), (103, "W7"), (103, "w8"), (104, "w7 w8")]
    return docs + copies + odd, items


def test_equals_a_plain_scan(spark, corpus):
    assert run(spark, *corpus) == brute(*corpus)


def test_blocks_ranges_and_k(spark, corpus, monkeypatch):
    monkeypatch.setattr(rs, "BLOCK_TERMS", 60)
    monkeypatch.setattr(rs, "RANGE_DOCS", 64)
    assert run(spark, *corpus, k=3) == brute(*corpus, k=3)


def test_empty_tables(spark, corpus):
    assert run(spark, [], corpus[1]) == [] == run(spark, corpus[0], [])
    assert run(spark, [(1, None), (2, "")], corpus[1]) == []


@pytest.mark.parametrize("docs", [1, 2, 8, 9, 64, 65, 700])
def test_tree_search_opens_what_it_must(docs):
    rng = np.random.default_rng(docs)
    term, place = np.nonzero(rng.random((12, docs)) < 0.2)
    score = rng.integers(1, 6, len(term))  # few values, so many ties
    tree = rs.MaxTree(term, place, score)
    ids = rng.permutation(docs)
    for wanted in ([0], [3, 5], list(range(12)), [11]):
        best = rs.Best(4)
        rs.search(tree, ids, np.array(wanted), best)
        sums = np.zeros(docs, dtype=int)
        for t, p, s in zip(term, place, score, strict=True):
            sums[p] += s * (t in wanted)
        want = sorted((-sums[p], ids[p]) for p in range(docs) if sums[p] > 0)[:4]
        assert list(zip(-best.scores, best.ids, strict=True)) == want


def test_few_documents_are_opened():
    """One document far above all others: its path is opened, the rest is pruned."""
    place = np.arange(4096)
    score = np.where(place == 1234, 1000, 1)
    tree = rs.MaxTree(np.zeros(4096, dtype=int), place, score)
    opened, plain = [], tree.open
    tree.open = lambda level, nodes, wanted: opened.append(len(nodes)) or plain(level, nodes, wanted)
    best = rs.Best(1)
    rs.search(tree, place, np.array([0]), best)
    assert best.ids.tolist() == [1234] and sum(opened) <= 4 * 49
