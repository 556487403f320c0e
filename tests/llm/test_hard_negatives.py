"""Hard negatives against a plain search of all rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string"


def brute(rows, positives=5, negatives=10):
    use = []
    for i, e, label in rows:
        if i is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        use.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in e]))
    anchors = {}
    for i, label, v in use:
        if i % 100 == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, other) for i, other, w in use if i != a or other != label)
        same = [(i, -s) for s, i, other in scored if other == label][:positives]
        for p, ps in same:
            fit = [(i, -s) for s, i, other in scored if other != label and 30 * ps <= -100 * s <= 90 * ps]
            out += [(a, p, r, i, ps, s) for r, (i, s) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return sorted(map(tuple, hn.hard_negatives(df, F.col("vec_id") % 100 == 0, **kw).collect()))


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.05, 0.3, 1, 2])).tolist(), int(rng.integers(0, 4))) for i in range(900)]
    same = rng.normal(size=6).tolist()
    rows += [(1000 + i, same, i % 3) for i in range(250)]  # a large group of copies: ties all over
    rows += [(None, same, 1), (2001, None, 1), (2002, same, None), (2003, [1.0, None], 1), (2004, [float("nan")] * 6, 1), (2005, [float("inf")] + [0.0] * 5, 1), (2006, [], 1), (2100, [0.0] * 6, 2), (2007, [0.5] * 9, 1), (2008, [0.5], 1)]
    return rows


def test_equals_a_plain_search(spark, vectors):
    assert run(spark, vectors) == brute(vectors)


def test_anchor_blocks_and_buckets(spark, vectors, monkeypatch):
    monkeypatch.setattr(hn, "ANCHOR_BLOCK", 4)
    monkeypatch.setattr(hn, "BUCKET", 16)
    monkeypatch.setattr(hn, "CELLS", 40)
    assert run(spark, vectors) == brute(vectors)


def test_empty_and_few(spark, vectors):
    assert run(spark, []) == []
    assert run(spark, [(100, [1.0], 1), (101, [1.0], 2)]) == []  # no positive
    assert run(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []  # no anchor
    assert run(spark, [(100, [1.0], 1), (101, [1.0], 1), (102, [0.5], 2)]) == [(100, 101, 1, 102, 65536, 32768)]


def test_repeated_rows(spark):
    rows = [(100, [1.0], 1), (100, [1.0], 1), (101, [1.0], 1), (102, [0.5], 2), (102, [0.5], 2)]
    assert run(spark, rows) == [(100, 101, 1, 102, 65536, 32768), (100, 101, 2, 102, 65536, 32768)]


def test_large_components_are_exact(spark):
    rows = [(100, [3e6, 1.0], 1), (101, [2e6, 1.0], 1), (102, [1e6, 0.5], 2), (103, [1e6, 0.25], 2)]
    assert run(spark, rows) == brute(rows)


def test_buckets_out_of_reach_are_passed_over():
    """A bucket whose greatest norm cannot reach the window is not multiplied."""
    table = hn.pa.table({"vec_id": [100], "label": [1], "vector": [[256, 0]], "norm2": [65536.0]})
    anchors = hn.Anchors(table)
    done, plain = [], anchors.scores
    anchors.scores = lambda vectors, norm, which: done.append(len(which)) or plain(vectors, norm, which)
    search = hn.Search(anchors, np.array([0]), np.array([20_000]), np.array([60_000]), 2, same=False)
    ids, labels = np.arange(4), np.full(4, 2)
    search.bucket(ids, labels, np.array([[200, 0]] * 4), 200.0)
    assert sum(done) == 1 and search.last[0] == 51_200
    search.bucket(ids + 10, labels, np.array([[190, 0]] * 4), 190.0)  # below the running last score
    search.bucket(ids + 20, labels, np.array([[10, 0]] * 4), 10.0)
    assert sum(done) == 1
    search.bucket(ids - 10, labels, np.array([[200, 0]] * 4), 200.0)  # equal: smaller ids come in
    assert search.rows().column("vec_id").to_pylist() == [-10, -9]
