"""Paths of ways in a task: the same as in rounds over whole tables, also where many ways end in one place."""

import random

import pytest

from wayfold.operators import search, stitching


def _ways(rng):
    rows = []
    for w in range(150):
        x, y, d = rng.randrange(6), rng.randrange(6), rng.randrange(2)
        ends = [(x, y), (x + d, y + 1 - d)]
        rng.shuffle(ends)
        rows += [(w, i, 100 + 0.01 * u + 0.0004 * rng.randrange(3), 30 + 0.01 * v) for i, (u, v) in enumerate(ends)]
    return rows + [(500, 0, 103.0, 30.0), (500, 1, 103.01, 30.0), (501, 0, 103.01, 30.0), (501, 1, 103.02, 30.0), (502, 0, 104.0, 30.0), (502, 1, 104.0, 30.0)]


def test_paths_in_tasks_are_those_of_rounds(spark, monkeypatch):
    rng = random.Random(4)
    points = spark.createDataFrame(_ways(rng), "way long, seq long, lng double, lat double").localCheckpoint()
    at = lambda: (100 + 0.06 * rng.random(), 30 + 0.06 * rng.random())
    pairs = [(i, *at(), *at()) for i in range(40)] + [(90, 103.001, 30.0, 103.019, 30.0), (91, 103.001, 30.0, 100.0, 30.0), (92, 103.0, 30.0, 103.001, 30.0), (93, 104.0, 30.0, 103.0, 30.0)]
    pairs = spark.createDataFrame(pairs, "pair long, a_lng double, a_lat double, b_lng double, b_lat double")
    rounds = stitching._paths_in_rounds
    monkeypatch.setattr(stitching, "_paths_in_rounds", lambda *a: pytest.fail("searched in rounds"))
    got = stitching.way_paths(points, pairs, 4.0, 0.0015).collect()
    monkeypatch.setattr(stitching, "_paths_in_rounds", rounds)
    monkeypatch.setattr(search, "MOST_EDGES", 0)
    want = stitching.way_paths(points, pairs, 4.0, 0.0015).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in want} and len(got) == len(want) > 100
    assert {r["pair"] for r in got} >= {90, 92} and not {r["pair"] for r in got} & {91, 93}
