"""Searches in a task against a plain one: many small components in a task, origins of a large one in several, and what no task holds."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_routing import EDGES, dijkstra
from wayfold.operators import graph, routing, search


@pytest.mark.parametrize(("own", "most", "work"), [(5_000, 4_000_000, 10**8), (0, 4_000_000, 2_000), (5, 100, 10**8)])
def test_costs_and_paths_of_copies_and_components(spark, monkeypatch, own, most, work):
    monkeypatch.setattr(search, "OWN_EDGES", own)
    monkeypatch.setattr(search, "MOST_EDGES", most)
    monkeypatch.setattr(search, "TASK_WORK", work)
    monkeypatch.setattr(search, "DENSE", 3)
    monkeypatch.setattr(search, "AT_ONCE", 50)
    rng = random.Random(own)
    # A dense part, small rings, and in the second copy other costs and some edges less.
    pairs = {tuple(sorted((rng.randrange(40), rng.randrange(40)))) for _ in range(160)} | {(100 * k + i, 100 * k + (i + 1) % 5) for k in range(1, 9) for i in range(5)}
    pairs = sorted({tuple(sorted(p)) for p in pairs if p[0] != p[1]})
    copies = {g: [(a, b, float(rng.choice([1, 2, 5, 17]))) for a, b in pairs if not g or (a + b) % 7] for g in (0, 1)}
    asked = {(g, rng.randrange(40), rng.randrange(40)) for g in (0, 1) for _ in range(20)} | {(g, 100 * k, 100 * k + 2) for g in (0, 1) for k in range(1, 9)} | {(0, 7777, 7777), (0, 1, 100), (1, 7777, 3)}
    df = spark.createDataFrame([(g, a, b, w, w, 0) for g, edges in copies.items() for a, b, w in edges], EDGES)
    rows = routing.routes(routing.with_ids(df), spark.createDataFrame(sorted(asked), "g int, origin long, dest long")).collect()
    got: dict = {}
    for r in rows:
        got.setdefault((r["g"], r["origin"], r["dest"]), {})[r["back"]] = (r["node"], r["cost"])
    for g, origin, dest in asked:
        cost, near = dijkstra(copies[g], origin)
        if dest not in cost:
            assert (g, origin, dest) not in got
            continue
        way = [dest]
        while way[-1] != origin:
            way.append(min(b for b, w in near[way[-1]] if b in cost and cost[b] + w == cost[way[-1]]))
        assert got[g, origin, dest] == {i: (n, cost[n]) for i, n in enumerate(way)}
    assert sum(map(len, got.values())) == len(rows)

    origins = [*range(0, 40, 3), 100, 302, 999]
    edges = spark.createDataFrame(copies[0], "lo long, hi long, w double")
    nodes = spark.createDataFrame([(o,) for o in origins], "node long")
    want = {(o, n, c) for o in origins for n, c in dijkstra(copies[0], o)[0].items()}
    for bound in (None, 6.0):
        found = graph.shortest_paths(edges, nodes, bound).collect()
        assert {tuple(r) for r in found} == {w for w in want if bound is None or w[2] <= bound} and len(found) == len({tuple(r) for r in found})


def test_paths_need_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(routing, "contract", lambda *a: pytest.fail("contracted"))
    monkeypatch.setattr(graph, "settled_costs", lambda *a, **k: pytest.fail("searched in rounds"))
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(300)], "lo long, hi long, w double")
    assert routing.cheapest_routes(edges, spark.createDataFrame([(0, 300)], "origin long, dest long")).count() == 301
    assert graph.shortest_paths(edges, spark.range(1).select(F.col("id").alias("node"))).count() == 301


def test_components_of_what_lies_close(spark, monkeypatch):
    """Stars of a few edges each, and rounds over those that share nodes only: the same as rounds over all."""
    monkeypatch.setattr(search, "AT_HAND", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    rng = random.Random(9)
    edges = [(i, i + rng.choice([1, 2, 3])) for i in range(0, 400, 2)] + [(rng.randrange(400), rng.randrange(400)) for _ in range(40)] + [(-10 - i, 5 * i) for i in range(90)] + [(7, 7), (1000, 1000)]
    df = spark.createDataFrame(edges, "a long, b long")
    rounds, seen = graph.components, []
    want = {tuple(r) for r in rounds(df, "a", "b").collect()}
    monkeypatch.setattr(graph, "components", lambda e, *a: seen.append(e.distinct().count()) or rounds(e, *a))
    got = graph.near_components(df, "a", "b").collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {tuple(r) for r in got} == want and len(got) == len(want) and 0 < seen[0] < len(edges)
    assert graph.near_components(df.limit(0), "a", "b").count() == 0
