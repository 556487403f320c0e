"""Searches with 64 origins in a row against a plain one."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_routing import dijkstra
from wayfold.operators import graph


def _graph(rng, n, weights):
    return [(a, b, rng.choice(weights)) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(4 * n)) if a != b] + [(2 * n, 2 * n + 1, weights[0])]


@pytest.mark.parametrize("weights", [[1.0, 2.0, 5.0, 17.0], [0.1, 0.2, 0.7, 1.3], [0.0, 0.001, 3.0, 90.5]])
def test_all_costs(spark, weights):
    rng = random.Random(len(weights) + int(10 * weights[2]))
    edges = _graph(rng, 40, weights)
    origins = [*range(40), 80, 999]
    got = graph.shortest_paths(spark.createDataFrame(edges, "lo long, hi long, w double"), spark.createDataFrame([(o,) for o in origins], "node long")).collect()
    want = {(o, n, c) for o in origins for n, c in dijkstra(edges, o)[0].items()}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_few_rows_carry_all_origins(spark):
    # One row per node and cost of a block of 64 origins; a row per origin and node would be 64 * 65.
    edges = spark.createDataFrame([(1000, i, 1.0) for i in range(64)], "lo long, hi long, w double")
    arcs = graph._arcs(edges).select(F.lit(0).alias("g"), "node", "to", "w")
    origins = graph.numbered(spark.range(64).select(F.lit(0).alias("g"), F.col("id").alias("origin")).coalesce(1))
    costs = graph.settled_costs(arcs, origins)
    blocks = origins.select("block").distinct().count()
    assert costs.count() <= 3 * 65 * blocks and graph.by_origin(costs, origins).count() == 64 * 65
