"""Nearest roads and vertices among many: the same as by brute force, without all pairs of a wide square."""

import math
import random

import pytest

from wayfold.operators import network, stitching


def _km(x, y, u, v):
    h = math.sin(math.radians(v - y) / 2) ** 2 + math.cos(math.radians(y)) * math.cos(math.radians(v)) * math.sin(math.radians(u - x) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(h))


@pytest.mark.parametrize("slack", [60.0, 1.0])
def test_nearest_roads_among_many(spark, monkeypatch, slack):
    rng = random.Random(6)
    spots = [(i % 7, 100 + 2 * rng.random(), 30 + 2 * rng.random()) for i in range(2500)] + [(9, 101.5, 31.5), (8, 110.0, 30.0), (7, 112.0, 31.0), (7, 112.0, 31.01)]
    points = [(i, 100 + 2 * rng.random(), 30 + 2 * rng.random()) for i in range(150)] + [(200, 101.5, 31.5), (201, 110.3, 30.2), (202, 112.0, 31.001), (203, 130.0, 30.0), (204, None, 30.0)]
    made, square = [], network._in_square
    monkeypatch.setattr(network, "_in_square", lambda *a: made.append(square(*a)) or made[-1])
    rows = network.nearest_roads(spark.createDataFrame(points, "id long, lng double, lat double"), spark.createDataFrame(spots, "key long, lng double, lat double"), 0.8, 5, slack).collect()
    want = {}
    for i, x, y in points[:-1]:
        seen = [(max(abs(math.floor(u / 0.8) - math.floor(x / 0.8)), abs(math.floor(v / 0.8) - math.floor(y / 0.8))), math.hypot((u - x) * math.cos(math.radians(y)), v - y) * 111, k) for k, u, v in spots]
        seen = [s for s in seen if s[0] <= 5]
        if seen:
            stop = next((r for r in range(5) if min([d for s, d, _ in seen if s <= r], default=1e9) <= r * 0.8 * 111 * 0.9), 5)
            best = sorted((min(d for s, d, k in seen if k == key and s <= stop), key) for key in {k for s, _, k in seen if s <= stop})
            want[i] = (math.floor(best[0][0] * 100 + 0.5) / 100, [k for d, k in best[:3] if d <= best[0][0] + slack])
    assert {r["id"]: (r["km"], r["keys"]) for r in rows} == want and len(rows) == len(want) and want[200][0] == 0
    assert sum(m.count() for m in made) < 150 * 2500 / 4


def test_nearest_vertices_among_many(spark):
    rng = random.Random(7)
    ways = [(w, i, 100 + rng.random() / 5, 30 + rng.random() / 5) for w in range(300) for i in range(3)] + [(900, 1, 100.1, 30.1), (800, 1, 100.0, 30.0), (800, 2, 100.1, 30.1), (901, 0, 103.0, 30.0)]
    places = [(i, 100 + rng.random() / 5, 30 + rng.random() / 5) for i in range(100)] + [(200, 100.1, 30.1), (201, 103.03, 30.01), (202, 105.0, 30.0)]
    got = stitching._nearest_vertex(spark.createDataFrame(places, "id long, lng double, lat double"), spark.createDataFrame(ways, "way long, seq long, lng double, lat double"), 4.0).collect()
    at = {(w, s): i for w in {r[0] for r in ways} for i, s in enumerate(sorted(s for v, s, *_ in ways if v == w))}
    want = {i: min((_km(x, y, u, v), w, at[w, s]) for w, s, u, v in ways) for i, x, y in places}
    assert {tuple(r) for r in got} == {(i, w, a) for i, (km, w, a) in want.items() if km <= 4.0} and len(got) == 102
