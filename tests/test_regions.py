"""Polygons with holes against a plain ray cast, and covers of dense groups against the one-by-one choice."""

import math
import random

import pytest

from wayfold.operators import matching, poi, regions
from wayfold.operators.cleaning import _km

CORNERS = "region long, poly int, ring int, seq int, lng double, lat double"


def star(rng, x, y, r, n):
    return [(x + r * rng.uniform(0.3, 1) * math.cos(2 * math.pi * k / n), y + r * rng.uniform(0.3, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]


def inside(lng, lat, ring):
    odd = False
    for k, (ax, ay) in enumerate(ring):
        bx, by = ring[k - 1]
        if (ay > lat) != (by > lat) and lng < (bx - ax) * (lat - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def plain(points, shapes):
    out = set()
    for i, lng, lat in points:
        for region, polys in shapes.items():
            if any(inside(lng, lat, rings[0]) and not any(inside(lng, lat, h) for h in rings[1:]) for rings in polys):
                out.add((i, region))
    return out


@pytest.mark.parametrize("size", [0.05, 0.3, 2.0])
def test_points_in_regions(spark, size):
    rng = random.Random(3)
    shapes = {}
    for region in range(12):
        x, y = rng.uniform(0, 6), rng.uniform(-3, 3)
        polys = [[star(rng, x, y, 1.5, 17), star(rng, x, y, 0.3, 5)], [star(rng, x + 2, y, 0.5, 4)]]
        shapes[region] = polys
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]  # edges along the lines between cells
    shapes[50], shapes[51] = [[square]], [[[(0.25, 0.25), (0.75, 0.25), (0.75, 0.75), (0.25, 0.75)], [(0.3, 0.3), (0.6, 0.3), (0.3, 0.6)]]]
    points = [(i, rng.uniform(-2, 9), rng.uniform(-5, 5)) for i in range(3000)]
    points += [(5000 + i, x, y) for i, (x, y) in enumerate((a / 4, b / 4) for a in range(6) for b in range(6))]  # corners and edges
    rows = [(r, p, k, s, *c) for r, polys in shapes.items() for p, rings in enumerate(polys) for k, ring in enumerate(rings) for s, c in enumerate(ring)]
    df = spark.createDataFrame([*points, (9999, None, 1.0), (9998, float("nan"), 1.0)], "id long, lng double, lat double")
    got = regions.points_in_regions(df, spark.createDataFrame(rows, CORNERS), size)
    assert {tuple(r) for r in got.collect()} == plain(points, shapes)


def test_first_regions_are_those_of_all_regions(spark, monkeypatch):
    """Regions upon each other: a point meets the first of those that hold its cell, not all of them."""
    rng, tables, kept = random.Random(8), {}, regions.stored
    monkeypatch.setattr(regions, "stored", lambda df, name, **k: tables.setdefault(name, kept(df, name, **k)))
    corners = [(r, 0, 0, k, x, y) for r in range(60) for k, (x, y) in enumerate(star(rng, 100 + rng.uniform(-0.3, 0.3), 30 + rng.uniform(-0.3, 0.3), 0.8, 7))]
    corners += [(r, 0, 1, k, 100 + 0.05 * x, 30 + 0.05 * y) for r in range(0, 60, 3) for k, (x, y) in enumerate([(1, 1), (-1, 1), (-1, -1), (1, -1)])]
    corners = spark.createDataFrame(corners, "region long, poly long, ring long, seq long, lng double, lat double")
    points = spark.createDataFrame([(i, 100 + rng.uniform(-1.2, 1.2), 30 + rng.uniform(-1.2, 1.2)) for i in range(400)], "id long, lng double, lat double")
    area = {r: None if r == 7 else float(r * 5 % 4) for r in range(60) if r != 11}
    named = spark.createDataFrame(list(area.items()), "region long, area double")
    got = {tuple(r) for r in regions.first_regions(points, corners, named).collect()}
    assert tables["open-cells"].count() < 0.7 * tables["cover"].where("NOT whole").count()
    tables.clear()
    held = {}
    for id_, region in (tuple(r) for r in regions.points_in_regions(points, corners).collect()):
        if region in area:
            held.setdefault(id_, []).append((area[region] is not None, area[region] or 0.0, region))
    assert got == {(i, min(v)[2]) for i, v in held.items()} and len(got) > 100


def test_seats_and_empty_tables(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 0.0), (3, 20.0, 0.0), (4, None, 0.0)], "id long, lng double, lat double")
    seats = spark.createDataFrame([("near", "A", 0.1, 0.0), ("far", "A", 12.9, 0.0), ("wide", "W", 25.5, 0.0)], "place string, province string, lng double, lat double")
    none = spark.createDataFrame([], CORNERS)
    named = spark.createDataFrame([], "region long, place string, province string, area double")
    out = {r["id"]: r["place"] for r in regions.place_of(points, none, named, seats, ("W",)).collect()}
    assert out == {1: "near", 2: None, 3: "wide", 4: None}


@pytest.mark.parametrize("km", [1.0, 25.0])
def test_cover_equals_the_sequential_choice(spark, km):
    rng = random.Random(int(km))
    span = km / 30
    items = [(i, rng.choice("ab"), rng.randrange(40), 100 + rng.uniform(0, span), rng.choice([30, 61, -70]) + rng.uniform(0, span)) for i in range(700)]
    want, kept = {}, {"a": [], "b": []}
    for i, g, r, x, y in sorted(items, key=lambda t: (t[2], t[0])):
        hit = next((k for k in kept[g] if _km(x, y, k[1], k[2]) <= km), None)
        want[i] = hit[0] if hit else None
        if not hit:
            kept[g].append((i, x, y))
    got = matching.greedy_cover(spark.createDataFrame(items, "id long, grp string, rank int, lng double, lat double"), km)
    assert {r["id"]: r["kept_by"] for r in got.collect()} == want
    assert matching.greedy_cover(spark.createDataFrame([], "id long, grp string, rank int, lng double, lat double"), km).count() == 0


def test_backfill_fills_only_what_is_empty(spark):
    rows = [(1, "a", 9.0, None, "", 0.0), (2, "a", 5.0, "x", "y", 4.0), (3, "a", 7.0, None, "z", 3.0), (4, "b", 1.0, None, None, 0.0)]
    spots = spark.createDataFrame(rows, "id long, name string, rank double, tel string, url string, rating double")
    kept = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, None)], "id long, kept_by long")
    got = {r["id"]: (r["tel"], r["url"], r["rating"]) for r in poi.backfill(spots, kept, ["tel", "url", "rating"], "rating").collect()}
    assert got == {1: ("x", "z", 3.0), 4: (None, None, 0.0)}


def test_peaks_of_a_family_are_one(spark):
    rows = [(1, "洛子峰", 100.0, 30.0, "nature.mountain"), (2, "洛子中一峰", 100.02, 30.0, "nature.mountain"), (3, "洛子东", 100.0, 30.02, "culture.temple"), (4, "洛子西峰", 100.2, 30.0, "nature.mountain"), (5, "别山", 100.001, 30.0, "nature.canyon")]
    df = spark.createDataFrame(rows, "id long, name string, lng double, lat double, category string")
    assert {r["id"]: r["group"] for r in poi.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    assert {r["id"]: r["group"] for r in poi.near_duplicates(df.drop("category")).collect()} == {i: i for i in range(1, 6)}
