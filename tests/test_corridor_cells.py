"""Corridors far north: the window of stops, and points near each other next to a pole."""

import math
import random

from wayfold.operators import corridors

RAILS, STATIONS, STOPS = "corridor long, seq int, lng double, lat double", "corridor long, pos int, name string", "trip long, idx int, name string, lng double, lat double"


def _km(a, b):
    h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


def test_the_window_leaves_out_segments_that_begin_farther_off(spark):
    rails = spark.createDataFrame([(1, 0, 80.0, 89.0), (1, 1, 80.01, 89.0), (2, 0, 80.7, 89.0), (2, 1, 80.71, 89.0)], RAILS)
    stops = spark.createDataFrame([(1, 0, "a", 80.1, 89.0)], STOPS)
    stations = spark.createDataFrame([], STATIONS)
    found = lambda **k: {r.corridor for r in corridors.on_corridors(stops, rails, stations, 2.4, **k).collect()}
    assert found() == {1, 2} and found(window_deg=0.5) == {1}


def test_near_pairs_are_whole_next_to_the_pole(spark):
    rng = random.Random(5)
    points = [(c, rng.uniform(75, 115), rng.choice([rng.uniform(89.9, 90.1), rng.uniform(88, 92), rng.uniform(30, 30.1)])) for c in range(300)]
    df = spark.createDataFrame(points, "corridor long, lng double, lat double")
    pairs = corridors._near_pairs(df, df, 2.4)
    want = {(a[0], b[0]) for a in points for b in points if a[0] < b[0] and round(_km(a[1:], b[1:]), 9) <= 2.4}
    rows = [(r.a, r.b) for r in pairs.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 50
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
