"""Nearest neighbours among many: the same as by brute force, without all pairs of a wide square."""

import math
import random

from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import lines, network, spatial


def test_nearest_node_among_many(spark, monkeypatch):
    rng = random.Random(5)
    nodes = [(i, 100 + rng.random() / 2, 30 + rng.random() / 2, i % 4 > 0) for i in range(1500)] + [(1500 + i, 110 + i / 10, 30.0, False) for i in range(5)] + [(2000, 100.25, 30.25, True), (2001, 100.25, 30.25, True)]
    points = [(i, 100 + rng.random() / 2, 30 + rng.random() / 2) for i in range(150)] + [(200, 101.7, 30.2), (201, 110.21, 30.1), (202, 120.0, 30.0), (203, 100.25, 30.25), (204, None, 30.0)]
    made, square = [], network._in_square
    monkeypatch.setattr(network, "_in_square", lambda *a: made.append(square(*a)) or made[-1])
    got = {r["id"]: r["node"] for r in network.nearest_node(spark.createDataFrame(points, "id long, lng double, lat double"), spark.createDataFrame(nodes, "node long, lng double, lat double, main boolean"), 200.0, 1.0).collect()}
    want = {}
    for i, x, y in points[:-1]:
        near = [(not main, (lng - x) ** 2 + (lat - y) ** 2, n) for n, lng, lat, main in nodes if abs(math.floor(lng) - math.floor(x)) <= 3 and abs(math.floor(lat) - math.floor(y)) <= 3]
        if near and math.sqrt(min(near)[1]) * 111 * math.cos(math.radians(y)) <= 200:
            want[i] = min(near)[2]
    assert got == want and got[203] == 2000
    assert sum(m.count() for m in made) < 150 * 1500 / 10


def _lines_and_points(spark, n):
    rng = random.Random(8)
    # Long segments that cross everywhere, on three lines; one line lies far from some of the points.
    line = [(k % 3, k, 100 + 4 * rng.random(), 30 + 3 * rng.random()) for k in range(n)] + [(3, 1, 104.3, 33.2), (3, 2, 104.3, 33.2), (3, 3, 104.8, 33.2)]
    points = [(i, 100 + 4 * rng.random(), 30 + 3 * rng.random()) for i in range(200)] + [(900, 104.5, 33.3), (901, 120.0, 30.0), (902, None, 30.0)]
    return spark.createDataFrame(line, "line_id long, seq long, lng double, lat double"), spark.createDataFrame(points, "id long, lng double, lat double")


def test_nearest_pairs_are_those_of_all_pairs(spark, monkeypatch):
    line, points = _lines_and_points(spark, 240)
    segs = lines.segments(line).localCheckpoint()
    every = points.crossJoin(segs)
    for lines_kept, distance, planar, project in (("line_id = 0", spatial.perp_km(), True, spatial.nearest_segment), ("true", spatial.perp_km(), True, spatial.nearest_segment), ("true", network.degree_km(), False, None)):
        def found(pairs):
            if project:
                return {tuple(r) for r in project(pairs, ["line_id", "id"], ["lng", "lat"]).where("dist_km <= 35").select("line_id", "id", "along_km", "dist_km").collect()}
            return {(r[0], r[1], round(r[2], 6), round(r[3], 6)) for r in network.project_in_degrees(pairs, ["line_id", "id"]).where("km <= 35").collect()}
        near = spatial.nearest_pairs(points, segs.where(lines_kept), 35.0, distance, planar, F.lit(35.0))
        assert found(near) == found(every.where(lines_kept))
        # What is carried on is a row per point and line, or two where segments meet, not all pairs.
        assert near.count() <= 2 * near.select("id", "line_id").distinct().count()


def test_cells_of_segments_come_once_and_hold_what_is_near(spark):
    line, points = _lines_and_points(spark, 60)
    segs = lines.segments(line)
    for km, size in ((35.0, 0.5), (2.0, 0.1)):
        cells = spatial.segment_cells(segs, km, size).select("line_id", "seg", "cx", "cy")
        assert cells.count() == cells.distinct().count()
        near = points.crossJoin(segs).where(spatial.perp_km() <= km * 0.98)
        near = near.withColumns({"cx": geo.cell(F.col("lng"), -180.0, size), "cy": geo.cell(F.col("lat"), -90.0, size)}).select("line_id", "seg", "cx", "cy").distinct()
        assert near.count() > 0 and near.join(cells, ["line_id", "seg", "cx", "cy"], "left_anti").count() == 0
