"""Nearest segments on the sphere across the 180th meridian and around the poles: the same as by all pairs."""

import random

from pyspark.sql import functions as F

from wayfold.operators import lines, network, spatial


def test_segments_are_met_across_the_meridian_and_the_poles(spark):
    rng = random.Random(3)
    line = [(0, k, 179.0 + 0.9 * rng.random(), 10.0 + k / 10) for k in range(8)] + [(1, k, -179.9 + 0.2 * k, 10.3) for k in range(4)]
    line += [(2, k, 60.0 * k - 170.0, 89.8 - 0.05 * k) for k in range(4)] + [(3, k, 20.0 + k / 4, -89.7) for k in range(4)]
    points = [(x, (-180.0 if rng.random() < 0.5 else 179.0) + rng.random(), 10.0 + rng.random()) for x in range(60)]
    points += [(100 + x, 360 * rng.random() - 180, 89.4 + 0.6 * rng.random()) for x in range(60)] + [(200 + x, 360 * rng.random() - 180, -89.4 - 0.6 * rng.random()) for x in range(60)]
    points = spark.createDataFrame(points, "id long, lng double, lat double")
    segs = lines.segments(spark.createDataFrame(line, "line_id long, seq long, lng double, lat double")).localCheckpoint()

    def found(pairs):
        return {(r[0], r[1], round(r[2], 6), round(r[3], 6)) for r in network.project_in_degrees(pairs, ["line_id", "id"]).where("km <= 40").collect()}

    near = spatial.nearest_pairs(points, segs, 40.0, network.degree_km(), False, F.lit(40.0)).localCheckpoint()
    want = found(points.crossJoin(segs))
    assert found(near) == want and {line_id for line_id, *_ in want} == {0, 1, 2, 3}
    assert near.count() == near.select("id", "line_id", "seg").distinct().count()
