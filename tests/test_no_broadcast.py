"""Tables that grow with the input are not gathered in the driver, and cells next to a pole stay few."""

from pyspark.sql import functions as F

from wayfold.operators import corridor_match, corridors, lines, spatial, stitching
from wayfold.sources import scratch


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_tables_of_many_rows_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(scratch, "MOST_BROADCAST", 3)
    few, many = scratch.stored(spark.range(3), "few"), scratch.stored(spark.range(9), "many")
    assert "Broadcast" in _plan(few.join(spark.range(4), "id"))
    wide = many.select("id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k"))
    assert "Broadcast" not in _plan(wide.join(few, "id"))
    assert wide.join(few, "id").count() == 15
    assert "Broadcast" in _plan(scratch.stored(spark.range(9), "free", sort=False).join(few, "id"))


def test_cells_and_parts_of_small_tables_are_shuffled(spark):
    ways = spark.createDataFrame([(1, 1, 100.0, 30.0), (1, 2, 100.1, 30.0)], "way long, seq long, lng double, lat double")
    places = spark.createDataFrame([(7, 100.01, 30.0)], "id long, lng double, lat double")
    near = stitching._nearest_vertex(places, ways, 4.0)
    assert "Broadcast" not in _plan(near)
    assert [tuple(r) for r in near.collect()] == [(7, 1, 0)]
    names = spark.createDataFrame([("杭州东站",), ("嘉兴",)], "name string")
    like = corridor_match.like_names(names, names.withColumn("corridor", F.lit(1)))
    assert "Broadcast" not in _plan(like)
    assert sorted(r["name"] for r in like.collect()) == ["嘉兴", "杭州东站"]


def test_window_keeps_cells_few_next_to_a_pole(spark):
    rails = spark.createDataFrame([(1, i, 100.0 + 0.03 * i, 89.7 + 0.01 * i) for i in range(4)], "corridor long, seq long, lng double, lat double")
    segs = lines.segments(rails.withColumnRenamed("corridor", "line_id"))
    narrow = spatial.segment_cells(segs, 20.0, 0.36, 0.5).groupBy("seg").count().agg(F.max("count")).first()[0]
    assert narrow <= 16 < spatial.segment_cells(segs, 20.0, 0.36).groupBy("seg").count().agg(F.max("count")).first()[0]
    stops = spark.createDataFrame([(1, i, 99.3 + 0.1 * i, 89.4 + 0.04 * i) for i in range(16)], "trip long, idx int, lng double, lat double")
    keys = ["id.idx", "seg"]
    some = {tuple(r) for r in corridors.near_segments(stops, rails, 20.0, 0.5).select(*keys).collect()}
    inside = (F.abs(F.col("lat") - F.col("a_lat")) < 0.5) & (F.abs(F.col("lng") - F.col("a_lng")) < 0.5)
    assert some == {tuple(r) for r in corridors.near_segments(stops, rails, 20.0).where(inside).select(*keys).collect()} and some
