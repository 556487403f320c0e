"""Polylines as rows (line_id, seq, lng, lat): lengths, segments, thinning, interpolation, gaps and turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from wayfold.functions.geo import bearing_deg, haversine_km


def _order() -> WindowSpec:
    return Window.partitionBy("line_id").orderBy("seq")


def with_cum_km(points: DataFrame) -> DataFrame:
    """Add cum_km, the length of the line up to each point."""
    step = haversine_km(F.lag("lng").over(_order()), F.lag("lat").over(_order()), F.col("lng"), F.col("lat"))
    return points.withColumn("_step", F.coalesce(step, F.lit(0.0))).withColumn("cum_km", F.sum("_step").over(_order().rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def segments(points: DataFrame) -> DataFrame:
    """Return a row per pair of neighbouring points: line_id, seg (from 1), a_*, b_*, cum_a, cum_b, and last."""
    p = with_cum_km(points).withColumn("seg", F.row_number().over(_order()))
    nxt = lambda c: F.lead(c).over(_order())
    p = p.select("line_id", "seg", F.col("lng").alias("a_lng"), F.col("lat").alias("a_lat"), F.col("cum_km").alias("cum_a"), nxt("lng").alias("b_lng"), nxt("lat").alias("b_lat"), nxt("cum_km").alias("cum_b"), nxt("seq").isNull().alias("_end"))
    p = p.withColumn("last", F.lead("_end").over(Window.partitionBy("line_id").orderBy("seg")))
    return p.where(~F.col("_end")).drop("_end")


def line_stats(points: DataFrame, buffer: float = 0.0) -> DataFrame:
    """Return points, length and the box of each line, widened by a buffer in km."""
    per = with_cum_km(points).groupBy("line_id").agg(
        F.count("*").alias("n_points"), F.max("cum_km").alias("length_km"), F.min("lng").alias("min_lng"), F.min("lat").alias("min_lat"), F.max("lng").alias("max_lng"), F.max("lat").alias("max_lat"))
    d_lat = F.lit(buffer / 111.32)
    d_lng = F.lit(buffer) / (111.32 * F.greatest(F.lit(0.2), F.cos(F.radians((F.col("min_lat") + F.col("max_lat")) / 2))))
    return per.withColumns({"min_lng": F.col("min_lng") - d_lng, "max_lng": F.col("max_lng") + d_lng, "min_lat": F.col("min_lat") - d_lat, "max_lat": F.col("max_lat") + d_lat})


def gaps(points: DataFrame, threshold_km: float) -> DataFrame:
    """Return the segments longer than a threshold."""
    return segments(points).withColumn("gap_km", F.col("cum_b") - F.col("cum_a")).where(F.col("gap_km") > threshold_km)


def sharp_turns(points: DataFrame, limit_deg: float = 150.0) -> DataFrame:
    """Return the points where the heading turns by the limit or more."""
    before = bearing_deg(F.lag("lng").over(_order()), F.lag("lat").over(_order()), F.col("lng"), F.col("lat"))
    after = bearing_deg(F.col("lng"), F.col("lat"), F.lead("lng").over(_order()), F.lead("lat").over(_order()))
    diff = F.abs(after - before)
    return points.withColumn("turn_deg", F.when(diff > 180, 360 - diff).otherwise(diff)).where(F.col("turn_deg") >= limit_deg)


def thin_evenly(points: DataFrame, most: int) -> DataFrame:
    """Keep at most so many points of a line, evenly spread, both ends among them."""
    n = F.count("*").over(Window.partitionBy("line_id"))
    at = F.row_number().over(_order()) - 1
    step = (F.col("_n") - 1) / F.lit(float(most - 1))
    picks = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * step + 0.5).cast("int"))
    rows = points.withColumns({"_n": n, "_at": at})
    return rows.where((F.col("_n") <= most) | F.array_contains(picks, F.col("_at").cast("int"))).drop("_n", "_at")


def densify(points: DataFrame, longest_km: float, every_km: float) -> DataFrame:
    """Fill segments longer than a limit with points at equal steps; ends stay as they are. seq becomes a double."""
    s = segments(points).withColumn("_len", F.col("cum_b") - F.col("cum_a"))
    parts = F.when(F.col("_len") > longest_km, F.ceil(F.col("_len") / every_km)).otherwise(F.lit(1)).cast("int")
    s = s.withColumn("_parts", parts).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_parts") - F.when(F.col("last"), 0).otherwise(1))))
    t = F.col("_k") / F.col("_parts")
    return s.select("line_id", (F.col("seg") + t).alias("seq"), (F.col("a_lng") + (F.col("b_lng") - F.col("a_lng")) * t).alias("lng"), (F.col("a_lat") + (F.col("b_lat") - F.col("a_lat")) * t).alias("lat"))


def at_km(points: DataFrame, wanted: DataFrame) -> DataFrame:
    """Interpolate points and headings at given distances. wanted: line_id, km; distances are clamped to the line.

    The join is on the line and the interval of its segment.
    """
    s = segments(points)
    total = s.groupBy("line_id").agg(F.max("cum_b").alias("_total"))
    w = wanted.join(total, "line_id").withColumn("_at", F.greatest(F.lit(0.0), F.least("km", "_total")))
    inside = (F.col("_at") >= F.col("cum_a")) & ((F.col("_at") < F.col("cum_b")) | (F.col("last") & (F.col("_at") <= F.col("cum_b"))))
    j = w.join(s, "line_id").where(inside)
    t = F.when(F.col("cum_b") > F.col("cum_a"), (F.col("_at") - F.col("cum_a")) / (F.col("cum_b") - F.col("cum_a"))).otherwise(0.0)
    return j.select("line_id", "km", (F.col("a_lng") + (F.col("b_lng") - F.col("a_lng")) * t).alias("lng"), (F.col("a_lat") + (F.col("b_lat") - F.col("a_lat")) * t).alias("lat"), bearing_deg(F.col("a_lng"), F.col("a_lat"), F.col("b_lng"), F.col("b_lat")).alias("heading"))


def anchors_every(points: DataFrame, step_km: float = 120.0) -> DataFrame:
    """Return the points of each line at every step, from 0 to its end."""
    total = with_cum_km(points).groupBy("line_id").agg(F.max("cum_km").alias("_t"))
    wanted = total.select("line_id", F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.col("_t") / step_km).cast("int")), lambda i: i * F.lit(step_km))).alias("km"))
    return at_km(points, wanted)


def monotone_breaks(rows: DataFrame, key: str, order: str, value: str, tolerance: float = 0.05) -> DataFrame:
    """Return the rows whose value falls below the highest before it by more than a tolerance."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_top", F.max(value).over(before)).where(F.col(value) < F.col("_top") - tolerance).drop("_top")


def islands(rows: DataFrame, key: str, order: list[Column], state: str) -> DataFrame:
    """Number the runs of equal neighbouring states per key: adds island, from 1."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.when(F.col(state).eqNullSafe(F.lag(state).over(w)), 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
