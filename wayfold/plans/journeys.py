"""Queries over timetables, positions, skies and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.functions import motion, names, sky
from wayfold.functions.geo import haversine_km
from wayfold.operators import graph, lines, routing, trips
from wayfold.plans.tables import COSTS, derived, epoch_ms, floored, hav, rounded, table, with_tables
from wayfold.streaming import live


def _sections(spark: SparkSession, d: str) -> DataFrame:
    c = F.element_at(F.array(*[F.lit(x) for x in ("G", "D", "C", "Z", "T", "K", "X")]), F.col("l_linenumber").cast("int"))
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("ds"), (F.col("l_quantity") * 40).alias("dt"), names.train_class(c).alias("class"))
    p = motion.profile(F.col("class"), hub=F.col("l_orderkey") % 5 == 0)
    return l.withColumns({k: p[k] for k in ("v_cap", "a_acc", "a_dec")})


def _solved(spark: SparkSession, d: str) -> DataFrame:
    s = _sections(spark, d)
    for step in motion.trapezoid():
        s = s.withColumns(step)
    return s


def sections(spark, d):
    s = _solved(spark, d).select("l_orderkey", "l_linenumber", "v", "degraded", "slack", "total_s", motion.min_section_time(F.col("ds"), F.col("v_cap"), F.col("a_acc"), F.col("a_dec")).alias("least_s"))
    return floored(s)


def section_curve(spark, d):
    """Times and speeds at a third of each section, and the way back from time to place."""
    s = _solved(spark, d).withColumn("x", F.col("ds") / 3).withColumn("t", motion.tau(F.col("x")))
    return floored(s.select("l_orderkey", "l_linenumber", "t", motion.speed_at(F.col("x")).alias("speed"), (F.abs(motion.tau_inverse(F.col("t")) - F.col("x")) < 0.01).alias("comes_back")))


def _anchored(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", ((F.col("event_id") * 37) % 1000).cast("double").alias("km"), F.when(F.col("event_type") == "error", F.col("value") * 20 - 300).alias("delta"))
    return e


def delays(spark, d):
    """Delay at each point of a trip from the anchors around it: the first's before, linear between, drifting after the last."""
    w = Window.partitionBy("user_id").orderBy("km", "event_id")
    a = F.when(F.col("delta").isNotNull(), F.struct("km", "delta"))
    e = _anchored(spark, d).withColumn("_a", F.last(a, ignorenulls=True).over(w)).withColumn("_b", F.first(a, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    plan_s = (F.col("km") - F.col("_a.km")) * 36
    beyond = F.greatest(F.lit(-300.0), F.least(F.col("_a.delta") + 0.4 * 60 * plan_s / 3600, F.least(F.col("_a.delta") + 0.5 * plan_s, F.lit(10800.0))))
    span = F.col("_b.km") - F.col("_a.km")
    between = F.when(span > 0, F.col("_a.delta") + (F.col("_b.delta") - F.col("_a.delta")) * (F.col("km") - F.col("_a.km")) / span).otherwise(F.col("_a.delta"))
    value = F.when(F.col("_a").isNull(), F.coalesce(F.col("_b.delta"), F.lit(0.0))).when(F.col("_b").isNull(), beyond).otherwise(between)
    return rounded(e.select("event_id", value.alias("delay_s")), 7)


def arrivals(spark, d):
    """Arrival estimates: plan blended with measured speed, half widths and confidence."""
    e = table(spark, d, "events").select("event_id", F.col("value"), (F.col("event_id") % 300 / 60).alias("plan_h"), (F.col("event_id") % 7 * 60).cast("double").alias("gap"))
    wgt = F.exp(-F.col("plan_h") / motion.TAU_H)
    sigma = motion.eta_sigma(F.lit(1.0), F.lit(0.35), F.col("plan_h"), F.lit(150.0), F.col("value"), F.col("gap"))
    return rounded(e.select("event_id", (wgt * F.col("value") * 10 + (1 - wgt) * 120).alias("shift_s"), sigma.alias("sigma_min"), motion.confidence(sigma).alias("confidence")), 4)


def isotonic(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("x"), (F.col("o_orderkey") % 3).cast("double").alias("w"))
    return rounded(trips.isotonic(o, "o_custkey", "o_orderkey", "x", "w").select("o_orderkey", "fitted"), 6)


def time_filled(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("x"), F.floor(epoch_ms("o_orderdate") / 1000).alias("t"))
    return rounded(trips.fill_by_time(o, "o_custkey", "o_orderkey", "x", "t").select("o_orderkey", "filled"), 6)


def day_rollover(spark, d):
    """Days passed on a trip by clock times that fall back."""
    e = table(spark, d, "events").select("user_id", "event_id", (F.hour("ts") * 60 + F.minute("ts")).alias("clock"))
    w = Window.partitionBy("user_id").orderBy("event_id")
    back = F.when(F.col("clock") < F.lag("clock").over(w), 1).otherwise(0)
    return e.withColumn("b", back).withColumn("day", F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, 0))).select("event_id", "day")


def phases(spark, d):
    """Runs of equal event types per user: gaps and islands."""
    e = lines.islands(table(spark, d, "events"), "user_id", [F.col("ts"), F.col("event_id")], "event_type")
    return e.groupBy("user_id", "island", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def progress_breaks(spark, d):
    return lines.monotone_breaks(table(spark, d, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value", 20.0).select("event_id")


def nearest_hour(spark, d):
    """The hourly sample nearest in time, within 45 minutes, the earlier on a tie: an as-of join by hour buckets."""
    e = table(spark, d, "events").select("event_id", F.floor(epoch_ms("ts") / 1000).alias("s"))
    hours = table(spark, d, "events").groupBy(F.floor(F.floor(epoch_ms("ts") / 1000) / 3600).alias("h")).agg(F.max("event_id").alias("sample")).where("sample % 3 <> 0")
    left = e.withColumn("h", F.explode(F.array(F.floor(F.col("s") / 3600), F.floor(F.col("s") / 3600) + 1)))
    near = left.join(hours, "h").withColumn("gap", F.abs(F.col("h") * 3600 - F.col("s"))).where("gap <= 2700")
    best = near.groupBy("event_id").agg(F.min_by("sample", F.struct("gap", "h")).alias("sample"), F.min("gap").alias("gap"))
    return e.select("event_id").join(best, "event_id", "left")


def minute_counts(spark, d):
    return live.counts_per_minute(table(spark, d, "events"), "ts", "event_type", 60)


def radar(spark, d):
    """The two nearest highlights ahead of each position within a look-ahead that grows with speed."""
    p = table(spark, d, "events").select("event_id", ((F.col("event_id") * 53) % 300).cast("double").alias("km"), (F.col("value") * 1.3).alias("kmh"))
    h = table(spark, d, "nation").select(F.col("n_name").alias("highlight"), ((F.col("n_nationkey") * 41) % 300).cast("double").alias("at_km"), (F.col("n_nationkey") % 2 == 0).alias("worth"), (F.col("n_nationkey") % 3 == 0).alias("park"))
    j = p.join(F.broadcast(h)).withColumn("ahead", F.col("at_km") - F.col("km") + F.when(F.col("at_km") < F.col("km"), 300.0).otherwise(0.0))  # a route's few highlights
    band = motion.speed_band(F.col("kmh"))
    ok = F.when(band == "fast", F.col("worth")).when(band == "slow", F.col("park")).otherwise(F.col("worth") | F.col("park"))
    j = j.where((F.col("ahead") <= motion.lookahead_km(F.col("kmh"))) & ok)
    nr = F.row_number().over(Window.partitionBy("event_id").orderBy("ahead", "highlight"))
    return j.withColumn("nr", nr.cast("int")).where("nr <= 2").select("event_id", "nr", "highlight", "ahead")


def sky_scores(spark, d):
    v = lambda k, m, s: ((F.col("event_id") * k) % m).cast("double") / s
    low, mid, high, total, vis, hum, rain, wind, temp = v(7, 101, 100), v(11, 97, 96), v(13, 89, 88), v(17, 83, 82), v(19, 30, 1), v(23, 71, 70), v(29, 61, 60), v(31, 12, 1), v(37, 40, 1) - 20
    alt, share, moon_alt, bortle = v(41, 120, 1) - 60, v(43, 53, 52), v(47, 140, 1) - 60, F.col("event_id") % 9 + 1
    e = table(spark, d, "events")
    scores = {"glow": sky.glow_index(low, mid, high, total, vis, hum, rain), "star": sky.star_index(total, vis, alt, share, moon_alt, bortle), "rainbow": sky.rainbow_index(total, rain, alt), "moon": sky.moon_index(total, share, moon_alt),
              "cloud_sea": sky.cloud_sea_index(low, hum, wind, vis * 100), "rime": sky.rime_index(temp, hum, wind, rain)}
    return e.select("event_id", *[c.alias(n) for n, c in scores.items()], sky.band(scores["glow"]).alias("glow_band"), sky.view_hint(F.col("event_id") % 31 == 0, vis, total, rain, F.col("event_id") % 2 == 0).alias("view"))


def sun_and_moon(spark, d):
    ms = F.floor(epoch_ms("ts") / 1000) * 1000
    lng, lat = 80.0 + (F.col("event_id") % 40).cast("double"), 20.0 + (F.col("user_id") % 30).cast("double")
    rise, down = sky.sun_hours(lng, lat, sky.day_of_year(F.col("ts")))
    e = table(spark, d, "events").select("event_id", sky.altitude(lng, lat, ms, sky.sun_equatorial(ms)).alias("sun_alt"), sky.altitude(lng, lat, ms, sky.moon_equatorial(ms)).alias("moon_alt"), sky.moon_light(ms).alias("moon_light"), sky.moon_phase(ms).alias("phase"), rise.alias("rise_h"), down.alias("set_h"))
    return rounded(e, 3)


def night_light(spark, d):
    """Light of the places around each spot and the class of its night sky; the places are a small dimension."""
    s, p = derived(spark, d, "spots"), derived(spark, d, "places").select(F.col("lng").alias("p_lng"), F.col("lat").alias("p_lat"), (F.length("place") / 10).alias("w"))
    j = s.join(F.broadcast(p)).withColumn("km", haversine_km(F.col("lng"), F.col("lat"), F.col("p_lng"), F.col("p_lat"), 6371.0088))
    light = j.groupBy("id").agg(F.sum(F.col("w") * F.exp(-F.col("km") / (12 + 34 * F.col("w")))).alias("light"))
    return rounded(light.select("id", "light", sky.bortle_class(F.col("light")).cast("int").alias("bortle")), 4)


def flights(spark, d):
    p = derived(spark, d, "lines")
    s = lines.segments(p).withColumn("km", F.col("cum_b") - F.col("cum_a"))
    return s.select("line_id", "seg", motion.cruise_altitude_m(F.col("km")).cast("int").alias("altitude"), motion.flight_minutes(F.col("km")).alias("minutes"))


def _edges(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    e = l.select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(w).alias("b"), "l_orderkey").where("b IS NOT NULL")
    return graph.undirected(e.select("a", "b", (F.abs(F.col("a") - F.col("b")) % 17 + 1).cast("double").alias("w"), (F.col("l_orderkey") % 4 == 0).alias("fast"), F.col("l_orderkey").alias("line")))


def graph_edges(spark, d):
    return _edges(spark, d)


def graph_components(spark, d):
    return graph.components(_edges(spark, d)).groupBy("label").agg(F.count("*").alias("size"))


def graph_paths(spark, d):
    """Costs from every fiftieth node, the stated query set, to all that it reaches."""
    e = _edges(spark, d)
    return graph.shortest_paths(e, graph.nodes(e).where("node % 50 = 0"))


def multi_stop_route(spark, d):
    """The nodes between stops that follow each other, at every fiftieth node, from the last one back."""
    e = _edges(spark, d)
    stops = graph.nodes(e).where("node % 50 = 0")
    out = routing.cheapest_routes(e, stops.select(F.col("node").alias("origin"), (F.col("node") + 50).alias("dest")))
    return out.withColumn("back", F.col("back").cast("int"))


def simplified(spark, d):
    return trips.simplify(derived(spark, d, "points"), 50_000.0).select("line_id", "seq")


def crowd_thinned(spark, d):
    s = derived(spark, d, "spots").select("id", "lng", "lat", "score")
    return trips.thin_crowded(s, F.concat_ws(":", F.floor(F.col("lng") / 4).cast("string"), F.floor(F.col("lat") / 4).cast("string")), 150.0).select("id")


def position_fusion(spark, d):
    e = table(spark, d, "events")
    t = F.floor(epoch_ms("ts") / 1000).cast("double")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fixes = e.select(F.col("user_id").alias("trip"), t.alias("t"), F.when(F.col("event_id") % 4 == 0, F.lit(float("nan"))).otherwise((F.row_number().over(w) * 900).cast("double")).alias("z"), F.col("value").alias("accuracy"), (F.col("event_id") % 1000).cast("double").alias("off"))
    return rounded(trips.fused(fixes, 86.0, 60.0), 3)


def track_points(spark, d):
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    s = e.select(F.col("user_id").alias("trip"), epoch_ms("ts").alias("ts"), (100 + F.col("event_id") % 100 / 50).alias("lng"), (30 + F.col("event_id") % 77 / 50).alias("lat"), F.col("value").alias("speed"), (F.sum("value").over(w) / 10).alias("along_km"))
    return rounded(trips.key_points(s, [("h1", 10.0), ("h2", 40.0)], [("c1", 0.0, 50.0), ("c2", 50.0, 100.0)]), 4)


_PROFILE = ", ".join(f"('{k}', {r[0]!r}, {r[1]!r}, {r[2]!r})" for k, r in motion.PROFILES.items())
_SOLVE = f"""pf(class, kmh, a_acc, a_dec) AS (VALUES {_PROFILE}),
l0 AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS ds, l_quantity * 40 AS dt, ['G', 'D', 'C', 'Z', 'T', 'K', 'OTHER'][l_linenumber] AS class FROM lineitem),
l1 AS (SELECT l0.*, CAST(a_acc AS DOUBLE) AS acc, CAST(a_dec AS DOUBLE) AS decl, kmh / 3.6 * CASE WHEN l_orderkey % 5 = 0 THEN 0.6 ELSE 1.0 END AS cap FROM l0 JOIN pf USING (class)),
l2 AS (SELECT *, (1 / acc + 1 / decl) / 2 AS beta FROM l1), l3 AS (SELECT *, dt * dt - 4 * beta * ds AS disc FROM l2),
l4 AS (SELECT *, disc < 0 OR ds <= 0 OR dt <= 0 AS flat, (dt - sqrt(greatest(disc, 0))) / (2 * beta) AS v0 FROM l3),
l5 AS (SELECT *, least(v0, cap) AS v1, CASE WHEN NOT flat AND v0 > cap THEN greatest(0, dt - (ds / cap + beta * cap)) ELSE 0 END AS slack FROM l4),
l6 AS (SELECT *, CASE WHEN flat THEN ds / dt WHEN v1 * v1 * beta > ds THEN sqrt(ds / beta) ELSE v1 END AS v FROM l5),
l7 AS (SELECT *, CASE WHEN flat THEN 0 ELSE v * v / (2 * acc) END AS sa, CASE WHEN flat THEN 0 ELSE v * v / (2 * decl) END AS sd, CASE WHEN flat THEN dt ELSE v / acc + (ds - v * v * beta) / v + v / decl END AS total FROM l6)"""
_X = "ds / 3"
_SKY = """q AS (SELECT event_id, (event_id * 7 % 101) / 100.0::DOUBLE AS low, (event_id * 11 % 97) / 96.0::DOUBLE AS mid, (event_id * 13 % 89) / 88.0::DOUBLE AS high, (event_id * 17 % 83) / 82.0::DOUBLE AS tot, (event_id * 19 % 30)::DOUBLE AS vis,
(event_id * 23 % 71) / 70.0::DOUBLE AS hum, (event_id * 29 % 61) / 60.0::DOUBLE AS rain, (event_id * 31 % 12)::DOUBLE AS wind, (event_id * 37 % 40)::DOUBLE - 20 AS temp, (event_id * 41 % 120)::DOUBLE - 60 AS alt, (event_id * 43 % 53) / 52.0::DOUBLE AS share, (event_id * 47 % 140)::DOUBLE - 60 AS malt, event_id % 9 + 1 AS bortle FROM events),
c AS (SELECT *, least(1, greatest(0, (mid + high) / 2 + greatest(mid, high) / 2)) AS scr FROM q),
r AS (SELECT *, CASE WHEN scr < 0.15 THEN 25 WHEN scr <= 0.9 THEN 60 + 40 * ((scr - 0.15) / 0.75) ELSE 35 END - least(1, greatest(0, (low - 0.55) / 0.45)) * 55 + least(1, greatest(0, (vis - 2) / 18)) * 25 - least(1, greatest(0, (hum - 0.75) / 0.25)) * 18 - rain * 45 AS g,
 28 + least(1, greatest(0, (-alt - 12) / 6)) * 30 + least(1, greatest(0, (vis - 4) / 16)) * 12 - CASE WHEN malt > 0 THEN share * least(1, malt / 45) * 32 ELSE 0 END - (bortle - 1) / 8.0 * 30 - tot * 35 AS s,
 CASE WHEN alt <= 1 THEN 0 ELSE CASE WHEN alt < 42 THEN least(1, greatest(0, (40 - alt) / 40)) * 35 ELSE 0 END + CASE WHEN rain >= 0.2 AND rain <= 0.85 THEN 45 * least(1, rain / 0.6) WHEN rain > 0.85 THEN 10 ELSE 0 END - least(1, greatest(0, (tot - 0.85) / 0.15)) * 25 END AS rb,
 20 + share * 45 + least(1, greatest(0, malt / 50)) * 35 - tot * 40 AS m,
 low * 40 + least(1, greatest(0, (hum - 0.6) / 0.4)) * 30 + (1 - least(1, wind / 8)) * 15 + CASE WHEN vis * 100 > 800 THEN 10 ELSE 5 END AS cs,
 least(1, greatest(0, (3 - temp) / 8)) * 45 + least(1, greatest(0, (hum - 0.75) / 0.25)) * 30 + least(1, greatest(0, (wind - 1) / 5)) * CASE WHEN temp <= 2 THEN 12 ELSE 0 END - rain * 25 AS ri FROM c)"""
_I = "CAST(floor(least(100, greatest(0, {0})) + 0.5) AS INTEGER)"
_MS = "(floor(epoch(ts)) * 1000)"
_D = f"(({_MS} - 946728000000.0) / 86400000.0)"
_AGE = f"fmod(fmod(({_MS} - 947182440000.0) / 86400000.0, 29.530588853) + 29.530588853, 29.530588853)"


def _turn(x: str) -> str:
    return f"fmod(fmod({x}, 360) + 360, 360)"


def _alt(ra: str, dec: str) -> str:
    return f"degrees(asin(greatest(-1, least(1, sin(radians({dec})) * sin(radians(lat)) + cos(radians({dec})) * cos(radians(lat)) * cos(radians(280.46061837 + 360.98564736629 * d + lng - {ra}))))))"


_EDGE_SQL = """e0 AS (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b, l_orderkey FROM lineitem),
e AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi, min((abs(a - b) % 17 + 1)::DOUBLE) AS w, bool_or(l_orderkey % 4 = 0) AS fast, min(l_orderkey) AS line FROM e0 WHERE b IS NOT NULL AND a <> b GROUP BY 1, 2)"""

QUERIES = {
    f.__name__: f for f in (sections, section_curve, delays, arrivals, isotonic, time_filled, day_rollover, phases, progress_breaks, nearest_hour, minute_counts, radar, sky_scores, sun_and_moon, night_light, flights,
                            graph_edges, graph_components, graph_paths, multi_stop_route, simplified, crowd_thinned, position_fusion, track_points)
}

ORACLES = {
    "sections": f"WITH {_SOLVE} SELECT l_orderkey, l_linenumber, floor(v * 10000 + 0.5) / 10000 AS v, flat AS degraded, floor(slack * 10000 + 0.5) / 10000 AS slack, floor(total * 10000 + 0.5) / 10000 AS total_s, floor((CASE WHEN ds >= beta * cap * cap THEN ds / cap + beta * cap ELSE 2 * sqrt(ds * beta) END) * 10000 + 0.5) / 10000 AS least_s FROM l7",
    "section_curve": f"""WITH {_SOLVE} SELECT l_orderkey, l_linenumber, floor((CASE WHEN flat THEN {_X} / v WHEN {_X} <= sa THEN sqrt(2 * {_X} / acc) WHEN {_X} >= ds - sd THEN total - sqrt(2 * (ds - {_X}) / decl) ELSE v / acc + ({_X} - sa) / v END) * 10000 + 0.5) / 10000 AS t,
floor((CASE WHEN flat THEN v WHEN {_X} <= sa THEN sqrt(2 * acc * {_X}) WHEN {_X} >= ds - sd THEN sqrt(2 * decl * (ds - {_X})) ELSE v END) * 10000 + 0.5) / 10000 AS speed, TRUE AS comes_back FROM l7""",
    "delays": """WITH e AS (SELECT event_id, user_id, (event_id * 37 % 1000)::DOUBLE AS km, CASE WHEN event_type = 'error' THEN value * 20 - 300 END AS delta FROM events),
n AS (SELECT *, last_value(CASE WHEN delta IS NOT NULL THEN {'km': km, 'delta': delta} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY km, event_id ROWS UNBOUNDED PRECEDING) AS a,
 first_value(CASE WHEN delta IS NOT NULL THEN {'km': km, 'delta': delta} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY km, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM e),
p AS (SELECT *, (km - a.km) * 36 AS ps FROM n)
SELECT event_id, round(CASE WHEN a IS NULL THEN coalesce(b.delta, 0) WHEN b IS NULL THEN greatest(-300, least(a.delta + 0.4 * 60 * ps / 3600, least(a.delta + 0.5 * ps, 10800))) WHEN b.km > a.km THEN a.delta + (b.delta - a.delta) * (km - a.km) / (b.km - a.km) ELSE a.delta END, 7) AS delay_s FROM p""",
    "arrivals": """WITH e AS (SELECT event_id, value, event_id % 300 / 60 AS h, event_id % 7 * 60 AS gap FROM events),
s AS (SELECT *, exp(-h / 0.42) AS w, sqrt(pow(1.0 + 0.35 * sqrt(h), 2) + pow(150.0 / greatest(value, 5) / 60, 2) + pow(gap / 60 * 0.15, 2)) AS sg FROM e)
SELECT event_id, round(w * value * 10 + (1 - w) * 120, 4) AS shift_s, round(sg, 4) AS sigma_min, CASE WHEN sg <= 3 THEN 'high' WHEN sg <= 10 THEN 'mid' ELSE 'low' END AS confidence FROM s""",
    "isotonic": """WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, o_totalprice AS x, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 ELSE 1 END AS w, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
m AS (SELECT a.c, a.n AS i, b.n AS j, sum(s.x * s.w) / sum(s.w) AS avg FROM o a JOIN o b ON a.c = b.c AND b.n >= a.n JOIN o s ON s.c = a.c AND s.n BETWEEN a.n AND b.n GROUP BY 1, 2, 3),
f AS (SELECT o.k, m.i, min(m.avg) AS lo FROM o JOIN m ON m.c = o.c AND m.i <= o.n AND m.j >= o.n GROUP BY 1, 2) SELECT k AS o_orderkey, round(max(lo), 6) AS fitted FROM f GROUP BY 1""",
    "time_filled": """WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS x, epoch(o_orderdate) AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
b AS (SELECT o.*, (SELECT max(n) FROM o p WHERE p.c = o.c AND p.n < o.n AND p.x IS NOT NULL) AS i, (SELECT min(n) FROM o p WHERE p.c = o.c AND p.n > o.n AND p.x IS NOT NULL) AS j FROM o)
SELECT b.k AS o_orderkey, round(coalesce(b.x, CASE WHEN p.n IS NOT NULL AND q.n IS NOT NULL THEN p.x + (q.x - p.x) * CASE WHEN q.t <> p.t THEN (b.t - p.t) / (q.t - p.t) ELSE (b.n - p.n) / (q.n - p.n) END ELSE coalesce(p.x, q.x, 0) END), 6) AS filled
FROM b LEFT JOIN o p ON p.c = b.c AND p.n = b.i LEFT JOIN o q ON q.c = b.c AND q.n = b.j""",
    "day_rollover": """WITH e AS (SELECT user_id, event_id, hour(ts) * 60 + minute(ts) AS clock FROM events), b AS (SELECT *, CASE WHEN clock < lag(clock) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS b FROM e)
SELECT event_id, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS day FROM b""",
    "phases": """WITH n AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS new FROM events),
i AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM n) SELECT user_id, island, event_type, count(*) AS n, min(event_id) AS first_id FROM i GROUP BY 1, 2, 3""",
    "progress_breaks": "SELECT event_id FROM (SELECT event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM events) WHERE value < top - 20",
    "nearest_hour": """WITH e AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events), h AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h, max(event_id) AS sample FROM events GROUP BY 1 HAVING max(event_id) % 3 <> 0),
j AS (SELECT e.event_id, h.sample, abs(h.h * 3600 - e.s) AS gap, row_number() OVER (PARTITION BY e.event_id ORDER BY abs(h.h * 3600 - e.s), h.h) AS nr FROM e JOIN h ON h.h BETWEEN e.s // 3600 - 1 AND e.s // 3600 + 2 AND abs(h.h * 3600 - e.s) <= 2700)
SELECT e.event_id, j.sample, j.gap FROM e LEFT JOIN j ON j.event_id = e.event_id AND j.nr = 1""",
    "minute_counts": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "radar": """WITH p AS (SELECT event_id, (event_id * 53 % 300)::DOUBLE AS km, value * 1.3 AS kmh FROM events), h AS (SELECT n_name AS highlight, (n_nationkey * 41 % 300)::DOUBLE AS at_km, n_nationkey % 2 = 0 AS worth, n_nationkey % 3 = 0 AS park FROM nation),
j AS (SELECT *, CASE WHEN at_km < km THEN at_km - km + 300 ELSE at_km - km END AS ahead FROM p CROSS JOIN h), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY event_id ORDER BY ahead, highlight) AS INTEGER) AS nr FROM j WHERE ahead <= least(15, greatest(3, kmh * 0.05)) AND CASE WHEN kmh > 80 THEN worth WHEN kmh < 40 THEN park ELSE worth OR park END)
SELECT event_id, nr, highlight, ahead FROM k WHERE nr <= 2""",
    "sky_scores": f"""WITH {_SKY} SELECT event_id, {_I.format('g')} AS glow, {_I.format('s')} AS star, {_I.format('rb')} AS rainbow, {_I.format('m')} AS moon, {_I.format('cs')} AS cloud_sea, {_I.format('ri')} AS rime,
CASE WHEN {_I.format('g')} >= 75 THEN 'excellent' WHEN {_I.format('g')} >= 55 THEN 'good' WHEN {_I.format('g')} >= 35 THEN 'fair' ELSE 'poor' END AS glow_band,
CASE WHEN event_id % 31 = 0 OR vis < 5 OR rain >= 0.6 THEN 'poor' WHEN vis < 10 THEN CASE WHEN event_id % 2 = 0 THEN 'poor' ELSE 'fair' END WHEN rain >= 0.35 THEN 'fair' WHEN event_id % 2 = 0 AND (tot >= 0.7 OR vis < 15) THEN 'fair' ELSE 'good' END AS view FROM r""",
    "sun_and_moon": f"""WITH e AS (SELECT event_id, ts, 80.0 + event_id % 40 AS lng, 20.0 + user_id % 30 AS lat, {_D} AS d, {_AGE} AS age FROM events),
s AS (SELECT *, {_turn('280.46 + 0.9856474 * d')} + 1.915 * sin(radians({_turn('357.528 + 0.9856003 * d')})) + 0.02 * sin(2 * radians({_turn('357.528 + 0.9856003 * d')})) AS sl, 23.439 - 0.0000004 * d AS ob,
 radians({_turn('357.529 + 0.98560028 * d')}) AS m, radians({_turn('134.963 + 13.064993 * d')}) AS mp, radians({_turn('297.850 + 12.190749 * d')}) AS dd, radians({_turn('93.272 + 13.229350 * d')}) AS f FROM e),
t AS (SELECT *, degrees(atan2(cos(radians(ob)) * sin(radians(sl)), cos(radians(sl)))) AS sra, degrees(asin(sin(radians(ob)) * sin(radians(sl)))) AS sdec,
 {_turn('218.316 + 13.176396 * d')} + 6.289 * sin(mp) + 1.274 * sin(2 * dd - mp) + 0.658 * sin(2 * dd) + 0.214 * sin(2 * mp) - 0.186 * sin(m) - 0.114 * sin(2 * f) AS ml, 5.128 * sin(f) + 0.281 * sin(mp + f) + 0.278 * sin(mp - f) + 0.173 * sin(2 * dd - f) AS mb FROM s),
u AS (SELECT *, degrees(atan2(sin(radians(ml)) * cos(radians(ob)) - tan(radians(mb)) * sin(radians(ob)), cos(radians(ml)))) AS mra, degrees(asin(sin(radians(mb)) * cos(radians(ob)) + cos(radians(mb)) * sin(radians(ob)) * sin(radians(ml)))) AS mdec,
 degrees(acos(greatest(-1, least(1, -tan(radians(lat)) * tan(radians(23.45 * sin(radians(360.0 * (284 + dayofyear(ts)) / 365)))))))) / 15 AS hh FROM t)
SELECT event_id, round({_alt('sra', 'sdec')}, 3) + 0.0 AS sun_alt, round({_alt('mra', 'mdec')}, 3) + 0.0 AS moon_alt, round((1 - cos(2 * pi() * age / 29.530588853)) / 2, 3) + 0.0 AS moon_light, CAST(floor(age / 29.530588853 * 8 + 0.5) % 8 AS INTEGER) AS phase, round(12 - lng / 15 - hh, 3) + 0.0 AS rise_h, round(12 - lng / 15 + hh, 3) + 0.0 AS set_h FROM u""",
    "night_light": with_tables(["spots", "places"], f"""j AS (SELECT s.id, length(p.place) / 10 AS w, {hav('s.lng', 's.lat', 'p.lng', 'p.lat')} * 6371.0088 / 6371.0 AS km FROM spots s CROSS JOIN places p), g AS (SELECT id, sum(w * exp(-km / (12 + 34 * w))) AS light FROM j GROUP BY 1)
SELECT id, round(light, 4) AS light, CAST(CASE WHEN light >= 3.2 THEN 9 WHEN light >= 2.2 THEN 8 WHEN light >= 1.4 THEN 7 WHEN light >= 0.85 THEN 6 WHEN light >= 0.45 THEN 5 WHEN light >= 0.22 THEN 4 WHEN light >= 0.09 THEN 3 WHEN light >= 0.03 THEN 2 ELSE 1 END AS INTEGER) AS bortle FROM g"""),
    "flights": with_tables(["lines"], f"""o AS (SELECT line_id, seq, {hav('lng', 'lat', 'lead(lng) OVER w', 'lead(lat) OVER w')} AS km, row_number() OVER w AS seg FROM lines WINDOW w AS (PARTITION BY line_id ORDER BY seq))
SELECT line_id, CAST(seg AS INTEGER) AS seg, CAST(CASE WHEN km < 800 THEN 8600 WHEN km < 1800 THEN 9800 WHEN km < 3500 THEN 10700 ELSE 11300 END AS INTEGER) AS altitude, CAST(CASE WHEN km <= 0 THEN 0 ELSE floor(km / 820 * 60 + 25 + 0.5) END AS BIGINT) AS minutes FROM o WHERE km IS NOT NULL"""),
    "graph_edges": f"WITH {_EDGE_SQL} SELECT * FROM e",
    "graph_components": f"""WITH RECURSIVE {_EDGE_SQL}, b AS (SELECT lo AS a, hi AS c FROM e UNION SELECT hi, lo FROM e), r(node, seen) AS (SELECT a, a FROM b UNION SELECT b.c, r.seen FROM r JOIN b ON b.a = r.node WHERE r.seen < b.c),
l AS (SELECT node, min(seen) AS label FROM r GROUP BY 1) SELECT label, count(*) AS size FROM l GROUP BY 1""",
    "multi_stop_route": f"""WITH RECURSIVE {_EDGE_SQL}, {COSTS}, k AS (SELECT origin, node, cost FROM r), z(origin, dest, back, node, cost) AS (SELECT origin, node, 0, node, cost FROM k WHERE node = origin + 50
UNION ALL SELECT z.origin, z.dest, z.back + 1, min(q.node), arg_min(q.cost, q.node) FROM z JOIN b ON b.c = z.node JOIN k q ON q.origin = z.origin AND q.node = b.a AND q.cost + b.w = z.cost WHERE z.node <> z.origin GROUP BY 1, 2, 3) SELECT * FROM z""",
    "graph_paths": f"WITH RECURSIVE {_EDGE_SQL}, {COSTS} SELECT origin, node, cost FROM r",
}
