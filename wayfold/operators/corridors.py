"""Corridors as a network: links at hubs, and the cheapest chain of corridors for the stops of a trip.

Corridors are lines (corridor, seq, lng, lat) with stations in order (corridor, pos, name), names once a corridor.
Trips are stops (trip, idx, name, lng, lat), idx from 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.functions.geo import KM_PER_LAT, KM_PER_LNG, cell, haversine_km
from wayfold.operators.lines import at_km, line_stats, segments
from wayfold.operators.spatial import nearest_segment, segment_cells
from wayfold.sources.scratch import stored

#: Corridors in a chain; km from a corridor at which a trip's end, and a stop on the way, is on it; km between ends, between lines and over a bridge.
MOST_HOPS = 8
END_KM, MID_KM, ENDS_KM, CROSS_KM, BRIDGE_KM = 40.0, 12.0, 12.0, 3.0, 280.0
#: Fixed values in km: what a change costs over a bridge, between lines, at an end station and elsewhere; what a corridor without new stops costs, at the goal and elsewhere; weak starts.
BRIDGE_COST, GEO_COST, TIP_COST, FAR_COST = 15.0, 25.0, 10.0, 280.0
GOAL_STALE, STALE, WEAK_START, NO_START = 120.0, 850.0, 220.0, 500.0


def _near_pairs(a: DataFrame, b: DataFrame, km: float) -> DataFrame:
    """Join points with those of other corridors with greater ids within a distance: a, b, km, a_pt, b_pt. a, b: corridor, lng, lat.

    Columns of cells are as wide as the distance at their row's edge nearest to a pole, so neighbours suffice; rows next to a pole have one column.
    Both sides are shuffled: what a point's cells make of a small table is no small table.
    """
    size = 1.1 * km / KM_PER_LAT
    cosine = lambda y: F.cos(F.radians(y * size))
    column = F.when(F.col("_e") < 0.001, 0).otherwise(F.floor(F.col("lng") * F.col("_e") * (KM_PER_LNG * 0.98 / km))).cast("long")
    row = F.floor(F.col("lat") / size).cast("long")

    def columns(df: DataFrame) -> DataFrame:
        c = df.withColumns({"_c0": cosine(F.col("y")), "_c1": cosine(F.col("y") + 1)})
        return c.withColumn("_e", F.when(F.col("_c0") * F.col("_c1") <= 0, 0.0).otherwise(F.least(F.abs("_c0"), F.abs("_c1")))).withColumn("x", column)

    own = columns(a.select(F.col("corridor").alias("a"), "lng", "lat", F.explode(F.sequence(row - 1, row + 1)).alias("y")))
    own = own.select("a", "lng", "lat", "y", F.explode(F.when(F.col("_e") < 0.001, F.array("x")).otherwise(F.sequence(F.col("x") - 1, F.col("x") + 1))).alias("x"))
    other = columns(b.select(F.col("corridor").alias("b"), F.col("lng").alias("o_lng"), F.col("lat").alias("o_lat"), "lng", row.alias("y"))).select("b", "o_lng", "o_lat", "x", "y")
    d = haversine_km(F.col("lng"), F.col("lat"), F.col("o_lng"), F.col("o_lat"))
    j = own.hint("merge").join(other, ["x", "y"]).where("a < b").withColumn("km", F.round(d, 9)).where(F.col("km") <= km)
    return j.select("a", "b", "km", F.struct("lng", "lat").alias("a_pt"), F.struct(F.col("o_lng").alias("lng"), F.col("o_lat").alias("lat")).alias("b_pt"))


def hub_links(rails: DataFrame, stations: DataFrame, ends_km: float = ENDS_KM, cross_km: float = CROSS_KM) -> DataFrame:
    """Link corridors: a, b (a < b), kind, hub, km, a_pt, b_pt; one link of two corridors, of the first kind that holds.

    hub: a station on both (km 0), one that ends either if there is one, else the first in the order of b. ends: ends within 12 km.
    cross: points of the lines within 3 km, the nearest two; a_pt and b_pt are where the links touch.
    """
    last = Window.partitionBy("corridor")
    s = stations.withColumn("tip", (F.col("pos") == F.min("pos").over(last)) | (F.col("pos") == F.max("pos").over(last)))
    a = s.select(F.col("corridor").alias("a"), "name", F.col("tip").alias("_a"))
    b = s.select(F.col("corridor").alias("b"), "name", F.col("tip").alias("_b"), "pos")
    shared = a.hint("merge").join(b, "name").where("a < b").groupBy("a", "b").agg(F.min_by("name", F.struct((~(F.col("_a") | F.col("_b"))).alias("inner"), "pos")).alias("hub"))
    point = F.struct(F.lit(None).cast("double").alias("lng"), F.lit(None).cast("double").alias("lat"))
    hubs = stored(shared.select("a", "b", F.lit("hub").alias("kind"), "hub", F.lit(0.0).alias("km"), point.alias("a_pt"), point.alias("b_pt")), "hubs")

    def nearest(pairs: DataFrame, kind: str, done: DataFrame) -> DataFrame:
        best = pairs.groupBy("a", "b").agg(F.min(F.struct("km", "a_pt", "b_pt")).alias("m")).join(done.select("a", "b"), ["a", "b"], "left_anti")
        return best.select("a", "b", F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("hub"), "m.km", "m.a_pt", "m.b_pt")

    place = F.struct("lng", "lat")
    tips = rails.groupBy("corridor").agg(F.min_by(place, "seq").alias("s"), F.max_by(place, "seq").alias("t")).select("corridor", F.explode(F.array("s", "t")).alias("p")).select("corridor", "p.*")
    found = stored(hubs.unionByName(nearest(_near_pairs(tips, tips, ends_km), "ends", hubs)), "links")
    return found.unionByName(nearest(_near_pairs(rails, rails, cross_km), "cross", found))


def near_segments(stops: DataFrame, rails: DataFrame, km: float, window_deg: float | None = None) -> DataFrame:
    """Pairs of stops (id: trip, idx) and segments of corridors (line_id) in cells within a distance; with a window only segments that begin less than so many degrees away.

    Both sides are shuffled, as cells make many rows of a small table.
    """
    size = max(0.05, 2 * km / KM_PER_LAT)
    s = stops.where("lng IS NOT NULL AND lat IS NOT NULL").select(F.struct("trip", "idx").alias("id"), "lng", "lat")
    s = s.withColumns({"cx": cell(F.col("lng"), -180.0, size), "cy": cell(F.col("lat"), -90.0, size)})
    pairs = s.hint("merge").join(segment_cells(segments(rails.withColumnRenamed("corridor", "line_id")), km, size, window_deg), ["cx", "cy"])
    if window_deg is None:
        return pairs
    return pairs.where((F.abs(F.col("lat") - F.col("a_lat")) < window_deg) & (F.abs(F.col("lng") - F.col("a_lng")) < window_deg))


def on_corridors(stops: DataFrame, rails: DataFrame, stations: DataFrame, km: float, window_deg: float | None = None) -> DataFrame:
    """Return trip, idx, corridor where a stop's name is a station of the corridor or the stop lies within a distance of its line, in the window of near_segments."""
    named = stops.select("trip", "idx", "name").hint("merge").join(stations.select("corridor", "name"), "name").select("trip", "idx", "corridor")
    pairs = near_segments(stops, rails, km, window_deg)
    near = nearest_segment(pairs, ["line_id", "id"], ["lng", "lat"]).where(F.col("dist_km") <= km)
    return named.unionByName(near.select("id.trip", "id.idx", F.col("line_id").alias("corridor"))).distinct()


def station_points(rails: DataFrame, stations: DataFrame) -> DataFrame:
    """Place stations on their corridor's line, evenly by their order: corridor, name, pos, lng, lat."""
    order = Window.partitionBy("corridor").orderBy("pos")
    s = stations.withColumns({"_i": F.row_number().over(order) - 1, "_n": F.count("*").over(Window.partitionBy("corridor"))})
    points = rails.withColumnRenamed("corridor", "line_id")
    total = line_stats(points).select(F.col("line_id").alias("corridor"), "length_km")
    at = s.join(total, "corridor").withColumn("km", F.when(F.col("_n") > 1, F.col("length_km") * F.col("_i") / (F.col("_n") - 1)).otherwise(0.0))
    xy = at_km(points, at.select(F.col("corridor").alias("line_id"), "km").distinct()).select(F.col("line_id").alias("corridor"), "km", "lng", "lat")
    return at.join(xy, ["corridor", "km"]).select("corridor", "name", "pos", "lng", "lat")


def stop_points(stops: DataFrame, rails: DataFrame, stations: DataFrame) -> DataFrame:
    """Give stops without coordinates the place of their name on the least corridor that has it: stops with lng, lat and corridor (null if not needed or not found)."""
    found = station_points(rails, stations).groupBy("name").agg(F.min(F.struct("corridor", "lng", "lat")).alias("_p"))
    j = stops.join(found, "name", "left")
    bare = F.col("lng").isNull() | F.col("lat").isNull()
    return j.select(*[c for c in stops.columns if c not in ("lng", "lat")], F.when(bare, F.col("_p.lng")).otherwise(F.col("lng")).alias("lng"), F.when(bare, F.col("_p.lat")).otherwise(F.col("lat")).alias("lat"), F.when(bare, F.col("_p.corridor")).alias("corridor"))


def bridges(stops: DataFrame, mid: DataFrame, bridge_km: float = BRIDGE_KM) -> DataFrame:
    """Return trip, a, b, km, lng, lat, name: from the last stop on corridor a to the first later one on b, without a stop between that is on neither.

    mid: trip, idx, corridor, the stops on each corridor. lng and lat are where b is entered.
    """
    at = stops.select("trip", "idx", "name", "lng", "lat")
    whole = stops.groupBy("trip").agg(F.max("idx").alias("_end"))
    last = mid.groupBy("trip", F.col("corridor").alias("a")).agg(F.max("idx").alias("_i"), F.collect_set("idx").alias("_on")).join(whole, "trip").where("_i < _end")
    here = at.select("trip", F.col("idx").alias("_i"), F.col("lng").alias("_lng"), F.col("lat").alias("_lat"))
    later = mid.select("trip", F.col("corridor").alias("b"), F.col("idx").alias("_j")).join(at.select("trip", F.col("idx").alias("_j"), "name", "lng", "lat"), ["trip", "_j"])
    all_on = mid.groupBy("trip", F.col("corridor").alias("b")).agg(F.collect_set("idx").alias("_b_on"))
    j = last.join(here, ["trip", "_i"]).join(later, "trip").where("a <> b AND _j > _i").join(all_on, ["trip", "b"])
    between = F.when(F.col("_j") - F.col("_i") > 1, F.sequence(F.col("_i") + 1, F.col("_j") - 1)).otherwise(F.array().cast("array<int>"))
    j = j.where(F.forall(between, lambda k: F.array_contains("_on", k) | F.array_contains("_b_on", k)))
    j = j.withColumn("km", haversine_km(F.col("_lng"), F.col("_lat"), F.col("lng"), F.col("lat"))).where(F.col("km") <= bridge_km)
    return j.groupBy("trip", "a", "b").agg(F.min_by(F.struct("km", "lng", "lat", "name"), "_j").alias("m")).select("trip", "a", "b", "m.*")


def _changes(links: DataFrame, rails: DataFrame, stations: DataFrame) -> DataFrame:
    """Links both ways: a, b, kind, hub, km, pt (where a is left), tip (the hub ends either corridor), blind (what stands for a way from an unknown place)."""
    both = links.select("a", "b", "kind", "hub", "km", F.col("a_pt").alias("pt")).unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "kind", "hub", "km", F.col("b_pt").alias("pt")))
    last = Window.partitionBy("corridor")
    where = station_points(rails, stations).hint("merge").withColumn("tip", (F.col("pos") == F.min("pos").over(last)) | (F.col("pos") == F.max("pos").over(last)))
    own = where.select(F.col("corridor").alias("a"), F.col("name").alias("hub"), F.struct("lng", "lat").alias("_own"), F.col("tip").alias("_a_tip"))
    other = where.select(F.col("corridor").alias("b"), F.col("name").alias("hub"), F.col("tip").alias("_b_tip"))
    both = both.join(own, ["a", "hub"], "left").join(other, ["b", "hub"], "left")
    at = F.when(F.col("kind") == "hub", F.col("_own")).otherwise(F.col("pt"))
    return both.select("a", "b", "kind", "hub", "km", at.alias("pt"), F.coalesce(F.col("_a_tip") | F.col("_b_tip"), F.lit(False)).alias("tip"))


def cheapest_chains(stops: DataFrame, rails: DataFrame, stations: DataFrame, links: DataFrame, end_km: float = END_KM, mid_km: float = MID_KM, bridge_km: float = BRIDGE_KM, hops: int = MOST_HOPS, window_deg: float | None = None) -> DataFrame:
    """Return each trip's cheapest chain of two to eight corridors from its first stop to its last: trip, cost, hops, corridors, hubs.

    Cost: the great-circle way from the first stop over the places of change to the last; changes (a hub that the stops call for 0, at a
    corridor's end station 10, else 280; lines that touch 25 and the distance, bridges between stops 15 and the distance); 850 for a corridor
    on which no new stop lies, 120 if the last stop's corridors hold it; 220 for a first corridor with the first stop alone, 500 with none.
    A hub is called for where it is a stop and of the stops after it as many are on the next corridor as on this one, and any.
    Chains repeat no corridor. Of equal costs the shorter chain wins, then the lesser corridors. hubs[i] is how corridor i was entered: a
    station, 'cross', 'ends' or 'bridge', null for the first.

    The costs of a step depend on the corridors before, so a corridor keeps several labels: of those with the same corridors behind them and the same
    place of entry the cheapest. Rounds are as many as hops; a label goes on if what is left by air cannot exceed the best chain found, and
    if it can still reach the goal within the hops.
    """
    rails, stations = rails.hint("merge"), stations.hint("merge")  # they grow with the input, however small their files are
    stops = stored(stops.select("trip", F.col("idx").cast("int").alias("idx"), "name", "lng", "lat"), "stops")
    mid = stored(on_corridors(stops, rails, stations, mid_km, window_deg), "mid")
    ends = stops.groupBy("trip").agg(F.min_by(F.struct("idx", "lng", "lat"), "idx").alias("s"), F.max_by(F.struct("idx", "lng", "lat"), "idx").alias("t"))
    ends = stored(ends.select("trip", F.col("s.idx").alias("first"), F.col("t.idx").alias("last"), F.struct("s.lng", "s.lat").alias("start"), F.struct("t.lng", "t.lat").alias("goal")), "ends")
    terminal = on_corridors(stops.join(ends.select("trip", "first", "last"), "trip").where("idx = first OR idx = last").select("trip", "idx", "name", "lng", "lat"), rails, stations, end_km, window_deg)
    terminal = stored(terminal.join(ends.select("trip", "first", "last"), "trip"), "terminal")
    goals = terminal.where("idx = last").select("trip", "corridor").distinct()
    covers = mid.groupBy("trip", "corridor").agg(F.sort_array(F.collect_set("idx")).alias("on"))
    lengths = line_stats(rails.withColumnRenamed("corridor", "line_id")).select(F.col("line_id").alias("a"), (F.col("length_km") * 0.3).alias("blind"))
    links = stored(_changes(links, rails, stations).join(lengths, "a"), "links")
    over = bridges(stops, mid, bridge_km).select("trip", "a", "b", F.lit("bridge").alias("kind"), F.lit(None).cast("string").alias("hub"), "km", F.struct("lng", "lat").alias("pt"), F.lit(False).alias("tip")).join(lengths, "a")
    over = stored(over, "bridges")
    hub_at = stops.groupBy("trip", F.col("name").alias("hub")).agg(F.min("idx").alias("hub_idx")).join(ends.select("trip", "last"), "trip")

    # How many changes each corridor is from the goal, for every trip: what cannot get there in time is not searched.
    near = stored(goals.withColumn("left", F.lit(0)), "toward")
    reach = near
    for k in range(1, hops):
        ahead = near.withColumnRenamed("corridor", "b")
        step = links.join(ahead, "b").select("trip", F.col("a").alias("corridor")).union(over.join(ahead, ["trip", "b"]).select("trip", F.col("a").alias("corridor"))).distinct()
        near = stored(step.join(reach.select("trip", "corridor"), ["trip", "corridor"], "left_anti").withColumn("left", F.lit(k)), "toward")
        if near.isEmpty():
            break
        reach = stored(reach.unionByName(near), "reach")

    none = F.array().cast("array<int>")
    start = terminal.where("idx = first").select("trip", "corridor").distinct().join(reach.select("trip", "corridor"), ["trip", "corridor"], "left_semi").join(covers, ["trip", "corridor"], "left").join(goals.withColumn("is_goal", F.lit(True)), ["trip", "corridor"], "left")
    on = F.coalesce("on", none)
    stale = lambda fresh: F.when(fresh > 0, 0.0).when(F.col("is_goal"), GOAL_STALE).otherwise(STALE)
    weak = F.when(F.size(on) == 0, NO_START).when((F.size(on) == 1) & (on[0] == F.col("first")), WEAK_START).otherwise(0.0)
    label = start.join(ends.select("trip", "first", "start"), "trip").select("trip", "corridor", F.array("corridor").alias("ids"), F.array(F.lit(None).cast("string")).alias("hubs"), (stale(F.size(on)) + weak).alias("cost"), F.col("start").alias("at"), on.alias("covered"), on.alias("here"))
    label, best = stored(label, "labels"), None
    for k in range(1, hops):
        by_link = label.join(links.withColumnRenamed("a", "corridor"), "corridor").drop("corridor")
        by_bridge = label.join(over.withColumnRenamed("a", "corridor"), ["trip", "corridor"]).drop("corridor")
        j = by_link.unionByName(by_bridge).where(~F.array_contains("ids", F.col("b"))).withColumnRenamed("b", "corridor")
        j = j.join(reach.where(F.col("left") <= hops - 1 - k), ["trip", "corridor"]).drop("left")
        j = j.join(covers, ["trip", "corridor"], "left").withColumn("on", F.coalesce("on", none)).join(goals.withColumn("is_goal", F.lit(True)), ["trip", "corridor"], "left").join(hub_at, ["trip", "hub"], "left")
        later = lambda c: F.size(F.filter(c, lambda i: i > F.col("hub_idx")))
        called = F.col("hub_idx").isNotNull() & ((F.col("hub_idx") == F.col("last")) | ((later("on") > 0) & (later("on") >= later("here"))))
        change = F.when(F.col("kind") == "bridge", BRIDGE_COST + F.col("km")).when(F.col("kind") != "hub", GEO_COST + F.col("km")).when(called, 0.0).when(F.col("tip"), TIP_COST).otherwise(FAR_COST)
        air = haversine_km(F.col("at.lng"), F.col("at.lat"), F.col("pt.lng"), F.col("pt.lat"))
        cost = F.col("cost") + F.coalesce(air, F.col("blind")) + change + stale(F.size(F.array_except("on", "covered")))
        j = j.select("trip", "corridor", F.concat("ids", F.array("corridor")).alias("ids"), F.concat("hubs", F.array(F.coalesce("hub", "kind"))).alias("hubs"), cost.alias("cost"), F.col("pt").alias("at"), F.array_union("covered", "on").alias("covered"), F.col("on").alias("here"))
        j = j.groupBy("trip", "corridor", F.array_sort("ids").alias("_set"), "at").agg(F.min(F.struct("cost", "ids", "hubs", "covered", "here")).alias("m")).select("trip", "corridor", "m.ids", "m.hubs", "m.cost", "at", "m.covered", "m.here")
        j = j.join(ends.select("trip", "goal"), "trip").withColumn("air", F.coalesce(haversine_km(F.col("at.lng"), F.col("at.lat"), F.col("goal.lng"), F.col("goal.lat")), F.lit(0.0)))
        label = stored(j, "labels")
        done = label.join(goals, ["trip", "corridor"], "left_semi").select("trip", F.struct(F.round(F.col("cost") + F.col("air"), 6).alias("cost"), F.size("ids").alias("hops"), "ids", "hubs").alias("m"))
        best = done if best is None else best.unionByName(done)
        best = stored(best.groupBy("trip").agg(F.min("m").alias("m")), "best")
        label = label.join(best.select("trip", F.col("m.cost").alias("_best")), "trip", "left").where("_best IS NULL OR cost + air <= _best + 0.000001").drop("_best", "air", "goal")
        if label.isEmpty():
            break
    return best.select("trip", F.col("m.cost").alias("cost"), F.col("m.hops").alias("hops"), F.col("m.ids").alias("corridors"), F.col("m.hubs").alias("hubs"))
