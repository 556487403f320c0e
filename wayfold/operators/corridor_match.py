"""The corridor that a trip's stops lie on, by places and names, and the slice of it that the trip runs over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.functions.geo import haversine_km
from wayfold.functions.names import same_station
from wayfold.operators.corridors import near_segments
from wayfold.operators.lines import at_km, line_stats, segments, with_cum_km
from wayfold.operators.spatial import nearest_segment
from wayfold.sources.scratch import stored

#: Km within which a stop counts as on the line, an end does, an end of another name is at the line's end; progress between which it is midway.
FIT_KM, END_KM, TIP_KM, MIDWAY = 20.0, 15.0, 12.0, (0.03, 0.97)
#: Weights of places and names; the share of stops with a rival name that rules a corridor out; scores that are as good as equal.
PLACE_WEIGHT, NAME_WEIGHT, RIVALS, AS_GOOD = 0.65, 0.35, 0.2, 0.05
#: Fixed values in km: from a named terminus to its line, from an end to the line, of an approach (from, to), from a stop to the slice; shares of stops and of length.
TERMINUS_KM, OD_KM, APPROACH_KM, STOP_KM, STOPS_SHARE, LENGTH_KM, LENGTH_SHARE = 25.0, 45.0, (0.2, 8.0), 40.0, 0.55, 80.0, 0.45
_SIDE = "[东西南北]$"


def _plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "站$", ""))


def _parts(c: Column) -> Column:
    """All parts of a name: a name within another is equal to one of them."""
    n = F.char_length(c)
    return F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substring(c, i, k))))


def like_names(stops: DataFrame, stations: DataFrame) -> DataFrame:
    """Return name, station: which stop names mean which stations. A join on parts of names, of each name once; both sides are shuffled, as parts are many."""
    a = stops.select("name").where("name IS NOT NULL").distinct().withColumn("_a", _plain(F.col("name"))).where("_a <> ''")
    b = stations.select(F.col("name").alias("station")).where("station IS NOT NULL").distinct().withColumn("_b", _plain(F.col("station"))).where("_b <> ''")
    inside = a.hint("merge").join(b.withColumn("_a", F.explode(F.array_distinct(_parts(F.col("_b"))))), "_a").select("name", "station")
    around = b.hint("merge").join(a.withColumn("_b", F.explode(F.array_distinct(_parts(F.col("_a"))))), "_b").select("name", "station")
    return inside.unionByName(around).distinct().where(same_station(F.col("name"), F.col("station")))


def _rivals(stops: DataFrame, stations: DataFrame) -> DataFrame:
    """Return name, corridor where a corridor has a station of the same town but another side, and not the stop's own."""
    stem = lambda c: F.regexp_replace(c, _SIDE, "")
    a = stops.select("name").where("name IS NOT NULL").distinct().withColumn("_n", _plain(F.col("name"))).withColumn("_stem", stem(F.col("_n"))).where(F.char_length("_stem") >= 2)
    b = stations.select("corridor", _plain(F.col("name")).alias("_h")).withColumn("_stem", stem(F.col("_h")))
    apart = a.hint("merge").join(b, "_stem").where((F.col("_n") != F.col("_h")) & (F.col("_n").rlike(_SIDE) | F.col("_h").rlike(_SIDE))).select("name", "_n", "corridor").distinct()
    own = b.select("corridor", F.col("_h").alias("_n"))
    return apart.join(own, ["corridor", "_n"], "left_anti").select("name", "corridor")


def _projected(stops: DataFrame, rails: DataFrame, km: float, window_deg: float | None = None) -> DataFrame:
    """Stops with a place within a distance of corridors: trip, idx, corridor, off (km), along (km)."""
    pairs = near_segments(stops, rails, km, window_deg)
    near = nearest_segment(pairs, ["line_id", "id"], ["lng", "lat"], rounded=False).where(F.col("dist_km") <= km)
    return near.select("id.trip", "id.idx", F.col("line_id").alias("corridor"), F.col("dist_km").alias("off"), F.col("along_km").alias("along"))


def _tips(rails: DataFrame) -> DataFrame:
    place = F.struct("lng", "lat")
    return rails.groupBy("corridor").agg(F.min_by(place, "seq").alias("s"), F.max_by(place, "seq").alias("t"), F.count("*").alias("points"))


def match_scores(stops: DataFrame, rails: DataFrame, stations: DataFrame, window_deg: float | None = None) -> DataFrame:
    """Score corridors for trips: trip, corridor, score, hits, points. stops: trip, idx, name, lng, lat; rails: corridor, seq, lng, lat; stations: corridor, pos, name.

    Both end stops must belong to the corridor: by name, or within 15 km of the line; a stop whose town has a station of another side there counts only
    at the line's end or midway on it. The score is 0.65 of the share of placed stops on the line and 0.35 of the share of named ones. Where a fifth of the
    stops have such rivals and few have names of the line, it is ruled out, and so is a corridor with little of either.
    """
    rails, stations = rails.hint("merge"), stations.hint("merge")  # they grow with the input, however small their files are
    stops = stored(stops.select("trip", F.col("idx").cast("int").alias("idx"), "name", "lng", "lat"), "stops")
    length = line_stats(rails.withColumnRenamed("corridor", "line_id")).select(F.col("line_id").alias("corridor"), "length_km")
    enough = stations.groupBy("corridor").agg(F.countDistinct("name").alias("_names")).where("_names > 1").select("corridor")
    near = stored(_projected(stops, rails, FIT_KM, window_deg).join(enough, "corridor", "left_semi"), "near")
    named = stops.select("trip", "idx", "name").join(like_names(stops, stations), "name").join(stations.select("corridor", F.col("name").alias("station")), "station").select("trip", "idx", "corridor").distinct().join(enough, "corridor", "left_semi")
    named = stored(named.withColumn("named", F.lit(True)), "named")
    ends = stops.groupBy("trip").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count("*").alias("n")).where("first < last")
    # Corridors that hold both ends in some way; only for them all stops are looked at.
    touch = near.select("trip", "idx", "corridor").union(named.select("trip", "idx", "corridor")).join(ends, "trip").where("idx = first OR idx = last")
    asked = touch.groupBy("trip", "corridor", "first", "last", "n").agg(F.countDistinct("idx").alias("_both")).where("_both = 2").drop("_both")
    j = asked.join(stops, "trip").join(near, ["trip", "idx", "corridor"], "left").join(named, ["trip", "idx", "corridor"], "left")
    j = j.join(_rivals(stops, stations).withColumn("rival", F.lit(True)), ["name", "corridor"], "left").join(_tips(rails), "corridor").join(length, "corridor")
    tip = F.least(haversine_km(F.col("lng"), F.col("lat"), F.col("s.lng"), F.col("s.lat")), haversine_km(F.col("lng"), F.col("lat"), F.col("t.lng"), F.col("t.lat")))
    close = F.coalesce(F.col("off") <= END_KM, F.lit(False))
    let = close & ((tip <= TIP_KM) | (F.col("along") / F.col("length_km")).between(*MIDWAY))
    j = j.withColumns({"rival": F.coalesce("rival", F.lit(False)), "named": F.coalesce("named", F.lit(False)), "let": F.coalesce(let, F.lit(False)), "close": close, "placed": F.col("lng").isNotNull() & F.col("lat").isNotNull()})
    is_end = (F.col("idx") == F.col("first")) | (F.col("idx") == F.col("last"))
    belongs = F.col("named") | F.when(F.col("rival"), F.col("let")).otherwise(F.col("close"))
    fits = F.when(F.col("rival"), F.col("let")).otherwise(F.coalesce(F.col("off") <= FIT_KM, F.lit(False)))
    per = j.groupBy("trip", "corridor", "n", "points").agg(
        F.bool_and(~is_end | belongs).alias("_in"), F.count_if(F.col("named")).alias("hits"), F.count_if(F.col("placed")).alias("_placed"),
        F.count_if(F.col("placed") & (~F.col("rival") | F.col("let"))).alias("_eligible"), F.count_if(F.col("placed") & fits).alias("_near"),
        (F.count_if(F.col("rival") & ~F.col("let")) / F.col("n")).alias("_rivals"), F.bool_and(~is_end | F.col("named")).alias("_named_ends"),
    ).where("_in")
    place = F.when((F.col("_placed") < 2) | (F.col("_eligible") < 2), 0.0).otherwise(F.col("_near") / F.col("_eligible"))
    per = per.withColumns({"_place": place, "_name": F.col("hits") / F.col("n")})
    out = (F.col("_rivals") >= RIVALS) & (F.col("hits") < F.greatest(F.lit(3), F.ceil(F.col("n") * 0.25)))
    good = (F.col("_place") >= 0.5) | (F.col("_named_ends") & (F.col("hits") >= 2)) | ((F.col("hits") >= 3) & (F.col("_name") >= 0.35))
    return per.where(~out & good).select("trip", "corridor", (F.col("_place") * PLACE_WEIGHT + F.col("_name") * NAME_WEIGHT).alias("score"), "hits", "points")


def best_corridor(scores: DataFrame) -> DataFrame:
    """Choose each trip's corridor: trip, corridor, score. Corridors are gone through in order; one takes over that scores over 0.05 more, or as good with fewer points or more hits.

    As good as is not transitive, so the order counts, and a trip's few candidates are folded one by one.
    """
    rows = scores.groupBy("trip").agg(F.array_sort(F.collect_list(F.struct("corridor", F.col("score").cast("double").alias("score"), F.col("hits").cast("long").alias("hits"), F.col("points").cast("long").alias("points")))).alias("c"))

    def step(best: Column, x: Column) -> Column:
        alike = F.abs(x["score"] - best["score"]) <= AS_GOOD
        return F.when((x["score"] > best["score"] + AS_GOOD) | (alike & (x["points"] < best["points"])) | (alike & (x["hits"] > best["hits"])), x).otherwise(best)

    best = F.aggregate(F.slice("c", 2, F.size("c")), F.col("c")[0], step)
    return rows.select("trip", best.alias("b")).select("trip", "b.corridor", "b.score")


def slices(stops: DataFrame, chosen: DataFrame, rails: DataFrame, stations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cut each trip's stretch out of its corridor: (points, verdicts). chosen: trip, corridor.

    The ends are the first and the last stop, never one between: by its place, or the line's end if its name is one of the first (last) two
    stations and it has no place or one over 25 km off. Both must lie within 45 km of the line. Points: trip, i, lng, lat, in the trip's direction, with an end 0.2 to 8 km
    off the line put on. Verdicts: trip, corridor, stage: ok, no_end, off_line, no_length, stops (fewer than 55 in 100 within 40 km of the slice) or
    length (under 45 in 100 of the way over the stops, if that is over 80 km). Only ok trips have points.
    """
    rails, stations = rails.hint("merge"), stations.hint("merge")
    order = Window.partitionBy("corridor")
    st = stations.withColumns({"_i": F.row_number().over(order.orderBy("pos")), "_n": F.count("*").over(order)})
    tips = _tips(rails)
    s = stored(stops.join(chosen.select("trip", "corridor"), "trip").withColumn("idx", F.col("idx").cast("int")), "stops")
    span = Window.partitionBy("trip")
    ends = s.withColumns({"_a": F.min("idx").over(span), "_b": F.max("idx").over(span)}).where("(idx = _a OR idx = _b) AND _a < _b").withColumn("start", F.col("idx") == F.col("_a"))
    term = st.where("_i <= 2 OR _i > _n - 2").select("corridor", F.col("name").alias("station"), (F.col("_i") <= 2).alias("_s"), (F.col("_i") > F.col("_n") - 2).alias("_t"))
    called = ends.select("trip", "idx", "name", "corridor", "start").join(like_names(ends, stations), "name").join(term, ["corridor", "station"]).where((F.col("start") & F.col("_s")) | (~F.col("start") & F.col("_t"))).select("trip", "idx").distinct().withColumn("called", F.lit(True))
    on = _projected_own(ends, rails)
    e = ends.join(called, ["trip", "idx"], "left").join(on, ["trip", "idx"], "left").join(tips, "corridor")
    tip = F.when(F.col("start"), F.col("s")).otherwise(F.col("t"))
    bare = F.col("lng").isNull() | F.col("lat").isNull()
    use_tip = F.coalesce("called", F.lit(False)) & (bare | (F.col("off") > TERMINUS_KM))
    e = e.select("trip", "corridor", "idx", "start", F.when(use_tip, tip["lng"]).otherwise(F.col("lng")).alias("lng"), F.when(use_tip, tip["lat"]).otherwise(F.col("lat")).alias("lat"))
    e = stored(e.join(_projected_own(e, rails), ["trip", "idx"], "left"), "ends")
    side = lambda start, c: F.max(F.when(F.col("start") == start, F.col(c)))
    od = e.groupBy("trip", "corridor").agg(*[side(b, c).alias(f"{n}_{c}") for b, n in ((True, "a"), (False, "b")) for c in ("lng", "lat", "off", "along", "idx")])
    length = line_stats(rails.withColumnRenamed("corridor", "line_id")).select(F.col("line_id").alias("corridor"), "length_km")
    od = od.join(length, "corridor").withColumns({"_lo": F.least("a_along", "b_along"), "_hi": F.greatest("a_along", "b_along"), "_back": F.col("a_along") > F.col("b_along")})
    stage = F.when(F.col("a_lng").isNull() | F.col("b_lng").isNull(), "no_end").when(F.coalesce(F.greatest("a_off", "b_off"), F.lit(1e9)) > OD_KM, "off_line").when((F.col("_hi") - F.col("_lo")) / F.col("length_km") < 0.0005, "no_length")
    od = stored(od.withColumn("stage", stage), "od")
    cut = od.where("stage IS NULL")
    rail = rails.withColumnRenamed("corridor", "line_id")
    inner = cut.join(with_cum_km(rail).withColumnRenamed("line_id", "corridor"), "corridor").where("cum_km > _lo AND cum_km < _hi").select("trip", "corridor", F.col("cum_km").alias("km"), "lng", "lat", "_back")
    wanted = cut.select("trip", "corridor", "_back", F.explode(F.array("_lo", "_hi")).alias("km"))
    tips_at = at_km(rail, wanted.select(F.col("corridor").alias("line_id"), "km").distinct()).select(F.col("line_id").alias("corridor"), "km", "lng", "lat")
    line = inner.unionByName(wanted.join(tips_at, ["corridor", "km"]).select("trip", "corridor", "km", "lng", "lat", "_back"))
    line = line.select("trip", F.when(F.col("_back"), -F.col("km")).otherwise(F.col("km")).alias("seq"), "lng", "lat")
    line = stored(line, "slice")
    here = F.struct("lng", "lat")
    first = line.groupBy("trip").agg(F.min_by(here, "seq").alias("_s"), F.max_by(here, "seq").alias("_t"), F.min("seq").alias("_from"), F.max("seq").alias("_to"))
    near = cut.join(first, "trip")
    gap = lambda n, p: haversine_km(F.col(f"{n}_lng"), F.col(f"{n}_lat"), F.col(f"{p}.lng"), F.col(f"{p}.lat"))
    put = lambda n, p, seq: near.where((gap(n, p) > APPROACH_KM[0]) & (gap(n, p) < APPROACH_KM[1])).select("trip", seq.alias("seq"), F.round(f"{n}_lng", 6).alias("lng"), F.round(f"{n}_lat", 6).alias("lat"))
    line = stored(line.unionByName(put("a", "_s", F.col("_from") - 1)).unionByName(put("b", "_t", F.col("_to") + 1)), "line")

    full = s.join(e.select("trip", "idx", F.col("lng").alias("_lng"), F.col("lat").alias("_lat")), ["trip", "idx"], "left").join(cut.select("trip"), "trip", "left_semi")
    full = full.select("trip", "idx", F.coalesce("_lng", "lng").alias("lng"), F.coalesce("_lat", "lat").alias("lat")).where("lng IS NOT NULL AND lat IS NOT NULL")
    own = nearest_segment(full.withColumnRenamed("trip", "line_id").join(segments(line.withColumnRenamed("trip", "line_id")), "line_id"), ["line_id", "idx"], ["lng", "lat"], rounded=False)
    fit = own.groupBy(F.col("line_id").alias("trip")).agg(F.count_if(F.col("dist_km") <= STOP_KM).alias("_near"), F.count("*").alias("_n"))
    chord = line_stats(full.select(F.col("trip").alias("line_id"), F.col("idx").alias("seq"), "lng", "lat")).select(F.col("line_id").alias("trip"), F.col("length_km").alias("_chord"))
    rail_km = line_stats(line.withColumnRenamed("trip", "line_id")).select(F.col("line_id").alias("trip"), F.col("length_km").alias("_rail"))
    v = od.select("trip", "corridor", "stage").join(fit, "trip", "left").join(chord, "trip", "left").join(rail_km, "trip", "left")
    late = F.when(F.col("_near") < F.ceil(F.col("_n") * STOPS_SHARE), "stops").when((F.col("_chord") > LENGTH_KM) & (F.col("_rail") < F.col("_chord") * LENGTH_SHARE), "length").otherwise("ok")
    verdicts = stored(v.select("trip", "corridor", F.coalesce("stage", late).alias("stage")), "verdicts")
    points = line.join(verdicts.where("stage = 'ok'").select("trip"), "trip", "left_semi")
    return points.withColumn("i", F.row_number().over(Window.partitionBy("trip").orderBy("seq")) - 1).select("trip", "i", "lng", "lat"), verdicts


def _projected_own(ends: DataFrame, rails: DataFrame) -> DataFrame:
    """Project ends of trips onto the trip's own corridor: trip, idx, off, along (km)."""
    e = ends.where("lng IS NOT NULL AND lat IS NOT NULL").select(F.col("corridor").alias("line_id"), F.struct("trip", "idx").alias("id"), "lng", "lat")
    near = nearest_segment(e.join(segments(rails.withColumnRenamed("corridor", "line_id")), "line_id"), ["line_id", "id"], ["lng", "lat"], rounded=False)
    return near.select("id.trip", "id.idx", F.col("dist_km").alias("off"), F.col("along_km").alias("along"))
