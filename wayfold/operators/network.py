"""Points against a network: nearest nodes and roads, links between lines, boxes of provinces, coordinates of ways."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.functions import geo
from wayfold.sources.scratch import stored

KM_PER_DEG = 111.0
#: Degrees to the edge of the first square in which a nearest node is looked for.
FIRST_DEG = 0.02


def _in_square(points: DataFrame, others: DataFrame, size: float, rings: int) -> DataFrame:
    """Join points with the others whose cell is at most so many cells away; adds ring, the cells between them.

    Both meet in coarse cells as wide as a point's square, so a point is four rows at most; others: o_lng, o_lat and more.
    """
    wide = 2 * rings + 1
    fine = lambda c: F.floor(F.col(c) / size).cast("long")
    coarse = lambda c: F.floor(c / wide).cast("long")
    p = points.withColumns({"_x": fine("lng"), "_y": fine("lat")})
    p = p.withColumn("_wx", F.explode(F.sequence(coarse(F.col("_x") - rings), coarse(F.col("_x") + rings))))
    p = p.withColumn("_wy", F.explode(F.sequence(coarse(F.col("_y") - rings), coarse(F.col("_y") + rings))))
    o = others.withColumns({"_ox": fine("o_lng"), "_oy": fine("o_lat")}).withColumns({"_wx": coarse(F.col("_ox")), "_wy": coarse(F.col("_oy"))})
    j = p.join(o, ["_wx", "_wy"]).withColumn("ring", F.greatest(F.abs(F.col("_x") - F.col("_ox")), F.abs(F.col("_y") - F.col("_oy"))))
    return j.where(F.col("ring") <= rings).drop("_wx", "_wy", "_x", "_y", "_ox", "_oy")


def nearest_node(points: DataFrame, nodes: DataFrame, most_km: float = 5.0, size: float = 0.03) -> DataFrame:
    """Snap each point to its nearest node in degrees, one of the main component first: id, node, km; none beyond the distance.

    points: id, lng, lat; nodes: node, lng, lat, main. Points without coordinates snap to nothing. Nodes count in the square of cells around a point
    that holds the distance. Squares grow from round to round, so only points without near nodes meet wide ones; nodes outside of the main component are
    looked at only for points that have none of it in their square.
    """
    rings = max(1, math.ceil(most_km / KM_PER_DEG / size) + 1)
    # Of nodes in one place the least counts.
    n = nodes.groupBy(F.coalesce("main", F.lit(False)).alias("main"), F.col("lng").alias("o_lng"), F.col("lat").alias("o_lat")).agg(F.min("node").alias("node"))
    n = stored(n, "nodes")
    left, out = stored(points.select("id", "lng", "lat").dropna(subset=["lng", "lat"]), "points"), None
    for side in (n.where("main"), n.where("NOT main")):
        reach, last = max(rings * size / 64, FIRST_DEG), out is not None and side.isEmpty()
        while not last:
            last = 2 * reach > rings * size
            j = _in_square(left, side, *((size, rings) if last else (reach, 1)))
            dx, dy = F.col("o_lng") - F.col("lng"), F.col("o_lat") - F.col("lat")
            best = j.groupBy("id", "lat").agg(F.min(F.struct((dx * dx + dy * dy).alias("d2"), "node")).alias("b")).select("id", "lat", "b.*")
            # A node nearer than the edge of the square is the nearest of all.
            best = stored(best if last else best.where(F.col("d2") <= reach * reach), "near")
            out = best if out is None else out.unionByName(best)
            left = stored(left.join(best.select("id", "lat"), ["id", "lat"], "left_anti"), "left")
            reach *= 3
    km = F.sqrt("d2") * KM_PER_DEG * F.cos(F.radians("lat"))
    return out.select("id", "node", km.alias("km")).where(F.col("km") <= most_km)


def nearest_roads(points: DataFrame, vertices: DataFrame, size: float = 0.1, rings: int = 5, slack_km: float = 5.0, most: int = 3) -> DataFrame:
    """Return each point's distance to its nearest road and the roads hardly farther: id, km (2 decimals), keys.

    vertices: key, lng, lat. Rings of cells are searched from the inside and no further than the ring that the nearest vertex is sure
    to lie in; of the roads seen there, those within the slack of the nearest count, at most so many. Small squares come first: a point whose
    answer lies within one of them does not meet the rings.
    """
    v = stored(vertices.select("key", F.col("lng").alias("o_lng"), F.col("lat").alias("o_lat")).distinct(), "vertices")
    left, out = stored(points.select("id", "lng", "lat"), "points"), None
    dx, dy = (F.col("o_lng") - F.col("lng")) * F.cos(F.radians("lat")), F.col("o_lat") - F.col("lat")
    line = Window.partitionBy("id").orderBy("d", "key")
    for part in (16, 4, 2, 1):
        reach = size / part
        # What is nearer than the edge of the square is surely nearest; a vertex in the very place of the point ends the search in its own cell.
        edge = F.lit(reach * KM_PER_DEG * 0.999) * F.cos(F.radians("lat"))
        near = _in_square(left, v, reach, 1).groupBy("id", "lat", "key").agg(F.min(F.sqrt(dx * dx + dy * dy) * KM_PER_DEG).alias("d")).where(F.col("d") <= edge)
        near = near.withColumns({"_nr": F.row_number().over(line), "_best": F.min("d").over(Window.partitionBy("id"))}).where(F.col("_nr") <= most)
        done = near.groupBy("id", "lat", "_best").agg(F.array_sort(F.collect_list(F.struct("_nr", "key", "d"))).alias("k"))
        done = stored(done.where((F.col("_best") > 0) & ((F.size("k") >= most) | (F.col("_best") + slack_km <= edge))).select("id", "_best", F.filter("k", lambda k: k["d"] <= F.col("_best") + slack_km).alias("k")), "done")
        done_ = done.select("id", geo.js_round(F.col("_best"), 2).alias("km"), F.col("k.key").alias("keys"))
        out = done_ if out is None else out.unionByName(done_)
        left = stored(left.join(done.select("id"), "id", "left_anti"), "left")
    return out.unionByName(_roads_in_rings(left, v, size, rings, slack_km, most))


def _roads_in_rings(points: DataFrame, vertices: DataFrame, size: float, rings: int, slack_km: float, most: int) -> DataFrame:
    """As nearest_roads, all rings at once. vertices: key, o_lng, o_lat."""
    j = _in_square(points, vertices, size, rings)
    dx, dy = (F.col("o_lng") - F.col("lng")) * F.cos(F.radians("lat")), F.col("o_lat") - F.col("lat")
    near = j.withColumn("d", F.sqrt(dx * dx + dy * dy) * KM_PER_DEG).groupBy("id", "key", "ring").agg(F.min("d").alias("d"))
    # One row per ring of a point: the nearest up to it, and the first ring that settles the search.
    found = near.groupBy("id").agg(F.collect_set("ring").alias("_seen"), *[F.min(F.when(F.col("ring") <= r, F.col("d"))).alias(f"_d{r}") for r in range(rings + 1)])
    stop = F.lit(rings)
    for r in reversed(range(rings)):
        stop = F.when(F.col(f"_d{r}") <= r * size * KM_PER_DEG * 0.9, r).otherwise(stop)
    seen = near.join(found.select("id", stop.alias("_stop")), "id").where(F.col("ring") <= F.col("_stop")).groupBy("id", "key").agg(F.min("d").alias("d"))
    line = Window.partitionBy("id").orderBy("d", "key")
    ranked = seen.withColumns({"_nr": F.row_number().over(line), "_best": F.min("d").over(Window.partitionBy("id"))})
    kept = ranked.where((F.col("_nr") <= most) & (F.col("d") <= F.col("_best") + slack_km))
    out = kept.groupBy("id").agg(F.min("_best").alias("km"), F.array_sort(F.collect_list(F.struct("_nr", "key"))).alias("k"))
    return out.select("id", geo.js_round(F.col("km"), 2).alias("km"), F.col("k.key").alias("keys"))


def cross_links(nodes: DataFrame, most_km: float = 1.0, penalty: float = 1.5, size: float = 0.02) -> DataFrame:
    """Link nodes of different lines that lie close: a, b (a < b), w. nodes: node, lng, lat, lines (array of line ids).

    Only neighbouring cells are searched; two nodes that are on one and the same line alone are not linked, nor are nodes in one place.
    """
    own = nodes.select(F.col("node").alias("a"), "lng", "lat", F.array_distinct("lines").alias("_a"))
    other = nodes.select(F.col("node").alias("b"), F.col("lng").alias("o_lng"), F.col("lat").alias("o_lat"), F.array_distinct("lines").alias("_b"))
    j = _in_square(own, other, size, 1).where("a < b").where(~((F.size("_a") == 1) & (F.size("_b") == 1) & (F.col("_a")[0] == F.col("_b")[0])))
    d = geo.haversine_km(F.col("lng"), F.col("lat"), F.col("o_lng"), F.col("o_lat"))
    return j.withColumn("_d", d).where((F.col("_d") > 0) & (F.col("_d") <= most_km)).select("a", "b", (F.col("_d") * penalty).alias("w"))


def province_of(points: DataFrame, boxes: DataFrame, before: dict[str, tuple[str, ...]], nested: tuple[str, ...], size: float = 2.0) -> DataFrame:
    """Give each point the province whose box holds it: adds province to points with current (a province or null).

    boxes: name, nr (their order), west, south, east, north. Where boxes overlap, a name in `before` wins over those listed there; names in `nested`
    only count where no other box holds the point; then the current one stays, then the first. Without a box the current one stays.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size).cast("long"), F.floor(F.col(b) / size).cast("long")))
    b = boxes.withColumn("_x", cells("west", "east")).withColumn("_y", cells("south", "north"))
    p = points.select("id", "lng", "lat").withColumns({"_x": F.floor(F.col("lng") / size).cast("long"), "_y": F.floor(F.col("lat") / size).cast("long")})
    hit = p.join(b, ["_x", "_y"]).where(F.col("lng").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north")))
    hits = hit.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("nr", "name"))).alias("_h")).select("id", F.col("_h.name").alias("_h"))
    own = F.filter("_h", lambda n: ~n.isin(*nested)) if nested else F.col("_h")
    pool = F.when(F.size(own) > 0, own).otherwise(F.col("_h"))
    pick = F.when(F.array_contains(pool, F.col("current")), F.col("current")).otherwise(pool[0])
    for name, others in before.items():
        pick = F.when(F.array_contains("_h", name) & F.arrays_overlap("_h", F.array(*[F.lit(o) for o in others])), F.lit(name)).otherwise(pick)
    return points.join(hits, "id", "left").withColumn("province", F.when(F.col("_h").isNull(), F.col("current")).otherwise(pick)).drop("_h")


def way_points(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Give the nodes of ways their coordinates: way, seq, lng, lat; nodes that are not known are left out. ways: way, seq, node."""
    return ways.join(nodes.select("node", "lng", "lat"), "node").select("way", "seq", "lng", "lat")


def spots_by_corridor(noted: DataFrame, near: DataFrame) -> DataFrame:
    """Count a corridor's points of interest: noted ones, near ones that are not noted, and both. noted, near: line_id, id."""
    both = noted.select("line_id", "id", F.lit(1).alias("n")).unionByName(near.select("line_id", "id", F.lit(0).alias("n"))).groupBy("line_id", "id").agg(F.max("n").alias("n"))
    return both.groupBy("line_id").agg(F.sum("n").alias("line_spots"), F.sum(1 - F.col("n")).alias("geo_spots"), F.count("*").alias("spots"))


def corridor_refs(items: DataFrame, keys: DataFrame, most: int = 12) -> tuple[DataFrame, DataFrame]:
    """Match the road numbers of points with known keys: (id, keys) with the first so many, in order; (key, spots). items: id, refs; keys: key."""
    refs = items.select("id", F.posexplode("refs").alias("pos", "key")).groupBy("id", "key").agg(F.min("pos").alias("pos")).join(keys.select("key").distinct(), "key", "left_semi")
    kept = refs.withColumn("_nr", F.row_number().over(Window.partitionBy("id").orderBy("pos"))).where(F.col("_nr") <= most)
    return kept.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "key"))).alias("k")).select("id", F.col("k.key").alias("keys")), refs.groupBy("key").agg(F.count("*").alias("spots"))


def routes_with_ref(routes: DataFrame, segments: DataFrame, ref: str) -> DataFrame:
    """Return the ids of routes that name a road number, or one of whose segments does; case aside. routes, segments: id, refs."""
    wanted = ref.strip().upper()
    has = F.exists("refs", lambda x: F.upper(x) == wanted)
    return routes.where(has).select("id").union(segments.where(has).select("id")).distinct()


def spot_stats(spots: DataFrame) -> DataFrame:
    """Count points by source (up to a colon), detour class and tier, and those with a rating: kind, value, n."""
    source = F.split(F.coalesce(F.col("source"), F.lit("unknown")), ":")[0]
    facets = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in (("source", source), ("detour_class", F.col("detour_class")), ("tier", F.col("tier")), ("rating", F.when(F.col("rating") > 0, "some")))])
    return spots.select(F.explode(facets).alias("f")).select("f.*").where("value IS NOT NULL").groupBy("kind", "value").agg(F.count("*").alias("n"))


def slice_of(spots: DataFrame, province: str | None = None, city: str | None = None, most: int = 0) -> DataFrame:
    """Return the points of a province and a city, by score if only so many (2,000 at most) are wanted."""
    out = spots
    for column, value in (("province", province), ("city", city)):
        if value:
            out = out.where(F.coalesce(F.col(column), F.lit("")) == value)
    return out.orderBy(F.coalesce("score", F.lit(0.0)).desc(), "id").limit(min(most, 2_000)) if most > 0 else out


def _degree_step() -> Column:
    """Where on a segment (0 to 1) a point lies by projection in raw degrees."""
    bx, by = F.col("b_lng") - F.col("a_lng"), F.col("b_lat") - F.col("a_lat")
    t = F.try_divide((F.col("lng") - F.col("a_lng")) * bx + (F.col("lat") - F.col("a_lat")) * by, bx * bx + by * by)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(t, F.lit(0.0))))


def degree_km() -> Column:
    """Great-circle distance of a point to its projection onto a segment in raw degrees."""
    t = _degree_step()
    return geo.haversine_km(F.col("lng"), F.col("lat"), F.col("a_lng") + (F.col("b_lng") - F.col("a_lng")) * t, F.col("a_lat") + (F.col("b_lat") - F.col("a_lat")) * t)


def project_in_degrees(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Project points onto segments in raw degrees and keep each key's nearest by great circle, the first on a tie: keys, km, at_km.

    pairs: candidate rows of a point (lng, lat) and a segment (seg, a_lng, a_lat, b_lng, b_lat, cum_a, cum_b), as they meet in grid cells.
    """
    at = F.col("cum_a") + (F.col("cum_b") - F.col("cum_a")) * _degree_step()
    best = pairs.groupBy(*keys).agg(F.min(F.struct(degree_km().alias("km"), "seg", at.alias("at"))).alias("b"))
    return best.select(*keys, F.col("b.km").alias("km"), F.col("b.at").alias("at_km"))


def tier_of(score: Column) -> Column:
    return F.when(score >= 82, "A").when(score >= 66, "B").otherwise("C")


def keeps_spur(detour_class: Column, honors: Column, score: Column, rating: Column) -> Column:
    """Tell whether a point passes the gate: one far from all roads needs an honour, a score of 74 or a rating of 4.2."""
    worth = (F.coalesce(F.size(honors), F.lit(0)) > 0) | (F.coalesce(score, F.lit(0.0)) >= 74) | (F.coalesce(rating, F.lit(0.0)) >= 4.2)
    return ~F.coalesce(detour_class == "spur", F.lit(False)) | worth


def plausible_rail_point(lng: Column, lat: Column) -> Column:
    """Tell whether a point can lie on a railway of the country: inside its box, and not on the islands east of it."""
    return F.coalesce(~F.isnan(lng) & ~F.isnan(lat) & lng.between(73, 135) & lat.between(18, 54) & ~((lng >= 128.5) & (lat < 41.5)), F.lit(False))
