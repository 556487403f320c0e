"""Lines between two places over raw ways whose ends lie close to each other, and lines traced through control points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.functions.geo import KM_PER_LAT, cell, haversine_km
from wayfold.operators import search
from wayfold.operators.graph import near_components
from wayfold.operators.network import _in_square, nearest_node
from wayfold.operators.routing import routes, settle
from wayfold.sources.scratch import stored

#: Degrees between ends of ways that connect, km up to which places snap to a way, and up to which two places are one.
CONNECT_DEG, SNAP_KM, SAME_KM = 0.012, 8.0, 0.5


def _ways(points: DataFrame) -> DataFrame:
    """Ways by length and ends: way, km, n, and s, t (lng, lat of the first and last point)."""
    order = Window.partitionBy("way").orderBy("seq")
    step = F.coalesce(haversine_km(F.lag("lng").over(order), F.lag("lat").over(order), F.col("lng"), F.col("lat")), F.lit(0.0))
    p = points.dropna(subset=["way", "seq", "lng", "lat"]).withColumn("_d", step)
    here = F.struct("lng", "lat")
    return p.groupBy("way").agg(F.sum("_d").alias("km"), F.count("*").alias("n"), F.min_by(here, "seq").alias("s"), F.max_by(here, "seq").alias("t"))


def connections(ways: DataFrame, within_deg: float = CONNECT_DEG) -> DataFrame:
    """Return the steps from one way to the next: node, to, w. A node is 2 * way + the side on which the way is left; w is the length of the next way.

    Ends of different ways connect where they lie less than so many degrees apart; they meet in cells of that size.
    """
    ends = ways.select("way", "km", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("s.lng"), F.col("s.lat")), F.struct(F.lit(1).alias("side"), F.col("t.lng"), F.col("t.lat")))).alias("e")).select("way", "km", "e.*")
    at = lambda c: cell(F.col(c), 0.0, within_deg)
    around = F.explode(F.array(*[F.struct((at("lng") + dx).alias("x"), (at("lat") + dy).alias("y")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]))
    own = ends.select("way", "side", "lng", "lat", around.alias("_c")).select("way", "side", "lng", "lat", "_c.*")
    other = ends.select(F.col("way").alias("o"), F.col("side").alias("o_side"), F.col("km").alias("w"), F.col("lng").alias("o_lng"), F.col("lat").alias("o_lat"), at("lng").alias("x"), at("lat").alias("y"))
    j = own.hint("merge").join(other, ["x", "y"]).where((F.col("way") != F.col("o")) & (F.sqrt(F.pow(F.col("lng") - F.col("o_lng"), 2) + F.pow(F.col("lat") - F.col("o_lat"), 2)) < within_deg))
    return j.select((2 * F.col("way") + F.col("side")).alias("node"), (2 * F.col("o") + 1 - F.col("o_side")).alias("to"), "w").distinct()


def _nearest_vertex(places: DataFrame, points: DataFrame, snap_km: float) -> DataFrame:
    """The nearest vertex of a way to each place, by great-circle distance, then way, then place on it: id, way, at (from 0). places: id, lng, lat.

    Both sides are shuffled, as cells make many rows of a small table. Of vertices in one place the first counts; small squares are looked at before wide ones.
    """
    order = Window.partitionBy("way").orderBy("seq")
    v = points.dropna(subset=["way", "seq", "lng", "lat"]).withColumn("at", F.row_number().over(order) - 1)
    v = v.groupBy(F.col("lng").alias("o_lng"), F.col("lat").alias("o_lat")).agg(F.min(F.struct("way", "at")).alias("_v")).select("o_lng", "o_lat", "_v.*")
    size = snap_km / KM_PER_LAT
    km = haversine_km(F.col("lng"), F.col("lat"), F.col("o_lng"), F.col("o_lat"))
    v, left, out = stored(v, "vertices"), stored(places.dropna(), "places"), None
    for part in (16, 4):
        reach = size / part
        edge = reach * KM_PER_LAT * 0.99 * F.cos(F.radians(F.least(F.abs("lat") + reach, F.lit(90.0))))
        found = _in_square(left, v, reach, 1).groupBy("id", "lat").agg(F.min(F.struct(km.alias("km"), "way", "at")).alias("b")).where(F.col("b.km") <= edge)
        found = stored(found.select("id", "b.way", "b.at"), "near")
        out = found if out is None else out.unionByName(found)
        left = stored(left.join(found.select("id"), "id", "left_anti"), "left")
    pad = F.lit(snap_km) / (110.0 * F.cos(F.radians(F.least(F.abs("lat") + 2 * size, F.lit(88.0)))))
    around = lambda c, d: F.explode(F.sequence(cell(F.col(c) - d, -180.0, size), cell(F.col(c) + d, -180.0, size)))
    p = left.withColumn("x", around("lng", pad)).withColumn("y", around("lat", F.lit(size)))
    v = v.select("way", "at", "o_lng", "o_lat", cell(F.col("o_lng"), -180.0, size).alias("x"), cell(F.col("o_lat"), -180.0, size).alias("y"))
    j = p.hint("merge").join(v, ["x", "y"]).withColumn("km", km).where(F.col("km") <= snap_km)
    return out.unionByName(j.groupBy("id").agg(F.min(F.struct("km", "way", "at")).alias("b")).select("id", "b.way", "b.at"))


def way_paths(points: DataFrame, pairs: DataFrame, snap_km: float = SNAP_KM, within_deg: float = CONNECT_DEG) -> DataFrame:
    """Return the ways of each pair's cheapest path in order: pair, nr (from 0), way, backward, km (their length up to this way's end).

    points: way, seq, lng, lat; pairs: pair, a_lng, a_lat, b_lng, b_lat. A path begins and ends with the ways that the places snap to and may leave
    a way at either end, but enters the next one where they connect. Pairs that do not snap or connect have no rows.
    Ways that connect are searched in a task where they fit one (see search.py), else in rounds; there is no bound on paths.
    """
    ways = stored(_ways(points), "ways")
    sides = F.array(F.struct(F.lit("a").alias("end"), F.col("a_lng").alias("lng"), F.col("a_lat").alias("lat")), F.struct(F.lit("b").alias("end"), F.col("b_lng").alias("lng"), F.col("b_lat").alias("lat")))
    places = pairs.select("pair", F.explode(sides).alias("e")).select(F.struct("pair", "e.end").alias("id"), "e.lng", "e.lat")
    snapped = stored(_nearest_vertex(places, points, snap_km), "snapped").select("id.pair", "id.end", "way")
    ends = snapped.groupBy("pair").agg(F.max(F.when(F.col("end") == "a", F.col("way"))).alias("a"), F.max(F.when(F.col("end") == "b", F.col("way"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    ends = stored(ends, "pairs")
    one = ends.where("a = b").join(ways.select(F.col("way").alias("a"), "km"), "a").select("pair", F.lit(0).alias("nr"), F.col("a").alias("way"), F.lit(False).alias("backward"), "km")
    asked = ends.where("a <> b")
    # Ways whose ends lie in the same or in neighbouring cells are dealt out together; what connects is among them.
    number = lambda x, y: y * 4_294_967_296 + x + 2_147_483_648
    at = lambda c: cell(F.col(c), 0.0, within_deg)
    laid = ways.select("way", "km", *[F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in "st" for c in ("lng", "lat")]).withColumns({f"{e}_{c[0]}": at(f"{e}_{c[1]}") for e in "st" for c in (("x", "lng"), ("y", "lat"))})
    laid = stored(laid.withColumns({e: number(F.col(f"{e}_x"), F.col(f"{e}_y")) for e in "st"}), "laid")
    cells = stored(laid.select(F.explode(F.array(*[F.struct(F.col(f"{e}_x").alias("x"), F.col(f"{e}_y").alias("y")) for e in "st"])).alias("c")).select("c.*").distinct().withColumn("node", number(F.col("x"), F.col("y"))), "cells")
    around = F.explode(F.array(*[number(F.col("x") + dx, F.col("y") + dy) for dx, dy in ((1, -1), (1, 0), (1, 1), (0, 1))])).alias("b")
    beside = cells.select(F.col("node").alias("a"), around).join(cells.select(F.col("node").alias("b")), "b", "left_semi")
    links = stored(laid.select(F.col("s").alias("a"), F.col("t").alias("b")).where("a <> b").unionByName(beside.select("a", "b")).distinct(), "links")
    label = stored(cells.select("node").join(near_components(links, "a", "b"), "node", "left").withColumn("label", F.coalesce("label", "node")), "labels")
    home = laid.select("way", F.col("s").alias("origin"))
    by = [home.join(label.withColumnRenamed("node", "origin"), "origin").select(F.col("way").alias(c), F.col("origin").alias(f"{c}_cell"), F.col("label").alias("_l")) for c in "ab"]
    near = stored(asked.select("a", "b").distinct().join(by[0], "a").join(by[1], ["b", "_l"]).select(F.lit(0).alias("g"), F.col("a_cell").alias("origin"), F.col("a").alias("from"), F.col("b").alias("to")), "asked")
    edges = laid.select(F.lit(0).alias("g"), F.col("s").alias("a"), F.col("way").alias("id"), F.col("km").alias("w"), "s_lng", "s_lat", "t_lng", "t_lat")
    dealt, wanted, large = search.deal(edges, near, label)
    keyed = asked.join(search.way_paths(dealt, wanted, within_deg), ["a", "b"]).select("pair", "nr", "way", "backward", "km")
    out = keyed.unionByName(one)
    if large.isEmpty():
        return out
    rest = label.join(large, "label").select(F.col("node").alias("origin"))
    some = stored(ways.join(home.join(rest, "origin").select("way"), "way", "left_semi"), "ways")
    return out.unionByName(_paths_in_rounds(some, asked.join(some.select(F.col("way").alias("a")), "a", "left_semi"), within_deg))


def _paths_in_rounds(ways: DataFrame, ends: DataFrame, within_deg: float) -> DataFrame:
    """As way_paths, in rounds over whole tables: as many as the longest path has ways. ends: pair, a, b, ways that differ."""
    # Places stand outside of the ways: one leaves the first way at either end, and arrives on leaving the last one at either end.
    begin, arrive = (lambda c: -2 - 2 * F.col(c)), (lambda c: -3 - 2 * F.col(c))
    both = lambda c: F.explode(F.array(2 * F.col(c), 2 * F.col(c) + 1))
    first = ends.select("a").distinct().join(ways.select(F.col("way").alias("a"), "km"), "a").select(begin("a").alias("node"), both("a").alias("to"), F.col("km").alias("w"))
    last = ends.select("b").distinct().select(both("b").alias("node"), arrive("b").alias("to"), F.lit(1.0).alias("w"))
    arcs = stored(connections(ways, within_deg).unionByName(first).unionByName(last).withColumn("g", F.lit(0)), "arcs", sort=False)
    asked = ends.where("a <> b").select(F.lit(0).alias("g"), begin("a").alias("origin"), arrive("b").alias("dest")).distinct()
    best = settle(arcs, asked)
    front = stored(best.withColumnRenamed("node", "dest").join(asked, ["g", "origin", "dest"]).select("origin", "dest", F.col("dest").alias("node"), "cost"), "front")
    found = None
    back = arcs.select(F.col("to").alias("node"), F.col("node").alias("_n"), "w")
    costs = best.select("origin", F.col("node").alias("_n"), F.col("cost").alias("_c"))
    nr = 0
    while True:
        step = front.where("node <> origin").join(back, "node").join(costs, ["origin", "_n"]).where(F.col("_c") + F.col("w") == F.col("cost"))
        step = stored(step.groupBy("origin", "dest").agg(F.min(F.struct("_n", "_c")).alias("p")).select("origin", "dest", F.col("p._n").alias("node"), F.col("p._c").alias("cost"), F.lit(nr).alias("back")), "step")
        if step.isEmpty():
            break
        found = step if found is None else stored(found.unionByName(step), "found")
        front, nr = step.drop("back"), nr + 1
    if found is None:
        return ends.select("pair", F.lit(0).alias("nr"), F.col("a").alias("way"), F.lit(False).alias("backward"), F.lit(0.0).alias("km")).limit(0)
    on = found.where("node >= 0")
    length = on.groupBy("origin", "dest").agg(F.max("back").alias("_last"))
    path = on.join(length, ["origin", "dest"]).select("origin", "dest", (F.col("_last") - F.col("back")).alias("nr"), F.floor(F.col("node") / 2).cast("long").alias("way"), (F.col("node") % 2 == 0).alias("backward"), F.col("cost").alias("km"))
    keyed = ends.where("a <> b").select("pair", begin("a").alias("origin"), arrive("b").alias("dest"))
    return keyed.join(path, ["origin", "dest"]).select("pair", "nr", "way", "backward", "km")


def stitched_lines(points: DataFrame, pairs: DataFrame, snap_km: float = SNAP_KM, within_deg: float = CONNECT_DEG) -> DataFrame:
    """Return each pair's line: pair, i, lng, lat. The ways of its path end to end, their first points but for the first way's left out, clipped
    to the points nearest to the two places; two places less than 0.5 km apart are joined straight.
    """
    near = haversine_km(F.col("a_lng"), F.col("a_lat"), F.col("b_lng"), F.col("b_lat")) < SAME_KM
    pairs = stored(pairs, "asked")
    path = stored(way_paths(points, pairs.where(~near), snap_km, within_deg), "paths")
    order = Window.partitionBy("way").orderBy("seq")
    p = points.dropna(subset=["way", "seq", "lng", "lat"]).withColumns({"_i": F.row_number().over(order) - 1, "_n": F.count("*").over(Window.partitionBy("way"))})
    # Points before each way of a path; a path's ways are few.
    sizes = path.join(p.where("_i = 0").select("way", "_n"), "way")
    sizes = sizes.withColumn("_from", F.coalesce(F.sum(F.col("_n") - 1).over(Window.partitionBy("pair").orderBy("nr").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    j = sizes.select("pair", "nr", "way", "backward", "_from").join(p.select("way", "_i", "_n", "lng", "lat"), "way")
    place = F.when(F.col("backward"), F.col("_n") - 1 - F.col("_i")).otherwise(F.col("_i"))
    line = j.withColumn("_at", place).where("nr = 0 OR _at > 0").select("pair", (F.col("_from") + F.col("_at")).alias("i"), "lng", "lat")
    line = stored(line.join(pairs, "pair"), "line")
    to = lambda c: F.min(F.struct(haversine_km(F.col("lng"), F.col("lat"), F.col(f"{c}_lng"), F.col(f"{c}_lat")).alias("km"), "i"))
    cut = line.groupBy("pair").agg(to("a").alias("a"), to("b").alias("b")).select("pair", F.least("a.i", "b.i").alias("_lo"), F.greatest("a.i", "b.i").alias("_hi"))
    clipped = line.join(cut, "pair").where((F.col("i").between(F.col("_lo"), F.col("_hi"))) | (F.col("_lo") == F.col("_hi")))
    ends = F.array(F.struct(F.lit(0).cast("long").alias("i"), F.col("a_lng").alias("lng"), F.col("a_lat").alias("lat")), F.struct(F.lit(1).cast("long").alias("i"), F.col("b_lng").alias("lng"), F.col("b_lat").alias("lat")))
    return clipped.select("pair", F.col("i").cast("long").alias("i"), "lng", "lat").unionByName(pairs.where(near).select("pair", F.explode(ends).alias("e")).select("pair", "e.*"))


def nearest_in_group(points: DataFrame, targets: DataFrame, first: float = 0.02) -> DataFrame:
    """Return each point's nearest target of its group: id, target, km; ties go to the lesser target. points: grp, id, lng, lat; targets: grp, target, lng, lat.

    Cells grow eightfold from round to round; a point goes on until what it has found is nearer than anything outside of its cells.
    """
    targets = stored(targets.select("grp", "target", F.col("lng").alias("o_lng"), F.col("lat").alias("o_lat")), "targets")
    left, size, out = stored(points.select("grp", "id", "lng", "lat"), "points"), first, None
    while True:
        last = size >= 360
        at = lambda c: F.lit(0).cast("long") if last else cell(F.col(c), -180.0, size)  # noqa: B023, E731
        around = (0,) if last else (-1, 0, 1)
        own = left.withColumn("_c", F.explode(F.array(*[F.struct((at("lng") + dx).alias("x"), (at("lat") + dy).alias("y")) for dx in around for dy in around])))
        j = own.select("grp", "id", "lng", "lat", "_c.*").join(targets.withColumns({"x": at("o_lng"), "y": at("o_lat")}), ["grp", "x", "y"])
        km: Column = haversine_km(F.col("lng"), F.col("lat"), F.col("o_lng"), F.col("o_lat"))
        reach = F.lit(1e9) if last else size * KM_PER_LAT * 0.99 * F.cos(F.radians(F.least(F.abs("lat") + 2 * size, F.lit(90.0))))
        found = j.groupBy("grp", "id", "lat").agg(F.min(F.struct(km.alias("km"), "target")).alias("b")).where(F.col("b.km") <= reach)
        found = stored(found.select("id", "b.target", "b.km"), "near")
        out = found if out is None else out.unionByName(found)
        if last:
            return out
        left = stored(left.join(found.select("id"), "id", "left_anti"), "left")
        if left.isEmpty():
            return out
        size *= 8


def traces(controls: DataFrame, nodes: DataFrame, edges: DataFrame, snap_km: float = SNAP_KM, size: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Trace lines through control points, each passed in turn: (steps, gaps).

    controls: line, seq, lng, lat; nodes: node, lng, lat, main; edges: id, g (0), a, b, w as for routing.routes. Controls that do not snap to the graph are passed over. Steps:
    line, leg, back, node, from a control's node towards the next one's, back from the leg's end. Where the next control is on another part of
    the graph, the leg ends at the reachable node nearest to it, and a gap follows: line, leg, from_node, to_node, km.
    """
    nodes = stored(nodes, "nodes")
    c = controls.withColumn("id", F.struct("line", "seq"))
    snap = nearest_node(c.select("id", "lng", "lat"), nodes, snap_km, size).select("id", "node")
    order = Window.partitionBy("line").orderBy("seq")
    legs = c.join(snap, "id").withColumns({"origin": F.lag("node").over(order), "leg": F.row_number().over(order) - 1}).where("origin IS NOT NULL")
    label = stored(near_components(edges, "a", "b"), "labels")
    legs = legs.select("line", "leg", "origin", F.col("node").alias("goal"), "lng", "lat")
    legs = legs.join(label.select(F.col("node").alias("origin"), F.col("label").alias("o_label")), "origin", "left").join(label.select(F.col("node").alias("goal"), F.col("label").alias("g_label")), "goal", "left")
    legs = stored(legs.withColumn("joined", F.coalesce(F.col("o_label") == F.col("g_label"), F.col("origin") == F.col("goal"))), "legs")
    parts = label.join(nodes, "node").select(F.col("label").alias("grp"), F.col("node").alias("target"), "lng", "lat")
    apart = legs.where("NOT joined")
    near = nearest_in_group(apart.where("o_label IS NOT NULL").select(F.col("o_label").alias("grp"), F.struct("line", "leg").alias("id"), "lng", "lat"), parts).select("id.line", "id.leg", "target")
    legs = stored(legs.join(near, ["line", "leg"], "left").withColumn("dest", F.when(F.col("joined"), F.col("goal")).otherwise(F.coalesce("target", "origin"))), "legs")
    paths = routes(edges, legs.select(F.lit(0).alias("g"), "origin", "dest")).select("origin", "dest", "back", "node")
    steps = legs.select("line", "leg", "origin", "dest").join(paths, ["origin", "dest"]).select("line", "leg", "back", "node")
    xy = lambda n: nodes.select(F.col("node").alias(n), F.col("lng").alias(f"{n}_x"), F.col("lat").alias(f"{n}_y"))
    gaps = legs.where("NOT joined").join(xy("dest"), "dest").join(xy("goal"), "goal")
    km = haversine_km(F.col("dest_x"), F.col("dest_y"), F.col("goal_x"), F.col("goal_y"))
    return steps, gaps.select("line", "leg", F.col("dest").alias("from_node"), F.col("goal").alias("to_node"), km.alias("km"))
