"""Weighted graphs as edge tables: building, components, shortest paths for many origins at once."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.operators import search
from wayfold.sources.scratch import stored

MOST_ROUNDS = 200
#: A node with more edges than this is a hub; with many edges the bound rises, so that there are no more hubs than MOST_HUBS.
HUB_EDGES, MOST_HUBS = 100_000, 1_000
#: The dearest arc is no more steps of a search long than this (twice as many, by the power of two); a block's origins are found again in so many parts.
MOST_STEPS, SALTS = 64, 16


def undirected(edges: DataFrame) -> DataFrame:
    """Merge repeated edges of a pair, either way round: the least weight, any fast flag, the least line. edges: a, b, w, fast, line."""
    e = edges.where("a <> b").withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")})
    return e.groupBy("lo", "hi").agg(F.min("w").alias("w"), F.bool_or("fast").alias("fast"), F.min("line").alias("line"))


def nodes(edges: DataFrame) -> DataFrame:
    """Return each node that has an edge, once."""
    return edges.select(F.explode(F.array("lo", "hi")).alias("node")).distinct()


def _least_near(pairs: DataFrame, node: str, other: str, hubs: list[int]) -> DataFrame:
    """Add m, the least of a node and its others, and _nr, 1 on at least one of a node's pairs.

    Hubs, at most MOST_HUBS, stay out of the window: their pairs stay where they are and get their least by a broadcast.
    """
    group = Window.partitionBy(node)
    rest = pairs.where(~F.col(node).isin(hubs)) if hubs else pairs
    out = rest.withColumns({"m": F.least(node, F.min(other).over(group)), "_nr": F.row_number().over(group.orderBy(other))})
    if not hubs:
        return out
    of_hubs = pairs.where(F.col(node).isin(hubs))
    least = of_hubs.groupBy(F.col(node).alias("_hub")).agg(F.min(other).alias("m"))
    return out.unionByName(of_hubs.join(F.broadcast(least), F.col(node) == F.col("_hub")).drop("_hub").withColumns({"m": F.least(node, "m"), "_nr": F.lit(1)}))


def components(edges: DataFrame, a: str = "lo", b: str = "hi") -> DataFrame:
    """Label each node that has an edge with the least node of its component: node, label.

    Large and small stars in turn, until every node points straight at one root. Edges may repeat,
    point either way or join a node to itself; nodes are longs and not null. A round is three
    shuffles of no more edges than there were plus one per node, without joins, and
    is stored in the shared folder, so a lost executor costs a round at most. Only nodes with no
    more than HUB_EDGES edges are handled by a task each; the edges of others, which are few, stay
    where they are. The driver sees sums and, where there are any, the hubs: at most MOST_HUBS nodes.
    """
    edges = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    edges = stored(edges.where("lo < hi").distinct(), "edges")
    for _ in range(MOST_ROUNDS):
        ends = edges.select(F.explode(F.array(F.struct(F.col("lo").alias("node"), F.lit(0).alias("up")), F.struct(F.col("hi").alias("node"), F.lit(1).alias("up")))).alias("e")).select("e.*")
        nodes = ends.groupBy("node").agg(F.count("*").alias("n"), F.sum("up").alias("ups"))
        state = nodes.agg(F.sum("n").alias("ends"), F.max("n").alias("most"), F.count_if((F.col("ups") > 1) | ((F.col("ups") > 0) & (F.col("n") > F.col("ups")))).alias("open")).first()
        if not state["open"]:
            break
        limit = max(HUB_EDGES, state["ends"] // MOST_HUBS)
        hubs = [r["node"] for r in nodes.where(F.col("n") > limit).collect()] if state["most"] > limit else []
        # Large star: every neighbour above a node moves to the least node it sees there.
        both = edges.select(F.explode(F.array(F.struct(F.col("lo").alias("u"), F.col("hi").alias("v")), F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")))).alias("e")).select("e.*")
        up = _least_near(both, "u", "v", hubs).where("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        # Small star: a node and its neighbours below point to the least of them.
        down = _least_near(up, "hi", "lo", hubs)
        to = F.array(F.when(F.col("m") < F.col("lo"), F.col("lo")), F.when(F.col("_nr") == 1, F.col("hi")))
        edges = stored(down.select(F.col("m").alias("lo"), F.explode(F.array_compact(to)).alias("hi")).distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct()
    return roots.union(edges.select(F.col("hi").alias("node"), F.col("lo").alias("label")))


def near_components(edges: DataFrame, a: str = "lo", b: str = "hi") -> DataFrame:
    """As `components`, for edges whose nodes mostly have numbers close to those of their component: node, label.

    Edges are put in order of their lesser node, and what lies close is joined into stars in one pass; only stars that share nodes go through rounds.
    It is right for any graph. The edges are read twice, so they should be a stored table.
    """
    e = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi")
    star = e.repartitionByRange("lo").mapInArrow(search.stars, "node long, root long")
    near = star.groupBy("node").agg(F.min("root").alias("root"), F.collect_set("root").alias("roots"))
    near = stored(near.withColumn("roots", F.when(F.size("roots") > 1, F.col("roots"))), "stars")
    top = components(near.where("roots IS NOT NULL").select(F.col("root").alias("lo"), F.explode("roots").alias("hi")))
    return near.join(top.select(F.col("node").alias("root"), "label"), "root", "left").select("node", F.coalesce("label", "root").alias("label"))


def _arcs(edges: DataFrame) -> DataFrame:
    """Edges both ways: node, to, w; none with a null."""
    ways = F.array(F.struct(F.col("lo").alias("node"), F.col("hi").alias("to")), F.struct(F.col("hi").alias("node"), F.col("lo").alias("to")))
    return edges.dropna(subset=["lo", "hi", "w"]).select(F.explode(ways).alias("e"), "w").select("e.*", "w")


def numbered(origins: DataFrame) -> DataFrame:
    """Number origins in order, 64 to a block: g, origin, block, mask (one bit). origins: g, origin."""
    n = origins.select("g", "origin").distinct().orderBy("g", "origin").withColumn("_n", F.monotonically_increasing_id())
    return stored(n.select("g", "origin", F.shiftright("_n", 6).alias("block"), F.expr("shiftleft(1L, CAST(_n & 63 AS INT))").alias("mask")), "origins", sort=False)


def _fresh(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Keep of each row the bits that its node has at no lesser cost: g, block, node, cost, bits."""
    rows = rows.groupBy("g", "block", "node", "cost").agg(F.bit_or("bits").alias("bits")).join(seen, ["g", "block", "node"], "left")
    before = F.bit_or("bits").over(Window.partitionBy("g", "block", "node").orderBy("cost").rowsBetween(Window.unboundedPreceding, -1))
    had = F.coalesce(before, F.lit(0)).bitwiseOR(F.coalesce("seen", F.lit(0)))
    return rows.select("g", "block", "node", "cost", F.col("bits").bitwiseAND(F.bitwise_not(had)).alias("bits")).where("bits <> 0")


def settled_costs(arcs: DataFrame, origins: DataFrame, pairs: DataFrame | None = None, most: float | None = None, ends: int | None = None) -> DataFrame:
    """Return least costs, the origins of a block that share one as bits of a row: g, block, node, cost, bits.

    arcs: g, node, to, w (not negative); origins as `numbered` gives them. Costs are gone through in steps; a node's arc is only followed in
    the step that its cost can lead to, and from a settled node, so what is found to be dear is never made. Steps
    are a power of two wide, which keeps sums of doubles on their side; steps without rows are passed over. pairs (g, origin,
    dest): an origin goes on until its destinations are settled; ends: the number of pairs of an origin and a node to be reached, if it is known.
    """
    least, dearest = arcs.agg(F.min(F.when(F.col("w") > 0, F.col("w"))), F.max("w")).first()
    wide = 2.0 ** math.floor(math.log2(max(least, dearest / MOST_STEPS))) if least else 1.0
    arcs = arcs.groupBy("g", "node", "to").agg(F.min("w").alias("w"))
    arcs = stored(arcs.select("g", "node", "to", "w", F.floor(F.col("w") / wide).cast("long").alias("ahead")), "arcs", sort=False)
    aheads = [r["ahead"] for r in arcs.select("ahead").distinct().collect()]  # at most twice MOST_STEPS
    light = 0 in aheads
    rows = origins.select("g", "block", F.col("origin").alias("node"), F.lit(0.0).alias("cost"), F.col("mask").alias("bits"))
    seen = origins.select("g", "block", F.col("origin").alias("node"), F.lit(0).cast("long").alias("seen")).limit(0)
    wanted = None
    if pairs is not None:
        wanted = stored(pairs.join(origins, ["g", "origin"]).select("g", "block", F.col("dest").alias("node"), "mask"), "wanted", sort=False)
    done: dict[int, DataFrame] = {}
    met, step = 0, 0

    def follow(front: DataFrame, on: list[str]) -> DataFrame:
        out = front.join(arcs, on).select("g", "block", F.col("to").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), "bits")
        return out if most is None else out.where(F.col("cost") <= most)

    while True:
        near = [d.withColumn("ahead", F.lit(step - i).cast("long")) for i, d in done.items() if step - i in aheads]
        if near:
            front = reduce(DataFrame.unionByName, near)
            if wanted is not None:
                still = wanted.groupBy("g", "block").agg(F.bit_or("mask").alias("_open"))
                front = front.join(still, ["g", "block"]).withColumn("bits", F.col("bits").bitwiseAND(F.col("_open"))).drop("_open").where("bits <> 0")
            rows = rows.unionByName(follow(front, ["g", "node", "ahead"]))
        rows = _fresh(rows, seen)
        rows = stored(rows, "costs", sort=False)
        top = (step + 1) * wide
        level, later = rows.where(F.col("cost") < top), rows.where(F.col("cost") >= top)
        added = level
        while light and not added.isEmpty():
            more = stored(follow(added, ["g", "node"]) if aheads == [0] else follow(added.withColumn("ahead", F.lit(0).cast("long")), ["g", "node", "ahead"]), "light", sort=False)
            later = later.unionByName(more.where(F.col("cost") >= top))
            old = level.select("g", "block", "node", "cost", F.col("bits").alias("_old"))
            both = _fresh(level.unionByName(more.where(F.col("cost") < top)), seen).join(old, ["g", "block", "node", "cost"], "left")
            both = stored(both.withColumn("_new", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_old", F.lit(0))))), "level", sort=False)
            level = both.drop("_old", "_new")
            added = both.where("_new <> 0").select("g", "block", "node", "cost", F.col("_new").alias("bits"))
        n, waiting = level.unionByName(later).agg(F.sum(F.when(F.col("cost") < top, F.bit_count("bits"))), F.min(F.when(F.col("cost") >= top, F.col("cost")))).first()
        if n:
            done[step] = level
            met += n
            mine = level.select("g", "block", "node", F.col("bits").alias("seen"))
            seen = stored(seen.unionByName(mine).groupBy("g", "block", "node").agg(F.bit_or("seen").alias("seen")), "seen", sort=False)
            if wanted is not None:
                wanted = stored(wanted.join(seen, ["g", "block", "node"], "left").where(F.coalesce(F.col("seen").bitwiseAND(F.col("mask")), F.lit(0)) == 0).drop("seen"), "wanted", sort=False)
        if met == ends or (wanted is not None and wanted.isEmpty()):
            break
        rows = later
        nexts = [i + a for i in done for a in aheads if i + a > step] + ([math.floor(waiting / wide)] if waiting is not None else [])
        if not nexts:
            break
        step = min(nexts)
    return reduce(DataFrame.unionByName, done.values()) if done else rows


def by_origin(costs: DataFrame, origins: DataFrame) -> DataFrame:
    """Give settled costs a row for each origin: g, origin, node, cost. Blocks are spread, so that none is one task's."""
    salt = lambda c: F.pmod(F.hash(c), F.lit(SALTS))
    of = origins.groupBy("g", "block").agg(F.collect_list(F.struct("mask", "origin")).alias("_of")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    j = costs.withColumn("_salt", salt(F.col("node"))).join(of, ["g", "block", "_salt"])
    has = F.filter("_of", lambda o: o["mask"].bitwiseAND(F.col("bits")) != 0)
    return j.select("g", F.explode(F.transform(has, lambda o: o["origin"])).alias("origin"), "node", "cost")


def shortest_paths(edges: DataFrame, origins: DataFrame, most: float | None = None) -> DataFrame:
    """Return the least cost from each origin to each node it reaches: origin, node, cost. edges: lo, hi, w (not negative); those with a null are passed over.

    Components that fit a task are searched there (see search.py); those of more than MOST_EDGES edges by all origins together, 64 in a row (see
    settled_costs), until each has reached all of its component. It is exact, and there is no bound on costs or edges. For single destinations routing.routes does less work.
    """
    e = stored(edges.dropna(subset=["lo", "hi", "w"]).select(F.lit(0).alias("g"), F.col("lo").alias("a"), F.col("hi").alias("b"), "w"), "edges")
    start = stored(origins.select(F.lit(0).alias("g"), F.col("node").alias("origin")).distinct(), "origins")
    label = stored(near_components(e, "a", "b"), "labels")
    dealt, asked, large = search.deal(e, start, label)
    alone = start.join(label, F.col("origin") == F.col("node"), "left_anti").select("origin", F.col("origin").alias("node"), F.lit(0.0).alias("cost"))
    out = search.costs(dealt, asked, most).select("origin", "node", "cost").unionByName(alone)
    if large.isEmpty():
        return out
    rest = label.join(large, "label", "left_semi")
    both = stored(_arcs(e.select(F.col("a").alias("lo"), F.col("b").alias("hi"), "w").join(rest.select(F.col("node").alias("lo")), "lo", "left_semi")).select(F.lit(0).alias("g"), "node", "to", "w"), "arcs", sort=False)
    far = numbered(start.join(rest.select(F.col("node").alias("origin")), "origin", "left_semi"))
    ends = None
    if most is None:
        sizes = rest.groupBy("label").agg(F.count("*").alias("n"))
        own = far.join(rest, F.col("origin") == F.col("node")).groupBy("label").agg(F.count("*").alias("k")).join(sizes, "label")
        ends = own.agg(F.sum(F.col("k") * F.col("n"))).first()[0]
    return out.unionByName(by_origin(settled_costs(both, far, most=most, ends=ends), far).select("origin", "node", "cost"))


def class_weight(km, road_class):
    """Cost of an edge: its length times the coefficient of its class."""
    k = F.lit(1.9)
    for name, factor in (("expressway", 1.0), ("national", 1.15), ("provincial", 1.35), ("county", 1.6)):
        k = F.when(road_class == name, F.lit(factor)).otherwise(k)
    return km * k
