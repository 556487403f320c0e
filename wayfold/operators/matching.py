"""Greedy choices and chains as rounds over whole tables: pairs shortest first, rows in order of rank, items linked end to end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.geo import haversine_km
from wayfold.operators.graph import near_components
from wayfold.sources.scratch import stored


def greedy_pairs(pairs: DataFrame) -> DataFrame:
    """Match ends shortest pair first, each end once: lo, hi, d of the pairs taken. pairs: lo, hi (longs, lo <> hi), d.

    The same as going through all pairs by (d, lo, hi) and taking those whose ends are both free. A round
    takes every pair that is the first of both its ends and drops all others of these ends, so it
    takes at least the first pair of all; rounds are stored. Rows with a null take no part; of a pair given twice the shorter counts.
    """
    swap = F.col("lo") > F.col("hi")
    left = pairs.dropna(subset=["lo", "hi", "d"]).where("lo <> hi")
    left = left.select(F.when(swap, F.col("hi")).otherwise(F.col("lo")).alias("lo"), F.when(swap, F.col("lo")).otherwise(F.col("hi")).alias("hi"), "d").groupBy("lo", "hi").agg(F.min("d").alias("d"))
    left, taken = stored(left, "pairs"), None
    while not left.isEmpty():
        ends = left.select(F.explode(F.array("lo", "hi")).alias("end"), F.struct("d", "lo", "hi").alias("p"))
        first = ends.groupBy("end").agg(F.min("p").alias("p"))
        now = stored(first.groupBy("p").agg(F.count("*").alias("n")).where("n = 2").select("p.lo", "p.hi", "p.d"), "taken")
        taken = now if taken is None else stored(taken.union(now), "taken")
        gone = now.select(F.explode(F.array("lo", "hi")).alias("end"))
        left = left.join(gone, F.col("lo") == F.col("end"), "left_anti").join(gone, F.col("hi") == F.col("end"), "left_anti")
        left = stored(left, "pairs")
    return left if taken is None else taken


def greedy_keep(items: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Keep items in order of rank unless they conflict with one kept before: id, kept_by (null if kept, else the first kept item in its way).

    items: id (long), rank (any ordered type; equal ranks go by id); conflicts: a, b (ids, either way round). The same as going through the
    items one by one. A round settles every item whose conflicts before it are all settled; rounds are
    stored. Ids in conflicts that are no items are passed over.
    """
    order = items.select("id", F.struct("rank", "id").alias("o"))
    both = conflicts.where("a <> b").select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("e")).select("e.*").distinct()
    after = both.join(order, "id").join(order.select(F.col("id").alias("other"), F.col("o").alias("before")), "other").where("before < o")
    open_ = stored(after.select("id", "other", "before", F.lit(None).cast("boolean").alias("kept")), "conflicts")  # each conflict once, at its later item
    settled = new = stored(order.select("id").join(open_.select("id").distinct(), "id", "left_anti").withColumn("kept_by", F.lit(None).cast("long")), "settled")
    while not open_.isEmpty():
        # An item that was dropped is in nobody's way any more; one that was kept stays known.
        known = new.select(F.col("id").alias("other"), F.col("kept_by").isNull().alias("_kept"))
        was = open_.select("id").distinct()
        open_ = stored(open_.join(known, "other", "left").select("id", "other", "before", F.coalesce("_kept", "kept").alias("kept")).where("kept IS NOT FALSE"), "conflicts")
        sums = open_.groupBy("id").agg(F.min(F.when(F.col("kept"), F.col("before"))).alias("hit"), F.min(F.when(F.col("kept").isNull(), F.col("before"))).alias("next"))
        # A kept item in the way is the first only if no open one comes before it.
        dropped = sums.where(F.col("hit").isNotNull() & (F.col("next").isNull() | (F.col("hit") < F.col("next")))).select("id", F.col("hit.id").alias("kept_by"))
        free = was.join(open_.select("id"), "id", "left_anti")
        new = stored(dropped.unionByName(free.withColumn("kept_by", F.lit(None).cast("long"))), "settled")
        settled = stored(settled.unionByName(new), "settled")
        open_ = open_.join(new.select("id"), "id", "left_anti")
    return settled


def ordered_chains(items: DataFrame, links: DataFrame, weights: tuple[str, ...] = ()) -> DataFrame:
    """Put items that are linked end to end in order: chain, item, pos, backward, and before_<w>, the sums of weights of the items before.

    items: item (long) and weights; links: a, a_side, b, b_side, sides 0 and 1, each end in one link at most, a <> b.
    A chain is named after its least item. It starts at its free end with the least item; a ring is cut where side 0 of its least
    item was linked. `backward` tells that the item is passed from side 1 to side 0.

    Ends point to the end at which one leaves the next item, and pointers are doubled until all have
    met a free end: as many rounds as the longest chain has binary digits. Each round is a join in which no key
    occurs twice on either side, so long chains are no task's alone.
    """
    ends = F.array(F.struct(F.col("a").alias("item"), F.col("a_side").alias("side"), F.col("b").alias("to"), F.col("b_side").alias("to_side")), F.struct(F.col("b").alias("item"), F.col("b_side").alias("side"), F.col("a").alias("to"), F.col("a_side").alias("to_side")))
    both = stored(links.select(F.explode(ends).alias("e")).select("e.*"), "ends")
    items = items.select("item", *weights)
    label = stored(near_components(both, "item", "to").select(F.col("node").alias("item"), F.col("label").alias("chain")), "labels")
    named = stored(items.join(label, "item", "left").withColumn("chain", F.coalesce("chain", "item")), "named")
    free = both.groupBy("item").agg(F.count("*").alias("n")).join(label, "item").groupBy("chain").agg(F.bool_or(F.col("n") < 2).alias("open"))
    rings = free.where("NOT open").select("chain")
    cut = both.join(rings, F.col("item") == F.col("chain"), "left_semi").where("side = 0")
    cuts = cut.select("item", "side").union(cut.select("to", "to_side"))
    both = both.join(cuts, ["item", "side"], "left_anti")

    start = named.select("item", "chain", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"), *weights).join(both, ["item", "side"], "left")
    next_weights = items.select(F.col("item").alias("to"), *[F.col(w).alias(f"_{w}") for w in weights])
    start = start.join(next_weights, "to", "left")
    sums = [F.coalesce(F.col(f"_{w}"), F.lit(0)).alias(f"before_{w}") for w in weights]
    # p, p_side: the end reached after pos items; it is the free one as soon as `met`. Leaving the next item means its other side.
    state = start.select("item", "side", "chain", F.coalesce("to", "item").alias("p"), F.coalesce(1 - F.col("to_side"), F.col("side")).alias("p_side"), F.col("to").isNotNull().cast("long").alias("pos"), F.col("to").isNull().alias("met"), *sums)
    state = stored(state, "ends")
    while not state.where("NOT met").isEmpty():
        ahead = state.select(F.col("item").alias("p"), F.col("side").alias("p_side"), F.col("p").alias("_p"), F.col("p_side").alias("_p_side"), F.col("pos").alias("_pos"), F.col("met").alias("_met"), *[F.col(f"before_{w}").alias(f"_{w}") for w in weights])
        on = state.where("NOT met").join(ahead, ["p", "p_side"])
        plus: list[Column] = [(F.col("pos") + F.col("_pos")).alias("pos"), F.col("_met").alias("met"), *[(F.col(f"before_{w}") + F.col(f"_{w}")).alias(f"before_{w}") for w in weights]]
        state = stored(state.where("met").unionByName(on.select("item", "side", "chain", F.col("_p").alias("p"), F.col("_p_side").alias("p_side"), *plus)), "ends")
    # Of the two ways out of an item the one that leads to the lesser free end leads to the start.
    of = [F.struct("p", "p_side", "side", "pos", *[f"before_{w}" for w in weights]).alias("o")]
    first = state.groupBy("item", "chain").agg(F.min(of[0]).alias("o"))
    return first.select("chain", "item", "o.pos", (F.col("o.side") == 1).alias("backward"), *[F.col(f"o.before_{w}") for w in weights])


#: Kilometres of a degree, a little less and a little more than true, so that cells are safe.
_LESS, _MORE = 110.5, 111.4


def greedy_cover(items: DataFrame, km: float) -> DataFrame:
    """Keep items in order of rank unless a kept one of their group lies within a distance: id, kept_by (null if kept, else the first kept one near).

    items: id (long), grp, rank (any ordered type; equal ranks go by id), lng, lat. The same as going through the items one by one, in
    rounds over cells so small that a cell keeps one item at most: only the first open item of each cell is tried, and
    meets the cells around it. An item is met by some thirty cells, so a group of any size and density makes linear work.
    """
    tall = 0.7 * km / _MORE
    row = F.floor((F.col("lat") + 90) / tall).cast("long")
    edge = lambda y, far: (F.greatest if far else F.least)(F.abs(y * tall - 90), F.abs((y + 1) * tall - 90))
    wide = lambda y: 0.7 * km / (_MORE * F.cos(F.radians(F.least(edge(y, False), F.lit(89.0)))))
    column = lambda x, y: F.floor((x + 180) / wide(y)).cast("long")
    pad = lambda y: km / (_LESS * F.cos(F.radians(F.least(edge(y, True), F.lit(89.0)))))
    items = items.dropna(subset=["id", "lng", "lat"]).select("id", "grp", F.struct("rank", "id").alias("o"), "lng", "lat", row.alias("y"))
    items = stored(items.withColumn("x", column(F.col("lng"), F.col("y"))), "items")

    def around(df: DataFrame, names: str) -> DataFrame:
        """Rows with the cells within reach: as y, x; what they had is named with the prefix."""
        out = df.select("grp", *[F.col(c).alias(f"{names}{c}") for c in ("id", "o", "lng", "lat")], F.explode(F.sequence(F.col("y") - 2, F.col("y") + 2)).alias("y"))
        return out.withColumn("x", F.explode(F.sequence(column(F.col(f"{names}lng") - pad(F.col("y")), F.col("y")), column(F.col(f"{names}lng") + pad(F.col("y")), F.col("y")))))

    def near(df: DataFrame) -> DataFrame:
        return df.where(haversine_km(F.col("lng"), F.col("lat"), F.col("t_lng"), F.col("t_lat")) <= km)

    open_, kept = items, None
    while not open_.isEmpty():
        tops = open_.groupBy("grp", "y", "x").agg(F.min(F.struct("o", "id", "lng", "lat")).alias("t")).select("grp", "y", "x", "t.*")
        reach = stored(around(tops, "t_"), "tops")
        beaten = near(reach.join(open_, ["grp", "y", "x"])).where("o < t_o").select("t_id").distinct()
        now = stored(tops.join(beaten, F.col("id") == F.col("t_id"), "left_anti"), "kept")
        kept = now if kept is None else stored(kept.unionByName(now), "kept")
        gone = near(around(now, "t_").join(open_, ["grp", "y", "x"])).select("id").distinct()
        open_ = stored(open_.join(gone, "id", "left_anti"), "open")
    if kept is None:
        return items.select("id", F.lit(None).cast("long").alias("kept_by"))
    hits = near(around(kept, "t_").join(items, ["grp", "y", "x"])).groupBy("id").agg(F.min(F.struct("t_o", "t_id")).alias("h"))
    own = kept.select("id", F.lit(True).alias("is_kept"))
    return hits.join(own, "id", "left").select("id", F.when(F.col("is_kept").isNull(), F.col("h.t_id")).alias("kept_by"))
