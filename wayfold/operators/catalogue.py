"""Route catalogues: filters, layers, facets, rankings, paging, merges of several sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.sources.scratch import stored

#: The order in which layers take turns in the recommended ranking, two places a turn.
ROTATION, STEP = ("L3", "L4", "L2", "L1", "L5"), 2
LAYERS = ("L1", "L2", "L3", "L4", "L5")


def resolve_layer(layer: Column, tier: Column, days: Column) -> Column:
    """Explicit layer, else by tier, else by days; missing or non-positive days count as two."""
    d = F.when(days > 0, days).otherwise(2)
    return F.coalesce(layer, F.when(tier == "national", "L1").when(tier == "regional", "L2").when(d <= 2, "L4").otherwise("L3"))


def matches(keyword: str | None = None, layer: str | None = None, tier: str | None = None, most_days: int | None = None, most_km: float | None = None, most_difficulty: int | None = None, text: tuple[str, ...] = ("name", "anchor_city", "tag"), lists: tuple[str, ...] = (), province: str | None = None, city: str | None = None, mode: str | None = None, shape: str | None = None, month: int | None = None) -> Column:
    """Predicate of a catalogue query; drafts show only in keyword searches. Keywords are case-sensitive and looked for in text columns and in the entries of lists.

    province, city, mode and month must be in the arrays provinces, cities (or be the anchor_city), modes and best_season; a null array holds nothing.
    """
    keyword = (keyword or "").strip()
    p = F.lit(True) if keyword else F.col("status") == "published"
    if keyword:
        hit = F.lit(False)
        for c in text:
            hit = hit | F.coalesce(F.col(c).contains(keyword), F.lit(False))
        for c in lists:
            hit = hit | F.coalesce(F.exists(c, lambda x: F.coalesce(x.contains(keyword), F.lit(False))), F.lit(False))
        p = p & hit
    in_list = lambda c, x: F.coalesce(F.array_contains(c, F.lit(x)), F.lit(False))
    for column, value in (("provinces", province), ("modes", mode), ("best_season", month)):
        if value is not None and value != "":
            p = p & in_list(column, value)
    if city:
        p = p & (in_list("cities", city) | F.coalesce(F.col("anchor_city") == city, F.lit(False)))
    if shape:
        p = p & F.coalesce(F.col("shape") == shape, F.lit(False))
    if layer:
        p = p & (resolve_layer(F.col("layer"), F.col("tier"), F.col("days")) == layer)
    if tier:
        p = p & (F.col("tier") == tier)
    for column, most in (("days", most_days), ("total_km", most_km), ("difficulty", most_difficulty)):
        if most is not None:
            p = p & F.coalesce(F.col(column) <= most, F.lit(True))
    return p


def recommended(routes: DataFrame, layer: str = "layer", rank: str = "editor_rank", key: str = "id") -> DataFrame:
    """Add place, from 1: layers take turns, each giving its next two routes by rank and key.

    A route's turn within its layer and the layer's place in the rotation give its rank in closed
    form, so only the last numbering sees all routes.
    """
    turn = F.floor((F.row_number().over(Window.partitionBy(layer).orderBy(rank, key)) - 1) / STEP)
    position = F.array_position(F.array(*[F.lit(x) for x in ROTATION]), F.col(layer))
    return routes.withColumns({"_turn": turn, "_pos": position}).withColumn("place", F.row_number().over(Window.orderBy("_turn", "_pos", rank, key))).drop("_turn", "_pos")


def named_sort(sort: str, ordinal: str = "ordinal") -> list[Column]:
    """Order of a named sort: km-desc, km-asc, days-asc, days-desc or layer (editor's rank, longer first); ties keep the order in which routes were loaded.

    The recommended order is that of recommended().
    """
    orders = {"km-desc": [F.desc("total_km")], "km-asc": [F.asc("total_km")], "days-asc": [F.asc("days")], "days-desc": [F.desc("days")], "layer": [F.asc("editor_rank"), F.desc("total_km")]}
    if sort not in orders:
        raise ValueError(f"no sort named {sort}: {', '.join(orders)}")
    return [*orders[sort], F.asc(ordinal)]


def page(rows: DataFrame, order: list[Column], offset: int = 0, limit: int = 0) -> DataFrame:
    """Sort and cut out a page; limit 0 or less means all. Adds total, the number of rows before the cut."""
    out = rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total")))).orderBy(*order).offset(max(0, offset))
    return out.limit(limit) if limit > 0 else out


def facet_counts(routes: DataFrame, columns: list[str]) -> DataFrame:
    """Count routes per value of each column, array columns value by value: facet, value, n. One pass over the routes."""
    kinds = dict(routes.dtypes)
    pairs = []
    for c in columns:
        values = F.array_distinct(F.col(c)) if kinds[c].startswith("array") else F.array(c)
        named = lambda v: F.struct(F.lit(c).alias("facet"), v.cast("string").alias("value"))  # noqa: E731, B023
        pairs.append(F.transform(F.coalesce(values, F.array().cast("array<string>")), named))
    rows = routes.select(F.explode(F.concat(*pairs)).alias("p")).select("p.*").where("value IS NOT NULL")
    return rows.groupBy("facet", "value").agg(F.count("*").alias("n"))


def counts_by_layer(routes: DataFrame) -> DataFrame:
    """Count routes per layer, with zeros for layers without any."""
    spark = routes.sparkSession
    every = spark.createDataFrame([(x,) for x in LAYERS], "layer string")
    return every.join(routes.groupBy("layer").agg(F.count("*").alias("n")), "layer", "left").select("layer", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def first_by_priority(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Keep the first row of each key in an order: unions by priority, exact-key dedupe."""
    return rows.withColumn("_nr", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nr = 1").drop("_nr")


def merge_sources(rows: DataFrame, keys: list[str], priority: str, fields: list[str], source: str) -> DataFrame:
    """Merge records of a key: each field's first non-null value by source priority, and the sorted set of sources."""
    filled = [F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.struct(priority, source))).alias(f) for f in fields]
    return rows.groupBy(*keys).agg(*filled, F.array_join(F.array_sort(F.collect_set(source)), ",").alias("sources"))


def richest(rows: DataFrame, keys: list[str], fields: list[str], priced: str, name: str) -> DataFrame:
    """Of records that describe one thing keep the one with most values, a price counting five; list the others' names in variants."""
    worth = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0)) + F.when(F.col(priced) > 0, 5).otherwise(0)
    best = rows.withColumn("_w", worth)
    return best.groupBy(*keys).agg(F.min_by(F.struct(name, *fields), F.struct(-F.col("_w"), F.col(name))).alias("_b"), F.array_sort(F.collect_set(name)).alias("_all")).select(*keys, "_b.*", F.array_join(F.array_remove("_all", F.col(f"_b.{name}")), ",").alias("variants"))


def mode_of_name(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Return each key's most frequent name; ties go to names in CJK letters, then shorter ones, then by code point."""
    n = rows.where(F.col(name).isNotNull()).groupBy(key, name).agg(F.count("*").alias("_n"))
    order = F.struct(-F.col("_n"), F.when(F.col(name).rlike("[一-鿿]"), 0).otherwise(1), F.char_length(name), F.col(name))
    return n.groupBy(key).agg(F.min_by(name, order).alias(name), F.min_by("_n", order).alias("n"))


def element_percentile(values: Column, percent: float) -> Column:
    """The value at floor(n * percent / 100) of the sorted array, clamped to its ends: no interpolation."""
    a = F.array_sort(values)
    return F.get(a, F.least(F.size(a) - 1, F.floor(F.size(a) * percent / 100).cast("int")))


#: Rows of a key that meet the others in one task, about; keys with more are split.
SPLIT_ROWS = 1_000


def also_in(items: DataFrame, item: str, key: str) -> DataFrame:
    """Return each two items that share a key, both ways round: item, other, and shared, the number of keys they share. Nulls share nothing.

    A key of many items is dealt to many tasks: one side by a salt, the other to all salts. The result itself has as many rows as there are such pairs.
    """
    held = items.select(F.col(item).alias("item"), F.col(key).alias("key")).dropna().distinct()
    sizes = held.groupBy("key").agg(F.ceil(F.count("*") / SPLIT_ROWS).cast("int").alias("_salts"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    dealt = held.join(sizes, "key")
    one = dealt.select("key", "item", F.pmod(F.xxhash64("item"), F.col("_salts")).cast("int").alias("_salt"))
    all_ = dealt.select("key", F.col("item").alias("other"), F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
    pairs = one.join(all_, ["key", "_salt"]).where("item <> other")
    return pairs.groupBy(F.col("item").alias(item), "other").agg(F.count("*").alias("shared"))


def lower_percentiles(rows: DataFrame, group: str, value: str, percents: tuple[int, ...], buckets: int = 64) -> DataFrame:
    """Return exact percentiles of each group without interpolation: group, percent, value, the one at floor(n * percent / 100) from 0.

    Equal values are counted first, so many of them are one row. The counts are dealt to ranges of (group, value) by a
    sample of them, so outliers crowd nothing; sums per range find the range of each rank, and only those are
    gone through. Null values are left out; a group without values has no row.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    dealt = stored(counts.repartitionByRange(buckets, "_g", "_v").withColumn("_k", F.spark_partition_id()), "value-counts")
    sums = dealt.groupBy("_g", "_k").agg(F.sum("_c").alias("_c"))  # a row per range of a group
    line = Window.partitionBy("_g").orderBy("_k")
    sums = sums.withColumns({"_before": F.coalesce(F.sum("_c").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_n": F.sum("_c").over(Window.partitionBy("_g"))})
    ranks = F.array(*[F.struct(F.lit(p).alias("percent"), F.least(F.col("_n") - 1, F.floor(F.col("_n") * p / 100)).cast("long").alias("rank")) for p in percents])
    wanted = sums.withColumn("_r", F.explode(ranks)).where((F.col("_r.rank") >= F.col("_before")) & (F.col("_r.rank") < F.col("_before") + F.col("_c")))
    wanted = wanted.select("_g", "_k", (F.col("_r.rank") - F.col("_before")).alias("_rank"), F.col("_r.percent").alias("percent"))
    held = dealt.join(wanted.select("_g", "_k").distinct(), [dealt["_g"].eqNullSafe(wanted["_g"]), dealt["_k"] == wanted["_k"]], "left_semi")
    up_to = F.sum("_c").over(Window.partitionBy("_g", "_k").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    held = held.withColumn("_upto", up_to).select(F.col("_g").alias("_hg"), F.col("_k").alias("_hk"), "_v", "_c", "_upto")
    hit = held.join(wanted, [F.col("_hg").eqNullSafe(F.col("_g")), F.col("_hk") == F.col("_k")]).where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_c")))
    return hit.select(F.col("_hg").alias(group), "percent", F.col("_v").alias(value))
