"""Points of interest: admission, near duplicates, merges of gazetteers, links to lines, cascaded lookups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.functions import geo
from wayfold.operators.graph import components
from wayfold.operators.matching import greedy_cover, greedy_keep
from wayfold.sources.scratch import stored

#: Country tags that count as inside; name endings left out of a core name; boxes of islands and of a border band.
INSIDE_TAGS = "(?i)^(CN|CHN|China|PRC|HK|MO|TW|中国|中华人民共和国|中国香港|香港|中国澳门|澳门|中国台湾|台湾)$"
NAME_ENDINGS = "(国家考古遗址公园|考古遗址公园|国家地质公园|地质公园|森林公园|国家公园|风景名胜区|风景区|景区|博物院|博物馆|纪念馆|美术馆|展览馆|陈列馆|观光厅|观景台|觀景台|瞭望台|瞭望點|主峰|峰)$"
ISLANDS = ((118.2, 24.16, 118.55, 24.55), (119.85, 25.9, 120.55, 26.45))
BAND = ((80.0, 26.2, 88.35, 28.15), (88.35, 26.4, 92.2, 27.72))
#: Words of names beyond the border band, whole words in any case.
FOREIGN_WORDS = ("Nepal", "Kathmandu", "Pokhara", "Namche", "Lukla", "Sikkim", "Gangtok", "Thimphu", "Paro", "Hanuman", "Chorten", "Melamchi", "Lobuche", "Kongma", "Chukhung", "Everest viewpoint", "Haa valley", "Bahrabise", "Nasim Pati")
CJK = "[一-鿿]"
#: Categories of peaks, whose neighbours of a like name are one family.
PEAKS = ("nature.mountain", "nature.canyon")


def admissible(lng: Column, lat: Column, name: Column, country: Column) -> Column:
    """Inside the land box, off the islands, no other country's tag, and a local name in the border band or with a word from beyond it.

    The northern edges of the band and the line between its two boxes belong to what lies north and east.
    """
    inside = geo.in_box(lng, lat)
    for box in ISLANDS:
        inside = inside & ~geo.in_box(lng, lat, box)
    west, east = BAND
    band = ((lng >= west[0]) & (lng < west[2]) & (lat >= west[1]) & (lat < west[3])) | ((lng >= east[0]) & (lng <= east[2]) & (lat >= east[1]) & (lat < east[3]))
    foreign = F.coalesce(name.rlike(rf"(?i)\b({'|'.join(FOREIGN_WORDS)})\b"), F.lit(False))
    local = F.coalesce(name.rlike(CJK), F.lit(False))
    home = F.coalesce(country, F.lit("")) == ""
    return inside & (home | F.coalesce(F.trim(country).rlike(INSIDE_TAGS), F.lit(False))) & (~(band | foreign) | local)


def split_by_land(spots: DataFrame) -> DataFrame:
    """Add kept, whether a spot is admitted, so that what is dropped can be told too. spots: lng, lat, name, country; without coordinates none is kept."""
    return spots.withColumn("kept", F.coalesce(admissible(F.col("lng"), F.col("lat"), F.col("name"), F.col("country")), F.lit(False)))


def core_name(name: Column) -> Column:
    """Name without blanks and the ending for a kind of place."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", ""), NAME_ENDINGS, "")


def _parts(core: Column, lengths: list[int]) -> Column:
    """All parts of a name of certain lengths, shorter than the name."""
    n = F.char_length(core)

    def of(k: int) -> Column:
        return F.when(n > k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(core, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.array(*[of(k) for k in lengths])))


def _buckets(s: DataFrame, size: float, by: list[str]) -> DataFrame:
    """Gather spots of one name in a cell: its number b (the least id) and its box; size 0 gathers spots in one place."""
    x, y = (geo.cell(F.col("lng"), -180.0, size), geo.cell(F.col("lat"), -90.0, size)) if size else (F.col("lng"), F.col("lat"))
    ends = [f(c).alias(f"{n}_{c}") for c in ("lng", "lat") for n, f in (("lo", F.min), ("hi", F.max))]
    return s.groupBy(*by, x.alias("cx"), y.alias("cy")).agg(F.min("id").alias("b"), *ends)


def _gaps(pairs: DataFrame) -> DataFrame:
    """Add near and far, bounds in km of the distances between the spots of two buckets; of two places both are the distance itself."""
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"lo_{c}") - F.col(f"o_hi_{c}"), F.col(f"o_lo_{c}") - F.col(f"hi_{c}"))
    span = lambda c: F.greatest(f"hi_{c}", f"o_hi_{c}") - F.least(f"lo_{c}", f"o_lo_{c}")
    north = F.greatest(*[F.abs(c) for c in ("lo_lat", "hi_lat", "o_lo_lat", "o_hi_lat")])
    south = F.least(*[F.abs(c) for c in ("lo_lat", "hi_lat", "o_lo_lat", "o_hi_lat")])
    south = F.when(F.least("lo_lat", "o_lo_lat") * F.greatest("hi_lat", "o_hi_lat") <= 0, 0.0).otherwise(south)
    deg = geo.EARTH_KM * math.pi / 180
    flat = lambda x, y, lat: F.sqrt(F.pow(x * F.cos(F.radians(lat)), 2) + F.pow(y, 2)) * deg
    exact = geo.haversine_km(F.col("lo_lng"), F.col("lo_lat"), F.col("o_lo_lng"), F.col("o_lo_lat"))
    single = (F.col("lo_lng") == F.col("hi_lng")) & (F.col("lo_lat") == F.col("hi_lat")) & (F.col("o_lo_lng") == F.col("o_hi_lng")) & (F.col("o_lo_lat") == F.col("o_hi_lat"))
    return pairs.withColumns({"near": F.when(single, exact).otherwise(flat(gap("lng"), gap("lat"), north) * 0.999), "far": F.when(single, exact).otherwise(flat(span("lng"), span("lat"), south) * 1.001)})


def near_duplicates(spots: DataFrame, size: float = 0.0125) -> DataFrame:
    """Group spots that are the same place: id, group (least id), by transitive closure over pairs in neighbouring cells.

    A pair is one place with equal names within 2 km, equal core names within 1.5 km, or a core name
    of three letters or more inside the other's within 1 km; where spots have a category, also two peaks with
    one's core name of two letters or more inside the other's within 2.5 km. spots: id, name, lng, lat, and category if known.

    Spots of one name in a cell, which is under 2 km across, are one place without comparing them. Of two such buckets with like names the boxes
    tell most: all within the distance, or none. Only what they leave open, and what is not yet one place by other ways, is compared in
    smaller cells, in the end place by place, so many spots in one area make no pairs of all. Like names meet by equal core names, or by a core name's parts.
    """
    peak = F.coalesce(F.col("category").isin(*PEAKS), F.lit(False)) if "category" in spots.columns else F.lit(False)
    s = spots.where(geo.in_box(F.col("lng"), F.col("lat"), (-180.0, -80.0, 180.0, 80.0))).select("id", F.regexp_replace("name", r"\s+", "").alias("name"), core_name(F.col("name")).alias("core"), "lng", "lat", peak.alias("peak"))
    s = s.where("name <> ''")
    top = ["name", "core", "peak"]
    buckets = stored(_buckets(s, size, top), "buckets")

    core = buckets.where(F.char_length("core") >= 2).select("core").distinct()
    lengths = sorted(r[0] for r in core.select(F.char_length("core")).distinct().collect())  # so many as there are lengths of names
    inner = core.select("core", F.explode(_parts(F.col("core"), lengths)).alias("part")).join(core.select(F.col("core").alias("part")), "part") if lengths else None
    # Cells shrink towards the poles: as many neighbours to either side as the farthest rule may reach.
    reach = F.ceil(2.5 / (geo.KM_PER_LNG * 0.99 * F.cos(F.radians(F.greatest(F.abs("lo_lat"), F.abs("hi_lat")) + 0.05)) * size)).cast("int")
    left = buckets.withColumn("cx", F.explode(F.transform(F.sequence(-reach, reach), lambda i: F.col("cx") + i)))
    left = left.withColumn("cy", F.explode(F.array(*[F.col("cy") + i for i in (-2, -1, 0, 1, 2)])))
    right = buckets.select("cx", "cy", *[F.col(c).alias(f"o_{c}") for c in buckets.columns if c not in ("cx", "cy")])
    equal = left.hint("merge").join(right.withColumn("core", F.col("o_core")), ["core", "cx", "cy"]).where("b < o_b")
    peaks = F.col("peak") & F.col("o_peak") & (F.char_length("core") >= 2) & (F.char_length("o_core") >= 2)
    km = F.when(F.col("name") == F.col("o_name"), 2.0).when(F.char_length("core") >= 2, 1.5).otherwise(0.0)
    cols = ["b", "o_b", *[f"{o}{n}_{c}" for o in ("", "o_") for c in ("lng", "lat") for n in ("lo", "hi")], "km"]
    pairs = equal.withColumn("km", F.when(peaks, 2.5).otherwise(km)).select(*cols)
    if inner is not None:
        within = left.hint("merge").join(inner, "core").hint("merge").join(right.withColumn("part", F.col("o_core")), ["part", "cx", "cy"])
        long = (F.char_length("core") >= 3) & (F.char_length("o_core") >= 3)
        pairs = pairs.unionByName(within.withColumn("km", F.when(peaks, 2.5).when(long, 1.0).otherwise(0.0)).select(*cols))
    open_ = stored(_gaps(pairs.where("km > 0")).where("near <= km"), "pairs")
    links = stored(open_.where("far <= km").select(F.col("b").alias("lo"), F.col("o_b").alias("hi")), "links")
    open_, parents = open_.where("far > km").select(F.struct("b", "o_b").alias("pair"), "b", "o_b", "km"), None
    for finer in (size / 8, 0.0):
        label = components(links)
        named = lambda c: label.select(F.col("node").alias(c), F.col("label").alias(f"l_{c}"))  # noqa: B023, E731
        rest = open_.join(named("b"), "b", "left").join(named("o_b"), "o_b", "left").where(F.coalesce("l_b", "b") != F.coalesce("l_o_b", "o_b")).select("b", "o_b", "km")
        rest = stored(rest, "open")
        if rest.isEmpty():
            break
        asked = rest.select(F.explode(F.array("b", "o_b")).alias("parent")).distinct()
        home = buckets.select(*top, "cx", "cy", F.col("b").alias("parent")).join(asked, "parent", "left_semi")
        of = s.withColumns({"cx": geo.cell(F.col("lng"), -180.0, size), "cy": geo.cell(F.col("lat"), -90.0, size)}).join(home, [*top, "cx", "cy"])
        if parents is not None:  # the smaller cells of the last round
            of = s.withColumns({"fx": geo.cell(F.col("lng"), -180.0, size / 8), "fy": geo.cell(F.col("lat"), -90.0, size / 8)}).join(parents.select(*top, F.col("cx").alias("fx"), F.col("cy").alias("fy"), F.col("b").alias("parent")).join(asked, "parent", "left_semi"), [*top, "fx", "fy"])
        small = stored(_buckets(of.select(*top, "parent", "id", "lng", "lat"), finer, [*top, "parent"]), "small")
        # Spots of one bucket are one place already; so the smaller ones stand beside it.
        links = links.unionByName(small.where("b <> parent").select(F.col("parent").alias("lo"), F.col("b").alias("hi")))
        one = small.drop(*top, "cx", "cy")
        other = one.select(F.col("parent").alias("o_parent"), *[F.col(c).alias(f"o_{c}") for c in one.columns if c != "parent"])
        j = rest.select(F.col("b").alias("parent"), F.col("o_b").alias("o_parent"), "km").join(one, "parent").join(other, "o_parent")
        j = stored(_gaps(j).where("near <= km").select("b", "o_b", "km", "far"), "pairs")
        links = stored(links.unionByName(j.where("far <= km").select(F.col("b").alias("lo"), F.col("o_b").alias("hi"))).distinct(), "links")
        open_, parents = j.where("far > km").select("b", "o_b", "km"), small
    labels = components(links)
    own = s.withColumns({"cx": geo.cell(F.col("lng"), -180.0, size), "cy": geo.cell(F.col("lat"), -90.0, size)}).join(buckets.select(*top, "cx", "cy", "b"), [*top, "cx", "cy"]).select("id", "b")
    own = own.join(labels.select(F.col("node").alias("b"), "label"), "b", "left").select("id", F.coalesce("label", "b").alias("label"))
    return spots.select("id").join(own, "id", "left").select("id", F.coalesce("label", "id").alias("group"))


def best_of_groups(spots: DataFrame, groups: DataFrame) -> DataFrame:
    """Keep each group's spot of the highest score; ties go to shorter names, then lower ids. A group of any size is no task's alone."""
    j = spots.join(groups, "id")
    nan = F.isnan(F.col("score").cast("double"))
    order = F.struct(F.col("score").isNull().alias("none"), (~F.coalesce(nan, F.lit(False))).alias("number"), (-F.col("score")).alias("score"), F.char_length("name").alias("long"), "id")
    return j.groupBy("group").agg(F.min_by(F.struct(*spots.columns), order).alias("_b")).select("_b.*")


def merge_stations(known: DataFrame, found: DataFrame, most_km: float = 2.0) -> DataFrame:
    """Give stations without coordinates those found under their name: the only one, or the mean of several all near the first.

    known: name, lng, lat; found: name, nr, lng, lat. Adds source: known, single, mean, spread (left out) or missing.
    """
    first = found.groupBy("name").agg(F.min_by(F.struct("lng", "lat"), "nr").alias("f"), F.count("*").alias("n"))
    far = found.join(first, "name").groupBy("name").agg(F.max(geo.haversine_km(F.col("f.lng"), F.col("f.lat"), F.col("lng"), F.col("lat"))).alias("far"), F.avg("lng").alias("m_lng"), F.avg("lat").alias("m_lat"), F.max("n").alias("n"))
    j = known.join(far, "name", "left")
    source = F.when(F.col("lng").isNotNull(), "known").when(F.col("n").isNull(), "missing").when(F.col("n") == 1, "single").when(F.col("far") <= most_km, "mean").otherwise("spread")
    take = source.isin("single", "mean")
    return j.select("name", F.when(take, F.col("m_lng")).otherwise(F.col("lng")).alias("lng"), F.when(take, F.col("m_lat")).otherwise(F.col("lat")).alias("lat"), source.alias("source"))


def cascade(rows: DataFrame, steps: list[tuple[DataFrame, str]], key: str, value: str) -> DataFrame:
    """Resolve a value by the first lookup that has it: each step is (table of key, value; name of the step). Adds value and resolved_by."""
    out, values = rows, []
    for i, (lookup, name) in enumerate(steps):
        out = out.join(lookup.select(F.col(key), F.col(value).alias(f"_v{i}")).dropDuplicates([key]), key, "left")
        values.append((F.col(f"_v{i}"), name))
    by = F.lit(None).cast("string")
    for column, name in reversed(values):
        by = F.when(column.isNotNull(), F.lit(name)).otherwise(by)
    return out.withColumns({value: F.coalesce(*[c for c, _ in values]), "resolved_by": by}).drop(*[f"_v{i}" for i in range(len(steps))])


def with_orphans(main: DataFrame, orphan: DataFrame, most: int) -> DataFrame:
    """Add to the hits of main chains those of orphan chains that main has not, at least 6 a chain: (line, chain, id, score)."""
    new = orphan.join(main.select("line", "id").distinct(), ["line", "id"], "left_anti")
    first = new.withColumn("_nr", F.row_number().over(Window.partitionBy("line", "id").orderBy("chain"))).where("_nr = 1").drop("_nr")
    chains = first.groupBy("line").agg(F.countDistinct("chain").alias("_n"))
    quota = F.greatest(F.lit(6), F.ceil(F.lit(most) / F.col("_n")))
    w = Window.partitionBy("line", "chain").orderBy(F.col("score").desc(), "id")
    kept = first.join(chains, "line").withColumn("_nr", F.row_number().over(w)).where(F.col("_nr") <= quota).drop("_nr", "_n")
    return main.unionByName(kept)


def coverage(cities: DataFrame, routes: DataFrame) -> DataFrame:
    """State of each city: covered where a published route starts there, partial where one passes, else todo. routes: city, anchor, status."""
    p = F.col("status") == "published"
    per = routes.groupBy("city").agg(F.max(p & F.col("anchor")).alias("a"), F.max(p).alias("b"))
    return cities.join(per, "city", "left").select("city", F.when(F.col("a"), "covered").when(F.col("b"), "partial").otherwise("todo").alias("state"))


#: Km within which an equal name is the same place; km of an equal core name, and of a core name inside another; size of the cells that are compared.
SAME_NAME_KM, SAME_CORE_KM, INSIDE_KM, NEAR_DEG = 25.0, 1.5, 0.35, 0.02
#: Names that are no places of interest, and places of amusement.
NO_PLACE = r"^(景点|观景台|观景点|停车场|服务区|公厕|厕所|游客中心|售票处|大门|门楼|牌坊|广场|步行街|商业街)$|^\d+$|[A-Za-z]{6,}"
AMUSEMENT = "奇航|漂流|过山车|矿山车|娱乐天地|摩天轮|旋转木马|碰碰车|游乐场|水上乐园|动物园|海洋馆|水族"


def spot_rank(score: Column, source: Column, has_wiki: Column, name: Column) -> Column:
    """Rank among near duplicates: the score, more for hand-picked ones, known ones and short names."""
    short = F.greatest(F.lit(0), 12 - F.coalesce(F.char_length(name), F.lit(12))) * 0.15
    return F.coalesce(score, F.lit(0.0)) + F.when(F.coalesce(source, F.lit("")).startswith("hand-curated"), 20.0).otherwise(0.0) + F.when(F.coalesce(has_wiki, F.lit(False)), 5.0).otherwise(0.0) + short


def backfill(spots: DataFrame, kept_by: DataFrame, fields: list[str], rating: str | None = None) -> DataFrame:
    """Return the kept spots, their empty fields filled from those that they stand for, the highest rank first.

    spots: id, rank and the fields; kept_by: id, kept_by. Empty is null or a blank string; the rating is empty unless above 0.
    """
    j = spots.join(kept_by, "id").withColumn("_to", F.coalesce("kept_by", "id"))
    order = F.struct(F.col("kept_by").isNotNull().alias("other"), (-F.col("rank")).alias("r"), "id")
    held = lambda c: (F.col(c) > 0) if c == rating else (F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
    # Where nothing is held, a field keeps the spot's own value, empty as it is.
    best = [F.coalesce(F.min_by(F.when(held(c), F.col(c)), F.when(held(c), order)), F.first(F.when(F.col("kept_by").isNull(), F.col(c)), ignorenulls=True)).alias(c) for c in fields]
    filled = j.groupBy("_to").agg(*best)
    rest = [c for c in spots.columns if c not in fields]
    return spots.join(kept_by.where("kept_by IS NULL").select("id"), "id", "left_semi").select(*rest).join(filled, F.col("id") == F.col("_to")).select(*spots.columns)


def same_name(spots: DataFrame, km: float = SAME_NAME_KM) -> DataFrame:
    """Settle places told more than once: id, kept_by, null or the kept spot of the same name within 25 km. Higher ranks first. spots: id, name, rank, lng, lat."""
    return greedy_cover(spots.where("name IS NOT NULL").select("id", F.col("name").alias("grp"), (-F.col("rank")).alias("rank"), "lng", "lat"), km)


def near_name(spots: DataFrame) -> DataFrame:
    """Settle places with like names in neighbouring cells: id, kept_by, null or the first kept spot that it is; names that are no places are left out.

    Like are equal core names within 1.5 km, and core names within each other within 0.35 km. Higher ranks first. spots: id, name, rank, lng, lat.
    """
    s = spots.dropna(subset=["id", "name", "lng", "lat"]).where(~F.col("name").rlike(NO_PLACE) & ~F.col("name").rlike(AMUSEMENT) & F.col("name").rlike(CJK))
    s = stored(s.select("id", core_name(F.col("name")).alias("core"), "rank", "lng", "lat").withColumns({"cx": geo.cell(F.col("lng"), 0.0, NEAR_DEG), "cy": geo.cell(F.col("lat"), 0.0, NEAR_DEG)}), "named")
    around = F.explode(F.array(*[F.struct((F.col("cx") + dx).alias("cx"), (F.col("cy") + dy).alias("cy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]))
    own = s.select("id", "core", "lng", "lat", around.alias("_c")).select("id", "core", "lng", "lat", "_c.*")
    other = s.select("cx", "cy", F.col("id").alias("b"), F.col("core").alias("b_core"), F.col("lng").alias("o_lng"), F.col("lat").alias("o_lat"))
    j = own.join(other, ["cx", "cy"]).where("id < b").withColumn("km", geo.haversine_km(F.col("lng"), F.col("lat"), F.col("o_lng"), F.col("o_lat")))
    like = ((F.col("km") <= SAME_CORE_KM) & (F.col("core") != "") & (F.col("core") == F.col("b_core"))) | ((F.col("km") <= INSIDE_KM) & (F.col("core").contains(F.col("b_core")) | F.col("b_core").contains(F.col("core"))))
    return greedy_keep(s.select("id", (-F.col("rank")).alias("rank")), j.where(like).select(F.col("id").alias("a"), "b"))
