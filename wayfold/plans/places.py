"""Queries over places, gates, chapters, boards of stations and events of the sky."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.functions import sky
from wayfold.operators import catalogue as cat
from wayfold.operators import gates, graph, lines, poi
from wayfold.plans.geometry import SEGMENTS
from wayfold.plans.tables import COSTS, derived, epoch_ms, hav, rounded, table, with_tables


def admitted(spark, d):
    s = derived(spark, d, "spots")
    country = F.when(F.col("id") % 7 == 0, "Nepal").when(F.col("id") % 7 == 1, " CN ")
    return s.where(poi.admissible(F.col("lng"), F.col("lat"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("山"), F.col("name"))).otherwise(F.col("name")), country)).select("id")


def land_split(spark: SparkSession, d: str) -> DataFrame:
    """Points by whether they are admitted, some of them with names from beyond the border."""
    i = F.col("id")
    name = F.when(i % 9 == 0, "Paro gate").when(i % 9 == 1, "Paro 门").when(i % 9 == 2, "Parochial hall").otherwise(F.col("name"))
    return poi.split_by_land(derived(spark, d, "spots").select("id", "lng", "lat", name.alias("name"), F.when(i % 11 == 0, "Nepal").alias("country"))).select("id", "kept")


def _named(spark: SparkSession, d: str) -> DataFrame:
    """Spots drawn together, a few names among many."""
    s = derived(spark, d, "spots")
    return s.select("id", F.concat(F.lit("poi"), (F.col("id") % 5).cast("string"), F.when(F.col("id") % 3 == 0, "景区").otherwise("")).alias("name"), (100 + F.col("lng") / 100).alias("lng"), (30 + F.col("lat") / 100).alias("lat"), "score")


def poi_groups(spark, d):
    return poi.near_duplicates(_named(spark, d))


def poi_best(spark, d):
    s = _named(spark, d)
    return poi.best_of_groups(s, poi.near_duplicates(s)).select("id", "name", "score")


def station_merge(spark, d):
    s = table(spark, d, "supplier").select("s_name", "s_suppkey", "s_nationkey")
    known = s.select(F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 == 0, F.lit(100.0)).alias("lng"), F.when(F.col("s_suppkey") % 3 == 0, F.lit(30.0)).alias("lat"))
    found = s.where("s_suppkey % 5 <> 1").select(F.col("s_name").alias("name"), F.explode(F.sequence(F.lit(1), (F.col("s_suppkey") % 3 + 1).cast("int"))).alias("nr"), "s_suppkey")
    found = found.select("name", "nr", (100 + F.col("nr") * F.when(F.col("s_suppkey") % 2 == 0, 0.001).otherwise(0.1)).alias("lng"), F.lit(30.5).alias("lat"))
    return rounded(poi.merge_stations(known, found), 6)


def cascade(spark, d):
    """City of a station: by full name, then without its number, then by nation."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    exact = s.where("k % 2 = 0").select("k", F.concat(F.lit("exact"), F.col("k").cast("string")).alias("city"))
    prefix = s.where("k % 3 = 0").select("k", F.lit("prefix").alias("city"))
    nation = s.where("k % 5 <> 4").select("k", F.lit("nation").alias("city"))
    return poi.cascade(s, [(exact, "exact"), (prefix, "prefix"), (nation, "nation")], "k", "city")


def orphan_chains(spark, d):
    l = table(spark, d, "lineitem")
    rows = l.select((F.col("l_suppkey") % 10).alias("line"), (F.col("l_linenumber") % 4).cast("int").alias("chain"), F.col("l_partkey").alias("id"), F.col("l_quantity").alias("score"))
    rows = rows.groupBy("line", "chain", "id").agg(F.max("score").alias("score"))
    return poi.with_orphans(rows.where("chain = 0"), rows.where("chain > 0"), 60)


def coverage(spark, d):
    r = derived(spark, d, "routes")
    routes = r.select(F.col("anchor_city").alias("city"), (F.col("id") % 97 == 0).alias("anchor"), "status").where("city <> 'Brand#1'")
    return poi.coverage(r.select(F.col("anchor_city").alias("city")).distinct(), routes)


def _stops(spark, d, of="lines"):
    p = derived(spark, d, of)
    return p.select("line_id", F.col("seq").alias("stop"), (F.col("lng") + F.when(F.col("seq") % 7 == 0, 0.5).otherwise(0.01)).alias("lng"), "lat")


def whole_trips(spark, d):
    return gates.whole_trip_gate(_stops(spark, d), derived(spark, d, "lines")).select("line_id", "stage")


def stop_gates(spark, d):
    return gates.stops_gate(_stops(spark, d, "tracks"), derived(spark, d, "tracks"), False)


def segment_gates(spark, d):
    l = table(spark, d, "lineitem")
    stage = gates.segment_gate(F.col("l_quantity") * 2 - 2, F.col("l_extendedprice") / 300, F.col("l_discount") * 100, F.col("l_tax") * 100, F.col("l_extendedprice") / 1000)
    return l.groupBy(stage.alias("stage")).agg(F.count("*").alias("n"))


def network_gates(spark, d):
    o = table(spark, d, "orders")
    r = o.select(F.col("o_orderpriority").alias("class"), (F.col("o_orderkey") % 10 != 0).alias("in_map"), (F.col("o_totalprice") > 50000).alias("has_geometry"), (F.col("o_orderkey") % 4001 == 0).alias("corrupt"), gates.precision_grade(F.col("o_totalprice") / 500000).alias("grade"))
    return gates.network_gate(r)


def key_issues(spark, d):
    l = table(spark, d, "lineitem").select(F.concat(F.element_at(F.array(*map(F.lit, "GSQ")), (F.col("l_suppkey") % 3 + 1).cast("int")), (F.col("l_partkey") % 700).cast("string")).alias("key"))
    return gates.key_issues(l, "key", "^[GSXYC][0-9]{1,4}$")


def chapters(spark, d):
    """Stretches of a road between its named nodes that lie 5 km apart or more, the first node of a name counting."""
    n = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("road"), F.concat(F.lit("n"), (F.col("l_partkey") % 50).cast("string")).alias("name"), F.col("l_extendedprice").alias("m"), "l_orderkey", "l_linenumber")
    first = cat.first_by_priority(n.where("m / 50 <= 1.35 * 1000"), ["road", "name"], [F.col("l_orderkey"), F.col("l_linenumber"), F.col("m")])
    w = Window.partitionBy("road").orderBy("km", "name")
    c = first.withColumn("km", F.col("m") / 50).select("road", "name", F.lead("name").over(w).alias("next"), F.col("km").alias("from_km"), F.lead("km").over(w).alias("to_km"))
    return rounded(c.where("to_km - from_km >= 5"), 6)


def chapter_widths(spark, d):
    """Widths of a road's chapters: half equal, half by the root of their length, no narrower than 4 %, adding up to one."""
    c = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("len"))
    w = Window.partitionBy("l_orderkey")
    share = 0.5 / F.count("*").over(w) + 0.5 * F.sqrt("len") / F.sum(F.sqrt("len")).over(w)
    c = c.withColumn("share", F.greatest(F.lit(0.04), share))
    return rounded(c.select("l_orderkey", "l_linenumber", "len", (F.col("share") / F.sum("share").over(w)).alias("width")), 6)


def clock_durations(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("k"))
    a, b, day = F.col("k") * 37 % 1440, F.col("k") * 53 % 1440, F.col("k") % 3
    return o.select("o_orderkey", F.greatest(F.lit(0), day * 1440 + b - a).cast("long").alias("minutes"))


def board_intersection(spark, d):
    """Orders' customers seen on one day and again at another place up to three days later: a semi join over the union of days."""
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("p"), F.floor(epoch_ms("o_orderdate") / 86400000).alias("day"))
    x, y = o.where("p = '1-URGENT'"), o.where("p = '2-HIGH'").select("o_custkey", F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.col("day") - i)).alias("day"))
    return x.join(y, ["o_custkey", "day"], "left_semi").groupBy("o_custkey").agg(F.count("*").alias("n"))


def direct_or_retro(spark, d):
    """Trains found directly, and those found by looking back that are not among them."""
    o = table(spark, d, "orders").select((F.col("o_custkey") % 400).alias("train"), "o_orderkey", F.col("o_orderstatus").alias("s"))
    direct = o.where("s = 'F'").groupBy("train").agg(F.min("o_orderkey").alias("departs")).withColumn("retro", F.lit(False))
    retro = o.where("s <> 'F'").groupBy("train").agg(F.min("o_orderkey").alias("departs")).withColumn("retro", F.lit(True))
    return direct.unionByName(retro.join(direct.select("train"), "train", "left_anti"))


def meteors(spark, d):
    """Showers within two days of each week of events, dimmed by the moon: an interval join with a small fixed table."""
    weeks = table(spark, d, "events").groupBy(F.floor(epoch_ms("ts") / 604800000).alias("week")).agg(F.count("*").alias("n"))
    # The years of the events and those beside them: as many rows as there are years.
    first = F.year(F.timestamp_millis(F.col("week") * 604800000))
    years = weeks.select(F.explode(F.sequence(first - 1, first + 1)).alias("y")).distinct()
    shower = F.inline(F.array(*[F.struct(F.lit(n).alias("shower"), F.lit(m).alias("m"), F.lit(day).alias("dd"), F.lit(z).alias("zhr")) for n, m, day, z in sky.SHOWERS]))
    peaks = years.select("y", shower).withColumn("peak", (F.unix_date(F.make_date(F.col("y").cast("int"), "m", "dd")).cast("long") * 86400000 + 4 * 3600000))
    window = 2 * 86400000
    j = weeks.join(F.broadcast(peaks), (F.col("peak") + window >= F.col("week") * 604800000) & (F.col("peak") - window <= (F.col("week") + 1) * 604800000))
    score = F.floor(F.least(F.lit(100.0), F.col("zhr") / 150 * 100) * (1 - sky.moon_light(F.col("peak")) * 0.75) + 0.5).cast("int")
    return j.select("week", "shower", "y", score.alias("score"))


def sunrises(spark, d):
    """First rise of the sun through the horizon in a day of ten-minute steps, by straight-line interpolation in its step."""
    p = derived(spark, d, "places").withColumn("day", (F.lit(19700) + F.length("place")).cast("long"))
    s = p.select("place", "lng", "lat", "day", F.explode(F.sequence(F.lit(0), F.lit(144))).alias("k")).withColumn("ms", F.col("day") * 86400000 + F.col("k").cast("long") * 600000)
    s = s.withColumn("alt", sky.altitude(F.col("lng"), F.col("lat"), F.col("ms"), sky.sun_equatorial(F.col("ms"))))
    w = Window.partitionBy("place").orderBy("k")
    s = s.withColumn("before", F.lag("alt").over(w)).where("before < 0 AND alt >= 0")
    return s.groupBy("place").agg(F.floor(F.min(F.col("k") - F.col("alt") / (F.col("alt") - F.col("before"))) * 10).cast("long").alias("minute"))


def road_paths(spark, d):
    """Costs from every fiftieth node, the stated query set, over edges weighted by class, on the graph of neighbouring parts."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    e = l.select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(w).alias("b"), "l_orderkey").where("b IS NOT NULL AND a <> b")
    cls = F.element_at(F.array(*map(F.lit, ("expressway", "national", "provincial", "county", "village"))), (F.col("l_orderkey") % 5 + 1).cast("int"))
    e = e.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), graph.class_weight(F.lit(10.0), cls).alias("w")).groupBy("lo", "hi").agg(F.min("w").alias("w"))
    return rounded(graph.shortest_paths(e, graph.nodes(e).where("node % 50 = 0")), 6)


def od_slices(spark, d):
    """Each line from a third to two thirds of its length: inner points and two cut ends, in order."""
    p = derived(spark, d, "lines")
    total = lines.line_stats(p).select("line_id", "length_km")
    ends = lines.at_km(p, total.select("line_id", F.explode(F.array(F.col("length_km") / 3, F.col("length_km") * 2 / 3)).alias("km"))).select("line_id", "km", "lng", "lat")
    inner = lines.with_cum_km(p).join(total, "line_id").where("cum_km > length_km / 3 AND cum_km < length_km * 2 / 3").select("line_id", F.col("cum_km").alias("km"), "lng", "lat")
    return rounded(ends.unionByName(inner), 4)


def box_overlaps(spark, d):
    """Pairs of lines whose boxes overlap, through shared cells of a coarse grid."""
    b = lines.line_stats(derived(spark, d, "lines")).select("line_id", "min_lng", "min_lat", "max_lng", "max_lat")
    cells = b.withColumn("cx", F.explode(F.sequence(F.floor(F.col("min_lng") / 10), F.floor(F.col("max_lng") / 10)))).withColumn("cy", F.explode(F.sequence(F.floor(F.col("min_lat") / 10), F.floor(F.col("max_lat") / 10))))
    o = cells.select("cx", "cy", *[F.col(c).alias(f"{c}_b") for c in b.columns])
    j = cells.join(o, ["cx", "cy"]).where("line_id < line_id_b AND min_lng <= max_lng_b AND min_lng_b <= max_lng AND min_lat <= max_lat_b AND min_lat_b <= max_lat")
    return j.select("line_id", F.col("line_id_b").alias("other")).distinct()


QUERIES = {
    f.__name__: f for f in (admitted, land_split, poi_groups, poi_best, station_merge, cascade, orphan_chains, coverage, whole_trips, stop_gates, segment_gates, network_gates, key_issues, chapters, chapter_widths, clock_durations, board_intersection,
                            direct_or_retro, meteors, sunrises, road_paths, od_slices, box_overlaps)
}

_LSEGS = SEGMENTS.format(points="lines")
_NAMED = "nm AS (SELECT id, 'poi' || (id % 5) || CASE WHEN id % 3 = 0 THEN '景区' ELSE '' END AS name, 'poi' || (id % 5) AS core, 100 + lng / 100 AS lng, 30 + lat / 100 AS lat, score FROM spots)"
_GROUPS = f"""{_NAMED}, pr AS (SELECT a.id AS a, b.id AS b FROM nm a JOIN nm b ON a.id <> b.id AND a.core = b.core AND ((a.name = b.name AND {hav('a.lng', 'a.lat', 'b.lng', 'b.lat')} <= 2) OR {hav('a.lng', 'a.lat', 'b.lng', 'b.lat')} <= 1.5)),
rc(id, seen) AS (SELECT id, id FROM nm UNION SELECT pr.b, rc.seen FROM rc JOIN pr ON pr.a = rc.id WHERE rc.seen < pr.b), gr AS (SELECT id, min(seen) AS "group" FROM rc GROUP BY 1)"""
_STOPS = f"""{_LSEGS}, st AS (SELECT line_id, seq AS stop, lng + CASE WHEN seq % 7 = 0 THEN 0.5 ELSE 0.01 END AS lng, lat FROM lines),
pr AS (SELECT s.line_id, s.stop, s.lng, s.lat, g.* EXCLUDE (line_id), 111.32 * cos(radians((a_lat + b_lat) / 2)) AS kx FROM st s JOIN segs g USING (line_id)),
pl AS (SELECT *, (b_lng - a_lng) * kx AS bx, (b_lat - a_lat) * 110.574 AS bby, (lng - a_lng) * kx AS sx, (lat - a_lat) * 110.574 AS sy FROM pr), tt AS (SELECT *, greatest(0.0, least(1.0, (sx * bx + sy * bby) / (bx * bx + bby * bby))) AS t FROM pl WHERE bx * bx + bby * bby > 0),
nn AS (SELECT *, row_number() OVER (PARTITION BY line_id, stop ORDER BY sqrt(pow(sx - bx * t, 2) + pow(sy - bby * t, 2)), seg) AS nr FROM tt),
sp AS (SELECT line_id, stop, lng, lat, floor((cum_a + (cum_b - cum_a) * t) * 100 + 0.5) / 100 AS along_km, floor({hav('lng', 'lat', 'a_lng + (b_lng - a_lng) * t', 'a_lat + (b_lat - a_lat) * t')} * 1000 + 0.5) / 1000 AS dist_km FROM nn WHERE nr = 1)"""

_TRACK_STOPS = _STOPS.replace("FROM lines", "FROM tracks")

ORACLES = {
    "stop_gates": with_tables(["tracks"], f"""{_TRACK_STOPS}, c AS (SELECT *, lag(along_km) OVER w - along_km AS back, {hav('lag(lng) OVER w', 'lag(lat) OVER w', 'lng', 'lat')} AS chord FROM sp WINDOW w AS (PARTITION BY line_id ORDER BY stop)),
per AS (SELECT line_id, max(dist_km) AS off, max(back - greatest(3.0, chord * 0.1)) AS back, sum(chord) AS chord, arg_min(lng, stop) AS x0, arg_min(lat, stop) AS y0, arg_max(lng, stop) AS x1, arg_max(lat, stop) AS y1 FROM c GROUP BY 1),
en AS (SELECT line_id, max(cum_b - cum_a) AS jump, max(cum_b) AS length, arg_min(a_lng, seg) AS ax, arg_min(a_lat, seg) AS ay, arg_max(b_lng, seg) AS bx, arg_max(b_lat, seg) AS bby FROM segs GROUP BY 1)
SELECT line_id, CASE WHEN greatest({hav('ax', 'ay', 'x0', 'y0')}, {hav('bx', 'bby', 'x1', 'y1')}) > 12 THEN 'od_anchor' WHEN off > 10 THEN 'stop_off_path' WHEN back > 0 THEN 'backtrack' WHEN jump > 60 THEN 'jump'
WHEN chord >= 50 AND (length / chord < 1 OR length / chord > 1.7) THEN 'length_ratio' ELSE 'ok' END AS stage FROM per JOIN en USING (line_id)"""),
    "admitted": with_tables(["spots"], """SELECT id FROM spots WHERE lng BETWEEN 73.5 AND 134.77 AND lat BETWEEN 17.5 AND 53.56 AND NOT (lng BETWEEN 118.2 AND 118.55 AND lat BETWEEN 24.16 AND 24.55) AND NOT (lng BETWEEN 119.85 AND 120.55 AND lat BETWEEN 25.9 AND 26.45)
AND id % 7 <> 0 AND (id % 2 = 0 OR NOT ((lng >= 80 AND lng < 88.35 AND lat >= 26.2 AND lat < 28.15) OR (lng >= 88.35 AND lng <= 92.2 AND lat >= 26.4 AND lat < 27.72)))"""),
    "land_split": with_tables(["spots"], """SELECT id, lng BETWEEN 73.5 AND 134.77 AND lat BETWEEN 17.5 AND 53.56 AND NOT (lng BETWEEN 118.2 AND 118.55 AND lat BETWEEN 24.16 AND 24.55) AND NOT (lng BETWEEN 119.85 AND 120.55 AND lat BETWEEN 25.9 AND 26.45)
AND id % 11 <> 0 AND (id % 9 = 1 OR NOT (id % 9 = 0 OR (lng >= 80 AND lng < 88.35 AND lat >= 26.2 AND lat < 28.15) OR (lng >= 88.35 AND lng <= 92.2 AND lat >= 26.4 AND lat < 27.72))) AS kept FROM spots"""),
    "poi_groups": with_tables(["spots"], f'{_GROUPS} SELECT id, "group" FROM gr').replace("WITH spots", "WITH RECURSIVE spots", 1),
    "poi_best": with_tables(["spots"], f'{_GROUPS}, b AS (SELECT nm.*, row_number() OVER (PARTITION BY "group" ORDER BY score DESC, length(name), id) AS nr FROM nm JOIN gr USING (id)) SELECT id, name, score FROM b WHERE nr = 1').replace("WITH spots", "WITH RECURSIVE spots", 1),
    "station_merge": """WITH f AS (SELECT s_name AS name, s_suppkey AS k, unnest(range(1, s_suppkey % 3 + 2)) AS nr FROM supplier WHERE s_suppkey % 5 <> 1), g AS (SELECT name, k, 100 + nr * CASE WHEN k % 2 = 0 THEN 0.001 ELSE 0.1 END AS lng FROM f),
a AS (SELECT name, count(*) AS n, avg(lng) AS lng, (max(lng) - min(lng)) > 0.05 AS far FROM g GROUP BY 1)
SELECT s_name AS name, round(CASE WHEN s_suppkey % 3 = 0 THEN 100.0 WHEN n = 1 OR NOT far THEN a.lng END, 6) AS lng, CASE WHEN s_suppkey % 3 = 0 THEN 30.0 WHEN n = 1 OR NOT far THEN 30.5 END::DOUBLE AS lat,
CASE WHEN s_suppkey % 3 = 0 THEN 'known' WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'single' WHEN NOT far THEN 'mean' ELSE 'spread' END AS source FROM supplier LEFT JOIN a ON a.name = s_name""",
    "cascade": "SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'exact' || s_suppkey WHEN s_suppkey % 3 = 0 THEN 'prefix' WHEN s_suppkey % 5 <> 4 THEN 'nation' END AS city, CASE WHEN s_suppkey % 2 = 0 THEN 'exact' WHEN s_suppkey % 3 = 0 THEN 'prefix' WHEN s_suppkey % 5 <> 4 THEN 'nation' END AS resolved_by FROM supplier",
    "orphan_chains": """WITH r AS (SELECT l_suppkey % 10 AS line, CAST(l_linenumber % 4 AS INTEGER) AS chain, l_partkey AS id, max(l_quantity) AS score FROM lineitem GROUP BY ALL), m AS (SELECT * FROM r WHERE chain = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY line, id ORDER BY chain) AS nr FROM r WHERE chain > 0 AND (line, id) NOT IN (SELECT (line, id) FROM m)), f AS (SELECT line, chain, id, score FROM o WHERE nr = 1),
c AS (SELECT line, greatest(6, ceil(60 / count(DISTINCT chain))) AS quota FROM f GROUP BY 1), k AS (SELECT f.*, quota, row_number() OVER (PARTITION BY line, chain ORDER BY score DESC, id) AS nr FROM f JOIN c USING (line))
SELECT * FROM m UNION ALL SELECT line, chain, id, score FROM k WHERE nr <= quota""",
    "coverage": with_tables(["routes"], "SELECT anchor_city AS city, CASE WHEN anchor_city = 'Brand#1' THEN 'todo' WHEN bool_or(status = 'published' AND id % 97 = 0) THEN 'covered' WHEN bool_or(status = 'published') THEN 'partial' ELSE 'todo' END AS state FROM routes GROUP BY 1"),
    "whole_trips": with_tables(["lines"], f"""{_STOPS}, ln AS (SELECT line_id, count(*) AS n, max(cum_km) AS km FROM cum GROUP BY 1),
so AS (SELECT line_id, stop, {hav('lag(lng) OVER w', 'lag(lat) OVER w', 'lng', 'lat')} AS step FROM st WINDOW w AS (PARTITION BY line_id ORDER BY stop)), sk AS (SELECT line_id, count(*) AS ns, sum(coalesce(step, 0)) AS skm FROM so GROUP BY 1),
mi AS (SELECT sp.*, along_km / km AS p, min(stop) OVER (PARTITION BY line_id) AS f, max(stop) OVER (PARTITION BY line_id) AS l FROM sp JOIN ln USING (line_id)), mm AS (SELECT * FROM mi WHERE stop > f AND stop < l),
bk AS (SELECT *, coalesce(max(p) OVER (PARTITION BY line_id ORDER BY stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - p AS back FROM mm), wo AS (SELECT line_id, max(dist_km) AS off, max(back) AS back FROM bk GROUP BY 1)
SELECT line_id, CASE WHEN n < 2 OR ns < 2 THEN 'bad_input' WHEN off > greatest(10.0, skm * 0.02) THEN 'stop_coverage' WHEN km > 2 * skm THEN 'length_ratio' WHEN back > 0.05 THEN 'progress_monotonic' ELSE 'ok' END AS stage FROM sk JOIN ln USING (line_id) LEFT JOIN wo USING (line_id)"""),
    "segment_gates": """WITH s AS (SELECT l_quantity * 2 - 2 AS chord, l_extendedprice / 300 AS len, l_discount * 100 AS a, l_tax * 100 AS b, l_extendedprice / 1000 AS lat FROM lineitem)
SELECT CASE WHEN chord < 0.5 THEN 'ok' WHEN len > 2.2 * chord AND len - chord > 25 THEN 'detour_ratio' WHEN greatest(a, b) > 8 THEN 'endpoint_far' WHEN lat > 45 THEN 'lateral' ELSE 'ok' END AS stage, count(*) AS n FROM s GROUP BY 1""",
    "network_gates": """WITH r AS (SELECT o_orderpriority AS class, o_orderkey % 10 <> 0 AS m, o_totalprice > 50000 AS g, o_orderkey % 4001 = 0 AS bad, o_totalprice / 500000 AS e FROM orders),
p AS (SELECT class, round(count(*) FILTER (WHERE m AND g) / greatest(count(*) FILTER (WHERE m), 1), 4) AS coverage, count(*) FILTER (WHERE bad) AS corrupt, round(count(*) FILTER (WHERE e <= 0.25) / count(*), 4) AS good_share FROM r GROUP BY 1)
SELECT *, CASE WHEN corrupt > 0 THEN 'corrupt' WHEN coverage < 0.5 THEN 'coverage' WHEN good_share < 0.75 THEN 'grade' ELSE 'ok' END AS gate FROM p""",
    "key_issues": """WITH k AS (SELECT substr('GSQ', CAST(l_suppkey % 3 + 1 AS INTEGER), 1) || (l_partkey % 700) AS key FROM lineitem)
SELECT key, 'duplicate' AS issue FROM k GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT DISTINCT key, 'format' FROM k WHERE NOT regexp_full_match(key, '[GSXYC][0-9]{1,4}')""",
    "chapters": """WITH n AS (SELECT l_suppkey AS road, 'n' || (l_partkey % 50) AS name, l_extendedprice AS m, row_number() OVER (PARTITION BY l_suppkey, l_partkey % 50 ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS nr FROM lineitem WHERE l_extendedprice / 50 <= 1350),
c AS (SELECT road, name, lead(name) OVER w AS next, m / 50 AS from_km, lead(m / 50) OVER w AS to_km FROM n WHERE nr = 1 WINDOW w AS (PARTITION BY road ORDER BY m / 50, name)) SELECT road, name, next, round(from_km, 6) AS from_km, round(to_km, 6) AS to_km FROM c WHERE to_km - from_km >= 5""",
    "chapter_widths": """WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity AS len, greatest(0.04, 0.5 / count(*) OVER w + 0.5 * sqrt(l_quantity) / sum(sqrt(l_quantity)) OVER w) AS share FROM lineitem WINDOW w AS (PARTITION BY l_orderkey))
SELECT l_orderkey, l_linenumber, len, round(share / sum(share) OVER (PARTITION BY l_orderkey), 6) AS width FROM c""",
    "clock_durations": "SELECT o_orderkey, greatest(0, o_orderkey % 3 * 1440 + o_orderkey * 53 % 1440 - o_orderkey * 37 % 1440) AS minutes FROM orders",
    "board_intersection": """WITH o AS (SELECT o_custkey, o_orderpriority AS p, epoch_ms(o_orderdate) // 86400000 AS day FROM orders)
SELECT o_custkey, count(*) AS n FROM o x WHERE p = '1-URGENT' AND EXISTS (SELECT 1 FROM o y WHERE y.p = '2-HIGH' AND y.o_custkey = x.o_custkey AND y.day BETWEEN x.day AND x.day + 3) GROUP BY 1""",
    "direct_or_retro": "SELECT o_custkey % 400 AS train, coalesce(min(o_orderkey) FILTER (WHERE o_orderstatus = 'F'), min(o_orderkey)) AS departs, NOT bool_or(o_orderstatus = 'F') AS retro FROM orders GROUP BY 1",
    "meteors": f"""WITH w AS (SELECT DISTINCT epoch_ms(ts) // 604800000 AS week FROM events), s(shower, m, dd, zhr) AS (VALUES {", ".join(str(x) for x in sky.SHOWERS)}), p AS (SELECT shower, zhr, y, epoch_ms(make_timestamp(y, m, dd, 4, 0, 0.0)) AS peak FROM s, (SELECT unnest(range(min(year(ts)) - 2, max(year(ts)) + 3)) AS y FROM events)),
j AS (SELECT *, fmod(fmod((peak - 947182440000.0) / 86400000.0, 29.530588853) + 29.530588853, 29.530588853) AS age FROM w JOIN p ON peak + 172800000 >= week * 604800000 AND peak - 172800000 <= (week + 1) * 604800000)
SELECT week, shower, y, CAST(floor(least(100.0, zhr / 150 * 100) * (1 - (1 - cos(2 * pi() * age / 29.530588853)) / 2 * 0.75) + 0.5) AS INTEGER) AS score FROM j""",
    "road_paths": """WITH RECURSIVE e0 AS (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b, l_orderkey FROM lineitem),
e AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi, min(10.0::DOUBLE * [1.0, 1.15, 1.35, 1.6, 1.9][l_orderkey % 5 + 1]::DOUBLE) AS w FROM e0 WHERE b IS NOT NULL AND a <> b GROUP BY 1, 2), """ + COSTS + " SELECT origin, node, round(cost, 6) AS cost FROM r",
    "od_slices": with_tables(["lines"], f"""{_LSEGS}, z AS (SELECT line_id, max(cum_b) AS total FROM segs GROUP BY 1), k AS (SELECT line_id, unnest([total / 3, total * 2 / 3]) AS km FROM z),
j AS (SELECT k.line_id, km, s.*, CASE WHEN cum_b > cum_a THEN (km - cum_a) / (cum_b - cum_a) ELSE 0 END AS t FROM k JOIN segs s ON k.line_id = s.line_id AND km >= cum_a AND (km < cum_b OR (last AND km <= cum_b)))
SELECT line_id, round(km, 4) AS km, round(a_lng + (b_lng - a_lng) * t, 4) AS lng, round(a_lat + (b_lat - a_lat) * t, 4) AS lat FROM j UNION ALL SELECT c.line_id, round(cum_km, 4), round(lng, 4), round(lat, 4) FROM cum c JOIN z ON z.line_id = c.line_id AND cum_km > total / 3 AND cum_km < total * 2 / 3"""),
    "box_overlaps": with_tables(["lines"], """b AS (SELECT line_id, min(lng) AS x0, max(lng) AS x1, min(lat) AS y0, max(lat) AS y1 FROM lines GROUP BY 1)
SELECT a.line_id, b.line_id AS other FROM b a JOIN b ON a.line_id < b.line_id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1"""),
}
