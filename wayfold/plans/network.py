"""Queries of points against networks, of road numbers and stations, and of timetables' labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.functions import geo, names
from wayfold.operators import lines, network, spatial
from wayfold.plans.tables import derived, epoch_ms, hav, rounded, table, with_tables

PROVINCES = ("P0", "P1", "P2", "P3", "P4", "P5")


def _nodes(spark, d):
    p = derived(spark, d, "lines")
    return p.select(F.col("seq").alias("node"), "lng", "lat", (F.col("seq") % 3 == 0).alias("main"), F.array("line_id").alias("lines"))


def _rated(spark, d):
    """Points of interest with a source, a distance class, honours and a rating, by their key."""
    i = F.col("id")
    return derived(spark, d, "spots").select(
        "id", "name", "score", "province", F.concat(F.element_at(F.array(*[F.lit(x) for x in ("osm", "amap", "hand")]), (i % 3 + 1).cast("int")), F.lit(":"), i.cast("string")).alias("source"),
        F.element_at(F.array(F.lit("pass"), F.lit("detour"), F.lit("spur"), F.lit(None)), (i % 4 + 1).cast("int")).alias("detour_class"),
        F.when(i % 6 == 0, F.array(F.lit("5A"), F.concat(F.lit("H"), (i % 7).cast("string")))).alias("honors"), F.when(i % 5 != 0, (i % 50) / 10).alias("rating"), (i % 400 / 7).alias("km"),
    )


def _refs(spark, d):
    l = table(spark, d, "lineitem")
    letter = F.substring(F.lit("GSXYCQ "), (F.col("l_suppkey") % 7 + 1).cast("int"), F.lit(1))
    return l.select("l_orderkey", "l_linenumber", F.concat(letter, (F.col("l_partkey") % 1200).cast("string")).alias("ref"))


def nearest_nodes(spark, d):
    """Each point's network node: the nearest of the main component if one is near, within 200 km."""
    return rounded(network.nearest_node(derived(spark, d, "spots"), _nodes(spark, d), 200.0, 1.0), 6)


def nearest_roads(spark, d):
    """Each point's nearest road and up to two more within 60 km of that."""
    v = derived(spark, d, "lines").select(F.col("line_id").alias("key"), "lng", "lat")
    return network.nearest_roads(derived(spark, d, "spots"), v, 0.8, 5, 60.0).select("id", "km", F.array_join(F.transform("keys", lambda k: k.cast("string")), ",").alias("keys"))


def cross_links(spark, d):
    """Links between nodes of different lines within 300 km, at 1.5 times their length."""
    return rounded(network.cross_links(_nodes(spark, d), 300.0, 1.5, 3.0), 6)


def provinces(spark, d):
    """Provinces of points by overlapping boxes: one wins over two others, one is nested, the current one stays where it can."""
    i = F.col("n_nationkey")
    boxes = table(spark, d, "nation").select(F.col("n_name").alias("name"), i.alias("nr"), (80.0 + i * 7 % 35).alias("west"), (20.0 + i * 5 % 25).alias("south"), (80.0 + i * 7 % 35 + 4 + i % 9).alias("east"), (20.0 + i * 5 % 25 + 3 + i % 7).alias("north"))
    s = derived(spark, d, "spots").withColumn("current", F.when(F.col("id") % 3 == 0, "CHINA").when(F.col("id") % 3 == 1, "FRANCE"))
    return network.province_of(s.select("id", "lng", "lat", "current"), boxes, {"BRAZIL": ("CANADA", "EGYPT")}, ("JAPAN", "KENYA")).select("id", "province")


def way_lengths(spark, d):
    """Ways by the coordinates of their nodes: how many are known and how long the way is."""
    ways = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("way"), (F.col("l_linenumber") * 1_000_000 + F.col("l_suppkey")).alias("seq"), F.col("l_suppkey").alias("node"))
    p = network.way_points(ways, derived(spark, d, "points").select(F.col("seq").alias("node"), "lng", "lat"))
    out = lines.line_stats(p.withColumnRenamed("way", "line_id")).select("line_id", "length_km")
    return rounded(out.join(p.groupBy(F.col("way").alias("line_id")).agg(F.count("*").alias("nodes")), "line_id"), 4)


def corridor_spots(spark, d):
    """Points of interest of each line: noted ones, near ones, both."""
    s, p = derived(spark, d, "spots"), derived(spark, d, "lines")
    noted = s.where("id % 10 = 0").select((F.col("id") % 25).alias("line_id"), "id")
    return network.spots_by_corridor(noted, spatial.near_lines(s, p, 40.0))


def ref_counts(spark, d):
    """Known road numbers by the orders that name them; an order's first twelve are kept."""
    r = _refs(spark, d)
    items = r.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "ref"))).alias("refs")).select("id", F.col("refs.ref").alias("refs"))
    keys = r.where("ref RLIKE '^[GS]'").select(F.col("ref").alias("key"))
    return network.corridor_refs(items, keys)[1]


def routes_on_ref(spark, d):
    """Routes that name a road, or one of whose segments does."""
    r = _refs(spark, d)
    routes = r.where("l_linenumber = 1").select(F.col("l_orderkey").alias("id"), F.array(F.lower("ref")).alias("refs"))
    return network.routes_with_ref(routes, r.where("l_linenumber > 1").select(F.col("l_orderkey").alias("id"), F.array("ref").alias("refs")), " g109 ")


def routes_of_names(spark, d):
    """Routes by the places they name: an equal name but for case and blanks around it."""
    called = table(spark, d, "lineitem").select(F.col("l_partkey").alias("route"), F.concat(F.lit("  SUPPLIER#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"), F.lit(" ")).alias("place"))
    spots = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lower(F.trim("s_name")).alias("k"))
    j = called.select("route", F.lower(F.trim("place")).alias("k")).distinct().join(spots, "k")
    return j.groupBy("id").agg(F.count("*").alias("routes"), F.min("route").alias("first"), F.max("route").alias("last"))


def spot_stats(spark, d):
    return network.spot_stats(_rated(spark, d).withColumn("tier", network.tier_of(F.col("score"))))


def spots_gated(spark, d):
    """Points that pass the gate for far places, with their tier and why they are worth the way."""
    s = _rated(spark, d)
    reason = F.when(F.col("detour_class") == "spur", names.spur_reason(F.col("honors"), F.lit(None).cast("string"), F.col("km")))
    return s.where(network.keeps_spur(F.col("detour_class"), F.col("honors"), F.col("score"), F.col("rating"))).select("id", network.tier_of(F.col("score")).alias("tier"), reason.alias("reason"))


def spots_of_province(spark, d):
    """The 50 best points of a province, a top list."""
    return network.slice_of(_rated(spark, d), "P3", most=50).select("id", "score")


def top_spots(spark, d):
    """The ten best points, a top list."""
    return derived(spark, d, "spots").orderBy(F.col("score").desc(), "name").limit(10).select("id", "name", "score")


def rail_points(spark, d):
    s = derived(spark, d, "spots").withColumns({"x": F.col("lng") + F.col("id") % 30, "y": F.col("lat") + F.col("id") % 9})
    return s.select("id", network.plausible_rail_point(F.col("x"), F.col("y")).alias("plausible"))


def degree_projections(spark, d):
    """Each point's nearest segment within 40 km by projection in degrees, per line."""
    s = derived(spark, d, "spots").select("id", "lng", "lat")
    pairs = spatial.nearest_pairs(s, lines.segments(derived(spark, d, "lines")), 40.0, network.degree_km(), False, F.lit(40.0))
    out = network.project_in_degrees(pairs, ["line_id", "id"])
    return rounded(out.where("km <= 40"), 5)


def road_signs(spark, d):
    return _refs(spark, d).groupBy(names.road_sign(F.col("ref")).alias("sign")).agg(F.count("*").alias("n"))


_STATIONS = ("嘉兴", "嘉兴南", "嘉兴站", "杭州东", "杭州南", "杭州", "上海虹桥站", "上海", "南", "")


def _station(key):
    return F.element_at(F.array(*[F.lit(n) for n in _STATIONS]), (F.col(key) % len(_STATIONS) + 1).cast("int"))


def station_pairs(spark, d):
    """Pairs of station names: one station, and one stop of a journey."""
    o = table(spark, d, "orders").select(_station("o_orderkey").alias("a"), _station("o_custkey").alias("b"))
    return o.groupBy("a", "b").agg(F.count("*").alias("n")).select("a", "b", "n", names.same_station(F.col("a"), F.col("b")).alias("station"), names.same_stop(F.col("a"), F.col("b")).alias("stop"))


def station_scores(spark, d):
    """Suggestion scores of parts as stations: name, brand as spelling, type as short form, container of digits as code."""
    p = table(spark, d, "part")
    score = names.station_score(F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_partkey").cast("string"), " Brand#1")
    return p.select("p_partkey", score.alias("score")).where("score IS NOT NULL")


def schedule_labels(spark, d):
    """Labels of shifts, whether a clock is near a stop's time, and the time each stop goes by."""
    e, i = table(spark, d, "events"), F.col("event_id")
    ms = epoch_ms("ts")
    kind = F.when(i % 3 == 0, "depart").when(i % 3 == 1, "arrive").otherwise("stop")
    at, arrive, depart = F.when(i % 2 == 0, ms), F.when(i % 5 != 0, ms + 60_000), F.when(i % 7 != 0, ms + 180_000)
    anchor = names.stop_anchor(kind, at, arrive, depart)
    return e.select("event_id", names.offset_label((F.col("value") - 50) * 20_000).alias("label"), (anchor - ms).alias("anchor"), names.near_arrival(ms + (i % 90) * 60_000, anchor).alias("near"), (names.stop_anchor(kind, at, arrive, depart, "arrive") - ms).alias("arrival"))


QUERIES = {f.__name__: f for f in (nearest_nodes, nearest_roads, cross_links, provinces, way_lengths, corridor_spots, ref_counts, routes_on_ref, routes_of_names, spot_stats, spots_gated, spots_of_province, top_spots, rail_points,
                                   degree_projections, road_signs, station_pairs, station_scores, schedule_labels)}

_REF_SQL = "r AS (SELECT l_orderkey, l_linenumber, substr('GSXYCQ ', CAST(l_suppkey % 7 + 1 AS INTEGER), 1) || CAST(l_partkey % 1200 AS VARCHAR) AS ref FROM lineitem)"
_RATED_SQL = """t AS (SELECT id, name, score, province, ['osm', 'amap', 'hand'][id % 3 + 1] AS source, ['pass', 'detour', 'spur', NULL][id % 4 + 1] AS detour_class,
CASE WHEN id % 6 = 0 THEN '5A、H' || CAST(id % 7 AS VARCHAR) END AS honors, CASE WHEN id % 5 <> 0 THEN id % 50 / 10 END AS rating, id % 400 / 7 AS km, CASE WHEN score >= 82 THEN 'A' WHEN score >= 66 THEN 'B' ELSE 'C' END AS tier FROM spots)"""
_NAME_SQL = "['" + "', '".join(_STATIONS) + "']"
_SIDE = "'[东西南北]$'"

ORACLES = {
    "nearest_nodes": with_tables(["spots", "lines"], """c AS (SELECT s.id, s.lat, l.seq AS node, l.seq % 3 <> 0 AS side, (l.lng - s.lng) * (l.lng - s.lng) + (l.lat - s.lat) * (l.lat - s.lat) AS d2
FROM spots s JOIN lines l ON abs(floor(l.lng) - floor(s.lng)) <= 3 AND abs(floor(l.lat) - floor(s.lat)) <= 3), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY side, d2, node) AS nr FROM c)
SELECT id, node, round(sqrt(d2) * 111 * cos(radians(lat)), 6) AS km FROM b WHERE nr = 1 AND sqrt(d2) * 111 * cos(radians(lat)) <= 200"""),
    "nearest_roads": with_tables(["spots", "lines"], """c AS (SELECT s.id, l.line_id AS k, greatest(abs(floor(l.lng / 0.8) - floor(s.lng / 0.8)), abs(floor(l.lat / 0.8) - floor(s.lat / 0.8))) AS ring,
sqrt(pow((l.lng - s.lng) * cos(radians(s.lat)), 2) + pow(l.lat - s.lat, 2)) * 111 AS d FROM spots s CROSS JOIN lines l), n AS (SELECT * FROM c WHERE ring <= 5),
g AS (SELECT id, r, min(d) AS best FROM n JOIN (SELECT unnest(range(6)) AS r) ON ring <= r GROUP BY 1, 2), st AS (SELECT id, coalesce(min(r) FILTER (WHERE best <= r * 0.8 * 111 * 0.9), 5) AS stop FROM g GROUP BY 1),
k AS (SELECT n.id, k, min(d) AS d FROM n JOIN st ON st.id = n.id AND ring <= stop GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, k) AS nr, min(d) OVER (PARTITION BY id) AS best FROM k)
SELECT id, floor(min(best) * 100 + 0.5) / 100 AS km, string_agg(CAST(k AS VARCHAR), ',' ORDER BY nr) AS keys FROM o WHERE nr <= 3 AND d <= best + 60 GROUP BY 1"""),
    "cross_links": with_tables(["lines"], f"""SELECT a.seq AS a, b.seq AS b, round({hav('a.lng', 'a.lat', 'b.lng', 'b.lat')} * 1.5, 6) AS w FROM lines a JOIN lines b ON a.seq < b.seq AND a.line_id <> b.line_id
AND abs(floor(a.lng / 3) - floor(b.lng / 3)) <= 1 AND abs(floor(a.lat / 3) - floor(b.lat / 3)) <= 1 WHERE {hav('a.lng', 'a.lat', 'b.lng', 'b.lat')} > 0 AND {hav('a.lng', 'a.lat', 'b.lng', 'b.lat')} <= 300"""),
    "provinces": with_tables(["spots"], """x AS (SELECT n_name AS name, n_nationkey AS nr, 80.0 + n_nationkey * 7 % 35 AS west, 20.0 + n_nationkey * 5 % 25 AS south, 80.0 + n_nationkey * 7 % 35 + 4 + n_nationkey % 9 AS east, 20.0 + n_nationkey * 5 % 25 + 3 + n_nationkey % 7 AS north FROM nation),
p AS (SELECT id, lng, lat, CASE id % 3 WHEN 0 THEN 'CHINA' WHEN 1 THEN 'FRANCE' END AS cur FROM spots),
h AS (SELECT p.id, any_value(cur) AS cur, coalesce(list(name ORDER BY nr) FILTER (WHERE name IS NOT NULL), []) AS h FROM p LEFT JOIN x ON lng BETWEEN west AND east AND lat BETWEEN south AND north GROUP BY 1),
q AS (SELECT *, list_filter(h, lambda n: n NOT IN ('JAPAN', 'KENYA')) AS own FROM h), z AS (SELECT *, CASE WHEN len(own) > 0 THEN own ELSE h END AS pool FROM q)
SELECT id, CASE WHEN len(h) = 0 THEN cur WHEN list_contains(h, 'BRAZIL') AND (list_contains(h, 'CANADA') OR list_contains(h, 'EGYPT')) THEN 'BRAZIL' WHEN list_contains(pool, cur) THEN cur ELSE pool[1] END AS province FROM z"""),
    "way_lengths": with_tables(["points"], f"""w AS (SELECT l_orderkey AS way, l_linenumber AS nr, lng, lat, lag(lng) OVER o AS x, lag(lat) OVER o AS y FROM lineitem JOIN points ON seq = l_suppkey WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey))
SELECT way AS line_id, round(sum(coalesce({hav('x', 'y', 'lng', 'lat')}, 0)), 4) AS length_km, count(*) AS nodes FROM w GROUP BY 1"""),
    "corridor_spots": with_tables(["spots", "lines"], f"""t AS (SELECT id % 25 AS line_id, id FROM spots WHERE id % 10 = 0), g AS (SELECT l.line_id, s.id FROM spots s CROSS JOIN lines l GROUP BY 1, 2 HAVING min({hav('s.lng', 's.lat', 'l.lng', 'l.lat')}) <= 40),
u AS (SELECT line_id, id, 1 AS n FROM t UNION ALL SELECT line_id, id, 0 FROM g WHERE (line_id, id) NOT IN (SELECT (line_id, id) FROM t)) SELECT line_id, CAST(sum(n) AS BIGINT) AS line_spots, CAST(sum(1 - n) AS BIGINT) AS geo_spots, count(*) AS spots FROM u GROUP BY 1"""),
    "ref_counts": f"WITH {_REF_SQL} SELECT ref AS key, count(DISTINCT l_orderkey) AS spots FROM r WHERE regexp_matches(ref, '^[GS]') GROUP BY 1",
    "routes_on_ref": f"WITH {_REF_SQL} SELECT DISTINCT l_orderkey AS id FROM r WHERE upper(ref) = 'G109'",
    "routes_of_names": """WITH j AS (SELECT DISTINCT s_suppkey AS id, l_partkey AS route FROM lineitem JOIN supplier ON lower(trim(s_name)) = lower(trim('  SUPPLIER#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') || ' ')))
SELECT id, count(*) AS routes, min(route) AS first, max(route) AS last FROM j GROUP BY 1""",
    "spot_stats": with_tables(["spots"], f"""{_RATED_SQL}, u AS (SELECT 'source' AS kind, source AS value FROM t UNION ALL SELECT 'detour_class', detour_class FROM t UNION ALL SELECT 'tier', tier FROM t UNION ALL SELECT 'rating', CASE WHEN rating > 0 THEN 'some' END FROM t)
SELECT kind, value, count(*) AS n FROM u WHERE value IS NOT NULL GROUP BY 1, 2"""),
    "spots_gated": with_tables(["spots"], f"""{_RATED_SQL} SELECT id, tier, CASE WHEN detour_class = 'spur' THEN '距本次路线 ' || CAST(CAST(floor(km + 0.5) AS BIGINT) AS VARCHAR) || ' km，需专程绕行；' || honors || '，值得为它单独安排时间' END AS reason
FROM t WHERE detour_class IS DISTINCT FROM 'spur' OR honors IS NOT NULL OR score >= 74 OR coalesce(rating, 0) >= 4.2"""),
    "spots_of_province": with_tables(["spots"], "SELECT id, score FROM spots WHERE province = 'P3' ORDER BY score DESC, id LIMIT 50"),
    "top_spots": with_tables(["spots"], "SELECT id, name, score FROM spots ORDER BY score DESC, name LIMIT 10"),
    "rail_points": with_tables(["spots"], "p AS (SELECT id, lng + id % 30 AS x, lat + id % 9 AS y FROM spots) SELECT id, x BETWEEN 73 AND 135 AND y BETWEEN 18 AND 54 AND NOT (x >= 128.5 AND y < 41.5) AS plausible FROM p"),
    "degree_projections": with_tables(["spots", "lines"], f"""o AS (SELECT line_id, seq, lng AS ax, lat AS ay, lead(lng) OVER w AS bx, lead(lat) OVER w AS by_, row_number() OVER w AS seg FROM lines WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
l AS (SELECT *, {hav('ax', 'ay', 'bx', 'by_')} AS len FROM o WHERE bx IS NOT NULL), g AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY line_id ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM l),
p AS (SELECT s.id, s.lng, s.lat, g.*, CASE WHEN pow(bx - ax, 2) + pow(by_ - ay, 2) > 0 THEN greatest(0, least(1, ((s.lng - ax) * (bx - ax) + (s.lat - ay) * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)))) ELSE 0 END AS t FROM spots s CROSS JOIN g),
q AS (SELECT line_id, id, seg, cum + len * t AS at_km, {hav('lng', 'lat', 'ax + (bx - ax) * t', 'ay + (by_ - ay) * t')} AS km FROM p), b AS (SELECT *, row_number() OVER (PARTITION BY line_id, id ORDER BY km, seg) AS nr FROM q)
SELECT line_id, id, round(km, 5) AS km, round(at_km, 5) AS at_km FROM b WHERE nr = 1 AND km <= 40"""),
    "road_signs": f"""WITH {_REF_SQL}, u AS (SELECT upper(trim(ref)) AS s FROM r) SELECT CASE WHEN regexp_full_match(s, '[GSXYC]\\d{{1,4}}') THEN CASE substr(s, 1, 1) WHEN 'G' THEN CASE WHEN length(s) = 4 THEN 'national-highway' ELSE 'national-expressway' END
WHEN 'S' THEN CASE WHEN length(s) = 4 THEN 'provincial-highway' ELSE 'provincial-expressway' END WHEN 'X' THEN 'county' WHEN 'Y' THEN 'township' ELSE 'village' END ELSE 'national-highway' END AS sign, count(*) AS n FROM u GROUP BY 1""",
    "station_pairs": f"""WITH o AS (SELECT {_NAME_SQL}[o_orderkey % {len(_STATIONS)} + 1] AS a, {_NAME_SQL}[o_custkey % {len(_STATIONS)} + 1] AS b, count(*) AS n FROM orders GROUP BY 1, 2),
x AS (SELECT *, regexp_replace(a, '站$', '') AS x, regexp_replace(b, '站$', '') AS y FROM o), s AS (SELECT *, regexp_replace(x, {_SIDE}, '') AS sx, regexp_replace(y, {_SIDE}, '') AS sy FROM x)
SELECT a, b, n, x <> '' AND y <> '' AND (x = y OR (NOT (sx = sy AND length(sx) >= 2 AND (regexp_matches(x, {_SIDE}) OR regexp_matches(y, {_SIDE}))) AND (contains(x, y) OR contains(y, x)))) AS station,
a <> '' AND b <> '' AND (a = b OR (x <> '' AND y <> '' AND (starts_with(x, y) OR starts_with(y, x)))) AS stop FROM s""",
    "station_scores": """WITH s AS (SELECT p_partkey, CAST(CASE WHEN lower(p_name) = 'brand#1' OR CAST(p_partkey AS VARCHAR) = 'brand#1' THEN 100 WHEN starts_with(lower(p_name), 'brand#1') THEN 80 WHEN starts_with(lower(p_type), 'brand#1') OR starts_with(lower(p_brand), 'brand#1') THEN 70
WHEN contains(lower(p_name), 'brand#1') THEN 50 WHEN contains(lower(p_brand), 'brand#1') OR contains(lower(p_type), 'brand#1') THEN 40 END AS INTEGER) AS score FROM part) SELECT * FROM s WHERE score IS NOT NULL""",
    "schedule_labels": """WITH e AS (SELECT event_id, CAST(floor((value - 50) * 20000 / 60000 + 0.5) AS BIGINT) AS m, CASE event_id % 3 WHEN 0 THEN 'depart' WHEN 1 THEN 'arrive' ELSE 'stop' END AS kind, CASE WHEN event_id % 2 = 0 THEN 0 END AS at_,
CASE WHEN event_id % 5 <> 0 THEN 60000 END AS arr, CASE WHEN event_id % 7 <> 0 THEN 180000 END AS dep FROM events),
a AS (SELECT *, CASE kind WHEN 'depart' THEN coalesce(at_, dep, arr) WHEN 'arrive' THEN coalesce(at_, arr, dep) ELSE coalesce(dep, arr, at_) END AS anchor FROM e)
SELECT event_id, CASE WHEN m = 0 THEN '准点' WHEN m > 0 THEN '晚点 ' || CAST(m AS VARCHAR) || ' 分钟' ELSE '早点 ' || CAST(abs(m) AS VARCHAR) || ' 分钟' END AS label, CAST(anchor AS BIGINT) AS anchor,
coalesce(abs(event_id % 90 * 60000 - anchor) <= 2700000, FALSE) AS near, CAST(coalesce(arr, at_, dep) AS BIGINT) AS arrival FROM a""",
}
