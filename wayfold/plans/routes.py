"""Queries of routes over stops and places, on the network that the ways make."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.functions.geo import haversine_km
from wayfold.operators import routing
from wayfold.plans.tables import derived, hav, rounded, with_tables

#: Preferences by trip: lines that are preferred, and whether fast ones are wanted.
PREFERENCES = [(0, [1, 2], False), (1, [3], True)]
CLASSES = ["expressway", "national", "provincial", "county", "township", "lane"]


def _nodes(ways):
    return ways.groupBy("node").agg(F.min("lng").alias("lng"), F.min("lat").alias("lat")).withColumn("main", F.lit(True))


def _edges(ways):
    """The pieces of ways, in whole metres, with a line and a kind by way."""
    order = Window.partitionBy("way").orderBy("seq")
    nxt = {f"_{c}": F.lead(c).over(order) for c in ("node", "lng", "lat")}
    metres = F.round(haversine_km(F.col("lng"), F.col("lat"), F.col("_lng"), F.col("_lat")) * 1000)
    return ways.withColumns(nxt).where("_node IS NOT NULL").select(F.col("node").alias("a"), F.col("_node").alias("b"), metres.alias("km"), (F.col("way") % 7).alias("line"), (F.col("way") % 3 == 0).alias("fast"))


def _stops(spark, d):
    """Four stops a trip, near crossings of the road of the trip's number, each eleventh far from all."""
    return derived(spark, d, "stops").select("trip", (F.col("trip") % 2).cast("int").alias("g"), "seq", "name", "lng", "lat")


def _graph(spark, ways, weight):
    # Costs are whole, so that equally cheap ways are seen to be so.
    p = spark.createDataFrame(PREFERENCES, "g int, lines array<bigint>, fast boolean")
    return routing.with_ids(routing.preferred_graphs(_edges(ways), p, lambda *x: F.round(weight(*x))))


def _rail(spark, d):
    ways = derived(spark, d, "ways")
    return routing.stop_routes(_stops(spark, d), _nodes(ways), _graph(spark, ways, routing.rail_weight))


def _drives(spark, d):
    ways = derived(spark, d, "ways")
    classes = spark.createDataFrame(list(enumerate(CLASSES)), "line long, class string")
    return routing.drive_routes(_stops(spark, d).drop("name"), _nodes(ways), _graph(spark, ways, lambda km, fast, wants, preferred: routing.road_weight(km, preferred)), classes)


def rail_lines(spark, d):
    """Trips laid over their stops on the cheapest rails for their kind and lines."""
    return rounded(_rail(spark, d)[0], 6)


def rail_failures(spark, d):
    """Legs of trips that do not snap to the network or have no path on it."""
    return _rail(spark, d)[1]


def drives(spark, d):
    """Trips driven over their places: how, how far, how long and on which roads."""
    return _drives(spark, d)[0].withColumn("roads", F.array_join(F.transform("roads", lambda x: x.cast("string")), ","))


def drive_lines(spark, d):
    """The lines of the drives."""
    return rounded(_drives(spark, d)[1], 6)


QUERIES = {f.__name__: f for f in (rail_lines, rail_failures, drives, drive_lines)}


def _paths(weight: str, snapped: str) -> str:
    """SQL for the legs of trips (lg) and their cheapest paths, from the destination back (bk)."""
    return f"""RECURSIVE nd AS (SELECT node, min(lng) AS lng, min(lat) AS lat FROM ways GROUP BY node),
e0 AS (SELECT node AS a, lead(node) OVER o AS b, round({hav('lng', 'lat', 'lead(lng) OVER o', 'lead(lat) OVER o')} * 1000) AS km, way % 7 AS line, way % 3 = 0 AS fast FROM ways WINDOW o AS (PARTITION BY way ORDER BY seq)),
pf(g, lines, wants) AS (VALUES (0, [1, 2], false), (1, [3], true)),
ew AS (SELECT g, least(a, b) AS lo, greatest(a, b) AS hi, min({{w: w, line: line}}) AS m FROM (SELECT g, a, b, line, round({weight}) AS w FROM e0, pf WHERE b IS NOT NULL AND a <> b) WHERE w > 0 GROUP BY 1, 2, 3),
bw AS (SELECT g, lo AS a, hi AS b, m.w AS w, m.line AS line FROM ew UNION ALL SELECT g, hi, lo, m.w, m.line FROM ew),
st AS (SELECT *, CAST(trip % 2 AS INT) AS g FROM stops), {snapped},
lg AS (SELECT * FROM (SELECT trip, g, row_number() OVER o - 1 AS leg, name AS a_name, lng AS a_lng, lat AS a_lat, node AS origin, far AS a_far, lead(name) OVER o AS b_name, lead(lng) OVER o AS b_lng, lead(lat) OVER o AS b_lat, lead(node) OVER o AS dest, lead(far) OVER o AS b_far, lead(seq) OVER o AS b_seq FROM sn WINDOW o AS (PARTITION BY trip ORDER BY seq)) WHERE b_seq IS NOT NULL),
r(g, origin, node, cost) USING KEY (g, origin, node) AS (SELECT DISTINCT g, origin, origin, 0.0::DOUBLE FROM lg WHERE origin IS NOT NULL AND dest IS NOT NULL
 UNION SELECT r.g, r.origin, bw.b, min(r.cost + bw.w) FROM r JOIN bw ON bw.g = r.g AND bw.a = r.node LEFT JOIN recurring.r k ON k.g = r.g AND k.origin = r.origin AND k.node = bw.b WHERE k.cost IS NULL OR r.cost + bw.w < k.cost GROUP BY 1, 2, 3),
k AS (SELECT g, origin, node, cost FROM r),
bk(g, origin, dest, back, node, cost) AS (SELECT DISTINCT k.g, k.origin, k.node, 0, k.node, k.cost FROM k JOIN lg ON lg.g = k.g AND lg.origin = k.origin AND lg.dest = k.node
 UNION ALL SELECT z.g, z.origin, z.dest, z.back + 1, min(q.node), arg_min(q.cost, q.node) FROM bk z JOIN bw ON bw.g = z.g AND bw.b = z.node JOIN k q ON q.g = z.g AND q.origin = z.origin AND q.node = bw.a AND q.cost + bw.w = z.cost WHERE z.node <> z.origin GROUP BY 1, 2, 3, 4),
ln AS (SELECT g, origin, dest, max(back) AS n FROM bk GROUP BY 1, 2, 3)"""


def _near(km: float, rows: str = "st") -> str:
    return f"(SELECT trip, seq, arg_min(node, (d2, node)) AS node FROM (SELECT s.trip, s.seq, s.lat, n.node, pow(n.lng - s.lng, 2) + pow(n.lat - s.lat, 2) AS d2 FROM {rows} s JOIN nd n ON abs(n.lat - s.lat) < {km} / 111.0 + 0.01 AND abs(n.lng - s.lng) < {km} / 60.0) GROUP BY trip, seq HAVING sqrt(min(d2)) * 111.0 * cos(radians(any_value(lat))) <= {km})"


_RAIL = _paths(
    "km * (1 + CASE WHEN fast <> wants THEN 0.35 ELSE 0.0 END) * (1 - CASE WHEN list_contains(lines, line) THEN 0.25 ELSE 0.0 END)",
    f"sn AS (SELECT st.*, n.node, false AS far FROM st LEFT JOIN {_near(3)} n USING (trip, seq))",
)
_DRIVE = _paths(
    "km * (1 - CASE WHEN list_contains(lines, line) THEN 0.2 ELSE 0.0 END)",
    f"n5 AS {_near(5)}, s2 AS (SELECT * FROM st WHERE (trip, seq) NOT IN (SELECT (trip, seq) FROM n5)), n1 AS {_near(150, 's2')}, sn AS (SELECT st.*, coalesce(n5.node, n1.node) AS node, n1.node IS NOT NULL AS far FROM st LEFT JOIN n5 USING (trip, seq) LEFT JOIN n1 USING (trip, seq))",
)
_PLANAR = "sqrt(pow(({2} - {0}) * cos(radians(({1} + {3}) / 2)), 2) + pow({3} - {1}, 2)) * 111"
_DRIVEN = f"""{_DRIVE}, ok AS (SELECT lg.*, n FROM lg LEFT JOIN ln ON ln.g = lg.g AND ln.origin = lg.origin AND ln.dest = lg.dest AND n > 0),
ts AS (SELECT trip, bool_and(n IS NOT NULL) AS ok, bool_or(coalesce(a_far, false) OR coalesce(b_far, false)) AS far, arg_min({{x: a_lng, y: a_lat}}, leg) AS s, arg_max({{x: b_lng, y: b_lat}}, leg) AS t FROM ok GROUP BY trip),
gd AS (SELECT ok.* FROM ok JOIN ts USING (trip) WHERE ts.ok),
pt AS (SELECT trip, leg, n - back + 1 AS i, nd.lng, nd.lat FROM gd JOIN bk ON bk.g = gd.g AND bk.origin = gd.origin AND bk.dest = gd.dest JOIN nd ON nd.node = bk.node
 UNION ALL SELECT trip, leg, 0, a_lng, a_lat FROM gd WHERE leg = 0 UNION ALL SELECT trip, leg, n + 2, b_lng, b_lat FROM gd
 UNION ALL SELECT trip, 0, 0, s.x, s.y FROM ts WHERE NOT ok UNION ALL SELECT trip, 0, 1, t.x, t.y FROM ts WHERE NOT ok)"""

ORACLES = {
    "rail_lines": with_tables(["ways", "stops"], f"""{_RAIL}, ok AS (SELECT lg.*, n, lag(b_lng) OVER w = a_lng AND lag(b_lat) OVER w = a_lat AS seam FROM lg JOIN ln USING (g, origin, dest) WINDOW w AS (PARTITION BY trip ORDER BY leg)),
pt AS (SELECT trip, leg, n - back + 1 AS i, nd.lng, nd.lat FROM ok JOIN bk USING (g, origin, dest) JOIN nd USING (node) WHERE NOT ((back = n AND sqrt(pow((nd.lng - a_lng) * 91, 2) + pow((nd.lat - a_lat) * 111, 2)) < 0.05) OR (back < n AND back = 0 AND sqrt(pow((nd.lng - b_lng) * 91, 2) + pow((nd.lat - b_lat) * 111, 2)) < 0.05))
 UNION ALL SELECT trip, leg, 0, a_lng, a_lat FROM ok WHERE seam IS NOT TRUE UNION ALL SELECT trip, leg, n + 2, b_lng, b_lat FROM ok)
SELECT trip, CAST(leg AS INT) AS leg, CAST(i AS BIGINT) AS i, round(lng, 6) AS lng, round(lat, 6) AS lat FROM pt"""),
    "rail_failures": with_tables(["ways", "stops"], f"""{_RAIL} SELECT trip, CAST(leg AS INT) AS leg, CASE WHEN origin IS NULL THEN 'snap_failed:' || a_name WHEN dest IS NULL THEN 'snap_failed:' || b_name ELSE 'unreachable:' || a_name || '→' || b_name END AS reason FROM lg LEFT JOIN ln USING (g, origin, dest) WHERE n IS NULL"""),
    "drives": with_tables(["ways", "stops"], f"""{_DRIVEN}, cl AS (SELECT unnest(range({len(CLASSES)})) AS line, unnest({CLASSES}) AS class, unnest([85.0, 65.0, 50.0, 40.0, 30.0, 40.0]) AS kmh),
us AS (SELECT gd.trip, gd.leg, bw.line, {_PLANAR.format('x.lng', 'x.lat', 'y.lng', 'y.lat')} / coalesce(kmh, 40.0) * 60 AS minutes FROM gd JOIN bk u ON u.g = gd.g AND u.origin = gd.origin AND u.dest = gd.dest JOIN bk v ON v.g = u.g AND v.origin = u.origin AND v.dest = u.dest AND v.back = u.back + 1 JOIN bw ON bw.g = u.g AND bw.a = u.node AND bw.b = v.node LEFT JOIN cl USING (line) JOIN nd x ON x.node = least(u.node, v.node) JOIN nd y ON y.node = greatest(u.node, v.node)),
mn AS (SELECT trip, leg, floor(sum(minutes) + any_value(more) + 0.5) AS minutes FROM us JOIN (SELECT trip, leg, ({_PLANAR.format('a_lng', 'a_lat', 'o.lng', 'o.lat')} + {_PLANAR.format('p.lng', 'p.lat', 'b_lng', 'b_lat')}) / 40.0 * 60 AS more FROM gd JOIN nd o ON o.node = origin JOIN nd p ON p.node = dest) USING (trip, leg) GROUP BY trip, leg),
km AS (SELECT trip, floor(sum(d) * 10 + 0.5) / 10 AS km FROM (SELECT trip, {hav('lag(lng) OVER w', 'lag(lat) OVER w', 'lng', 'lat')} AS d FROM pt WINDOW w AS (PARTITION BY trip ORDER BY leg, i)) GROUP BY trip)
SELECT trip, CASE WHEN NOT ok THEN 'direct' WHEN far THEN 'local-spliced' ELSE 'local' END AS engine, km, minutes, roads FROM ts JOIN km USING (trip) LEFT JOIN (SELECT trip, sum(minutes) AS minutes FROM mn GROUP BY trip) USING (trip) LEFT JOIN (SELECT trip, array_to_string(list_sort(list(DISTINCT line)), ',') AS roads FROM us GROUP BY trip) USING (trip)"""),
    "drive_lines": with_tables(["ways", "stops"], f"{_DRIVEN} SELECT trip, CAST(leg AS INT) AS leg, CAST(i AS BIGINT) AS i, round(lng, 6) AS lng, round(lat, 6) AS lat FROM pt"),
}
