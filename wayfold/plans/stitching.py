"""Queries that stitch ways between places and trace lines through control points."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.operators import routing, stitching
from wayfold.plans.routes import _edges, _nodes
from wayfold.plans.tables import derived, hav, rounded, with_tables

CONNECT_DEG, SNAP_KM = 0.0015, 4.0


def _pairs(spark, d):
    """Each stop with the one after it on its trip."""
    order = Window.partitionBy("trip").orderBy("seq")
    s = derived(spark, d, "stops").withColumns({"b_lng": F.lead("lng").over(order), "b_lat": F.lead("lat").over(order)}).where("b_lng IS NOT NULL")
    return s.select(F.col("seq").alias("pair"), F.col("lng").alias("a_lng"), F.col("lat").alias("a_lat"), "b_lng", "b_lat")


def way_costs(spark, d):
    """The length of the cheapest path of ways between stops."""
    path = stitching.way_paths(derived(spark, d, "ways"), _pairs(spark, d), SNAP_KM, CONNECT_DEG)
    return rounded(path.groupBy("pair").agg(F.max("km").alias("km")), 4)


def way_lines(spark, d):
    """The lines of these paths, clipped to the stops."""
    return rounded(stitching.stitched_lines(derived(spark, d, "ways"), _pairs(spark, d), SNAP_KM, CONNECT_DEG), 6)


def _traces(spark, d):
    ways = derived(spark, d, "ways")
    e = routing.with_ids(_edges(ways).select(F.lit(0).alias("g"), "a", "b", F.col("km").alias("w"), "km", "line"))
    return stitching.traces(derived(spark, d, "stops").select(F.col("trip").alias("line"), "seq", "lng", "lat"), _nodes(ways), e, 3.0)


def traced(spark, d):
    """The nodes of lines traced through the stops of each trip."""
    return _traces(spark, d)[0]


def trace_gaps(spark, d):
    """Where a traced line goes over to another part of the network."""
    return rounded(_traces(spark, d)[1], 4)


QUERIES = {f.__name__: f for f in (way_costs, way_lines, traced, trace_gaps)}

_D = hav("p.lng", "p.lat", "w.lng", "w.lat")
_G = hav("w.lng", "w.lat", "l.lng", "l.lat")
ORACLES = {
    "way_costs": with_tables(["ways", "stops"], f"""RECURSIVE pr AS (SELECT * FROM (SELECT seq AS pair, lng AS al, lat AS aa, lead(lng) OVER o AS bl, lead(lat) OVER o AS ba FROM stops WINDOW o AS (PARTITION BY trip ORDER BY seq)) WHERE bl IS NOT NULL),
wy AS (SELECT way, sum(coalesce(d, 0)) AS km, arg_min({{x: lng, y: lat}}, seq) AS s, arg_max({{x: lng, y: lat}}, seq) AS t FROM (SELECT *, {hav('lag(lng) OVER o', 'lag(lat) OVER o', 'lng', 'lat')} AS d FROM ways WINDOW o AS (PARTITION BY way ORDER BY seq)) GROUP BY way),
pl AS (SELECT pair, 'a' AS e, al AS lng, aa AS lat FROM pr UNION ALL SELECT pair, 'b', bl, ba FROM pr),
sn AS (SELECT pair, e, arg_min(way, (km, way, seq)) AS way FROM (SELECT p.pair, p.e, w.way, w.seq, {_D} AS km FROM pl p JOIN ways w ON abs(w.lat - p.lat) < 0.05) WHERE km <= {SNAP_KM} GROUP BY 1, 2),
ab AS (SELECT a.pair, a.way AS a, b.way AS b FROM sn a JOIN sn b USING (pair) WHERE a.e = 'a' AND b.e = 'b'),
en AS (SELECT way, km, 0 AS side, s.x AS x, s.y AS y FROM wy UNION ALL SELECT way, km, 1, t.x, t.y FROM wy),
ar AS MATERIALIZED (SELECT DISTINCT 2 * a.way + a.side AS n, 2 * b.way + 1 - b.side AS m, b.km AS w FROM en a JOIN en b ON a.way <> b.way AND abs(a.y - b.y) < {CONNECT_DEG} AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) < {CONNECT_DEG}),
r(a, n, cost) USING KEY (a, n) AS (SELECT DISTINCT a, 2 * a + i, km FROM ab JOIN wy ON wy.way = a, (SELECT 0 AS i UNION ALL SELECT 1)
 UNION SELECT r.a, ar.m, min(r.cost + ar.w) FROM r JOIN ar ON ar.n = r.n LEFT JOIN recurring.r k ON k.a = r.a AND k.n = ar.m WHERE k.cost IS NULL OR r.cost + ar.w < k.cost GROUP BY 1, 2)
SELECT pair, round(min(cost), 4) AS km FROM ab JOIN r ON r.a = ab.a AND r.n // 2 = ab.b GROUP BY pair"""),
    "trace_gaps": with_tables(["ways", "stops"], f"""RECURSIVE nd AS (SELECT node, min(lng) AS lng, min(lat) AS lat FROM ways GROUP BY node), e AS (SELECT node AS a, lead(node) OVER (PARTITION BY way ORDER BY seq) AS b FROM ways),
t AS (SELECT a, b FROM e WHERE b IS NOT NULL UNION SELECT b, a FROM e WHERE b IS NOT NULL), rc(node, seen) AS (SELECT a, a FROM t UNION SELECT t.b, rc.seen FROM rc JOIN t ON t.a = rc.node WHERE rc.seen < t.b), lb AS (SELECT node, min(seen) AS label FROM rc GROUP BY node),
sn AS (SELECT s.trip, s.seq, any_value(s.lng) AS lng, any_value(s.lat) AS lat, arg_min(n.node, (pow(n.lng - s.lng, 2) + pow(n.lat - s.lat, 2), n.node)) AS node FROM stops s JOIN nd n ON abs(n.lat - s.lat) < 0.1 AND abs(n.lng - s.lng) < 0.1 GROUP BY 1, 2 HAVING sqrt(min(pow(n.lng - s.lng, 2) + pow(n.lat - s.lat, 2))) * 111.0 * cos(radians(any_value(s.lat))) <= 3),
lg AS (SELECT * FROM (SELECT trip AS line, row_number() OVER o - 1 AS leg, lag(node) OVER o AS origin, node AS goal, lng, lat FROM sn WINDOW o AS (PARTITION BY trip ORDER BY seq)) WHERE origin IS NOT NULL),
ap AS (SELECT lg.*, a.label FROM lg JOIN lb a ON a.node = origin JOIN lb b ON b.node = goal WHERE a.label <> b.label),
nr AS (SELECT l.line, l.leg, any_value(l.goal) AS goal, arg_min(w.node, ({_G}, w.node)) AS node FROM ap l JOIN lb ON lb.label = l.label JOIN nd w ON w.node = lb.node GROUP BY 1, 2)
SELECT line, CAST(leg AS INT) AS leg, nr.node AS from_node, goal AS to_node, round({hav('a.lng', 'a.lat', 'b.lng', 'b.lat')}, 4) AS km FROM nr JOIN nd a ON a.node = nr.node JOIN nd b ON b.node = goal"""),
}
