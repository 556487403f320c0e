"""Queries over routes and points of interest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import lines, spatial
from wayfold.plans.tables import bear, derived, hav, rounded, with_tables

SEGMENTS = f"""
o AS (SELECT *, {hav('lag(lng) OVER w', 'lag(lat) OVER w', 'lng', 'lat')} AS step, row_number() OVER w AS seg FROM {{points}} WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
cum AS (SELECT *, sum(coalesce(step, 0)) OVER (PARTITION BY line_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS cum_km FROM o),
nx AS (SELECT line_id, seg, lng AS a_lng, lat AS a_lat, cum_km AS cum_a, lead(lng) OVER w AS b_lng, lead(lat) OVER w AS b_lat, lead(cum_km) OVER w AS cum_b FROM cum WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
segs AS (SELECT *, seg = max(seg) OVER (PARTITION BY line_id) AS last FROM nx WHERE b_lng IS NOT NULL)"""

NEAREST = f"""
pr AS (SELECT s.*, g.*, 111.32 * cos(radians((a_lat + b_lat) / 2)) AS kx FROM spots s CROSS JOIN segs g WHERE s.score >= 35),
pl AS (SELECT *, (b_lng - a_lng) * kx AS bx, (b_lat - a_lat) * 110.574 AS bby, (lng - a_lng) * kx AS sx, (lat - a_lat) * 110.574 AS sy FROM pr),
rw AS (SELECT *, (sx * bx + sy * bby) / (bx * bx + bby * bby) AS raw FROM pl WHERE bx * bx + bby * bby > 0),
tt AS (SELECT *, greatest(0.0, least(1.0, raw)) AS t FROM rw),
pp AS (SELECT *, sqrt(pow(sx - bx * t, 2) + pow(sy - bby * t, 2)) AS perp FROM tt),
nn AS (SELECT *, row_number() OVER (PARTITION BY line_id, id ORDER BY perp, seg) AS nr FROM pp),
hit AS (SELECT line_id, id, name, lng, lat, score, coalesce(category, 'other') AS category, visibility, floor((cum_a + (cum_b - cum_a) * t) * 100 + 0.5) / 100 AS along_km,
  floor({hav('lng', 'lat', 'a_lng + (b_lng - a_lng) * t', 'a_lat + (b_lat - a_lat) * t')} * 1000 + 0.5) / 1000 AS dist_km,
  bx * (sy - bby * raw) - bby * (sx - bx * raw) AS cr, (seg = 1 OR last) AS e, abs(raw - t) * sqrt(bx * bx + bby * bby) AS over FROM nn WHERE nr = 1),
al AS (SELECT *, floor(dist_km * 100 + 0.5) / 100 AS d2, e AND over > 1 AS outside, CASE WHEN e THEN floor(over * 100 + 0.5) / 100 ELSE 0 END AS extra FROM hit
  WHERE dist_km <= CASE visibility WHEN 'roadside' THEN 0.3 WHEN 'detour5' THEN 3.0 WHEN 'distant' THEN 35.0 ELSE 12.0 END),
alo AS (SELECT line_id, id, score, category, along_km, dist_km,
  CASE WHEN outside THEN 'unknown' WHEN d2 <= 0.08 THEN 'both' WHEN cr > 0 THEN 'left' ELSE 'right' END AS side,
  CASE WHEN outside THEN 'low' WHEN d2 <= 0.08 THEN 'high' WHEN d2 <= 1 THEN CASE WHEN extra > 0 THEN 'mid' ELSE 'high' END WHEN d2 <= 8 THEN 'mid' ELSE 'low' END AS side_confidence,
  CASE WHEN dist_km <= 0.15 THEN 0.0 ELSE greatest(0.5, floor((dist_km * 2 - 0.3) / 0.5) * 0.5) END AS detour_km,
  CASE WHEN dist_km <= 1 THEN 'pass' WHEN dist_km <= 12 THEN 'detour' ELSE 'spur' END AS detour_class FROM al)"""

COLUMNS = ["line_id", "id", "score", "category", "along_km", "dist_km", "side", "side_confidence", "detour_km", "detour_class"]


def along_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = spatial.along_route(derived(spark, sf_dir, "spots"), derived(spark, sf_dir, "points"))
    return hits.select(COLUMNS)


def along_route_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = derived(spark, sf_dir, "points")
    hits = spatial.along_route(derived(spark, sf_dir, "spots"), points)
    return spatial.spread_along(hits, lines.line_stats(points), 60).select("line_id", "id", "along_km", "score")


def along_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = spatial.along_route(derived(spark, sf_dir, "spots"), derived(spark, sf_dir, "points"), categories=["building", "other"], include_spur=False)
    return hits.select("id", "category", "along_km", "detour_class")


def line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lines.line_stats(derived(spark, sf_dir, "lines"), 35.0), 4)


def cum_km(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lines.with_cum_km(derived(spark, sf_dir, "lines")), 4)


def line_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lines.gaps(derived(spark, sf_dir, "lines"), 1500.0).select("line_id", "seg", "gap_km"), 4)


def sharp_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lines.sharp_turns(derived(spark, sf_dir, "lines")).select("line_id", "seq", "turn_deg"), 4)


def thin_evenly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.thin_evenly(derived(spark, sf_dir, "points"), 20).select("line_id", "seq")


def densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lines.densify(derived(spark, sf_dir, "lines"), 500.0, 100.0), 7)


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lines.anchors_every(derived(spark, sf_dir, "lines"), 250.0), 4)


def spot_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.near_vertices(derived(spark, sf_dir, "spots"), derived(spark, sf_dir, "lines").hint("merge"), 40.0), 4)


def nearest_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = spatial.nearest_place(derived(spark, sf_dir, "spots"), derived(spark, sf_dir, "places"), 400.0)
    return rounded(named.select("id", "place", "place_km"), 4)


def province_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.clusters(derived(spark, sf_dir, "spots"), "province")


def datum_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = derived(spark, sf_dir, "spots")
    g_lng, g_lat = geo.wgs84_to_gcj02(F.col("lng"), F.col("lat"))
    s = s.withColumns({"g_lng": g_lng, "g_lat": g_lat})
    w_lng, w_lat = geo.gcj02_to_wgs84(F.col("g_lng"), F.col("g_lat"))
    shift = geo.haversine_km(F.col("lng"), F.col("lat"), F.col("g_lng"), F.col("g_lat"))
    back = geo.haversine_km(F.col("lng"), F.col("lat"), w_lng, w_lat)
    return s.select("id", (shift.between(0.005, 2.0)).alias("shifted"), (back < 0.001).alias("comes_back"))


def in_land(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = derived(spark, sf_dir, "spots")
    return s.groupBy(geo.in_box(F.col("lng"), F.col("lat"), (90.0, 25.0, 110.0, 45.0)).alias("inside")).agg(F.count("*").alias("n"))


def travel_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lines.segments(derived(spark, sf_dir, "lines"))
    tangent = geo.bearing_deg(F.col("a_lng"), F.col("a_lat"), F.col("b_lng"), F.col("b_lat"))
    heading = F.when(F.col("seg") % 4 == 0, F.lit(None)).otherwise((F.col("seg") * 77 % 360).cast("double"))
    d = geo.direction(heading, tangent)
    side = geo.flip_side(F.when(F.col("seg") % 2 == 0, "left").otherwise("right"), d == "backward")
    return s.select("line_id", "seg", d.alias("direction"), side.alias("side"))


def province_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = F.array(*[F.struct(F.lit(x).alias("lng"), F.lit(y).alias("lat")) for x, y in RING])
    s = derived(spark, sf_dir, "spots")
    return s.where(spatial.inside_polygon(F.col("lng"), F.col("lat"), ring)).select("id")


RING = [(85.0, 25.0), (105.0, 24.0), (100.0, 35.0), (112.0, 44.0), (88.0, 41.0), (95.0, 33.0)]
_EDGES = ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in zip(RING, [RING[-1], *RING[:-1]], strict=True))
_ALONG = SEGMENTS.format(points="points") + "," + NEAREST
_LSEGS = SEGMENTS.format(points="lines")
_PAD = "35.0 / (111.32 * greatest(0.2, cos(radians((min(lat) + max(lat)) / 2))))"
_TURN = f"abs({bear('lng', 'lat', 'nlng', 'nlat')} - {bear('plng', 'plat', 'lng', 'lat')})"
_TANGENT = bear("a_lng", "a_lat", "b_lng", "b_lat")

QUERIES = {
    "along_route": along_route, "along_route_spread": along_route_spread, "along_category": along_category, "line_stats": line_stats, "cum_km": cum_km, "line_gaps": line_gaps,
    "sharp_turns": sharp_turns, "thin_evenly": thin_evenly, "densify": densify, "line_anchors": anchors, "spot_lines": spot_lines, "nearest_place": nearest_place,
    "province_clusters": province_clusters, "datum_shift": datum_shift, "in_land": in_land, "travel_direction": travel_direction, "province_polygon": province_polygon,
}

ORACLES = {
    "along_route": with_tables(["spots", "points"], f"{_ALONG} SELECT {', '.join(COLUMNS)} FROM alo"),
    "along_route_spread": with_tables(["spots", "points"], f"""{_ALONG}, len AS (SELECT line_id, max(cum_km) AS km FROM cum GROUP BY 1),
b AS (SELECT a.*, floor(along_km / greatest(30.0, km / 24)) AS w FROM alo a JOIN len USING (line_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY line_id, w ORDER BY along_km, score DESC, id) AS nr FROM b),
t AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY nr, w) AS turn FROM r) SELECT line_id, id, along_km, score FROM t WHERE turn <= 60"""),
    "along_category": with_tables(["spots", "points"], f"{_ALONG} SELECT id, category, along_km, detour_class FROM alo WHERE detour_class <> 'spur' AND (category = 'other' OR category = 'building' OR category LIKE 'building.%' OR category LIKE 'other.%')"),
    "line_stats": with_tables(["lines"], f"""{_LSEGS}, b AS (SELECT line_id, count(*) AS n_points, max(cum_km) AS length_km, min(lng) - {_PAD} AS min_lng, max(lng) + {_PAD} AS max_lng, min(lat) - 35.0 / 111.32 AS min_lat, max(lat) + 35.0 / 111.32 AS max_lat FROM cum GROUP BY line_id)
SELECT line_id, n_points, round(length_km, 4) AS length_km, round(min_lng, 4) AS min_lng, round(max_lng, 4) AS max_lng, round(min_lat, 4) AS min_lat, round(max_lat, 4) AS max_lat FROM b"""),
    "cum_km": with_tables(["lines"], f"{_LSEGS} SELECT line_id, seq, round(lng, 4) AS lng, round(lat, 4) AS lat, round(cum_km, 4) AS cum_km FROM cum"),
    "line_gaps": with_tables(["lines"], f"{_LSEGS} SELECT line_id, CAST(seg AS INTEGER) AS seg, round(cum_b - cum_a, 4) AS gap_km FROM segs WHERE cum_b - cum_a > 1500"),
    "sharp_turns": with_tables(["lines"], f"""p AS (SELECT *, lag(lng) OVER w AS plng, lag(lat) OVER w AS plat, lead(lng) OVER w AS nlng, lead(lat) OVER w AS nlat FROM lines WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
t AS (SELECT line_id, seq, CASE WHEN {_TURN} > 180 THEN 360 - {_TURN} ELSE {_TURN} END AS turn_deg FROM p) SELECT line_id, seq, round(turn_deg, 4) AS turn_deg FROM t WHERE turn_deg >= 150"""),
    "thin_evenly": with_tables(["points"], """n AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY seq) - 1 AS pos FROM points),
k AS (SELECT DISTINCT CAST(floor(i * ((SELECT max(n) FROM n) - 1) / 19.0 + 0.5) AS BIGINT) AS pick FROM range(20) r(i)) SELECT line_id, seq FROM n WHERE n <= 20 OR pos IN (SELECT pick FROM k)"""),
    "densify": with_tables(["lines"], f"""{_LSEGS}, q AS (SELECT *, CASE WHEN cum_b - cum_a > 500 THEN CAST(ceil((cum_b - cum_a) / 100.0) AS INTEGER) ELSE 1 END AS parts FROM segs),
k AS (SELECT *, unnest(range(0, parts + CASE WHEN last THEN 1 ELSE 0 END)) AS k FROM q)
SELECT line_id, round(seg + k / parts, 7) AS seq, round(a_lng + (b_lng - a_lng) * (k / parts), 7) AS lng, round(a_lat + (b_lat - a_lat) * (k / parts), 7) AS lat FROM k"""),
    "line_anchors": with_tables(["lines"], f"""{_LSEGS}, z AS (SELECT line_id, max(cum_b) AS total FROM segs GROUP BY 1), k AS (SELECT line_id, total, unnest(range(0, CAST(floor(total / 250.0) AS INTEGER) + 1)) * 250.0 AS km FROM z),
j AS (SELECT k.line_id, km, s.*, CASE WHEN cum_b > cum_a THEN (km - cum_a) / (cum_b - cum_a) ELSE 0 END AS t FROM k JOIN segs s ON k.line_id = s.line_id AND km >= cum_a AND (km < cum_b OR (last AND km <= cum_b)))
SELECT line_id, km, round(a_lng + (b_lng - a_lng) * t, 4) AS lng, round(a_lat + (b_lat - a_lat) * t, 4) AS lat, round({_TANGENT}, 4) AS heading FROM j"""),
    "spot_lines": with_tables(["spots", "lines"], f"SELECT s.id, l.line_id, round(min({hav('s.lng', 's.lat', 'l.lng', 'l.lat')}), 4) AS dist_km FROM spots s CROSS JOIN lines l GROUP BY 1, 2 HAVING min({hav('s.lng', 's.lat', 'l.lng', 'l.lat')}) <= 40"),
    "nearest_place": with_tables(["spots", "places"], f"""d AS (SELECT s.id, p.level, p.place, {hav('s.lng', 's.lat', 'p.lng', 'p.lat')} AS km FROM spots s CROSS JOIN places p WHERE p.level <> 'province'),
r AS (SELECT *, row_number() OVER (PARTITION BY id, level ORDER BY km, place) AS nr FROM d WHERE km <= 400),
c AS (SELECT s.id, a.place AS ap, a.km AS ak, b.place AS bp, b.km AS bk FROM spots s LEFT JOIN r a ON a.id = s.id AND a.nr = 1 AND a.level = 'city' LEFT JOIN r b ON b.id = s.id AND b.nr = 1 AND b.level = 'county')
SELECT id, CASE WHEN bp IS NOT NULL AND (ap IS NULL OR bk * 2 < ak) THEN bp ELSE ap END AS place, round(CASE WHEN bp IS NOT NULL AND (ap IS NULL OR bk * 2 < ak) THEN bk ELSE ak END, 4) AS place_km FROM c"""),
    "province_clusters": with_tables(["spots"], "SELECT province, count(*) AS n, round(avg(lng), 4) AS lng, round(avg(lat), 4) AS lat FROM spots GROUP BY province"),
    "datum_shift": with_tables(["spots"], "SELECT id, TRUE AS shifted, TRUE AS comes_back FROM spots"),
    "in_land": with_tables(["spots"], "SELECT lng BETWEEN 90 AND 110 AND lat BETWEEN 25 AND 45 AS inside, count(*) AS n FROM spots GROUP BY 1"),
    "travel_direction": with_tables(["lines"], f"""{_LSEGS}, h AS (SELECT *, CASE WHEN seg % 4 = 0 THEN NULL ELSE CAST(seg * 77 % 360 AS DOUBLE) END AS heading, {_TANGENT} AS tangent FROM segs),
d AS (SELECT *, fmod(fmod(heading - tangent, 360) + 360, 360) AS diff FROM h),
e AS (SELECT *, CASE WHEN heading IS NULL THEN 'unknown' WHEN CASE WHEN diff > 180 THEN 360 - diff ELSE diff END < 90 THEN 'forward' ELSE 'backward' END AS direction FROM d)
SELECT line_id, CAST(seg AS INTEGER) AS seg, direction, CASE WHEN (seg % 2 = 0) = (direction = 'backward') THEN 'right' ELSE 'left' END AS side FROM e"""),
    "province_polygon": with_tables(["spots"], f"""e(ax, ay, bx, bby) AS (VALUES {_EDGES}) SELECT id FROM spots JOIN e ON (ay > lat) <> (bby > lat) AND lng < (bx - ax) * (lat - ay) / (bby - ay) + ax GROUP BY id HAVING count(*) % 2 = 1"""),
}
