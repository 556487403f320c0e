"""Inputs of the queries, derived from the driver's tables by the same arithmetic in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: SQL for the derived tables; both engines read the same text where the dialects agree.
SPOTS = """
SELECT c_custkey AS id, c_name AS name, 80.0 + CAST((c_custkey * 7919) % 40000 AS DOUBLE) / 1000.0 AS lng,
       20.0 + CAST((c_custkey * 104729) % 30000 AS DOUBLE) / 1000.0 AS lat, CAST((c_custkey * 37) % 101 AS DOUBLE) AS score,
       CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE concat(lower(c_mktsegment), '.k', CAST(c_custkey % 3 AS VARCHAR(2))) END AS category,
       CASE c_custkey % 5 WHEN 0 THEN 'roadside' WHEN 1 THEN 'detour5' WHEN 2 THEN 'detour20' WHEN 3 THEN 'distant' END AS visibility,
       concat('P', CAST(c_nationkey AS VARCHAR(3))) AS province
FROM customer
"""
POINTS = """
SELECT CAST(0 AS BIGINT) AS line_id, s_suppkey AS seq, 80.0 + CAST((s_suppkey * 6007) % 40000 AS DOUBLE) / 1000.0 AS lng,
       20.0 + CAST((s_suppkey * 3571) % 30000 AS DOUBLE) / 1000.0 AS lat
FROM supplier
"""
LINES = """
SELECT CAST(s_nationkey AS BIGINT) AS line_id, s_suppkey AS seq, 80.0 + CAST((s_suppkey * 6007) % 40000 AS DOUBLE) / 1000.0 AS lng,
       20.0 + CAST((s_suppkey * 3571) % 30000 AS DOUBLE) / 1000.0 AS lat
FROM supplier
"""
PLACES = """
SELECT n_name AS place, CASE n_nationkey % 3 WHEN 0 THEN 'city' WHEN 1 THEN 'county' ELSE 'province' END AS level,
       80.0 + CAST((n_nationkey * 9176) % 40000 AS DOUBLE) / 1000.0 AS lng, 20.0 + CAST((n_nationkey * 5519) % 30000 AS DOUBLE) / 1000.0 AS lat
FROM nation
"""
ROUTES = """
SELECT p_partkey AS id, p_name AS name, CASE p_size % 6 WHEN 0 THEN 'L1' WHEN 1 THEN 'L5' END AS layer,
       CASE p_partkey % 4 WHEN 0 THEN 'national' WHEN 1 THEN 'regional' WHEN 2 THEN 'city' END AS tier, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(p_size % 6 AS BIGINT) END AS days,
       CAST((p_partkey * 271) % 3000 AS DOUBLE) AS total_km, CAST((p_partkey * 17) % 50 AS BIGINT) AS editor_rank, CAST(p_size % 5 + 1 AS BIGINT) AS difficulty,
       CASE WHEN p_partkey % 7 = 0 THEN 'draft' ELSE 'published' END AS status, p_brand AS anchor_city, p_type AS tag, CAST(p_partkey % 9 AS BIGINT) AS poi_count
FROM part
"""
#: Short lines of six points each, so that there are as many lines as the data asks for.
TRACKS = """
SELECT CAST(floor((c_custkey - 1) / 6) AS BIGINT) AS line_id, c_custkey AS seq, 100.0 + CAST((c_custkey * 7919) % 40000 AS DOUBLE) / 100000.0 AS lng,
       30.0 + CAST((c_custkey * 104729) % 30000 AS DOUBLE) / 100000.0 AS lat
FROM customer
"""
#: Ways of three points on small lattices, one lattice a road of forty ways; each ninth way stops short of its last crossing.
WAYS = """
SELECT ref, way, i AS seq, CASE WHEN j = 1 THEN -10 - 2 * way WHEN j = 2 AND off THEN -11 - 2 * way ELSE ref * 100 + (x + CAST(j / 2 AS BIGINT) * (1 - d)) * 10 + y + CAST(j / 2 AS BIGINT) * d END AS node,
       80.0 + CAST((ref * 37) % 3000 AS DOUBLE) / 100.0 + 0.01 * x + 0.005 * j * (1 - d) + CASE WHEN j = 1 THEN 0.0002 * ((way * 13) % 7 - 3) * d WHEN j = 2 AND off THEN -0.002 ELSE 0.0 END AS lng,
       20.0 + CAST((ref * 91) % 2500 AS DOUBLE) / 100.0 + 0.01 * y + 0.005 * j * d + CASE WHEN j = 1 THEN 0.0002 * ((way * 11) % 7 - 3) * (1 - d) WHEN j = 2 AND off THEN 0.001 ELSE 0.0 END AS lat
FROM (SELECT CAST(floor(o_orderkey / 40) AS BIGINT) AS ref, o_orderkey AS way, i, CASE WHEN o_custkey % 3 = 0 THEN 2 - i ELSE i END AS j, CAST(o_custkey % 5 AS BIGINT) AS x, CAST(floor(o_custkey / 5) AS BIGINT) % 5 AS y, o_orderkey % 2 AS d, o_orderkey % 9 = 4 AS off
      FROM orders CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2) AS v) AS o
"""
#: Four stops a trip near crossings of the road with the trip's number; each eleventh lies far off.
STOPS = """
SELECT CAST(floor(c_custkey / 4) AS BIGINT) AS trip, c_custkey AS seq, c_name AS name,
       80.0 + CAST((CAST(floor(c_custkey / 4) AS BIGINT) * 37) % 3000 AS DOUBLE) / 100.0 + 0.01 * ((c_custkey * 7) % 5) + CASE WHEN c_custkey % 11 = 0 THEN 0.213 ELSE 0.0003 * (c_custkey % 5) END AS lng,
       20.0 + CAST((CAST(floor(c_custkey / 4) AS BIGINT) * 91) % 2500 AS DOUBLE) / 100.0 + 0.01 * ((c_custkey * 3) % 5) + 0.0002 AS lat
FROM customer
"""
#: Short corridors, six to a square degree, their stations by name, and trips that call near each of the six.
RAILS = """
SELECT c AS corridor, j AS seq, CAST(75 + g % 40 AS DOUBLE) + 0.1 * k + j * (0.03 + 0.005 * ((c * 7) % 4)) AS lng, CAST(5 + floor(g / 40) AS DOUBLE) + 0.1 * ((k * 5) % 3) + j * (0.0075 * ((c * 3) % 5) - 0.015) AS lat
FROM (SELECT c_custkey AS c, c_custkey % 6 AS k, CAST(floor(c_custkey / 6) AS BIGINT) AS g, j FROM customer CROSS JOIN (SELECT 0 AS j UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) AS v) AS r
"""
STATIONS = """
SELECT c AS corridor, pos, concat(CASE WHEN pos = 2 THEN 'M' ELSE 'H' END, CAST(g AS VARCHAR(9)), '-', CAST(CASE pos WHEN 0 THEN k WHEN 2 THEN (c * 7) % 5 ELSE k + 1 + c % 3 END AS VARCHAR(9))) AS name
FROM (SELECT c_custkey AS c, c_custkey % 6 AS k, CAST(floor(c_custkey / 6) AS BIGINT) AS g, pos FROM customer CROSS JOIN (SELECT 0 AS pos UNION ALL SELECT 2 UNION ALL SELECT 4) AS v) AS r
"""
CALLS = """
SELECT g AS trip, CAST(k AS INT) AS idx, CASE WHEN c % 2 = 0 THEN concat('H', CAST(g AS VARCHAR(9)), '-', CAST(k AS VARCHAR(9))) ELSE concat('S', CAST(c AS VARCHAR(9))) END AS name,
       CAST(75 + g % 40 AS DOUBLE) + 0.1 * k + 0.03 + 0.005 * ((c * 7) % 4) + 0.002 AS lng, CAST(5 + floor(g / 40) AS DOUBLE) + 0.1 * ((k * 5) % 3) + 0.0075 * ((c * 3) % 5) - 0.015 + 0.003 AS lat
FROM (SELECT c_custkey AS c, c_custkey % 6 AS k, CAST(floor(c_custkey / 6) AS BIGINT) AS g FROM customer) AS r
"""
#: Six-cornered regions of seven sizes, every third with a square hole, every fourth with a second, detached part.
CORNERS = """
SELECT s AS region, poly, ring, seq, x + r * dx + CASE WHEN poly = 1 THEN 3.0 ELSE 0.0 END AS lng, y + r * dy AS lat
FROM (SELECT s_suppkey AS s, 80.0 + CAST((s_suppkey * 6007) % 40000 AS DOUBLE) / 1000.0 AS x, 20.0 + CAST((s_suppkey * 3571) % 30000 AS DOUBLE) / 1000.0 AS y, 0.5 + 0.4 * CAST(s_suppkey % 7 AS DOUBLE) AS r FROM supplier) AS o
CROSS JOIN (SELECT 0 AS poly, 0 AS ring, 0 AS seq, 1.0 AS dx, 0.0 AS dy UNION ALL SELECT 0, 0, 1, 0.5, 0.87 UNION ALL SELECT 0, 0, 2, -0.5, 0.87 UNION ALL SELECT 0, 0, 3, -1.0, 0.0 UNION ALL SELECT 0, 0, 4, -0.5, -0.87 UNION ALL SELECT 0, 0, 5, 0.5, -0.87
 UNION ALL SELECT 0, 1, 0, 0.3, 0.3 UNION ALL SELECT 0, 1, 1, -0.3, 0.3 UNION ALL SELECT 0, 1, 2, -0.3, -0.3 UNION ALL SELECT 0, 1, 3, 0.3, -0.3 UNION ALL SELECT 1, 0, 0, 0.2, 0.1 UNION ALL SELECT 1, 0, 1, -0.2, 0.3 UNION ALL SELECT 1, 0, 2, 0.0, -0.4) AS v
WHERE ring = 0 AND poly = 0 OR ring = 1 AND s % 3 = 0 OR poly = 1 AND s % 4 = 0
"""
SQL_NAMES = {"spots": SPOTS, "points": POINTS, "lines": LINES, "places": PLACES, "routes": ROUTES, "tracks": TRACKS, "ways": WAYS, "stops": STOPS, "rails": RAILS, "stations": STATIONS, "calls": CALLS, "corners": CORNERS}
SOURCES = {"spots": "customer", "points": "supplier", "lines": "supplier", "places": "nation", "routes": "part", "tracks": "customer", "ways": "orders", "stops": "customer", "rails": "customer", "stations": "customer", "calls": "customer", "corners": "supplier"}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Return a derived table; its source is scanned with only the columns in use."""
    source = SOURCES[name]
    sql = SQL_NAMES[name].replace(f"FROM {source}", "FROM {src}")
    return spark.sql(sql, src=table(spark, sf_dir, source))


def with_tables(names: list[str], sql: str) -> str:
    """Put the derived tables in front of a SQL query as common table expressions."""
    ctes = ",\n".join(f"{n} AS ({SQL_NAMES[n]})" for n in names)
    if sql.lstrip().startswith("RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {sql.lstrip().removeprefix('RECURSIVE ')}"
    return f"WITH {ctes}{', ' if not sql.lstrip().startswith('SELECT') else ' '}{sql}"


#: SQL for the least cost from every fiftieth node over edges e (lo, hi, w): r (origin, node, cost), one row per pair, replaced as it gets cheaper.
COSTS = """b AS (SELECT lo AS a, hi AS c, w FROM e UNION ALL SELECT hi, lo, w FROM e), r(origin, node, cost) USING KEY (origin, node) AS (SELECT DISTINCT a, a, 0.0::DOUBLE FROM b WHERE a % 50 = 0
UNION SELECT r.origin, b.c, min(r.cost + b.w) FROM r JOIN b ON b.a = r.node LEFT JOIN recurring.r k ON k.origin = r.origin AND k.node = b.c WHERE k.cost IS NULL OR r.cost + b.w < k.cost GROUP BY 1, 2)"""


def hav(lng1: str, lat1: str, lng2: str, lat2: str) -> str:
    """SQL for the great-circle distance in km."""
    return (
        f"(2 * 6371.0 * asin(sqrt(pow(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians(({lng2}) - ({lng1})) / 2), 2))))"
    )


def bear(lng1: str, lat1: str, lng2: str, lat2: str) -> str:
    """SQL for the initial bearing."""
    d = f"radians(({lng2}) - ({lng1}))"
    y = f"sin({d}) * cos(radians({lat2}))"
    x = f"cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) * cos(radians({lat2})) * cos({d})"
    return f"fmod(degrees(atan2({y}, {x})) + 360, 360)"


def epoch_ms(ts: str) -> Column:
    """Milliseconds since 1970 of a timestamp without time zone."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})")


def floored(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round all double columns half up by `floor`, for values that are the same to the last bit in both engines but end in a five."""
    k = 10.0**digits
    return df.select(*[(F.floor(F.col(c) * k + 0.5) / k).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    """Round all double columns, so that the last bits of two engines' functions do not count."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
