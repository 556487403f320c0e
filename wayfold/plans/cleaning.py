"""Queries that clean lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.operators import cleaning
from wayfold.plans.tables import derived, hav, rounded, with_tables


def scrubbed(spark, d):
    """Trips without the places of the stops that make them a zigzag."""
    s = derived(spark, d, "lines").withColumnRenamed("line_id", "trip")
    return rounded(cleaning.scrub_zigzags(s), 6)


def _narrow(spark, d):
    """Short lines pressed together from east to west, so that they turn sharply and come back."""
    return derived(spark, d, "tracks").withColumn("lng", 100.0 + (F.col("lng") - 100.0) / 4)


def spaced_out(spark, d):
    """Points of short lines at least 17 km from the last one kept."""
    return cleaning.spaced(_narrow(spark, d), 17.0).select("line_id", "seq")


def despiked(spark, d):
    """Points of short lines without spikes."""
    return cleaning.without_spikes(_narrow(spark, d)).select("line_id", "seq")


def unrevisited(spark, d):
    """Points of short lines that do not come back within 8 km of a kept point after 25 km."""
    return rounded(cleaning.without_revisits(_narrow(spark, d), 25.0, 8.0).select("line_id", "seq", "cum_km"), 6)


def unprotruded(spark, d):
    """Points of short lines that do not stand far out to the side."""
    return cleaning.without_protrusions(derived(spark, d, "tracks")).select("line_id", "seq")


def _there_and_back(spark, d):
    """Short lines with their points once more from the last but one back to the first, and a last point beyond."""
    p = derived(spark, d, "tracks")
    n = F.col("line_id") * 6
    back = p.select("line_id", (n * 2 + 20 - F.col("seq")).alias("seq"), "lng", "lat")
    on = p.where("seq % 6 = 1").select("line_id", (n + 60).alias("seq"), (F.col("lng") + 1).alias("lng"), "lat")
    return p.unionByName(back).unionByName(on)


def unlooped(spark, d):
    """Lines that go out and back the same way, with that trimmed."""
    return cleaning.without_loops(_there_and_back(spark, d)).select("line_id", "seq")


def unretraced(spark, d):
    """Lines that go out and back, without what goes back from a sharp turn to a jump."""
    return cleaning.without_retraces(_there_and_back(spark, d)).select("line_id", "seq")


QUERIES = {f.__name__: f for f in (scrubbed, spaced_out, despiked, unrevisited, unprotruded, unlooped, unretraced)}

_BAD = "direct > 40 AND via > direct * 1.75 AND via - direct > 50"
_TRACK = "RECURSIVE p AS (SELECT line_id, seq, 100.0::DOUBLE + (lng - 100.0) / 4 AS lng, lat, row_number() OVER (PARTITION BY line_id ORDER BY seq) AS i, count(*) OVER (PARTITION BY line_id) AS n FROM tracks)"
_TURN = "CASE WHEN ab < 0.25 OR bc < 0.25 THEN 0 ELSE 180 - abs(180 - abs(degrees(atan2(y - b.y, x - b.x) - atan2(b.y - a.y, b.x - a.x)))) END"

ORACLES = {
    "scrubbed": with_tables(["lines"], f"""RECURSIVE t AS (SELECT line_id AS trip, seq, lng, lat, row_number() OVER w AS i, lng BETWEEN 73.5 AND 134.77 AND lat BETWEEN 17.5 AND 53.56 AS ok, lag(lng) OVER w AS ax, lag(lat) OVER w AS ay, lead(lng) OVER w AS cx, lead(lat) OVER w AS cy FROM lines WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
k AS (SELECT *, {hav('ax', 'ay', 'cx', 'cy')} AS direct, {hav('ax', 'ay', 'lng', 'lat')} + {hav('lng', 'lat', 'cx', 'cy')} AS via FROM t), j AS (SELECT *, coalesce({_BAD}, false) AND ok AND coalesce(lag(ok) OVER (PARTITION BY trip ORDER BY i), false) AND coalesce(lead(ok) OVER (PARTITION BY trip ORDER BY i), false) AS bad FROM k),
g(trip, i, gone) AS (SELECT trip, i, bad FROM j WHERE i = 1 UNION ALL SELECT j.trip, j.i, j.bad AND NOT g.gone FROM g JOIN j ON j.trip = g.trip AND j.i = g.i + 1)
SELECT trip, seq, CASE WHEN NOT gone THEN round(lng, 6) END AS lng, CASE WHEN NOT gone THEN round(lat, 6) END AS lat FROM j JOIN g USING (trip, i)"""),
    "spaced_out": with_tables(["tracks"], f"""{_TRACK}, r(line_id, i, x, y, kept) AS (SELECT line_id, i, lng, lat, true FROM p WHERE i = 1
UNION ALL SELECT line_id, i, CASE WHEN far THEN lng ELSE x END, CASE WHEN far THEN lat ELSE y END, far FROM (SELECT p.line_id, p.i, p.lng, p.lat, r.x, r.y, {hav('r.x', 'r.y', 'p.lng', 'p.lat')} >= 17 AS far FROM r JOIN p ON p.line_id = r.line_id AND p.i = r.i + 1))
SELECT line_id, seq FROM p JOIN r USING (line_id, i) WHERE kept OR (i = n AND greatest(abs(x - lng), abs(y - lat)) > 0.0001)"""),
    "despiked": with_tables(["tracks"], f"""{_TRACK}, r(line_id, k, st) AS (SELECT line_id, 2::BIGINT, [{{seq: seq, x: lng, y: lat}}] FROM p WHERE i = 1
UNION ALL SELECT line_id, CASE WHEN spike THEN k ELSE k + 1 END, CASE WHEN spike THEN st[1:len(st) - 1] ELSE list_append(st, {{seq: seq, x: x, y: y}}) END FROM (SELECT line_id, k, st, seq, x, y, coalesce(ab >= 0.08 AND bc >= 0.08 AND ac < greatest(ab, bc) * 1.08 AND {_TURN} >= 145, false) AS spike
 FROM (SELECT r.line_id, r.k, r.st, p.seq, p.lng AS x, p.lat AS y, r.st[-2] AS a, r.st[-1] AS b, {hav('r.st[-2].x', 'r.st[-2].y', 'r.st[-1].x', 'r.st[-1].y')} AS ab, {hav('r.st[-1].x', 'r.st[-1].y', 'p.lng', 'p.lat')} AS bc, {hav('r.st[-2].x', 'r.st[-2].y', 'p.lng', 'p.lat')} AS ac FROM r JOIN p ON p.line_id = r.line_id AND p.i = r.k)))
SELECT line_id, unnest(st).seq AS seq FROM (SELECT line_id, arg_max(st, k) AS st FROM r GROUP BY line_id)"""),
    "unrevisited": with_tables(["tracks"], f"""{_TRACK}, c AS (SELECT *, sum(coalesce(d, 0)) OVER (PARTITION BY line_id ORDER BY i) AS cum FROM (SELECT *, {hav('lag(lng) OVER w', 'lag(lat) OVER w', 'lng', 'lat')} AS d FROM p WINDOW w AS (PARTITION BY line_id ORDER BY i))),
m AS (SELECT b.line_id, b.i, list(a.i) AS met FROM c a JOIN c b ON a.line_id = b.line_id AND b.cum - a.cum >= 25 AND a.i < a.n AND b.i < b.n WHERE {hav('a.lng', 'a.lat', 'b.lng', 'b.lat')} < 8 GROUP BY 1, 2),
r(line_id, i, kept) AS (SELECT line_id, 1::BIGINT, [1::BIGINT] FROM c WHERE i = 1 UNION ALL SELECT r.line_id, r.i + 1, CASE WHEN m.met IS NOT NULL AND len(list_intersect(m.met, r.kept)) > 0 THEN r.kept ELSE list_append(r.kept, r.i + 1) END FROM r JOIN c ON c.line_id = r.line_id AND c.i = r.i + 1 LEFT JOIN m ON m.line_id = r.line_id AND m.i = r.i + 1)
SELECT c.line_id, seq, round(cum, 6) + 0.0 AS cum_km FROM c JOIN (SELECT line_id, arg_max(kept, i) AS kept FROM r GROUP BY 1) k ON k.line_id = c.line_id AND list_contains(kept, c.i)"""),
}
