"""Queries of stops on their trips' mileage axes."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.operators import trips
from wayfold.plans.tables import derived, hav, rounded, with_tables


def mileage_axes(spark, d):
    """Stops near the points of short lines, out of order here and there, each fifth without a place, on one axis a trip."""
    p, seq = derived(spark, d, "tracks"), F.col("seq")
    known = lambda c: F.when(seq % 5 != 1, c)
    stops = p.select(F.col("line_id").alias("trip"), seq.alias("idx"), (seq * 600 + seq * 7 % 300).alias("at"), known(F.col("lng") + (seq * 3 % 5 - 2) * 0.08).alias("lng"), known(F.col("lat")).alias("lat"))
    return rounded(trips.mileage_axis(stops, p).select("trip", "idx", "axis_m", "off_m", (F.col("weight") * 1e6).alias("weight"), "degradation"), 3)


QUERIES = {"mileage_axes": mileage_axes}

ORACLES = {
    "mileage_axes": with_tables(["tracks"], f"""RECURSIVE s0 AS (SELECT line_id AS trip, seq AS idx, seq * 600 + seq * 7 % 300 AS at, CASE WHEN seq % 5 <> 1 THEN lng + (seq * 3 % 5 - 2) * 0.08 END AS lng, CASE WHEN seq % 5 <> 1 THEN lat END AS lat FROM tracks),
s AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY trip) AS n, count(lng) OVER (PARTITION BY trip) AS placed FROM s0 WINDOW w AS (PARTITION BY trip ORDER BY idx)),
g0 AS (SELECT line_id, seq, lng AS x0, lat AS y0, lead(lng) OVER w AS x1, lead(lat) OVER w AS y1 FROM tracks WINDOW w AS (PARTITION BY line_id ORDER BY seq)), g1 AS (SELECT *, {hav('x0', 'y0', 'x1', 'y1')} AS d FROM g0 WHERE x1 IS NOT NULL),
g AS (SELECT *, sum(d) OVER w - d AS c0, sum(d) OVER (PARTITION BY line_id) AS total FROM g1 WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
pj AS (SELECT s.trip, s.i, s.lng, s.lat, g.*, 111.32 * cos(radians((y0 + y1) / 2)) AS kx FROM s JOIN g ON g.line_id = s.trip WHERE s.lng IS NOT NULL),
pl AS (SELECT *, (x1 - x0) * kx AS bx, (y1 - y0) * 110.574 AS bby, (lng - x0) * kx AS sx, (lat - y0) * 110.574 AS sy FROM pj), tt AS (SELECT *, greatest(0.0, least(1.0, (sx * bx + sy * bby) / (bx * bx + bby * bby))) AS t FROM pl),
nn AS (SELECT *, row_number() OVER (PARTITION BY trip, i ORDER BY sqrt(pow(sx - bx * t, 2) + pow(sy - bby * t, 2)), seq) AS nr FROM tt),
on_ AS (SELECT trip, i, (c0 + d * t) * 1000 AS along, {hav('lng', 'lat', 'x0 + (x1 - x0) * t', 'y0 + (y1 - y0) * t')} * 1000 AS off FROM nn WHERE nr = 1),
r AS (SELECT s.*, coalesce(l.total, 0) * 1000 AS len, CASE WHEN s.i = 1 THEN 0.0 WHEN s.i = n THEN l.total * 1000 ELSE along END AS x, CASE WHEN s.i = 1 OR s.i = n THEN 0.0 ELSE off END AS o FROM s LEFT JOIN on_ USING (trip, i) LEFT JOIN (SELECT line_id AS trip, any_value(total) AS total FROM g GROUP BY 1) l ON l.trip = s.trip),
b AS (SELECT r.*, (SELECT max(i) FROM r p WHERE p.trip = r.trip AND p.i < r.i AND p.x IS NOT NULL) AS pi, (SELECT min(i) FROM r p WHERE p.trip = r.trip AND p.i > r.i AND p.x IS NOT NULL) AS qi FROM r WHERE len > 0 AND placed > 0),
f AS (SELECT b.trip, b.i, b.idx, b.n, b.len, b.o, 1 / (coalesce(b.o, 1000) + 200) AS w, coalesce(b.x, p.x + (q.x - p.x) * CASE WHEN q.at <> p.at THEN (b.at - p.at) / (q.at - p.at) ELSE (b.i - p.i) / (q.i - p.i) END) AS v FROM b LEFT JOIN b p ON p.trip = b.trip AND p.i = b.pi LEFT JOIN b q ON q.trip = b.trip AND q.i = b.qi),
m AS (SELECT a.trip, a.i, z.i AS j, sum(k.v * k.w) / sum(k.w) AS mean FROM f a JOIN f z ON z.trip = a.trip AND z.i >= a.i JOIN f k ON k.trip = a.trip AND k.i BETWEEN a.i AND z.i GROUP BY 1, 2, 3),
lo AS (SELECT f.trip, f.i, m.i AS a, min(mean) AS mean FROM f JOIN m ON m.trip = f.trip AND m.i <= f.i AND m.j >= f.i GROUP BY 1, 2, 3),
iso AS (SELECT trip, i, CASE WHEN i = 1 THEN 0.0 WHEN i = n THEN len ELSE fit END AS v FROM (SELECT trip, i, max(mean) AS fit FROM lo GROUP BY 1, 2) JOIN f USING (trip, i)),
sp(trip, k, v) AS (SELECT trip, 1::BIGINT, list(v ORDER BY i) FROM iso GROUP BY trip UNION ALL
 SELECT trip, k + 1, list_transform(v, lambda x, j: CASE WHEN v[k + 1] - v[k] >= 200 THEN x WHEN j = k + 1 THEN v[k] + 200 WHEN j > k + 1 AND v[-1] - v[k + 1] > 200 - (v[k + 1] - v[k]) THEN v[k] + 200 + (x - v[k + 1]) * (v[-1] - v[k + 1] - (200 - (v[k + 1] - v[k]))) / (v[-1] - v[k + 1]) ELSE x END) FROM sp WHERE k < len(v)),
ax AS (SELECT trip, arg_max(v, k) AS v FROM sp GROUP BY trip), dg AS (SELECT trip, CASE WHEN len(list_filter(range(2, len(v) + 1), lambda j: v[j] - v[j - 1] < -1)) > len(v) * 0.3 THEN 'severe_disorder' ELSE 'none' END AS degradation FROM ax)
SELECT r.trip, r.idx, round(CASE WHEN ax.trip IS NOT NULL THEN ax.v[r.i] ELSE (r.i - 1) / greatest(1, r.n - 1) * r.len END, 3) + 0.0 AS axis_m, round(CASE WHEN ax.trip IS NOT NULL THEN r.o ELSE 0.0 END, 3) AS off_m, round(CASE WHEN ax.trip IS NOT NULL THEN 1 / (coalesce(r.o, 1000) + 200) ELSE 1.0 END * 1e6, 3) AS weight, coalesce(dg.degradation, CASE WHEN r.len > 0 THEN 'all_missing' ELSE 'zero_length' END) AS degradation FROM r LEFT JOIN ax ON ax.trip = r.trip LEFT JOIN dg ON dg.trip = r.trip"""),
}
