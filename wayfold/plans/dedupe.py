"""Queries that settle places told more than once."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.operators import poi
from wayfold.plans.tables import derived, hav, rounded, with_tables


def _spots(spark, d):
    """Points pressed into a square degree, with few names, some of them with an ending for a kind of place, and fields with gaps."""
    i = F.col("id")
    name = F.concat(F.lit("山"), (i % 23).cast("string"), F.when(i % 3 == 0, "景区").when(i % 7 == 0, "风景区").otherwise(""))
    return derived(spark, d, "spots").select(
        "id", F.when(i % 31 == 0, "停车场").otherwise(name).alias("name"), ((i * 37) % 1009).cast("double").alias("rank"), (100 + (F.col("lng") - 80) / 40).alias("lng"), (30 + (F.col("lat") - 20) / 30).alias("lat"),
        F.when(i % 4 == 0, (i % 50) / 10).alias("rating"), F.when(i % 5 == 0, F.concat(F.lit("t"), i.cast("string"))).when(i % 5 == 1, "").alias("tel"),
    )


def same_names(spark, d):
    """Places by the one of their name within 25 km that stands for them."""
    return poi.same_name(_spots(spark, d))


def near_names(spark, d):
    """Places by the one of a like name close by that stands for them."""
    return poi.near_name(_spots(spark, d))


def backfilled(spark, d):
    """The kept places, their empty fields filled from those they stand for."""
    s = _spots(spark, d)
    return rounded(poi.backfill(s, poi.same_name(s), ["rating", "tel"], "rating").select("id", "rating", "tel"), 4)


QUERIES = {f.__name__: f for f in (same_names, near_names, backfilled)}

_SPOTS = """RECURSIVE s AS (SELECT id, CASE WHEN id % 31 = 0 THEN '停车场' ELSE '山' || (id % 23) || CASE WHEN id % 3 = 0 THEN '景区' WHEN id % 7 = 0 THEN '风景区' ELSE '' END END AS name, '山' || (id % 23) AS core,
 CAST((id * 37) % 1009 AS DOUBLE) AS rank, 100 + (lng - 80) / 40 AS lng, 30 + (lat - 20) / 30 AS lat, CASE WHEN id % 4 = 0 THEN (id % 50) / 10 END AS rating, CASE id % 5 WHEN 0 THEN 't' || id WHEN 1 THEN '' END AS tel FROM spots)"""


def _fold(group: str, rows: str, like: str) -> str:
    """SQL that goes through the rows of each group by rank: kp(id, kept_by)."""
    return f"""o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY rank DESC, id) AS nr FROM {rows}),
c AS MATERIALIZED (SELECT b.id, list(a.id ORDER BY a.nr) AS before FROM o a JOIN o b ON a.{group} = b.{group} AND a.nr < b.nr WHERE {like} GROUP BY b.id),
f({group}, nr, kept, id, kept_by) AS (SELECT DISTINCT {group}, 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT FROM o
UNION ALL SELECT {group}, nr, CASE WHEN hit IS NULL THEN list_append(kept, id) ELSE kept END, id, hit FROM (SELECT o.{group}, o.nr, f.kept, o.id, list_filter(c.before, lambda x: list_contains(f.kept, x))[1] AS hit FROM f JOIN o ON o.{group} = f.{group} AND o.nr = f.nr + 1 LEFT JOIN c ON c.id = o.id)),
kp AS (SELECT id, kept_by FROM f WHERE id IS NOT NULL)"""


_KM = hav("a.lng", "a.lat", "b.lng", "b.lat")
_SAME = f"{_SPOTS}, {_fold('name', 's', f'{_KM} <= 25')}"

ORACLES = {
    "same_names": with_tables(["spots"], f"{_SAME} SELECT id, kept_by FROM kp"),
    "near_names": with_tables(["spots"], f"""{_SPOTS}, q AS (SELECT *, 1 AS g FROM s WHERE id % 31 <> 0), {_fold('g', 'q', f'abs(floor(a.lng / 0.02) - floor(b.lng / 0.02)) <= 1 AND abs(floor(a.lat / 0.02) - floor(b.lat / 0.02)) <= 1 AND (({_KM} <= 1.5 AND a.core = b.core) OR ({_KM} <= 0.35 AND (contains(a.core, b.core) OR contains(b.core, a.core))))')} SELECT id, kept_by FROM kp"""),
    "backfilled": with_tables(["spots"], f"""{_SAME}, j AS (SELECT s.*, kept_by, coalesce(kept_by, s.id) AS t, row_number() OVER (PARTITION BY coalesce(kept_by, s.id) ORDER BY kept_by IS NOT NULL, rank DESC, s.id) AS n FROM s JOIN kp USING (id))
SELECT t AS id, round(coalesce(arg_min(rating, n) FILTER (WHERE rating > 0), max(rating) FILTER (WHERE kept_by IS NULL)), 4) AS rating, coalesce(arg_min(tel, n) FILTER (WHERE tel IS NOT NULL AND tel <> ''), max(tel) FILTER (WHERE kept_by IS NULL)) AS tel FROM j GROUP BY t"""),
}
