"""Queries over the route catalogue, numbers and names, merges and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.functions import names
from wayfold.operators import catalogue as cat
from wayfold.plans.tables import derived, table, with_tables


def _routes(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, d, "routes")


def _layered(spark: SparkSession, d: str) -> DataFrame:
    return _routes(spark, d).withColumn("layer", cat.resolve_layer(F.col("layer"), F.col("tier"), F.col("days")))


def route_search(spark, d):
    return _routes(spark, d).where(cat.matches(keyword="SMALL")).select("id", "name", "status")


def route_filter(spark, d):
    return _routes(spark, d).where(cat.matches(layer="L4", most_days=4, most_km=2000, most_difficulty=4)).select("id")


def route_layers(spark, d):
    return _layered(spark, d).select("id", "layer")


def route_recommended(spark, d):
    return cat.recommended(_layered(spark, d).where("status = 'published'")).select("id", "layer", "place")


def route_page(spark, d):
    return cat.page(_routes(spark, d).where("status = 'published'").select("id", "total_km"), [F.col("total_km").desc(), F.col("id")], 20, 30)


def route_facets(spark, d):
    return cat.facet_counts(_layered(spark, d), ["layer", "tier", "anchor_city", "tag"])


def route_layer_counts(spark, d):
    return cat.counts_by_layer(_layered(spark, d).where("layer <> 'L5'"))


def corpus_overview(spark, d):
    p = F.col("status") == "published"
    r = _routes(spark, d)
    return r.agg(F.count("*").alias("routes"), F.count_if(p).alias("published"), F.sum("poi_count").alias("pois"), F.floor(F.sum(F.when(p, F.col("total_km"))) * 10 + 0.5).cast("long").alias("km_tenths"))


def _refs(spark, d):
    letter = F.element_at(F.array(*[F.lit(x) for x in "GSXYCGQ"]), (F.col("l_suppkey") % 7 + 1).cast("int"))
    number = F.when(F.col("l_linenumber") % 2 == 0, F.lpad((F.col("l_partkey") % 1200).cast("string"), 4, "0")).otherwise((F.col("l_partkey") % 1200).cast("string"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(letter, number).alias("ref"), F.col("l_suppkey").alias("supp"), "l_quantity", "l_returnflag")


def ref_classes(spark, d):
    r = _refs(spark, d)
    return r.groupBy(F.coalesce(names.road_class(F.col("ref")), F.lit("none")).alias("class")).agg(F.count("*").alias("n"), F.countDistinct("ref").alias("refs"))


def ref_canonical(spark, d):
    return _refs(spark, d).groupBy(names.canonical_ref(F.col("ref")).alias("ref")).agg(F.count("*").alias("n"))


def ref_keys(spark, d):
    key = names.road_key(F.col("ref"), F.concat(F.lit("p"), (F.col("supp") % 5).cast("string")), F.when(F.col("supp") % 3 == 0, F.concat(F.lit("c"), (F.col("supp") % 4).cast("string"))))
    return _refs(spark, d).withColumn("key", key).where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"))


def ref_lists(spark, d):
    raw = F.concat_ws("; ", F.array_sort(F.collect_list(F.struct("l_linenumber", "ref")))["ref"])
    return _refs(spark, d).groupBy("l_orderkey").agg(raw.alias("raw")).select("l_orderkey", F.array_join(names.normalize_refs(F.col("raw")), ",").alias("refs"))


def road_register(spark, d):
    """Length, ways and most frequent name per road number: a register derived from ways."""
    ways = _refs(spark, d).select(names.canonical_ref(F.col("ref")).alias("ref"), "l_quantity", F.col("l_returnflag").alias("name"))
    sums = ways.groupBy("ref").agg(F.round(F.sum("l_quantity"), 2).alias("km"), F.count("*").alias("ways"))
    return sums.join(cat.mode_of_name(ways, "ref", "name").select("ref", "name"), "ref", "left")


def census(spark, d):
    """Ways by class per supplier group and in all: two grains in one pass."""
    r = _refs(spark, d).select((F.col("supp") % 10).cast("long").alias("grp"), F.coalesce(names.road_class(F.col("ref")), F.lit("none")).alias("class"), "ref")
    return r.rollup("grp").agg(F.count("*").alias("ways"), F.countDistinct("ref").alias("refs"), F.count_if(F.col("class") == "none").alias("without_class"), F.grouping("grp").cast("int").alias("total"))


def network_stats(spark, d):
    o = table(spark, d, "orders")
    grade = F.when(F.col("o_totalprice") <= 60000, "A").when(F.col("o_totalprice") <= 150000, "B").when(F.col("o_totalprice") <= 300000, "C").otherwise("X")
    return o.groupBy(F.col("o_orderstatus").alias("class")).agg(F.count("*").alias("total"), F.count_if(F.col("o_totalprice") > 100000).alias("with_geometry"), (F.floor(F.count_if(F.col("o_totalprice") > 100000) / F.count("*") * 100 + 0.5) / 100).alias("ratio"),
        *[F.count_if(grade == g).alias(f"grade_{g.lower()}") for g in "ABCX"])


def train_classes(spark, d):
    code = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("G", "d", "C", "Z", "T", "K", "Y", "")]), (F.col("o_orderkey") % 8 + 1).cast("int")), (F.col("o_orderkey") % 9999).cast("string"))
    o = table(spark, d, "orders").select(code.alias("code"))
    return o.groupBy(names.train_class(F.col("code")).alias("class"), names.is_train_code(F.col("code")).alias("valid")).agg(F.count("*").alias("n"))


def search_scores(spark, d):
    """Top matches per kind of thing for a search text."""
    q = "al"
    part = table(spark, d, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.greatest(names.text_score(F.col("p_name"), q), names.text_score(F.col("p_brand"), q, 0.8)).alias("score"))
    supp = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), names.text_score(F.col("s_name"), "supplier#000000001").alias("score"))
    nation = table(spark, d, "nation").select(F.lit("nation").alias("kind"), F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), names.text_score(F.col("n_name"), q).alias("score"))
    rows = part.unionByName(supp).unionByName(nation).where("score > 0")
    quota = F.when(F.col("kind") == "part", 14).when(F.col("kind") == "supplier", 8).otherwise(6)
    nr = F.row_number().over(Window.partitionBy("kind").orderBy(F.col("score").desc(), F.char_length("name"), "name", "id"))
    return rows.withColumn("nr", nr.cast("int")).where(F.col("nr") <= quota)


def suggest(spark, d):
    s = table(spark, d, "supplier").withColumn("score", names.suggest_score(F.col("s_name"), "Supplier#00000001"))
    return s.where("score > 0").orderBy(F.col("score").desc(), F.char_length("s_name"), "s_name").limit(10).select("s_suppkey", "s_name", F.col("score").cast("int").alias("score"))


def months(spark, d):
    m = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set(F.month("o_orderdate")).alias("m"))
    return m.select("o_custkey", names.months_text(F.col("m")).alias("months"))


def merged_records(spark, d):
    """Orders' lines as offers of several sources: fields filled by source priority."""
    l = table(spark, d, "lineitem").select("l_partkey", (F.col("l_suppkey") % 4).alias("prio"), F.concat(F.lit("s"), (F.col("l_suppkey") % 4).cast("string")).alias("source"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).alias("quantity"), F.when(F.col("l_linenumber") % 3 == 0, F.col("l_returnflag")).alias("flag"))
    one = l.groupBy("l_partkey", "prio", "source").agg(F.max("quantity").alias("quantity"), F.max("flag").alias("flag"))
    return cat.merge_sources(one, ["l_partkey"], "prio", ["quantity", "flag"], "source")


def codeshares(spark, d):
    o = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderpriority").alias("priority"), names.flight_number(F.concat(F.lit("_mu0"), F.col("o_orderkey").cast("string"))).alias("no"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("status"))
    return cat.richest(o, ["day", "priority"], ["price", "status"], "price", "no")


def exact_dedupe(spark, d):
    s = derived(spark, d, "spots")
    return cat.first_by_priority(s.withColumns({"x": F.floor(F.col("lng")), "y": F.floor(F.col("lat"))}), ["x", "y"], [F.col("score").desc(), F.col("id")]).select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "id", "score")


def shared_boards(spark, d):
    """Orders as boards of parts: of each board how many of its parts are on other boards, and how many other boards those are."""
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("board"), F.col("l_partkey").alias("part"))
    also = cat.also_in(b, "board", "part").groupBy("board").agg(F.count("*").alias("also_in"))
    held = b.distinct()
    many = held.groupBy("part").agg((F.count("*") > 1).alias("many"))
    shared = held.join(many, "part").groupBy("board").agg(F.count_if(F.col("many")).alias("shared"))
    return shared.join(also, "board", "left").select("board", "shared", F.coalesce("also_in", F.lit(0)).cast("long").alias("also_in"))


def _wide_routes(spark, d):
    """Routes with the lists that a query may ask of: provinces, cities, ways of travel, months and road numbers."""
    i = F.col("id")
    text = lambda letter, n: F.concat(F.lit(letter), (i % n).cast("string"))
    return _routes(spark, d).withColumns({
        "provinces": F.array(text("P", 5), text("P", 3)), "cities": F.when(i % 4 != 0, F.array(text("C", 6))), "modes": F.array(F.element_at(F.array(F.lit("drive"), F.lit("rail"), F.lit("walk")), (i % 3 + 1).cast("int"))),
        "shape": F.when(i % 2 == 0, "loop").otherwise("line"), "best_season": F.sequence((i % 6 + 1).cast("int"), (i % 6 + 4).cast("int")), "road_refs": F.array(F.concat(F.lit("G"), (i % 40).cast("string"))),
    })


def wide_filter(spark, d):
    """Routes by province, city, way of travel, shape and month at once."""
    return _wide_routes(spark, d).where(cat.matches(province="P1", city="C1", mode="rail", shape="line", month=5)).select("id")


def list_search(spark, d):
    """Routes by a word in any of their lists, drafts too."""
    return _wide_routes(spark, d).where(cat.matches(keyword="G3", lists=("provinces", "cities", "road_refs"))).select("id", "status")


def sorted_routes(spark, d):
    """The first thirty routes by length, and by rank, ties as they were loaded."""
    r = _wide_routes(spark, d)
    top = lambda sort: r.orderBy(*cat.named_sort(sort, "id")).limit(30).select("id", F.lit(sort).alias("sort"))
    return top("km-desc").unionByName(top("layer")).unionByName(top("days-asc"))


def _ends(spark, d):
    l = table(spark, d, "lineitem")
    pair = lambda flag: l.where(F.col("l_returnflag") == flag).select("l_partkey", "l_suppkey").distinct()
    return pair("A"), pair("R")


def both_ends(spark, d):
    """Parts of a supplier that came back and were also accepted: an intersection by semi join."""
    a, r = _ends(spark, d)
    return a.join(r, ["l_partkey", "l_suppkey"], "left_semi")


def only_one_end(spark, d):
    a, r = _ends(spark, d)
    return a.join(r, ["l_partkey", "l_suppkey"], "left_anti")


def eta_errors(spark, d):
    """Mean, median and 90th percentile of absolute errors, without interpolation."""
    e = table(spark, d, "events").select("event_type", F.abs(F.col("value") - 50).alias("off"))
    p = cat.lower_percentiles(e, "event_type", "off", (50, 90)).groupBy("event_type").agg(F.max(F.when(F.col("percent") == 50, F.col("off"))).alias("p50"), F.max(F.when(F.col("percent") == 90, F.col("off"))).alias("p90"))
    return e.groupBy("event_type").agg(F.round(F.avg("off"), 6).alias("mae")).join(p, "event_type")


def catalogue_issues(spark, d):
    """Validator rows: level, route, field and message of each broken rule."""
    r = _routes(spark, d)
    checks = [("error", "days", F.col("days").isNull() | (F.col("days") <= 0), "days missing or not positive"), ("error", "tier", F.col("tier").isNull(), "tier missing"),
              ("warn", "poi_count", F.col("poi_count") < 2, "fewer than two places"), ("warn", "total_km", F.col("total_km") / F.greatest("days", F.lit(1)) > 900, "too far for a day")]
    found = F.filter(F.array(*[F.when(bad, F.struct(F.lit(level).alias("level"), F.lit(field).alias("field"), F.lit(text).alias("message"))) for level, field, bad, text in checks]), lambda x: x.isNotNull())
    rules = r.select("id", F.explode(found).alias("i")).select("i.level", F.col("id").alias("route_id"), "i.field", "i.message")
    twice = r.groupBy("layer", "editor_rank").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n > 1 AND layer IS NOT NULL")
    return rules.unionByName(twice.select(F.lit("error").alias("level"), F.col("id").alias("route_id"), F.lit("editor_rank").alias("field"), F.lit("rank used twice").alias("message")))


_REFS = "rf AS (SELECT l_orderkey, l_linenumber, substr('GSXYCGQ', CAST(l_suppkey % 7 + 1 AS INTEGER), 1) || CASE WHEN l_linenumber % 2 = 0 THEN lpad(CAST(l_partkey % 1200 AS VARCHAR), 4, '0') ELSE CAST(l_partkey % 1200 AS VARCHAR) END AS ref, l_suppkey AS supp, l_quantity, l_returnflag FROM lineitem)"
_CLASS = """CASE WHEN regexp_full_match(ref, 'G\\d{1,3}') THEN CASE WHEN CAST(substr(ref, 2) AS INTEGER) < 100 THEN 'expressway' ELSE 'national' END
WHEN regexp_full_match(ref, 'G\\d{4}') THEN 'expressway' WHEN regexp_full_match(ref, 'S\\d{1,4}') THEN 'provincial' WHEN regexp_full_match(ref, 'X\\d{1,4}') THEN 'county'
WHEN regexp_full_match(ref, 'Y\\d{1,4}') THEN 'township' WHEN regexp_full_match(ref, 'C\\d{1,4}') THEN 'village' END"""
_CANON = "CASE WHEN regexp_full_match(ref, 'G\\d{4}') THEN ref WHEN regexp_full_match(ref, 'G0*\\d{1,3}|[SXYC]0*\\d{1,4}') THEN regexp_replace(ref, '^([GSXYC])0*(\\d)', '\\1\\2') ELSE ref END"
_LAYERED = "lr AS (SELECT * EXCLUDE (layer), coalesce(layer, CASE WHEN tier = 'national' THEN 'L1' WHEN tier = 'regional' THEN 'L2' WHEN CASE WHEN days > 0 THEN days ELSE 2 END <= 2 THEN 'L4' ELSE 'L3' END) AS layer FROM routes)"

QUERIES = {
    f.__name__: f for f in (wide_filter, list_search, sorted_routes, route_search, route_filter, route_layers, route_recommended, route_page, route_facets, route_layer_counts, corpus_overview, ref_classes, ref_canonical, ref_keys, ref_lists, road_register, census,
                            network_stats, train_classes, search_scores, suggest, months, merged_records, codeshares, exact_dedupe, shared_boards, both_ends, only_one_end, eta_errors, catalogue_issues)
}

ORACLES = {
    "route_search": with_tables(["routes"], "SELECT id, name, status FROM routes WHERE contains(name, 'SMALL') OR contains(anchor_city, 'SMALL') OR contains(tag, 'SMALL')"),
    "route_filter": with_tables(["routes"], f"{_LAYERED} SELECT id FROM lr WHERE status = 'published' AND layer = 'L4' AND coalesce(days <= 4, TRUE) AND total_km <= 2000 AND difficulty <= 4"),
    "route_layers": with_tables(["routes"], f"{_LAYERED} SELECT id, layer FROM lr"),
    "route_recommended": with_tables(["routes"], f"""{_LAYERED}, n AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY editor_rank, id) AS rn FROM lr WHERE status = 'published')
SELECT id, layer, CAST(row_number() OVER (ORDER BY (rn - 1) // 2, CASE layer WHEN 'L3' THEN 1 WHEN 'L4' THEN 2 WHEN 'L2' THEN 3 WHEN 'L1' THEN 4 ELSE 5 END, rn) AS INTEGER) AS place FROM n"""),
    "route_page": with_tables(["routes"], "SELECT id, total_km, count(*) OVER () AS total FROM routes WHERE status = 'published' ORDER BY total_km DESC, id LIMIT 30 OFFSET 20"),
    "route_facets": with_tables(["routes"], f"""{_LAYERED}, u AS (SELECT 'layer' AS facet, layer AS value FROM lr UNION ALL SELECT 'tier', tier FROM lr UNION ALL SELECT 'anchor_city', anchor_city FROM lr UNION ALL SELECT 'tag', tag FROM lr)
SELECT facet, value, count(*) AS n FROM u WHERE value IS NOT NULL GROUP BY ALL"""),
    "route_layer_counts": with_tables(["routes"], f"{_LAYERED}, v AS (SELECT unnest(['L1', 'L2', 'L3', 'L4', 'L5']) AS layer) SELECT v.layer, count(lr.id) AS n FROM v LEFT JOIN lr ON lr.layer = v.layer AND lr.layer <> 'L5' GROUP BY 1"),
    "corpus_overview": with_tables(["routes"], "SELECT count(*) AS routes, count(*) FILTER (WHERE status = 'published') AS published, CAST(sum(poi_count) AS BIGINT) AS pois, CAST(floor(sum(total_km) FILTER (WHERE status = 'published') * 10 + 0.5) AS BIGINT) AS km_tenths FROM routes"),
    "ref_classes": f"WITH {_REFS} SELECT coalesce({_CLASS}, 'none') AS class, count(*) AS n, count(DISTINCT ref) AS refs FROM rf GROUP BY 1",
    "ref_canonical": f"WITH {_REFS} SELECT {_CANON} AS ref, count(*) AS n FROM rf GROUP BY 1",
    "ref_keys": f"""WITH {_REFS}, k AS (SELECT *, {_CLASS} AS class, 'p' || CAST(supp % 5 AS VARCHAR) AS prov, CASE WHEN supp % 3 = 0 THEN 'c' || CAST(supp % 4 AS VARCHAR) END AS county FROM rf)
SELECT CASE WHEN class IN ('national', 'expressway') THEN ref WHEN class IN ('township', 'village') AND county IS NOT NULL THEN prov || ':' || county || ':' || ref ELSE prov || ':' || ref END AS key, count(*) AS n FROM k WHERE class IS NOT NULL GROUP BY 1""",
    "ref_lists": f"""WITH {_REFS}, c AS (SELECT l_orderkey, l_linenumber, ref AS raw, {_CANON} AS ref FROM rf), f AS (SELECT l_orderkey, ref, min((l_linenumber, raw)) AS pos FROM c GROUP BY 1, 2)
SELECT l_orderkey, string_agg(ref, ',' ORDER BY pos) AS refs FROM f GROUP BY 1""",
    "road_register": f"""WITH {_REFS}, w AS (SELECT {_CANON} AS ref, l_quantity, l_returnflag AS name FROM rf), n AS (SELECT ref, name, row_number() OVER (PARTITION BY ref ORDER BY count(*) DESC, name) AS nr FROM w GROUP BY 1, 2)
SELECT w.ref, round(sum(l_quantity), 2) AS km, count(*) AS ways, any_value(n.name) AS name FROM w JOIN n ON n.ref = w.ref AND n.nr = 1 GROUP BY 1""",
    "census": f"WITH {_REFS} SELECT supp % 10 AS grp, count(*) AS ways, count(DISTINCT ref) AS refs, count(*) FILTER (WHERE {_CLASS} IS NULL) AS without_class, CAST(grouping(supp % 10) AS INTEGER) AS total FROM rf GROUP BY ROLLUP (supp % 10)",
    "network_stats": """SELECT o_orderstatus AS class, count(*) AS total, count(*) FILTER (WHERE o_totalprice > 100000) AS with_geometry, floor(count(*) FILTER (WHERE o_totalprice > 100000) / count(*) * 100 + 0.5) / 100 AS ratio,
count(*) FILTER (WHERE o_totalprice <= 60000) AS grade_a, count(*) FILTER (WHERE o_totalprice > 60000 AND o_totalprice <= 150000) AS grade_b, count(*) FILTER (WHERE o_totalprice > 150000 AND o_totalprice <= 300000) AS grade_c, count(*) FILTER (WHERE o_totalprice > 300000) AS grade_x FROM orders GROUP BY 1""",
    "train_classes": """WITH c AS (SELECT upper(['G', 'd', 'C', 'Z', 'T', 'K', 'Y', ''][o_orderkey % 8 + 1] || CAST(o_orderkey % 9999 AS VARCHAR)) AS code FROM orders)
SELECT CASE WHEN substr(code, 1, 1) IN ('G', 'D', 'C', 'Z', 'T', 'K') THEN substr(code, 1, 1) ELSE 'OTHER' END AS class, regexp_full_match(code, '[GDCZTKYS]?\\d{1,5}') AS valid, count(*) AS n FROM c GROUP BY ALL""",
    "search_scores": """WITH s AS (SELECT 'part' AS kind, p_partkey AS id, p_name AS name, greatest(CASE WHEN lower(p_name) = 'al' THEN 100.0 WHEN lower(p_name) LIKE 'al%' THEN 86.0 WHEN lower(p_name) LIKE '%al%' THEN 68.0 ELSE 0.0 END, CASE WHEN lower(p_brand) = 'al' THEN 80.0 WHEN lower(p_brand) LIKE 'al%' THEN 68.8 WHEN lower(p_brand) LIKE '%al%' THEN 54.4 ELSE 0.0 END)::DOUBLE AS score FROM part
UNION ALL SELECT 'supplier', s_suppkey, s_name, CASE WHEN lower(s_name) = 'supplier#000000001' THEN 100.0 WHEN lower(s_name) LIKE 'supplier#000000001%' THEN 86.0 WHEN lower(s_name) LIKE '%supplier#000000001%' THEN 68.0 ELSE 0.0 END FROM supplier
UNION ALL SELECT 'nation', n_nationkey, n_name, CASE WHEN lower(n_name) = 'al' THEN 100.0 WHEN lower(n_name) LIKE 'al%' THEN 86.0 WHEN lower(n_name) LIKE '%al%' THEN 68.0 ELSE 0.0 END FROM nation),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY score DESC, length(name), name, id) AS INTEGER) AS nr FROM s WHERE score > 0) SELECT * FROM r WHERE nr <= CASE kind WHEN 'part' THEN 14 WHEN 'supplier' THEN 8 ELSE 6 END""",
    "suggest": "SELECT s_suppkey, s_name, CAST(CASE WHEN s_name = 'Supplier#00000001' THEN 100 WHEN starts_with(s_name, 'Supplier#00000001') THEN 80 ELSE 50 END AS INTEGER) AS score FROM supplier WHERE contains(s_name, 'Supplier#00000001') ORDER BY score DESC, length(s_name), s_name LIMIT 10",
    "months": """WITH m AS (SELECT DISTINCT o_custkey, month(o_orderdate) AS m FROM orders), g AS (SELECT *, m - row_number() OVER (PARTITION BY o_custkey ORDER BY m) AS grp, count(*) OVER (PARTITION BY o_custkey) AS n FROM m),
r AS (SELECT o_custkey, grp, any_value(n) AS n, min(m) AS lo, max(m) AS hi, string_agg(CAST(m AS VARCHAR), '、' ORDER BY m) AS each FROM g GROUP BY 1, 2)
SELECT o_custkey, CASE WHEN any_value(n) = 12 THEN '全年' ELSE string_agg(CASE WHEN hi - lo >= 2 THEN CAST(lo AS VARCHAR) || '-' || CAST(hi AS VARCHAR) ELSE each END, '、' ORDER BY lo) || ' 月' END AS months FROM r GROUP BY 1""",
    "merged_records": """WITH l AS (SELECT l_partkey, l_suppkey % 4 AS prio, max(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END) AS q, max(CASE WHEN l_linenumber % 3 = 0 THEN l_returnflag END) AS f FROM lineitem GROUP BY 1, 2)
SELECT l_partkey, first(q ORDER BY prio) FILTER (WHERE q IS NOT NULL) AS quantity, first(f ORDER BY prio) FILTER (WHERE f IS NOT NULL) AS flag, string_agg('s' || CAST(prio AS VARCHAR), ',' ORDER BY prio) AS sources FROM l GROUP BY 1""",
    "codeshares": """WITH o AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS priority, 'MU' || CAST(o_orderkey AS VARCHAR) AS no, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS status FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY day, priority ORDER BY (price IS NOT NULL)::INT + (status IS NOT NULL)::INT + CASE WHEN price > 0 THEN 5 ELSE 0 END DESC, no) AS nr FROM o)
SELECT day, priority, max(no) FILTER (WHERE nr = 1) AS no, max(price) FILTER (WHERE nr = 1) AS price, max(status) FILTER (WHERE nr = 1) AS status, coalesce(string_agg(no, ',' ORDER BY no) FILTER (WHERE nr > 1), '') AS variants FROM r GROUP BY 1, 2""",
    "exact_dedupe": with_tables(["spots"], "SELECT * EXCLUDE (nr) FROM (SELECT CAST(floor(lng) AS BIGINT) AS x, CAST(floor(lat) AS BIGINT) AS y, id, score, row_number() OVER (PARTITION BY floor(lng), floor(lat) ORDER BY score DESC, id) AS nr FROM spots) WHERE nr = 1"),
    "wide_filter": with_tables(["routes"], "SELECT id FROM routes WHERE status = 'published' AND (id % 5 = 1 OR id % 3 = 1) AND ((id % 4 <> 0 AND id % 6 = 1) OR anchor_city = 'C1') AND id % 3 = 1 AND id % 2 = 1 AND 5 BETWEEN id % 6 + 1 AND id % 6 + 4"),
    "list_search": with_tables(["routes"], "SELECT id, status FROM routes WHERE contains(name, 'G3') OR contains(anchor_city, 'G3') OR contains(tag, 'G3') OR id % 40 = 3 OR id % 40 BETWEEN 30 AND 39"),
    "sorted_routes": with_tables(["routes"], "SELECT id, 'km-desc' AS sort FROM (SELECT id FROM routes ORDER BY total_km DESC, id LIMIT 30) UNION ALL SELECT id, 'layer' FROM (SELECT id FROM routes ORDER BY editor_rank, total_km DESC, id LIMIT 30) UNION ALL SELECT id, 'days-asc' FROM (SELECT id FROM routes ORDER BY days NULLS FIRST, id LIMIT 30)"),
    "shared_boards": "WITH b AS (SELECT DISTINCT l_orderkey AS board, l_partkey AS part FROM lineitem), n AS (SELECT part, count(*) AS boards FROM b GROUP BY 1), o AS (SELECT a.board, count(DISTINCT c.board) AS also_in FROM b a JOIN b c ON a.part = c.part AND a.board <> c.board GROUP BY 1) SELECT board, count(*) FILTER (WHERE boards > 1) AS shared, coalesce(any_value(also_in), 0) AS also_in FROM b JOIN n USING (part) LEFT JOIN o USING (board) GROUP BY 1",
    "both_ends": "SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'",
    "only_one_end": "SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'",
    "eta_errors": """WITH e AS (SELECT event_type, list_sort(list(abs(value - 50))) AS v, round(avg(abs(value - 50)), 6) AS mae FROM events GROUP BY 1)
SELECT event_type, mae, v[least(len(v) - 1, CAST(floor(len(v) * 50 / 100) AS BIGINT)) + 1] AS p50, v[least(len(v) - 1, CAST(floor(len(v) * 90 / 100) AS BIGINT)) + 1] AS p90 FROM e""",
    "catalogue_issues": with_tables(["routes"], """i AS (SELECT 'error' AS level, id AS route_id, 'days' AS field, 'days missing or not positive' AS message FROM routes WHERE days IS NULL OR days <= 0
UNION ALL SELECT 'error', id, 'tier', 'tier missing' FROM routes WHERE tier IS NULL UNION ALL SELECT 'warn', id, 'poi_count', 'fewer than two places' FROM routes WHERE poi_count < 2
UNION ALL SELECT 'warn', id, 'total_km', 'too far for a day' FROM routes WHERE total_km / greatest(coalesce(days, 1), 1) > 900
UNION ALL SELECT 'error', min(id), 'editor_rank', 'rank used twice' FROM routes WHERE layer IS NOT NULL GROUP BY layer, editor_rank HAVING count(*) > 1) SELECT * FROM i"""),
}
