"""Mixing sources to target weights by Pareto order sampling.

A source's target is filled with whole copies of all its documents first. What is left is a sample:
each document gets an inclusion probability in proportion to its weight, a random number turns that into a
rank (random odds over inclusion odds), and documents go in by rank until their words fill the rest. What decides is one cut
per source, so the decision about a document needs its own row and its source's row only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.llm.scratch import saved

WORD = r"[^\x20\x09-\x0D]+"
#: Slices of a source's ranking: slices below the cut are taken whole, only the one at the cut is sorted.
SLICES = 4096
#: Sources that one row each is broadcast for, at most; beyond, rows are joined by a shuffle on the source.
MOST_BROADCAST = 100_000
#: Rows of a range of sources, about.
RANGE_ROWS = 100_000


def word_count(text: Column) -> Column:
    """Count the words of a text as a long; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def richness(size: Column) -> Column:
    """Return a document's weight in the sample: the binary digits of its number of words, so that longer texts are likelier."""
    return F.length(F.bin(size)).cast("long")


def _ranked(by: DataFrame) -> DataFrame:
    """Add _rank, from 0, of sources in code-point order, null last: within ranges of some RANGE_ROWS sources, after the counts of the ranges before."""
    parts = min(int(by.sparkSession.conf.get("spark.sql.shuffle.partitions")), by.count() // RANGE_ROWS + 1)
    if parts == 1:
        return by.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranged = saved(by.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()), "sources")
    up_to = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = ranged.groupBy(F.col("_part").alias("_p")).agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(up_to), F.lit(0)).alias("_before"))
    nr = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last()))
    return ranged.withColumn("_nr", nr).join(F.broadcast(offsets), F.col("_part") == F.col("_p")).withColumn("_rank", F.col("_before") + F.col("_nr") - 1).drop("_p", "_part", "_n", "_before", "_nr")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, total: float | None = None) -> DataFrame:
    """Share the total of all sizes among the sources. sizes: source, size -> source, source_size, weight, target.

    Sources in code-point order, null last, take the weights in turn. No target is above `most` times
    its source's size; what goes over is shared again by weight, until none is above: each round is a sum over the sources.
    One row per source; an empty table gives an empty table; a source of size 0 has the target 0.
    """
    by = saved(sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), "source-sizes")
    listed = _ranked(by).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))).drop("_rank")
    listed = listed.withColumn("_cap", F.col("source_size") * F.lit(float(most))).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    whole = listed.agg(F.sum("source_size")).first()[0] if total is None else float(total)
    level = None
    while whole is not None:
        over = F.lit(False) if level is None else F.col("_ratio") < level
        capped, rest = listed.agg(F.coalesce(F.sum(F.when(over, F.col("_cap"))), F.lit(0.0)), F.sum(F.when(~over, F.col("weight")))).first()
        new = (whole - capped) / rest if rest else None
        if new is None or new == level:
            level = new
            break
        level = new
    target = F.col("_cap") if level is None else F.least(F.col("_cap"), F.lit(level) * F.col("weight"))
    return listed.select("source", "source_size", "weight", target.cast("double").alias("target"))


def order_key(doc_id: Column, salt: Column, seed: str) -> Column:
    """Return a number in (0, 1) that depends on the document and the seed alone."""
    text = F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), salt.cast("string"))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


def _with_source(rows: DataFrame, table: DataFrame, few: bool) -> DataFrame:
    """Add a source's row to its rows; null is a source. The table is broadcast if its sources are few."""
    named = table.withColumnRenamed("source", "_source")
    return rows.join(F.broadcast(named) if few else named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _rank(weight: Column, seed: str) -> Column:
    """Return a document's rank in (0, 1), smallest first: q / (1 + q) of its Pareto odds ratio q; 0 if it is certain, 1 if it is not wanted."""
    p = F.least(F.lit(1.0), F.try_divide(F.col("_rest").cast("double") * weight, F.col("_weights").cast("double")))
    u = order_key(F.col("doc_id"), F.col("size"), seed)
    odds = F.try_divide(u / (1 - u), F.try_divide(p, 1 - p))
    return F.when(p >= 1, F.lit(0.0)).when(p > 0, odds / (1 + odds)).otherwise(F.lit(1.0))


def decide(rows: DataFrame, targets: DataFrame, seed: str = "mix", slices: int = SLICES, weight_col: str | None = None) -> DataFrame:
    """Return what each source takes, a row per source: _sure whole copies of all, and of the sample all documents before the cut.

    rows: doc_id, source, size (long, 0 or more) and optionally weight_col (positive). targets: as
    source_targets returns them. Sums per slice of the ranking find the slice of the cut, and only that is
    sorted, so no source is sorted whole; rows is read three times and should be a stored table.
    The cut document (or each of n rows equal to it) gives the words still wanted, _room.
    """
    weight = F.col(weight_col) if weight_col else F.lit(1)
    sums = rows.groupBy("source").agg(F.sum(F.col("size") * weight).alias("_weights"))
    sure = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = _with_source(targets.withColumn("_sure", sure), sums, False)
    goal = saved(goal.withColumn("_rest", F.round("target").cast("long") - F.col("_sure") * F.col("source_size")).drop("weight"), "goals")
    few = goal.count() <= MOST_BROADCAST

    ranked = _with_source(rows.select("doc_id", "source", "size", weight.alias("_w")), goal, few).withColumn("_q", _rank(F.col("_w"), seed))
    ranked = ranked.withColumn("_slice", F.least(F.floor(F.col("_q") * slices), F.lit(slices - 1)).cast("int"))
    by_slice = ranked.groupBy("source", "_rest", "_slice").agg(F.sum("size").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = by_slice.withColumn("_left", F.col("_rest") - before).where((F.col("_left") >= 0) & (F.col("_left") < F.col("_sum")))
    cut = left.select(F.col("source").alias("_c"), F.col("_slice").alias("_s"), "_left")  # a row per source at most

    at_cut = ranked.join(F.broadcast(cut) if few else cut, F.col("source").eqNullSafe(F.col("_c")) & (F.col("_slice") == F.col("_s")))
    equal = at_cut.groupBy("source", "_left", "_q", "doc_id", "size").agg(F.count("*").alias("_n"))
    line = Window.partitionBy("source").orderBy("_q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("_left") - F.coalesce(F.sum(F.col("_n") * F.col("size")).over(line), F.lit(0))
    at = F.struct(F.col("_q").alias("q"), F.col("doc_id").alias("id"), F.col("size").alias("size"))
    first = equal.withColumn("_room", room).where("_room < _n * size").groupBy("source").agg(F.min(F.struct(at.alias("at"), F.floor(F.col("_room") / F.col("_n")).cast("long").alias("room"))).alias("_cut"))
    first = first.select(F.col("source").alias("_c"), F.col("_cut.at").alias("_at"), F.col("_cut.room").alias("_room"))
    return saved(goal.join(first, F.col("source").eqNullSafe(F.col("_c")), "left").drop("_c"), "decisions")


def apply(rows: DataFrame, decisions: DataFrame, seed: str = "mix", weight_col: str | None = None) -> DataFrame:
    """Add source_size, target, copies (whole ones), part (words of the cut document) and taken to rows; their own row and their source's decide."""
    few = decisions.count() <= MOST_BROADCAST
    weight = F.col(weight_col) if weight_col else F.lit(1)
    out = _with_source(rows, decisions, few).withColumn("_q", _rank(weight, seed))
    own = F.struct(F.col("_q").alias("q"), F.col("doc_id").alias("id"), F.col("size").alias("size"))
    # Nulls come first in the order of structs, as in the order of the sample.
    give = F.when(F.col("_at").isNull() | (own < F.col("_at")), F.col("size")).when(own == F.col("_at"), F.col("_room")).otherwise(F.lit(0))
    out = out.withColumn("_give", give)
    full = (F.col("_give") == F.col("size")) & (F.col("size") > 0)
    out = out.withColumn("taken", (F.col("_sure") * F.col("size") + F.col("_give")).cast("long"))
    out = out.withColumn("part", F.when(full, F.lit(0)).otherwise(F.col("_give")).cast("long"))
    out = out.withColumn("copies", (F.col("_sure") + F.when(full, 1).otherwise(0)).cast("long"))
    return out.drop("_sure", "_rest", "_weights", "_at", "_room", "_q", "_give")


def mix(rows: DataFrame, targets: DataFrame, seed: str = "mix", slices: int = SLICES, weight_col: str | None = None) -> DataFrame:
    """Decide how often each document is taken so that each source comes near its target.

    rows: doc_id, source, size (long, 0 or more) and optionally weight_col (positive). The whole part of
    target / source_size is taken of every document for certain. The rest of the target is a sample with inclusion
    probabilities in proportion to the weights (equal without them; those that come to 1 are certain), drawn in Pareto order:
    u / (1 - u) over p / (1 - p) with u a fixed random number of the document, smallest first, until
    the words fill the rest. So the sample's size is fixed: a source misses its target by less than a word (by less than n if n
    equal rows are at its cut), and no document is taken more than ceil(target / source_size) times.

    Adds source_size, target, copies (whole ones), part (words of the cut document) and taken. Null sources are a source;
    equal ranks are ordered by doc_id, null first, then size; rows equal in all of them get the same.
    """
    return apply(rows, decide(rows, targets, seed, slices, weight_col), seed, weight_col)


def _sizes(documents: DataFrame) -> DataFrame:
    sizes = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return saved(sizes.withColumn("_richness", richness(F.col("size"))), "sizes")


def mix_documents(documents: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: str = "mix") -> DataFrame:
    """Mix a table of documents, longer ones likelier: doc_id, source, size, source_size, target, copies, part, taken, a row per document."""
    sizes = _sizes(documents)
    return mix(sizes, source_targets(sizes, weights, most), seed, weight_col="_richness").drop("_richness")


def mixed_texts(documents: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: str = "mix") -> DataFrame:
    """Return documents as often as the mix takes them whole, with the columns of documents.

    The document at a source's cut is left out: its text is never shortened. Texts stay where they
    are: each row's own size and its source's decision tell how often it is taken.
    """
    sizes = _sizes(documents)
    decisions = decide(sizes, source_targets(sizes, weights, most), seed, weight_col="_richness")
    row = documents.select(F.struct(*[F.col(c) for c in documents.columns]).alias("_row"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    times = apply(row.withColumn("_richness", richness(F.col("size"))), decisions, seed, "_richness").where("copies > 0")
    return times.withColumn("_nr", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("_row.*")


def op10_mixing(documents: DataFrame) -> DataFrame:
    """Mix all documents with the weights 5, 2, 1 in turn, at most 3 times each source's size."""
    return mix_documents(documents).select("doc_id", "size", "source_size", "target", "taken", "copies", "part")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
c AS (SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / weight AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM c),
f AS (SELECT lvl FROM l WHERE ratio >= lvl ORDER BY ratio, lvl LIMIT 1),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT lvl FROM f) * weight, cap))::DOUBLE AS target FROM l),
r AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
v AS (SELECT *, floor(rate)::BIGINT AS sure, round(target)::BIGINT - floor(rate)::BIGINT * source_size AS rest, length(bin(size)) AS richness FROM r),
q AS (SELECT *, least(1.0::DOUBLE, rest::DOUBLE * richness / nullif(sum(size * richness) OVER (PARTITION BY source), 0)::DOUBLE) AS p,
             (('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, 'null') || '|' || size::VARCHAR), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u FROM v),
o AS (SELECT *, CASE WHEN p > 0 AND p < 1 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM q),
k AS (SELECT *, CASE WHEN p >= 1 THEN 0.0 WHEN p > 0 THEN odds / (1 + odds) ELSE 1.0 END AS rank_key FROM o),
g AS (SELECT *, rest - coalesce(sum(size) OVER (PARTITION BY source ORDER BY rank_key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM k),
e AS (SELECT *, greatest(0, least(size, room))::BIGINT AS give FROM g)
SELECT doc_id, size, source_size, target, (sure * size + give)::BIGINT AS taken,
       (sure + CASE WHEN give = size AND size > 0 THEN 1 ELSE 0 END)::BIGINT AS copies,
       (CASE WHEN give = size AND size > 0 THEN 0 ELSE give END)::BIGINT AS part
FROM e
"""
