"""Ranked lexical search: a max tree over document ranges per term, searched best first.

1. One scan reads the texts and stores, per document, its number of terms and how often it holds each
   term of the items: whatever the texts' size, later steps see these few numbers only.
2. Sums over the stored table give the statistics; the weights follow from them.
3. Each task takes ranges of the stored documents. For a range it builds, per term, a tree whose leaves
   are the term's scores in single documents and whose inner nodes hold the greatest score below them,
   eight children each. A sum of an item's terms at a node bounds all scores below it; an item opens
   the nodes with the highest bounds first, and stops when none reaches its running last score.
   Equal bounds are opened, as the smaller doc_id comes first among equal scores.
4. What the tasks found, a few rows an item and task, is ranked in two steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.llm.scratch import bounded_batches, new_folder, saved

TOP = 10
#: Terms of the items that go over the documents in one scan, about; they are sent to the tasks, so this bounds what is sent.
BLOCK_TERMS = 200_000
#: Documents and counted terms of a range, at most (but for a single document).
RANGE_DOCS, RANGE_POSTINGS = 1 << 16, 1 << 21
#: Children of a node are 2 ** FAN; nodes opened at once.
FAN, OPEN_AT_ONCE = 3, 48
#: Salts of the first step of the final ranking.
SALTS = 32
#: What parts terms, as a pattern and as bytes. Bytes from 128 on are parts of letters of any script.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SPACED = bytes(32 if b < 48 or 57 < b < 65 or 90 < b < 97 or 122 < b < 128 else b for b in range(256))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: str) -> list[bytes]:
    """Return a text's terms in order, with repeats; only A-Z are lower-cased."""
    return text.encode().lower().translate(_SPACED).split()


def item_terms(items: DataFrame) -> DataFrame:
    """Return item_id and terms, its distinct terms. Items that share an item_id are one; those without one, or without terms, are left out."""
    found = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(TERM), 0)
    rows = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", F.explode(found).alias("term"))
    return rows.groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def term_counts(documents: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """Return doc_id, n (terms with repeats), term and times (of the numbered terms it holds) for every row."""
    sent = documents.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            n, sizes, found, times = [], [0], [], []
            for text in batch.column(1):
                words = terms(text.as_py() or "")
                ids, count = np.unique(np.array([known[w] for w in words if w in known], dtype=np.int32), return_counts=True)
                n.append(len(words))
                sizes.append(sizes[-1] + len(ids))
                found.append(ids)
                times.append(count.astype(np.int32))
            at = pa.array(sizes, pa.int32())
            flat = [pa.array(np.concatenate([np.empty(0, dtype=np.int32), *x])) for x in (found, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *[pa.ListArray.from_arrays(at, x) for x in flat]], names=["doc_id", "n", "term", "times"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, term array<int>, times array<int>")


def weight(docs: int, df: int) -> int:
    """Weight of a term that df of all documents with terms hold."""
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


class MaxTree:
    """Greatest scores of terms over ranges of documents, level by level.

    A level holds sorted keys (term, range) with their greatest score and where their children start in
    the level below; ranges without the term have no entry. Level 0 has the documents themselves.
    """

    BITS = 40

    def __init__(self, term: np.ndarray, place: np.ndarray, score: np.ndarray):
        order = np.lexsort((place, term))
        key, value = term[order].astype(np.int64) << self.BITS | place[order], score[order]
        self.keys, self.values, self.below = [key], [value], [np.arange(len(key) + 1)]
        while len(key) and int((key & ((1 << self.BITS) - 1)).max()):
            up = (key >> self.BITS << self.BITS) | ((key & ((1 << self.BITS) - 1)) >> FAN)
            starts = np.flatnonzero(np.r_[True, up[1:] != up[:-1]])
            value = np.maximum.reduceat(value, starts)
            key = up[starts]
            self.keys.append(key)
            self.values.append(value)
            self.below.append(np.r_[starts, len(up)])

    def top(self) -> int:
        return len(self.keys) - 1

    def root(self, wanted: np.ndarray) -> int:
        """Return the bound of everything for the terms."""
        at = np.searchsorted(self.keys[-1], wanted << self.BITS)
        hit = at < len(self.keys[-1])
        hit[hit] = self.keys[-1][at[hit]] == wanted[hit] << self.BITS
        return int(self.values[-1][at[hit]].sum())

    def open(self, level: int, nodes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Return the children of nodes of a level that hold any of the terms, with their bounds: at level 1 documents with their scores."""
        keys = self.keys[level]
        key = (wanted[:, None] << self.BITS | nodes[None, :]).ravel()
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        at = at[keys[at] == key]
        first, sizes = self.below[level][at], np.diff(self.below[level])[at]
        child = np.repeat(first - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        places = self.keys[level - 1][child] & ((1 << self.BITS) - 1)
        found, which = np.unique(places, return_inverse=True)
        bounds = np.zeros(len(found), dtype=np.int64)
        np.add.at(bounds, which, self.values[level - 1][child])
        return found, bounds


class Best:
    """The running first k documents of an item, by falling score and rising doc_id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    @property
    def last(self) -> int:
        """The least score that can come in."""
        return max(1, int(self.scores[-1])) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.r_[self.scores, scores], np.r_[self.ids, ids]
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def search(tree: MaxTree, ids: np.ndarray, wanted: np.ndarray, best: Best) -> None:
    """Best first: open the nodes with the highest bounds until none reaches the last of the best; add documents as they are met."""
    if not len(tree.keys[0]):
        return
    if not tree.top():  # the only document is the root
        root = tree.root(wanted)
        if root >= best.last:
            best.add(np.array([root]), ids[:1])
        return
    bound, level, node = (np.array([x], dtype=np.int64) for x in (tree.root(wanted), tree.top(), 0))
    while True:
        alive = bound >= best.last
        if not alive.any():
            return
        bound, level, node = bound[alive], level[alive], node[alive]
        order = np.argsort(-bound, kind="stable")
        now, later = order[:OPEN_AT_ONCE], order[OPEN_AT_ONCE:]
        parts = [(bound[later], level[later], node[later])]
        for at in np.unique(level[now]).tolist():
            found, bounds = tree.open(at, node[now[level[now] == at]], wanted)
            good = bounds >= best.last
            found, bounds = found[good], bounds[good]
            if at == 1:
                best.add(bounds, ids[found])
            else:
                parts.append((bounds, np.full(len(found), at - 1), found))
        bound, level, node = (np.concatenate(x) for x in zip(*parts, strict=True))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Gather batches into ranges of documents of bounded size."""
    held, docs, postings = [], 0, 0
    for whole in batches:
        for at in range(0, whole.num_rows, RANGE_DOCS // 16):
            batch = whole.slice(at, RANGE_DOCS // 16)
            size = len(batch.column(2).flatten())
            if held and (docs + batch.num_rows > RANGE_DOCS or postings + size > RANGE_POSTINGS):
                yield pa.Table.from_batches(held)
                held, docs, postings = [], 0, 0
            held.append(batch)
            docs, postings = docs + batch.num_rows, postings + size
    if held:
        yield pa.Table.from_batches(held)


def _found(counts: DataFrame, wanted: list[np.ndarray], weights: np.ndarray, docs: int, length: int, k: int) -> DataFrame:
    """Search the ranges of every task: item (its number), doc_id, score."""
    sent = counts.sparkSession.sparkContext.broadcast((wanted, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight_of = sent.value
        best = [Best(k) for _ in items]
        for part in _ranges(batches):
            n, ids = part.column("n").to_numpy(), part.column("doc_id").to_numpy()
            lists = part.column("term").combine_chunks()
            place = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy())
            term, times = lists.flatten().to_numpy().astype(np.int64), part.column("times").combine_chunks().flatten().to_numpy().astype(np.int64)
            m = 100 - 90 + (90 * n * docs) // length
            score = weight_of[term] * ((1_000_000_000 * times) // (1000 * times + 8 * m[place]))
            some = score > 0
            tree = MaxTree(term[some], place[some], score[some])
            for item, one in zip(items, best, strict=True):
                search(tree, ids, item, one)
        sizes = [len(b.ids) for b in best]
        columns = [np.repeat(np.arange(len(best)), sizes), *(np.concatenate([np.empty(0, dtype=np.int64), *x]) for x in ([b.ids for b in best], [b.scores for b in best]))]
        yield pa.record_batch([pa.array(c.astype(np.int64)) for c in columns], names=["item", "doc_id", "score"])

    return counts.mapInArrow(run, "item long, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """Rank in two steps, so that no task sorts what all tasks found for an item."""
    first: list[Column] = [F.desc("score"), F.asc("doc_id")]
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    some = found.withColumn("_salt", salt).withColumn("_nr", F.row_number().over(Window.partitionBy("item", "_salt").orderBy(*first))).where(F.col("_nr") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*first))).where(F.col("rank") <= k).drop("_salt", "_nr")


def ranked_search(documents: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """Rank all documents for each item: item_id, rank, doc_id, score of the k highest with a score above 0.

    documents: doc_id (a whole number), text; items: item_id, text. Null and empty texts have no terms. Rows that
    share a doc_id are documents each; rows without one count in the statistics but are not ranked.
    Items that share an item_id are one item with the terms of all. Equal scores go by doc_id. Items go
    over the documents in blocks of bounded size; each block is one scan of the texts.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    asked = saved(item_terms(items), "items")
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_TERMS))
    folder = new_folder(spark, "ranked") if blocks > 1 else None
    for block in range(blocks):
        out = _of_block(documents, asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block), k)
        if folder:
            out.write.mode("append").parquet(folder)
    return spark.read.schema(out.schema).parquet(folder) if folder else out


def _of_block(documents: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Rank for a block of items; the block's terms, their statistics and the items' ids pass the driver."""
    spark = documents.sparkSession
    rows = asked.orderBy("item_id").collect()
    numbers = {t: i for i, t in enumerate(sorted({t.encode() for r in rows for t in r["terms"]}))}
    counts = saved(term_counts(documents, numbers), "term-counts")
    docs, length = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(numbers), dtype=np.int64)
    for r in counts.select(F.explode("term").alias("term")).groupBy("term").count().collect():
        weights[r["term"]] = weight(docs, r["count"])
    wanted = [np.array([numbers[t.encode()] for t in r["terms"]], dtype=np.int64) for r in rows]
    ranked = _ranked(_found(counts.where("doc_id IS NOT NULL AND size(term) > 0"), wanted, weights, docs, max(1, length), k), k)
    ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item long, item_id {asked.schema['item_id'].dataType.simpleString()}")
    return ranked.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Return the 10 highest-scoring documents of every benchmark item; nulls, repeats and ties as in ranked_search, empty tables give none."""
    return ranked_search(documents, benchmark)


ORACLE_SQL = rf"""
WITH t AS (
  SELECT nr, doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}')) AS term FROM (SELECT row_number() OVER () AS nr, * FROM documents)
), d AS (SELECT nr, any_value(doc_id) AS doc_id, count(*) AS n FROM t GROUP BY nr
), s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM d
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}')) AS term FROM benchmark WHERE item_id IS NOT NULL
), tf AS (SELECT nr, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY nr, term
), w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term
), scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // length)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN d USING (nr), s WHERE doc_id IS NOT NULL GROUP BY item_id, nr, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""
