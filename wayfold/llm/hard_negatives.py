"""Hard negatives by norm-bucketed search.

Candidates are sorted by norm and stored; a bucket is a batch of that order. By Cauchy-Schwarz no
row of a bucket scores above its greatest norm times the anchor's, so a bucket is passed over for
an anchor whose window starts above that, or whose running last score does. Scores of the rest come
from one matrix product of the bucket and a block of anchors. A scan keeps a few rows an anchor and
task; only these are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.llm.scratch import new_folder, saved

POSITIVES, NEGATIVES = 5, 10
#: The window of a positive's score, in hundredths of it.
LOWER, UPPER = 30, 90
SCALE = 256
#: Anchors that meet all rows in one scan, about; they are sent to the tasks, so this bounds what is sent.
ANCHOR_BLOCK = 16_384
#: Rows of a bucket and cells of a matrix of scores, at most.
BUCKET, CELLS = 2048, 1 << 22
#: Below this bound of a score, products in doubles are exact.
EXACT = float(1 << 52)


def usable(rows: DataFrame) -> DataFrame:
    """Return vec_id, label (with one in seven moved on), vector in whole numbers and norm2 of the rows that take part.

    Rows with a null vec_id, label or vector, or a null or non-finite component, take no part; an
    empty vector does. Components from 2^54 on are out of the range of whole scores and raise an error.
    """
    vector = F.col("embedding")
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform(vector, lambda x: F.when(F.abs(x) < float(1 << 54), F.floor(x.cast("double") * SCALE)).otherwise(F.raise_error(F.lit("a component is out of range"))).cast("long"))
    out = rows.where(sound).select(F.col("vec_id").cast("long"), label.cast("long").alias("label"), whole.alias("vector"))
    return out.withColumn("norm2", F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def by_norm(rows: DataFrame) -> DataFrame:
    """Store the rows by falling norm. The id is part of the sort key, so that equal norms do not fall to one task."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = F.xxhash64("vec_id")
    out = rows.withColumn("_at", spread)
    return saved(out.repartitionByRange(parts, F.col("norm2").desc(), "_at").sortWithinPartitions(F.col("norm2").desc(), "_at").drop("_at"), "by-norm")


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors as the rows of a matrix; shorter ones end in zeros."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    sizes = np.asarray(vectors.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    width = max(width, int(sizes.max(initial=0)))
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


class Anchors:
    """A block of anchors in a task: ids, labels, vectors and norms."""

    def __init__(self, rows: pa.Table):
        self.ids, self.labels = (rows.column(c).to_numpy() for c in ("vec_id", "label"))
        self.vectors = _matrix(rows.column("vector").combine_chunks(), 0)
        self.norms = np.sqrt(rows.column("norm2").to_numpy())

    def scores(self, vectors: np.ndarray, norm: float, which: np.ndarray) -> np.ndarray:
        """Return the inner products, exactly: a row per anchor in `which`."""
        width = min(vectors.shape[1], self.vectors.shape[1])
        own, other = self.vectors[which, :width], vectors[:, :width]
        if norm * self.norms[which].max(initial=0.0) * 1.0001 < EXACT:
            return (own.astype(np.float64) @ other.astype(np.float64).T).astype(np.int64)
        exact = own.astype(object) @ other.astype(object).T
        if exact.size and max(map(abs, (exact.max(), exact.min()))) >= 1 << 63:
            raise ValueError("a score is out of the range of 64 bits")
        return exact.astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Return the places of the k first by falling score, then rising id."""
    if len(scores) > k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


class Search:
    """The running first k of each of a list of searches; a search is an anchor, whom it may find, and a window of scores."""

    def __init__(self, anchors: Anchors, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.anchors, self.anchor, self.low, self.high, self.k, self.same = anchors, anchor, low, high, k, same
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, dtype=np.int64),) * 2 for _ in anchor]
        self.last = low.copy()  # no lower score can come in

    def bucket(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, norm: float) -> None:
        """Search a bucket whose greatest norm is given. The bound is rounded up, so equal scores are always seen."""
        bound = self.anchors.norms[self.anchor] * norm * (1 + 1e-9) + 1
        open_ = np.flatnonzero(bound >= self.last)
        which, row = np.unique(self.anchor[open_], return_inverse=True)
        step = max(1, CELLS // max(1, len(ids)))
        for start in range(0, len(which), step):
            part = which[start : start + step]
            scores = self.anchors.scores(vectors, norm, part)
            alike = labels == self.anchors.labels[part][:, None]
            fit = (alike & (ids != self.anchors.ids[part][:, None])) if self.same else ~alike
            for search, at in zip(open_[(row >= start) & (row < start + step)], row[(row >= start) & (row < start + step)] - start, strict=True):
                line = scores[at]
                some = np.flatnonzero(fit[at] & (line >= self.last[search]) & (line <= self.high[search]))
                if len(some):
                    self._take(search, line[some], ids[some])

    def _take(self, search: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.r_[self.found[search][0], scores], np.r_[self.found[search][1], ids]
        first = _best(scores, ids, self.k)
        self.found[search] = (scores[first], ids[first])
        if len(first) == self.k:
            self.last[search] = max(self.last[search], scores[first[-1]])

    def rows(self) -> pa.RecordBatch:
        """What was found: number of the search, vec_id, score."""
        sizes = [len(f[0]) for f in self.found]
        columns = [np.repeat(np.arange(len(sizes)), sizes), *(np.concatenate([np.empty(0, dtype=np.int64), *[f[i] for f in self.found]]) for i in (1, 0))]
        return pa.record_batch([pa.array(c.astype(np.int64)) for c in columns], names=["search", "vec_id", "score"])


def _scan(rows: DataFrame, start: Callable[[], Search]) -> DataFrame:
    """Run the searches over all rows in their buckets and return what each task found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = None
        for whole in batches:
            for at in range(0, whole.num_rows, BUCKET):
                batch = whole.slice(at, BUCKET)
                search = search or start()
                norm = float(np.sqrt(batch.column(3).to_numpy().max()))
                search.bucket(batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), 0), norm)
        if search:
            yield search.rows()

    return rows.select("vec_id", "label", "vector", "norm2").mapInArrow(run, "search long, vec_id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    """Rank what the tasks found; of a search there are at most k rows a task."""
    order = Window.partitionBy("search").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, lower: int = LOWER, upper: int = UPPER) -> DataFrame:
    """Return each anchor's first `positives` other rows of its label, and for each the first `negatives` of other labels in its window.

    rows: vec_id, label, embedding. Result: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score; a positive whose window holds no row has none. Scores are whole
    and exact; the window is lower * positive_score <= 100 * negative_score <= upper * positive_score,
    so it is empty for a negative positive_score (upper >= lower). Rows that share a vec_id are
    candidates each, but never each other's positives; of anchors that share one, the least label
    and vector is the anchor. Vectors of different lengths multiply as far as the shorter goes.
    Anchors go over all rows in blocks of about ANCHOR_BLOCK at most, each sent to the tasks.
    """
    stored = by_norm(usable(rows))
    own = stored.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "vector", "norm2")).alias("a")).select("vec_id", "a.*")
    own = saved(own, "anchors")
    blocks = max(1, -(-own.count() // ANCHOR_BLOCK))
    of_block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    if blocks == 1:
        return _of_block(stored, own.toArrow(), positives, negatives, lower, upper)
    folder = new_folder(rows.sparkSession, "negatives")
    for block in range(blocks):
        out = _of_block(stored, own.where(of_block == block).toArrow(), positives, negatives, lower, upper)
        out.write.mode("append").parquet(folder)
    return rows.sparkSession.read.schema(out.schema).parquet(folder)


def _of_block(stored: DataFrame, table: pa.Table, positives: int, negatives: int, lower: int, upper: int) -> DataFrame:
    """Run both scans for a block of anchors; the block and its positives are of bounded size and go to the tasks."""
    spark = stored.sparkSession
    n = table.num_rows
    least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    sent = spark.sparkContext.broadcast(table)

    def likes() -> Search:
        return Search(Anchors(sent.value), np.arange(n), np.full(n, least), np.full(n, most), positives, same=True)

    first = _first(_scan(stored, likes), positives).orderBy("search", "rank").toArrow()  # at most `positives` rows an anchor
    anchor, score = first.column("search").to_numpy(), first.column("score").to_numpy()
    # Whole limits: the least s with 100 s >= lower * p and the greatest with 100 s <= upper * p, by Python's whole numbers.
    low = np.array([-(-lower * p // 100) for p in score.tolist()], dtype=np.int64)
    high = np.array([upper * p // 100 for p in score.tolist()], dtype=np.int64)
    held = spark.sparkContext.broadcast((anchor, low, high))

    def others() -> Search:
        return Search(Anchors(sent.value), *held.value, negatives, same=False)

    ids = table.column("vec_id").to_numpy()
    windows = spark.createDataFrame(pa.table({"search": np.arange(len(anchor)), "anchor_id": ids[anchor], "positive_id": first.column("vec_id").to_numpy(), "positive_score": score}))
    ranked = _first(_scan(stored, others), negatives).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
    return ranked.join(windows, "search").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(embeddings: DataFrame) -> DataFrame:
    """Mine hard negatives for the anchors, rows whose vec_id is divisible by 100: a row per anchor, positive and negative.

    Rows with a null id, label or vector, or a null or non-finite component, take no part; an empty
    table gives an empty one; ties go to the smaller vec_id; other columns do not matter. For rows
    that share a vec_id see hard_negatives.
    """
    return hard_negatives(embeddings, F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON b.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
