"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text becomes the set of its paragraphs' 64-bit digests; long lines are parted after sentence marks,
and at 160 characters where there are none. Each digest goes into one cell of each of three
subtables; a cell keeps a count, the xor of its digests and the xor of their checks. Subtracting one
version's cells from another's leaves those of the differing digests. Peeling takes out digests that
are alone in a cell until no cell is left; if it gets stuck, the sketches are made again four times larger.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.scratch import bounded_batches

#: Cells of a subtable in the stored fingerprint; three subtables of 8 cells settle about 18 differing paragraphs.
CELLS = 8
TABLES = 3
GROWTH = 4
PIECE = re.compile(r"[^\n.!?|]{1,160}[.!?|]*|[.!?|]+")

_U = np.uint64
_MIX = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9))


def paragraphs(text: str) -> np.ndarray:
    """Return the sorted distinct digests of a text's paragraphs, those of white space alone left out."""
    pieces = {s for p in PIECE.findall(text) if (s := p.strip())}
    return np.unique(np.array([xxhash.xxh3_64_intdigest(p) for p in pieces], dtype=_U))


def _mixed(keys: np.ndarray, by: np.uint64) -> np.ndarray:
    x = (keys ^ (keys >> _U(29))) * by
    return x ^ (x >> _U(32))


def checks(keys: np.ndarray) -> np.ndarray:
    return _mixed(keys ^ _U(0xD6E8FEB86659FD93), _MIX[0])


def cells_of(keys: np.ndarray, cells: int) -> np.ndarray:
    """Return each key's cell in each subtable, subtables after one another: shape (3, keys)."""
    return np.stack([(_mixed(keys, m) >> _U(7)) % _U(cells) + _U(i * cells) for i, m in enumerate(_MIX)]).astype(np.int64)


def sketch(groups: np.ndarray, keys: np.ndarray, n: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Make n sketches at once; groups says which sketch a key goes to. Return counts, key xors, check xors: shape (n, 3 * cells)."""
    width = TABLES * cells
    count, xor, check = np.zeros(n * width, np.int64), np.zeros(n * width, _U), np.zeros(n * width, _U)
    own = checks(keys)
    for at in cells_of(keys, cells):
        at = at + groups * width
        count += np.bincount(at, minlength=n * width)
        np.bitwise_xor.at(xor, at, keys)
        np.bitwise_xor.at(check, at, own)
    return count.reshape(n, width), xor.reshape(n, width), check.reshape(n, width)


def subtract(a: tuple, b: tuple) -> tuple:
    return a[0] - b[0], a[1] ^ b[1], a[2] ^ b[2]


def peel(diff: tuple, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Peel subtracted sketches, all at once. Return per recovered digest its sketch, itself and its sign (+1: only in the first); and which sketches came out whole."""
    count, xor, check = (x.copy() for x in diff)
    n, width = count.shape
    rows, keys, signs = [], [], []
    # Each round takes out what is alone in a cell; a sketch cannot yield more rounds than it has cells.
    for _ in range(4 * width):
        alone = (np.abs(count) == 1) & (checks(xor) == check)
        row, cell = np.nonzero(alone)
        if not len(row):
            break
        key, sign = xor[row, cell], count[row, cell]
        first = np.unique(np.stack([row.astype(_U), key]), axis=1, return_index=True)[1]  # a digest may be alone in several cells
        row, key, sign = row[first], key[first], sign[first]
        for at in cells_of(key, cells):
            np.subtract.at(count, (row, at), sign)
            np.bitwise_xor.at(xor, (row, at), key)
            np.bitwise_xor.at(check, (row, at), checks(key))
        rows.append(row), keys.append(key), signs.append(sign)
    whole = ~(count.any(1) | xor.any(1) | check.any(1))
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join(rows, np.int64), join(keys, _U), join(signs, np.int64), whole


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets) if sets else np.zeros(0, _U)


def differences(a: list[np.ndarray], b: list[np.ndarray], cells: int = CELLS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Recover, by sketches alone, the digests that only a[i] and only b[i] hold; sketches that fail are made again larger."""
    out: list = [None] * len(a)
    todo = np.arange(len(a))
    while len(todo):
        for part in np.array_split(todo, max(1, len(todo) * cells // 200_000)):
            (ga, ka), (gb, kb) = _flat([a[i] for i in part]), _flat([b[i] for i in part])
            row, key, sign, whole = peel(subtract(sketch(ga, ka, len(part), cells), sketch(gb, kb, len(part), cells)), cells)
            order = np.argsort(row, kind="stable")
            row, key, sign = row[order], key[order], sign[order]
            ends = np.searchsorted(row, np.arange(len(part) + 1))
            for j in np.nonzero(whole)[0]:
                k, s = key[ends[j] : ends[j + 1]], sign[ends[j] : ends[j + 1]]
                out[part[j]] = (k[s > 0], k[s < 0])
        todo = np.array([i for i in todo if out[i] is None], dtype=np.int64)
        cells *= GROWTH
    return out


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> list[float]:
    """Shared paragraphs over all paragraphs of two texts, from sketch sizes and recovered differences; 1 if both have none."""
    out = []
    for x, y, (only_x, only_y) in zip(a, b, differences(a, b), strict=True):
        both = len(x) - len(only_x)
        every = both + len(only_x) + len(only_y)
        out.append(both / every if every else 1.0)
    return out


def encode(sets: list[np.ndarray]) -> list[str]:
    """Write each set's sketch as text: number of digests, then all cells' counts, digests and checks."""
    count, xor, check = sketch(*_flat(sets), len(sets), CELLS)
    body = np.concatenate([count.astype("<u4").view(np.uint8), xor.view(np.uint8), (check >> _U(32)).astype("<u4").view(np.uint8)], axis=1)
    return [f"{len(s)}:{base64.b64encode(b.tobytes()).decode()}" for s, b in zip(sets, body, strict=True)]


def edited(text: str, following: str) -> str:
    """Replace the last quarter of a text by as many first characters of the next document, or all of it."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def with_next(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Deal rows into ranges of the key, each with the first row of the next range at its end; the last range gets the first row of all.

    Bounds are quantiles of the key, so a range holds about as many rows as another. Adds _bucket and
    _place (1 for rows that only end a range). A range's rows are one task's, in order, read as a stream.
    """
    spark = df.sparkSession
    bounds = sorted(set(df.where(F.col(key).isNotNull()).approxQuantile(key, [i / buckets for i in range(1, buckets)], 0.1 / buckets)))
    dealt = df.withColumn("_key", F.coalesce(F.col(key).cast("double"), F.lit(float("-inf"))))
    if bounds:
        dealt = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol="_key", outputCol="_bucket").transform(dealt)
    else:
        dealt = dealt.withColumn("_bucket", F.lit(0))
    dealt = dealt.withColumn("_bucket", F.col("_bucket").cast("int")).drop("_key")
    # A row per range, whatever the number of rows: the range's least key, null before all.
    firsts = dealt.groupBy("_bucket").agg(F.min(F.struct(F.col(key).isNotNull().alias("some"), key)).alias("least")).orderBy("_bucket").collect()
    ends = [(r["least"][key], firsts[i - 1]["_bucket"]) for i, r in enumerate(firsts)]
    ends = spark.createDataFrame(ends, "_least long, _to int")
    lead = dealt.join(F.broadcast(ends), F.col(key).eqNullSafe(F.col("_least"))).withColumn("_bucket", F.col("_to")).drop("_least", "_to")
    both = dealt.withColumn("_place", F.lit(0)).unionByName(lead.withColumn("_place", F.lit(1)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(parts, "_bucket").sortWithinPartitions("_bucket", "_place", F.col(key).asc_nulls_first(), "text")


def op3_fingerprint(documents: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprint every whole text and its edited text; null texts count as empty.

    The next document is the next by doc_id (null first), ties by text; after the last comes the first.
    Repeated rows are documents of their own. One document alone is its own next. The fingerprint
    column is a sketch of fixed size; the likeness columns come from sketches that grow until they peel.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(docs, "doc_id", buckets).select("_bucket", "_place", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (bucket, doc_id, text, paragraphs) of a row that waits for the next; nothing more is kept
        ended = None  # the range whose end was seen
        for batch in batches:
            out: list[tuple] = []
            for bucket, place, doc_id, text in zip(*[batch.column(i).to_pylist() for i in range(3)], batch.column(3), strict=True):
                if bucket == ended and place:
                    continue
                text = text.as_py()
                own = paragraphs(text)
                if last is not None:
                    out.append((*last[1:], text, own))
                if place:
                    last, ended = None, bucket
                else:
                    last = (bucket, doc_id, text, own)
            for start in range(0, len(out), 500):
                yield _fingerprints(out[start : start + 500])

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInArrow(run, schema)


def _fingerprints(rows: list[tuple]) -> pa.RecordBatch:
    ids, texts, own, following, next_sets = zip(*rows, strict=True)
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    changed_sets = [paragraphs(t) for t in changed]
    own, next_sets = list(own), list(next_sets)
    columns = {
        "doc_id": pa.array(ids, pa.int64()), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
        "fingerprint": pa.array(encode(own)), "edited_fingerprint": pa.array(encode(changed_sets)),
        "near_edited": pa.array(likeness(own, changed_sets)), "near_next": pa.array(likeness(own, next_sets)),
    }
    return pa.record_batch(list(columns.values()), names=list(columns))
