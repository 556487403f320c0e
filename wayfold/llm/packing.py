"""Packing token pieces into sequences: dominance reduction, then best fit.

Sizes are whole numbers up to the capacity, so the whole instance is a histogram with at most
`capacity` rows, however many documents there are. The plan is made from the histogram alone, on
multiples of equal bins; Spark then deals the pieces of each size into the plan's places by rank.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.llm.scratch import bounded_batches, saved

CAPACITY = 2048
#: The end-of-text marker of the vocabulary; a text that holds it gets its id, as the tokenizers library does.
END_OF_TEXT, END_OF_TEXT_ID = "<|endoftext|>", 50256


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoder(path: str):
    """Load a byte-level BPE vocabulary kept as ranks, the one of byte_bpe_50k.json, which it encodes five times faster."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: END_OF_TEXT_ID})


@lru_cache(maxsize=2)
def whole_encoder(path: str):
    """Load the same vocabulary as a tokenizers file, beside the ranks."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path.removesuffix(".tiktoken") + ".json")


def token_ids(text: str, path: str) -> list[int]:
    """Return a text's ids, those of the tokenizers library.

    The ranks' encoder gives the same ones, as tests show; only on runs of a million white space characters or so
    its pattern matcher gives up, and such a text goes to the library itself.
    """
    try:
        return encoder(path).encode(text, allowed_special="all")
    except ValueError:
        return whole_encoder(path).encode(text, add_special_tokens=False).ids


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """Cut a document's ids into (start, length): only where longer than the capacity, the odd piece first."""
    first = length if length <= capacity else length % capacity
    ends = ([first] if first else []) + list(range(first + capacity, length + 1, capacity))
    return list(zip([0, *ends], ends, strict=False))


def token_pieces(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Encode every whole text, add id 0, and cut: doc_id, piece, start, length, ids_crc32. Null texts count as empty."""
    path = vocabulary or default_vocabulary()
    bounded_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*token_ids(text.as_py() or "", path), 0], dtype="<u4")
                for n, (start, end) in enumerate(cut(len(ids), capacity)):
                    out.append((doc_id, n, start, end - start, zlib.crc32(ids[start:end].tobytes())))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


class Stock:
    """Pieces left by size: counts, and the sizes in use in ascending order."""

    def __init__(self, counts: dict[int, int]):
        self.count = {s: n for s, n in counts.items() if n > 0}
        self.sizes = sorted(self.count)

    def take(self, sizes: Counter, times: int) -> None:
        for s, n in sizes.items():
            self.count[s] -= n * times
            if not self.count[s]:
                del self.count[s]
                del self.sizes[bisect.bisect_left(self.sizes, s)]

    def largest(self, limit: int, without: Counter) -> int:
        """Return the largest size up to the limit of which something is left besides `without`; 0 if none."""
        i = bisect.bisect_right(self.sizes, limit) - 1
        while i >= 0 and self.count[self.sizes[i]] <= without[self.sizes[i]]:
            i -= 1
        return self.sizes[i] if i >= 0 else 0

    def smallest(self, n: int, without: Counter) -> list[int]:
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(n - len(out), self.count[s] - without[s])
            if len(out) == n:
                break
        return out


def dominating_set(stock: Stock, a: int, capacity: int) -> Counter | None:
    """Return a set holding a piece of size a that dominates all sets that do, or None if none of up to three pieces is seen to.

    A set dominates another if the other's pieces can be parted so that each part fits in the place
    of one of its own. Some best packing then has it as a bin. With r the room beside a:
    a alone, if nothing fits in r; {a, b} with b the largest that fits, if b fills r or no two others fit
    together; {a, b, d}, if no three others fit together, d is the largest beside b, and the smaller
    of any two that fit together is at most d.
    """
    room, own = capacity - a, Counter([a])
    low = stock.smallest(3, own)
    if not low or low[0] > room:
        return own
    b = stock.largest(room, own)
    if b == room or len(low) < 2 or low[0] + low[1] > room:
        return own + Counter([b])
    d = stock.largest(room - b, own + Counter([b]))
    if not d or (len(low) == 3 and sum(low) <= room):
        return None
    y = stock.largest(room // 2, own)  # the largest that can be the smaller of two
    while y > d:
        x = stock.largest(room - y, own + Counter([y]))
        if x >= y:
            return None
        y = stock.largest(y - 1, own)
    return own + Counter([b, d])


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Counter, int]], Stock]:
    """Fix dominating sets from the largest piece down, each as often as it can be; return them and the stock that is left."""
    stock, fixed, tried = Stock(counts), [], capacity + 1
    while stock.sizes and (a := stock.largest(tried - 1, Counter())):
        found = dominating_set(stock, a, capacity)
        if found:
            # Fixing a set leaves what made it dominate true for as long as copies of all its pieces are left.
            times = min(stock.count[s] // n for s, n in found.items())
            stock.take(found, times)
            fixed.append((found, times))
            if a in stock.count:
                continue
        tried = a
    return fixed, stock


def best_fit(stock: Stock, capacity: int) -> list[tuple[Counter, int]]:
    """Pack the stock by best fit, largest first, on groups of equal bins: (pieces of a bin, number of such bins)."""
    open_bins: dict[int, list[tuple[Counter, int]]] = {}
    rooms: list[int] = []  # ascending

    def put(room: int, bins: Counter, times: int) -> None:
        if times:
            if room not in open_bins:
                bisect.insort(rooms, room)
            open_bins.setdefault(room, []).append((bins, times))

    for size in reversed(stock.sizes):
        left = stock.count[size]
        while left:
            i = bisect.bisect_left(rooms, size)
            if i < len(rooms):
                room = rooms[i]
                bins, times = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room], rooms[i]
            else:
                room, bins, times = capacity, Counter(), left  # as many new bins as could be wanted
            each = min(room // size, left)
            full = min(times, left // each)
            put(room - each * size, bins + Counter({size: each}), full)
            left -= full * each
            if bins:
                put(room, bins, times - full)
    return [group for groups in open_bins.values() for group in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Plan all bins. Return runs of places: (size, first rank, places in each bin, bins, first bin's number, offset of the first place)."""
    fixed, stock = reduce_instance(counts, capacity)
    runs, rank, number = [], Counter(), 0
    for bins, times in [*fixed, *best_fit(stock, capacity)]:
        offset = 0
        for size in sorted(bins, reverse=True):
            runs.append((size, rank[size], bins[size], times, number, offset))
            rank[size] += bins[size] * times
            offset += bins[size] * size
        number += times
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY, keys: tuple[str, ...] = ("doc_id", "piece"), size: str = "length") -> DataFrame:
    """Add sequence_id and offset to rows with a size of 1 to capacity, in as few sequences as the plan needs.

    Rows with equal keys and sizes are interchangeable. No size needs one task: rows of a size are
    salted, numbered within a salt, and get their rank from the counts of the salts before. pieces
    is read twice and should be a stored table. Columns of it named like the results are replaced.
    An empty table gives an empty table; a size out of bounds is an error.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    salts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int"))
    counts = salted.groupBy(size, "_salt").agg(F.count("*").alias("_n"))
    counts = saved(counts, "sizes")  # at most capacity * salts rows
    histogram = {r[0]: r[1] for r in counts.groupBy(size).agg(F.sum("_n")).collect()}
    if any(s is None or not 1 <= s <= capacity for s in histogram):
        raise ValueError(f"sizes must be from 1 to {capacity}")
    runs = spark.createDataFrame(plan(histogram, capacity), "_size long, _first long, _each long, _bins long, _number long, _at long")
    before = Window.partitionBy(size).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(size).alias("_c_size"), F.col("_salt").alias("_c_salt"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = salted.withColumn("_nr", F.row_number().over(Window.partitionBy(size, "_salt").orderBy(*keys)))
    ranked = ranked.join(offsets, (F.col(size) == F.col("_c_size")) & (F.col("_salt") == F.col("_c_salt")))
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_nr") - 1)
    # The runs depend on the sizes in use, not on the number of documents: some thousands of rows at most.
    placed = ranked.join(F.broadcast(runs), (F.col(size) == F.col("_size")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_each") * F.col("_bins")))
    nth = F.col("_rank") - F.col("_first")
    bin_nr = F.floor(nth / F.col("_each")).cast("long")
    out = placed.withColumn("sequence_id", F.col("_number") + bin_nr)
    out = out.withColumn("offset", (F.col("_at") + (nth - bin_nr * F.col("_each")) * F.col("_size")).cast("long"))
    return out.select(*pieces.columns, "sequence_id", "offset")


def op4_packing(documents: DataFrame) -> DataFrame:
    """Pack all documents into sequences of at most 2048 tokens. The texts are encoded once; only piece sizes and checksums move."""
    return pack(saved(token_pieces(documents), "pieces"))
