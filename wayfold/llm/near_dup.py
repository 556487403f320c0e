"""Near duplicates: b-bit MinHash signatures, a multi-index Hamming join, and an exact check on full sets.

A document's set is its distinct five-word shingles. Its signature has 65 slots of 16 bits; slots of
two documents agree about as often as their sets are similar. Documents with equal sets become one node.

1. Multi-index: all slots are split into chunks, so many that of two signatures within the distance of
   step 2 some chunk differs in at most one slot (pigeonhole). Each chunk is keyed with each slot left
   out in turn, so all such pairs share a key.
2. In every key's group signatures are compared, and a spanning forest of the pairs with at most
   `most_differing(percent)` differing slots goes on; components of these are families. A pair at the
   limit itself differs in more slots with a probability of at most LOSS (binomial), the only way to miss it.
3. Within a family, full sets are compared until all links are known or implied, and the components of the confirmed links
   are the result.

Groups larger than a block are compared block by block against the group's pivot first; only rows that
did not connect to it there meet the other blocks (see `connected`). No link is left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.scratch import bounded_batches, saved
from wayfold.operators.graph import components

WORDS = 5
SLOTS = 65
#: Probability that a pair just similar enough differs in more slots than are compared.
LOSS = 1e-6
#: Rows of a group in one block, and shingles of a family in one block.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1_000_000
#: Bytes of text hashed at once in a task.
SLICE_BYTES = 2 << 20


def most_differing(percent: int) -> int:
    """Return the least number of slots that a pair at the limit exceeds with a probability of at most LOSS."""
    differ, more, most = 1 - percent / 100, 1.0, -1
    while more > LOSS:
        most += 1
        more = sum(math.comb(SLOTS, k) * differ**k * (1 - differ) ** (SLOTS - k) for k in range(most + 1, SLOTS + 1))
    return most


def chunk_slots(percent: int) -> list[list[int]]:
    """Split the slots into chunks, of which one or more differ in at most one slot where most_differing(percent) slots differ."""
    chunks = most_differing(percent) // 2 + 1
    return [list(range(c * SLOTS // chunks, (c + 1) * SLOTS // chunks)) for c in range(chunks)]


#: At 85 in 100, where all chunks are alike.
CHUNKS, CHUNK_SLOTS = len(chunk_slots(85)), len(chunk_slots(85)[0])

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=_U)


def _slot_factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 2**64, SLOTS, dtype=_U) | _U(1), rng.integers(0, 2**64, SLOTS, dtype=_U)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Return each text's sorted distinct shingle hashes: of UTF-8 bytes, A-Z in lower case, words parted by ASCII white space.

    A text of fewer words has its whole sequence as one shingle; one without words has none.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    none = [np.zeros(0, _U) for _ in texts]
    if not len(data):
        return none
    data = data + np.uint8(32) * ((data >= 65) & (data <= 90))
    first = np.zeros(len(data) + 1, dtype=bool)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    first[bounds] = True
    space = (data == 32) | ((data >= 9) & (data <= 13))
    before, after = np.concatenate([[True], space[:-1]]) | first[:-1], np.concatenate([space[1:], [True]]) | first[1:]
    starts, ends = np.nonzero(~space & before)[0], np.nonzero(~space & after)[0] + 1
    if not len(starts):
        return none
    powers = np.full(len(data), _BASE)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.concatenate([[_U(0)], np.cumsum((data.astype(_U) + _U(1)) * powers)])
    back = np.full(len(data), _INVERSE)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    hashes = _mix((sums[ends] - sums[starts]) * back[starts])
    cuts = np.searchsorted(starts, bounds)
    rolled = np.zeros(max(0, len(hashes) - words + 1), _U)
    for k in range(words):
        rolled += hashes[k : len(hashes) - words + 1 + k] * _PLACES[k]
    rolled = _mix(rolled)
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            out.append(_mix(np.array([(hashes[a:b] * _PLACES[: b - a]).sum() + _U(b - a)], dtype=_U)))
        else:
            out.append(np.zeros(0, _U))
    return out


def signatures(sets: list[np.ndarray]) -> list[bytes | None]:
    """Return each set's signature: the lowest 16 bits, after mixing, of the least value of each of 65 hash functions."""
    full = [i for i, s in enumerate(sets) if len(s)]
    out: list[bytes | None] = [None] * len(sets)
    if not full:
        return out
    values = np.concatenate([sets[i] for i in full])
    at = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
    least = np.empty((len(full), SLOTS), _U)
    for k, (factor, plus) in enumerate(zip(*_slot_factors(), strict=True)):
        least[:, k] = np.minimum.reduceat(values * factor + plus, at)
    low = (_mix(least) & _U(0xFFFF)).astype("<u2")
    for row, i in zip(low, full, strict=True):
        out[i] = row.tobytes()
    return out


def _slices(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Yield (first row, texts) so that no slice but a single long text is over SLICE_BYTES."""
    start, part, size = 0, [], 0
    for i, text in enumerate(column):
        data = (text.as_py() or "").encode()
        if part and size + len(data) > SLICE_BYTES:
            yield start, part
            start, part, size = i, [], 0
        part.append(data)
        size += len(data)
    if part:
        yield start, part


def signed(documents: DataFrame) -> DataFrame:
    """Return doc_id, n_shingles, digest (of the set; null if empty) and sig for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in _slices(batch.column(1)):
                sets = shingle_sets(texts)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.record_batch(
                    [batch.column(0).slice(start, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures(sets), pa.binary())],
                    names=["doc_id", "n_shingles", "digest", "sig"],
                )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, sig binary")


def chunk_keys(percent: int):
    """Return an array column of the keys of `sig`: a hash of each chunk with each of its slots left out."""
    keys = []
    for chunk, slots in enumerate(chunk_slots(percent)):
        slot = [F.substring("sig", 2 * i + 1, 2) for i in slots]
        keys += [F.xxhash64(F.lit(chunk), F.lit(out), *[s for i, s in enumerate(slot) if i != out]) for out in range(len(slots))]
    return F.array(*keys)


class Union:
    """Sets of row numbers that are known to be connected."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _streamed(batches: Iterator[pa.RecordBatch], keys: int, handle: Callable[[tuple, list[tuple]], list[tuple]]) -> Iterator[pa.RecordBatch]:
    """Hand over each run of rows that share their first `keys` columns; yield what comes back: group, a, b. One run is held at a time."""
    key, rows, out = None, [], []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[:keys] != key:
                if rows:
                    out += handle(key, rows)
                key, rows = row[:keys], []
            rows.append(row[keys:])
        if len(out) > 10_000:
            yield _found(out)
            out = []
    if rows:
        out += handle(key, rows)
    yield _found(out)


def _found(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) or [[]] * 3
    return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["group", "a", "b"])


def _forest(compare: Callable[[list[bytes], np.ndarray], list[tuple[int, int]]], rows: list[tuple], role: np.ndarray) -> list[tuple[int, int]]:
    nodes = [r[0] for r in rows]
    return [(nodes[i], nodes[j]) for i, j in compare([r[-1] for r in rows], role) if nodes[i] != nodes[j]]


def connected(members: DataFrame, compare: Callable[[list[bytes], np.ndarray], list[tuple[int, int]]], name: str) -> DataFrame:
    """Return a, b: pairs of nodes that connect all that comparing every two rows of each group would connect.

    members: group, pivot (the group's least node), rows, blocks, node, data; read up to three times, so a stored table.
    compare(data, role) returns a spanning forest of the rows' links, of those with different roles only if there are two roles.

    1. A block of a group is one task's work, with a copy of the pivot in it. What connects to the
       pivot in each block is connected throughout, so its pairs across blocks are implied: work and rows
       are linear in a group, however large, as far as its rows are near its pivot.
    2. The rest, rows that did not connect to the pivot in their block, meet all blocks of the group, a
       task per pair of blocks, so no link is lost. Groups of one block have no rest.
    """
    spark = members.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int")
    upto = lambda c: F.sequence(F.lit(0), (F.col(c) - 1).cast("int"))
    dealt = members.withColumn("part", F.explode(F.when(F.col("node") == F.col("pivot"), upto("blocks")).otherwise(F.array(own))))
    dealt = dealt.repartition(parts, "group", "part").sortWithinPartitions("group", "part", "node").select("group", "part", "blocks", "pivot", "node", "data")

    def first(key: tuple, rows: list[tuple]) -> list[tuple]:
        group, _, blocks, pivot = key
        edges = _forest(compare, rows, np.zeros(len(rows), np.int8))
        out = [(group, a, b) for a, b in edges]
        if blocks > 1:
            nodes = sorted({r[0] for r in rows})
            at = {n: i for i, n in enumerate(nodes)}
            known = Union(len(nodes))
            for a, b in edges:
                known.join(at[a], at[b])
            out += [(group, n, n) for n in nodes if known.find(at[n]) != known.find(at[pivot])]
        return out

    found = saved(dealt.mapInArrow(lambda batches: _streamed(batches, 4, first), "group long, a long, b long"), name)
    edges = found.where("a <> b").select("a", "b")
    rest = found.where("a = b").select("group", F.col("a").alias("node")).distinct()
    if rest.isEmpty():
        return edges
    left = rest.groupBy("group").agg(F.count("*").alias("_n"))
    again = members.drop("data").join(left, "group").join(rest.withColumn("rest", F.lit(1).cast("long")), ["group", "node"], "left")
    again = again.select("group", "node", "blocks", F.ceil(F.col("blocks") * F.col("_n") / F.col("rows")).cast("long").alias("rest_blocks"), F.coalesce("rest", F.lit(0).cast("long")).alias("rest"))
    other = F.pmod(F.xxhash64("node", F.lit(5)), F.col("rest_blocks")).cast("int")
    place = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), F.lit(role).alias("role"))
    as_all = F.transform(upto("rest_blocks"), lambda i: place(i, own, 0))
    as_rest = F.transform(F.when(F.col("rest") == 1, upto("blocks")).otherwise(F.array().cast("array<int>")), lambda j: place(other, j, 1))
    dealt = members.select("group", "node", "data").join(again, ["group", "node"]).withColumn("at", F.explode(F.concat(as_all, as_rest))).select("group", "at.i", "at.j", "node", "at.role", "data")
    dealt = dealt.repartition(parts, "group", "i", "j").sortWithinPartitions("group", "i", "j", "node", "role")

    def across(key: tuple, rows: list[tuple]) -> list[tuple]:
        return [(key[0], a, b) for a, b in _forest(compare, rows, np.array([r[1] for r in rows], np.int8))]

    return edges.union(dealt.mapInArrow(lambda batches: _streamed(batches, 3, across), "group long, a long, b long").select("a", "b"))


def near_signatures(percent: int) -> Callable[[list[bytes], np.ndarray], list[tuple[int, int]]]:
    """Return a comparison that finds a spanning forest of the pairs whose signatures differ in at most most_differing(percent) slots."""
    most = most_differing(percent)

    def compare(data: list[bytes], role: np.ndarray) -> list[tuple[int, int]]:
        sig = np.frombuffer(b"".join(data), dtype="<u2").reshape(len(data), SLOTS)
        known, out, mixed = Union(len(data)), [], role.any()
        for i in range(len(data) - 1):
            near = (sig[i + 1 :] != sig[i]).sum(1) <= most
            if mixed:
                near &= role[i + 1 :] != role[i]
            for j in (np.nonzero(near)[0] + i + 1).tolist():
                if known.join(i, j):
                    out.append((i, j))
        return out

    return compare


def similar_sets(percent: int) -> Callable[[list[bytes], np.ndarray], list[tuple[int, int]]]:
    """Return a comparison that finds a spanning forest of the links of full sets; pairs already connected are implied."""

    def compare(data: list[bytes], role: np.ndarray) -> list[tuple[int, int]]:
        order = sorted(range(len(data)), key=lambda k: len(data[k]))
        sets = [np.frombuffer(data[k], dtype=_U) for k in order]
        sizes, roles = np.array([len(s) for s in sets]), role[order]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        number = np.unique(np.concatenate(sets), return_inverse=True)[1]
        known, out, mixed = Union(len(sets)), [], role.any()
        mark = np.zeros(number.max() + 1, dtype=np.int32)
        for i in range(len(sets) - 1):
            # Sorted by size, so only a run of larger sets can be similar enough.
            end = int(np.searchsorted(sizes * percent, 100 * sizes[i], side="right"))
            if end <= i + 1:
                continue
            own = number[bounds[i] : bounds[i + 1]]
            mark[own] = 1
            both = np.add.reduceat(mark[number[bounds[i + 1] : bounds[end]]], bounds[i + 1 : end] - bounds[i + 1])
            mark[own] = 0
            hit = 100 * both >= percent * (sizes[i] + sizes[i + 1 : end] - both)
            if mixed:
                hit &= roles[i + 1 : end] != roles[i]
            for j in (np.nonzero(hit)[0] + i + 1).tolist():
                if known.join(i, j):
                    out.append((order[i], order[j]))
        return out

    return compare


def _member_sets(documents: DataFrame, members: DataFrame) -> DataFrame:
    """Add `data`, the shingle set, to members (long columns, node among them), whole texts hashed anew; a batch gives a repeated row once."""
    names = members.columns
    rows = documents.select(F.col("doc_id").cast("long").alias("node"), "text").join(members, "node").select(*names, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()
            for start, texts in _slices(batch.column(len(names))):
                sets = shingle_sets(texts)
                keep = []
                for k, (node, s) in enumerate(zip(batch.column(names.index("node")).slice(start, len(sets)).to_pylist(), sets, strict=True)):
                    mark = (node, hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    if len(s) and mark not in seen:
                        seen.add(mark)
                        keep.append(k)
                at = pa.array([start + k for k in keep], pa.int64())
                yield pa.record_batch([*[batch.column(c).take(at) for c in range(len(names))], pa.array([sets[k].tobytes() for k in keep], pa.binary())], names=[*names, "data"])

    return rows.mapInArrow(run, ", ".join(f"`{n}` long" for n in names) + ", data binary")


def near_duplicates(documents: DataFrame, percent: int = 80) -> DataFrame:
    """Return doc_id, n_shingles, component_id and kept for every row of documents.

    Documents are linked where 100 * shared shingles >= percent * shingles of either (percent from 70
    to 100, as the signature bounds are set for it). component_id is the least doc_id reachable, kept
    tells whether that is the document itself. Null and empty texts have no shingles and no links. A
    row without doc_id links nothing and has no component_id. Rows that share a doc_id are one document.
    """
    if not 70 <= percent <= 100:
        raise ValueError("percent must be from 70 to 100")
    bounded_batches(documents.sparkSession)
    rows = saved(signed(documents), "signed")
    nodes = rows.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    nodes = saved(nodes, "nodes")

    keys = nodes.select("node", F.explode(chunk_keys(percent)).alias("group"))
    shared = keys.groupBy("group").agg(F.count("*").alias("rows"), F.min("node").alias("pivot")).where("rows > 1")
    shared = shared.withColumn("blocks", F.ceil(F.col("rows") / BLOCK_ROWS).cast("long"))
    shared = saved(keys.join(shared, "group"), "keys")
    signed_keys = saved(shared.join(nodes.select("node", F.col("sig").alias("data")), "node"), "signed-keys")
    families = components(connected(signed_keys, near_signatures(percent), "near"), "a", "b")

    sizes = families.join(nodes.select("node", "n"), "node").groupBy("label").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("n") / BLOCK_SHINGLES)).cast("long")
    members = families.join(sizes.select("label", "rows", blocks.alias("blocks")), "label").select(F.col("label").alias("group"), F.col("label").alias("pivot"), "rows", "blocks", "node")
    sets = saved(_member_sets(documents, members), "sets")
    labels = components(connected(sets, similar_sets(percent), "links"), "a", "b")

    by_digest = nodes.join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "digest").join(by_digest, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(documents: DataFrame, percent: int = 80) -> DataFrame:
    """Keep one row of each group of near duplicates, the one with the least doc_id; columns as in documents.

    Documents without words and rows without doc_id are in no group and stay. Of rows that share a
    doc_id one stays.
    """
    kept = near_duplicates(documents, percent).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct()
    rows = documents.join(kept, F.col("doc_id") == F.col("_id"), "left_semi")
    return rows.dropDuplicates(["doc_id"]).unionByName(documents.where("doc_id IS NULL"))


def op7_near_dup(documents: DataFrame) -> DataFrame:
    """Group all documents at a similarity of 85 in 100."""
    return near_duplicates(documents, 85)
