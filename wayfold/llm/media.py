"""Media columns: content-addressed payloads in tar shards, read back by byte ranges.

Each task writes its payloads as grey PNG images, 64 samples of 8 bits a row, into a tar shard of
its own in a shared folder, a payload once per shard under its SHA-256. Rows carry digest, shard, offset and length.
Width, height and depth come from a read of the member's header alone; features from the whole member.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.scratch import bounded_batches, new_folder, saved

WIDTH = 64
BLOCK = 512
SHARD_BYTES = 256 << 20
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Tar header, PNG signature, and the IHDR chunk: all that a header-only read fetches.
HEADER_BYTES = BLOCK + 8 + 25

ROWS = "n_bytes long, payload_bytes long, digest string, shard string, offset long, length long"


def padded(data: bytes) -> bytes:
    """Append zero bytes up to a positive multiple of the width."""
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """Store a payload as an 8-bit grey image. The same payload always gives the same bytes."""
    rows = len(payload) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), dtype=np.uint8)  # each row starts with filter type 0
    lines[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return PNG_SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 3)) + _chunk(b"IEND", b"")


def png_header(data: bytes) -> tuple[int, int, int]:
    """Return width, height and bit depth from an image's first 33 bytes."""
    if data[:8] != PNG_SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    return struct.unpack(">IIB", data[16:25])


def from_png(data: bytes) -> bytes:
    """Read the samples back, checking every chunk."""
    at, packed = 8, []
    width, height, _ = png_header(data)
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("damaged PNG chunk")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


def feature(payload: bytes, width: int, height: int, depth: int) -> str:
    """Describe the samples: size, depth, mean, spread, share of zeros, and shares of eight value ranges in 1/255."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    shares = np.bincount(samples >> 5, minlength=8) * 255 // len(samples)
    return f"{width}x{height}x{depth} mean={samples.mean():.3f} std={samples.std():.3f} zeros={(samples == 0).mean():.4f} bands={bytes(shares.astype(np.uint8)).hex()}"


class ShardWriter:
    """Writes members to tar shards under a folder, starting a new shard when one is full."""

    def __init__(self, root: str):
        self.fs, self.root = pafs.FileSystem.from_uri(root)
        self.scheme = root[: len(root) - len(self.root)] if root.endswith(self.root) else ""
        self.fs.create_dir(self.root)
        self.out, self.known = None, {}

    def add(self, name: str, payload: bytes) -> tuple[str, int, int]:
        """Store a payload unless the shard has it; return shard, offset of its tar header, length of the stored image."""
        if name not in self.known:
            if self.out is None or self.at > SHARD_BYTES:
                self.close()
                # A repeated task writes under another name, so no shard is ever written over.
                self.shard = f"{self.root}/shard-{uuid.uuid4().hex}.tar"
                self.out, self.at, self.known = self.fs.open_output_stream(self.shard), 0, {}
            image = to_png(payload)
            info = tarfile.TarInfo(f"{name}.png")
            info.size = len(image)
            member = info.tobuf(tarfile.USTAR_FORMAT) + image + bytes(-len(image) % BLOCK)
            self.out.write(member)
            self.known[name] = (self.scheme + self.shard, self.at, len(image))
            self.at += len(member)
        return self.known[name]

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(2 * BLOCK))
            self.out.close()
            self.out = None


def store_texts(df: DataFrame, root: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every whole text, as padded UTF-8, to tar shards under root; return id, sizes, digest, shard, offset, length.

    Null texts count as empty. Running the plan writes shards, so store the rows before using them twice.
    The memory of a task is one batch and the digests of one shard.
    """
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ShardWriter(root)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                data = (text.as_py() or "").encode()
                payload = padded(data)
                digest = hashlib.sha256(payload).hexdigest()
                rows.append((len(data), len(payload), digest, *writer.add(digest, payload)))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.record_batch([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=[id_col, "n_bytes", "payload_bytes", "digest", "shard", "offset", "length"])
        writer.close()

    return df.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, f"{id_col} long, {ROWS}")


def _by_shard(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "shard", F.floor(F.col("offset") / (4 << 20))).sortWithinPartitions("shard", "offset")


def _ranged(rows: DataFrame, names: list[str], kinds: list[pa.DataType], read) -> DataFrame:
    """Add what read(file, offset, length) returns to each row; a member is read once for neighbouring rows that share it."""
    fields = ", ".join(f"{n} {'string' if k == pa.string() else 'long'}" for n, k in zip(names, kinds, strict=True))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", " + fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, file, last, value = None, None, None, None
        for batch in batches:
            out = []
            keys = zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist(), batch.column("length").to_pylist(), strict=True)
            for key in keys:
                if key[0] != shard:
                    if file:
                        file.close()
                    fs, path = pafs.FileSystem.from_uri(key[0])
                    shard, file = key[0], fs.open_input_file(path)
                if key != last:
                    last, value = key, read(file, key[1], key[2])
                out.append(value)
            cols = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.record_batch([*batch.columns, *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=[*batch.schema.names, *names])

    return _by_shard(rows).mapInArrow(run, schema)


def header_columns(rows: DataFrame) -> DataFrame:
    """Add width, height and depth by reading only each member's first 545 bytes."""

    def read(file, offset, length):
        return png_header(file.read_at(HEADER_BYTES, offset)[BLOCK:])

    return _ranged(rows, ["width", "height", "depth"], [pa.int64()] * 3, read)


def read_media(rows: DataFrame) -> DataFrame:
    """Read the stored members back and add payload_sha256, tail_crc32, media_bytes, media_sha256 and feature.

    The header's range is read first and fills width, height and depth; the image's range is read after.
    """

    def read(file, offset, length):
        width, height, depth = png_header(file.read_at(HEADER_BYTES, offset)[BLOCK:])
        image = file.read_at(length, offset + BLOCK)
        payload = from_png(image)
        return (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(image), hashlib.sha256(image).hexdigest(), feature(payload, width, height, depth), width, height)

    names = ["payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"]
    return _ranged(rows, names, [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()], read)


def op6_media(documents: DataFrame) -> DataFrame:
    """Store every whole text of documents in tar shards in the shared folder, and read all of them back."""
    root = new_folder(documents.sparkSession, "media")
    rows = saved(store_texts(documents.select("doc_id", "text"), root), "media-rows")
    return read_media(rows).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "digest", "width", "height")
