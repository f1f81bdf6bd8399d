"""Media columns: payloads in tar shards, rows with digest, shard, offset and length.

A text becomes an 8-bit greyscale PNG of 576 samples a row. The image's SHA-256 is its name in the tar
shard and its address: every digest has one place, and every row points to that byte range. Tasks write
without knowing of each other, so an image may be written once a task; then only digests and places
are shuffled, the first place of a digest becomes its home, and the other ones are never read. Metadata
columns come from range reads of the PNG header alone; only a reader that asks for samples fetches
the whole range. Each place is read once, however many rows point to it. Each attempt at a task writes shards of its own, and the index, a Parquet table that
Spark commits, names those of the attempts that ended well, so a lost executor costs only a repeat.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_text, new_path, ranges_for, saved

WIDTH, LEVEL = 576, 1
#: A shard is closed once it has so many bytes.
SHARD = 64 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature and IHDR chunk.
HEADER = 33


def payload(text: str) -> bytes:
    """UTF-8, then bytes 255 up to a positive multiple of WIDTH."""
    raw = text.encode()
    return raw + b"\xff" * (max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(samples: bytes) -> bytes:
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    filtered = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row starts with its filter, 0: none
    filtered[:, 1:] = rows
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bits a sample and colour type from the first HEADER bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not a PNG header")
    return struct.unpack(">IIBB", head[16:26])


def from_png(data: bytes) -> bytes:
    """The samples of an image made by ``to_png``."""
    width, height, bits, colour = png_header(data[:HEADER])
    if (bits, colour) != (8, 0):
        raise ValueError("not 8-bit greyscale")
    at, packed = HEADER, []
    while data[at + 4 : at + 8] != b"IEND":
        n = struct.unpack(">I", data[at : at + 4])[0]
        if data[at + 4 : at + 8] == b"IDAT":
            packed.append(data[at + 8 : at + 8 + n])
        at += n + 12
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("a filter that to_png doesn't use")
    return rows[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Mean and spread of the samples, and a 64-bit hash of their brightness on an 8 x 8 grid."""
    a = np.frombuffer(samples, np.uint8)
    image = a.reshape(-1, WIDTH).astype(np.int64)
    edges = np.arange(9) * len(image) // 8
    bands = [image[p : max(q, p + 1)] for p, q in zip(edges[:-1], edges[1:], strict=True)]  # short images repeat rows
    grid = np.array([b.sum(axis=0).reshape(8, WIDTH // 8).sum(axis=1) * 1000 // len(b) for b in bands])
    bits = np.packbits(grid.reshape(-1) * grid.size > grid.sum()).tobytes().hex()
    n, total, squares = len(a), int(image.sum()), int((image * image).sum())
    return f"mean={total * 1000 // n};var={(squares * n - total * total) // (n * n)};hash={bits}"


class ShardWriter:
    """Tar shards of one task; equal media are stored once."""

    def __init__(self, folder: str):
        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.store.create_dir(self.root, recursive=True)
        self.out, self.at, self.path, self.places = None, 0, "", {}

    def add(self, data: bytes) -> tuple[str, str, int]:
        """(digest, shard, offset) of the stored bytes."""
        digest = hashlib.sha256(data).hexdigest()
        if digest not in self.places:
            if self.out is None or self.at >= SHARD:
                self.close()
                self.path, self.at = f"{self.root}/{uuid.uuid4().hex}.tar", 0
                self.out = self.store.open_output_stream(self.path)
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(data)
            head = info.tobuf(tarfile.USTAR_FORMAT if len(data) < 8 << 30 else tarfile.GNU_FORMAT)
            self.places[digest] = (self.path, self.at + len(head))
            block = head + data + b"\0" * (-len(data) % tarfile.BLOCKSIZE)
            self.out.write(block)
            self.at += len(block)
        return digest, *self.places[digest]

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * (2 * tarfile.BLOCKSIZE))
            self.out.close()
            self.out = None


class RangeReader:
    """Byte ranges of shards; the last shard stays open."""

    def __init__(self, folder: str):
        self.store, self.path, self.file = fs.FileSystem.from_uri(folder)[0], None, None

    def __call__(self, path: str, offset: int, n: int) -> bytes:
        if path != self.path:
            self.close()
            self.path, self.file = path, self.store.open_input_file(path)
        self.file.seek(offset)
        return self.file.read(n)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def write_media(docs: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Contents of ``docs`` (doc_id, n_bytes, digest), one row for each row, and media (digest, shard, offset, length), one row for each content.

    A null or empty text is an image of one row; no documents give no shards and empty tables.
    """

    def write(batches):
        shards = ShardWriter(folder)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                image = to_png(payload(text))
                rows.append((doc_id, len(text.encode()), *shards.add(image), len(image)))
            if rows:
                columns = zip(*rows, strict=True)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        shards.close()

    written = saved(id_text(docs).mapInArrow(write, "doc_id long, n_bytes long, digest string, shard string, offset long, length long"), "media-written")
    homes = written.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("home"))
    return written.select("doc_id", "n_bytes", "digest"), saved(homes.select("digest", "home.*"), "media")


def store_media(docs: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """The index (doc_id, n_bytes, digest, shard, offset, length), one row for each row of ``docs``, and the media, as in ``write_media``."""
    contents, media = write_media(docs, folder)
    return contents.join(media, "digest").select("doc_id", "n_bytes", "digest", "shard", "offset", "length"), media


def by_shard(index: DataFrame) -> DataFrame:
    """The index in ranges of (shard, offset), so that tasks have equal shares and read from front to back."""
    n = ranges_for(index.sparkSession, index.agg(F.sum("length")).first()[0])
    return index.repartitionByRange(n, "shard", "offset").sortWithinPartitions("shard", "offset")


def with_metadata(index: DataFrame, folder: str) -> DataFrame:
    """The index with width, height, bits and colour, from reads of HEADER bytes each."""

    def read(batches):
        get = RangeReader(folder)
        for batch in batches:
            heads = [png_header(get(p, o, HEADER)) for p, o in zip(batch["shard"].to_pylist(), batch["offset"].to_pylist(), strict=True)]
            for k, name in enumerate(("width", "height", "bits", "colour")):
                batch = batch.append_column(name, pa.array([h[k] for h in heads], pa.int64()))
            yield batch
        get.close()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema)
    return index.mapInArrow(read, f"{schema}, width long, height long, bits long, colour long")


def with_samples(index: DataFrame, folder: str) -> DataFrame:
    """The index with what its stored bytes give: digests of payload and media, and the feature string."""

    def read(batches):
        get, last, found = RangeReader(folder), None, ()
        for batch in batches:
            rows = []
            for digest, shard, offset, length in zip(*(batch[c].to_pylist() for c in ("digest", "shard", "offset", "length")), strict=True):
                if (shard, offset) != last:
                    data = get(shard, offset, length)
                    media = hashlib.sha256(data).hexdigest()
                    if media != digest:
                        raise ValueError(f"{shard} at {offset}: stored bytes don't have digest {digest}")
                    samples = from_png(data)
                    found = (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(data), media, feature(samples))
                    last = (shard, offset)
                rows.append(found)
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            for name, c, k in zip(("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"), columns, kinds, strict=True):
                batch = batch.append_column(name, pa.array(c, k))
            yield batch
        get.close()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema)
    return index.mapInArrow(read, f"{schema}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_report(docs: DataFrame) -> DataFrame:
    """Store every text as an image, fill metadata from headers, then read the images back.

    A null or empty text is one row of samples 255; repeated rows give repeated rows; no documents
    give none. Other columns are ignored.
    """
    folder = new_path(docs.sparkSession, "shards")
    contents, media = write_media(docs, folder)
    read = with_samples(with_metadata(by_shard(media), folder), folder).drop("shard", "offset", "length")
    return contents.join(read, "digest").select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"
    )
