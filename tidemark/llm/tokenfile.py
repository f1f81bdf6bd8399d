"""Token ids in binary files: byte planes of fixed-size chunks, each compressed, with a chunk index.

File layout, all numbers little-endian:

    magic | chunks and blocks of the document table | index | size of index (8 bytes) | magic

A chunk is CHUNK ids (the last one fewer) transposed into byte planes, lowest byte first, each
compressed with zstandard on its own: the high planes of ids are nearly constant and shrink to almost
nothing. The document table has id, presence of the id and number of tokens of every document, in the
file's order, in blocks of TABLE documents. The index has position, number of ids, size of each plane and
crc32 of every chunk, and position, size and number of documents of every block, so that a reader fetches
only what it needs. A writer begins a new file beyond ROLL ids, so that what is held of a file, its index,
is bounded, and readers can share the files of one writer.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import word_encoder
from .shared import id_text, new_path, ranges_for, saved

MAGIC = b"TMTOKEN2"
CHUNK, LEVEL, END = 1 << 16, 3, 1
#: Documents in a block of the document table.
TABLE = 1 << 13
#: Ids of a file, about.
ROLL = 1 << 26
_DOCUMENT = [("id", "<i8"), ("named", "u1"), ("n", "<u8")]


def planes(ids: np.ndarray, width: int) -> list[bytes]:
    """The compressed byte planes of a chunk."""
    parts = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T)
    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    return [pack(p.tobytes()) for p in parts]


def from_planes(parts: list[bytes], n: int) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    for k, part in enumerate(parts):
        out[:, k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(part, max_output_size=n), np.uint8)
    return out.view("<u4").reshape(-1)


class TokenWriter:
    """Appends documents to one file; at most a chunk of ids and a block of the document table are held."""

    def __init__(self, out, width: int = 4):
        self.out, self.width, self.at = out, width, 0
        self.index, self.blocks, self.documents, self.held, self.n = [], [], [], [], 0
        self._write(MAGIC)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def append(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.documents.append((doc_id or 0, doc_id is not None, len(ids)))
        if len(self.documents) == TABLE:
            self._block()
        self.held.append(ids)
        self.n += len(ids)
        if self.n >= CHUNK:
            every = np.concatenate(self.held)
            whole = self.n // CHUNK * CHUNK
            for k in range(0, whole, CHUNK):
                self._chunk(every[k : k + CHUNK])
            self.held, self.n = [every[whole:]], self.n - whole

    def _chunk(self, ids: np.ndarray) -> None:
        parts = planes(ids, self.width)
        self.index.append(struct.pack(f"<QI{self.width}II", self.at, len(ids), *map(len, parts), zlib.crc32(ids.astype("<u4").tobytes())))
        for part in parts:
            self._write(part)

    def _block(self) -> None:
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(np.array(self.documents, _DOCUMENT).tobytes())
        self.blocks.append(struct.pack("<QII", self.at, len(packed), len(self.documents)))
        self._write(packed)
        self.documents = []

    def close(self) -> None:
        if self.n:
            self._chunk(np.concatenate(self.held))
        if self.documents:
            self._block()
        index = struct.pack("<BII", self.width, len(self.index), len(self.blocks)) + b"".join(self.index + self.blocks)
        self._write(index + struct.pack("<Q", len(index)) + MAGIC)


class TokenReader:
    """Random access to a file: the index is read first, then only the chunks asked for."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        tail = self._range(size - 16, 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a token file")
        n = struct.unpack("<Q", tail[:8])[0]
        index = self._range(size - 16 - n, n)
        self.width, chunks, blocks = struct.unpack_from("<BII", index)
        form, first = struct.Struct(f"<QI{self.width}II"), struct.calcsize("<BII")
        self.chunks = [form.unpack_from(index, first + k * form.size) for k in range(chunks)]
        self.blocks = [struct.unpack_from("<QII", index, first + chunks * form.size + k * 16) for k in range(blocks)]

    def documents(self) -> Iterator[tuple[int, int, int]]:
        """(id, whether it has one, number of ids) of every document, block by block."""
        for at, packed, n in self.blocks:
            plain = zstandard.ZstdDecompressor().decompress(self._range(at, packed), max_output_size=n * 17)
            yield from np.frombuffer(plain, _DOCUMENT).tolist()

    def _range(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def chunk(self, k: int) -> np.ndarray:
        at, n, *sizes, crc = self.chunks[k]
        raw, parts, to = self._range(at, sum(sizes)), [], 0
        for size in sizes:
            parts.append(raw[to : to + size])
            to += size
        ids = from_planes(parts, n)
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"chunk {k} is damaged")
        return ids

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from the file's ``start``-th on."""
        got, k = [], start // CHUNK
        while n > 0:
            part = self.chunk(k)[start - k * CHUNK :][:n]
            got.append(part)
            start, n, k = start + len(part), n - len(part), k + 1
        return np.concatenate(got) if got else np.zeros(0, "<u4")

    def each(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, place of its first id, ids) of every document; holds a document and a chunk at a time."""
        held, k, start = np.zeros(0, "<u4"), 0, 0
        for doc_id, named, n in self.documents():
            parts, size = [held], len(held)
            while size < n:
                parts.append(self.chunk(k))
                size, k = size + len(parts[-1]), k + 1
            every = np.concatenate(parts) if len(parts) > 1 else held
            yield (doc_id if named else None), start, every[:n]
            held, start = every[n:], start + n


def write_token_files(docs: DataFrame, folder: str, vocabulary: str = "word_bpe_49k.json", end: int = END, parts: int | None = None, roll: int = ROLL) -> DataFrame:
    """Encode ``docs`` into token files in ``folder``, in ascending doc_id order over all files; gives the files' table.

    Columns: part and file (their order), path, n_documents, n_ids. Null ids come first, and rows that
    repeat an id are ordered by their text's hash. A null or empty text is the end id alone; no documents
    give no files. Every attempt at a task writes files of its own, and the table names those of the
    attempts that ended well.
    """
    n = parts or ranges_for(docs.sparkSession, docs.agg(F.sum(F.octet_length("text"))).first()[0])
    key = ["doc_id", "hash"]

    def write(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, encode, tail = TaskContext.get().partitionId(), word_encoder(vocabulary), np.array([end], "<u4").tobytes()
        file, out, ids, documents = 0, None, 0, 0

        def closed():
            writer.close()
            out.close()
            return pa.RecordBatch.from_pydict({"part": [part], "file": [file], "path": [path], "n_documents": [documents], "n_ids": [ids]})

        for batch in batches:
            for doc_id, found in zip(batch["doc_id"].to_pylist(), encode.encode_many(batch["text"].to_pylist()), strict=True):
                if out is None:
                    path, ids, documents = f"{root}/part-{part:06d}-{file:06d}-{uuid.uuid4().hex}.ids", 0, 0
                    out = store.open_output_stream(path)
                    writer = TokenWriter(out, encode.width)
                array = np.frombuffer(found + tail, "<u4")
                writer.append(doc_id, array)
                documents, ids = documents + 1, ids + len(array)
                if ids >= roll:
                    yield closed()
                    file, out = file + 1, None
        if out is not None:
            yield closed()

    ranged = id_text(docs).withColumn("hash", F.xxhash64("text")).withColumn("text", F.col("text").cast("binary"))
    ordered = ranged.repartitionByRange(n, *key).sortWithinPartitions(*key).select("doc_id", "text")
    return saved(ordered.mapInArrow(write, "part long, file long, path string, n_documents long, n_ids long"), "token-files")


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (binary) of every document in ``files``; no files give no rows."""
    before = F.sum("n_ids").over(Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1))  # one row a file of ROLL ids
    based = files.withColumn("base", F.coalesce(before, F.lit(0)))
    n = ranges_for(files.sparkSession, files.agg(F.sum("n_ids") * 4).first()[0])
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def read(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, base in zip(batch["path"].to_pylist(), batch["base"].to_pylist(), strict=True):
                with store.open_input_file(path) as file:
                    rows, size = [], 0
                    for doc_id, start, ids in TokenReader(file).each():
                        rows.append((doc_id, base + start, ids.tobytes()))
                        size += 4 * len(ids) + 64
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return based.select("path", "base").repartition(n, "path").mapInArrow(read, "doc_id long, start long, ids binary")


def token_file_report(docs: DataFrame) -> DataFrame:
    folder = new_path(docs.sparkSession, "tokens")
    back = read_token_files(write_token_files(docs, folder), folder)
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
