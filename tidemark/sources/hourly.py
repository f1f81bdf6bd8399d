"""The hourly archive as a data source of its own, in batch and as a stream.

    spark.dataSource.register(HourlyArchive)
    spark.read.format("hourly_archive").load(path).filter("hour >= '2026-07-27 00:00:00' and hour < '2026-07-28 00:00:00'")
    spark.readStream.format("hourly_archive").load(path)

One hour's file is one partition; filters on ``hour`` choose the files before any is opened. A task streams its
file through a decompressor, chunk by chunk, and holds a chunk, a pending record and a batch of rows,
whatever the file's size. A file that breaks off or is damaged keeps what was read and adds a parse-error.

The stream's offsets are hours: the next hour, and which hours below it have had no file yet. A batch reads
the files of its hours, and of missing hours whose file has come since (told by a record ``late-file``);
an hour that is still missing ``lateHours`` behind the next one is given up (told by ``missing-file``). So
every hour is read once, or told to be missing, and a batch that is replayed reads the same files.

Options: ``markFiles`` (a record of kind ``file`` for every file), ``maxLines``, ``maxBytes`` (bounds of
a recovered record), ``lateHours`` (168). Files are opened by the tasks themselves, through the file systems of
pyarrow; ``archive.read_archive`` reads those that only Spark can open. A file must appear whole (by a rename).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Sequence
from datetime import date, datetime, timedelta, timezone
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..operators.events import RECORD
from . import archive

NAME = "hourly_archive"
HOUR = timedelta(hours=1)
#: Bytes read at once, records of a batch, and the hours that a stream waits for a missing file.
CHUNK, ROWS, LATE_HOURS = 1 << 18, 10_000, 168
#: Hours before the last one that a stream's first batch looks back, and for which an offset lists missing ones.
REMEMBERED = 24 * 366
_KINDS = {"timestamp": pa.timestamp("us", "UTC"), "long": pa.int64(), "int": pa.int32(), "string": pa.string()}
SCHEMA = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in RECORD.split(", ")])


def opened(path: str):
    """The file system of ``path`` and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def hours_of(path: str) -> dict[datetime, str]:
    """The archive files in a folder, by hour (UTC, without a zone)."""
    from pyarrow import fs

    store, root = opened(path)
    found = {}
    for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if info.type == fs.FileType.File and (match := archive._FILE.search(info.base_name)):
            found[datetime.fromisoformat(match[1]) + int(match[2]) * HOUR] = info.path
    return found


def lines(chunks: Iterable[bytes]) -> Iterator[str]:
    """Lines of a gzip file of any number of members, as they are decompressed; what comes before a fault comes out first."""
    rest, inflate = b"", zlib.decompressobj(wbits=31)
    for chunk in chunks:
        while chunk:
            text = inflate.decompress(chunk, CHUNK)
            chunk = inflate.unconsumed_tail
            if inflate.eof:
                chunk = inflate.unused_data.lstrip(b"\0")  # padding may follow a member
                if chunk:
                    inflate = zlib.decompressobj(wbits=31)
            *whole, rest = (rest + text).split(b"\n")
            for line in whole:
                yield line.removesuffix(b"\r").decode(errors="replace")
    if rest:
        yield rest.removesuffix(b"\r").decode(errors="replace")
    if not inflate.eof:
        raise EOFError("the compressed file ends before its end mark")


def file_records(path: str, hour: datetime, marks: Sequence[str], max_lines: int, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches of a file's records. ``marks``: kinds of records on line 0 that go before them."""
    hour = hour.replace(tzinfo=timezone.utc)
    rows: list[dict] = [{"kind": k, "line": 0, "hour": hour} for k in marks]
    last = 0
    try:
        store, place = opened(path)
        with store.open_input_stream(place, compression=None) as file:
            for record in archive.records(lines(iter(lambda: file.read(CHUNK), b"")), max_lines, max_bytes):
                last = record.get("line_end") or record["line"]
                rows.append(archive.columns(record) | {"hour": hour})
                if len(rows) >= ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)
                    rows = []
    except (OSError, EOFError, zlib.error) as error:
        rows.append({"kind": "parse-error", "line": last + 1, "message": str(error), "hour": hour})
    yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)


def _hours(first: datetime, end: datetime) -> list[datetime]:
    return [first + k * HOUR for k in range(int((end - first) / HOUR))]


class Hour(InputPartition):
    """One hour to read, and the marks that go before it; without a path, only these."""

    def __init__(self, hour: datetime, path: str | None, marks: Sequence[str] = ()):
        self.hour, self.path, self.marks = hour, path, tuple(marks)


class _Options:
    def __init__(self, options: dict[str, str]):
        if not options.get("path"):
            raise ValueError("the archive's path is missing")
        self.path = options["path"]
        self.mark = options.get("markFiles", "false").lower() == "true"
        self.max_lines, self.max_bytes = int(options.get("maxLines", archive.MAX_LINES)), int(options.get("maxBytes", archive.MAX_BYTES))
        self.late_hours = int(options.get("lateHours", LATE_HOURS))
        if min(self.max_lines, self.max_bytes) < 1 or self.late_hours < 0:
            raise ValueError("bounds must be positive")

    def at(self, path: str) -> str:
        """A path of the file system as one that ``opened`` takes."""
        scheme, mark, rest = self.path.partition("://")
        return f"{scheme}://{path}" if mark and scheme == "file" else f"{scheme}://{rest.partition('/')[0]}/{path.lstrip('/')}" if mark and scheme == "hdfs" else f"{scheme}://{path}" if mark else path

    def records(self, partition: Hour) -> Iterator[pa.RecordBatch]:
        if partition.path is None:
            yield pa.RecordBatch.from_pylist([{"kind": k, "line": 0, "hour": partition.hour.replace(tzinfo=timezone.utc)} for k in partition.marks], schema=SCHEMA)
        else:
            marks = [*partition.marks, *(["file"] if self.mark else [])]
            yield from file_records(partition.path, partition.hour, marks, self.max_lines, self.max_bytes)


def _naive(value: Any) -> datetime | None:
    """A filter's time in UTC without a zone."""
    if isinstance(value, datetime):
        return value.astimezone(timezone.utc).replace(tzinfo=None) if value.tzinfo else value
    return datetime.combine(value, datetime.min.time()) if isinstance(value, date) else None


class HourReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = _Options(options)
        self.least, self.end, self.only = datetime.min, datetime.max, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            value = _naive(f.value) if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and f.attribute == ("hour",) else None
            wanted = {_naive(v) for v in f.value} if isinstance(f, In) and f.attribute == ("hour",) else None
            if wanted and None not in wanted:
                self.only = wanted if self.only is None else self.only & wanted
            elif value is None:
                yield f
            elif isinstance(f, EqualTo):
                self.only = {value} if self.only is None else self.only & {value}
            elif isinstance(f, GreaterThanOrEqual | GreaterThan):
                self.least = max(self.least, value + timedelta(microseconds=isinstance(f, GreaterThan)))
            else:
                self.end = min(self.end, value + timedelta(microseconds=isinstance(f, LessThanOrEqual)))

    def partitions(self) -> Sequence[InputPartition]:
        found = hours_of(self.options.path)
        chosen = [h for h in sorted(found) if self.least <= h < self.end and (self.only is None or h in self.only)]
        return [Hour(h, self.options.at(found[h])) for h in chosen] or [Hour(datetime(1970, 1, 1), None)]

    def read(self, partition: Hour) -> Iterator[pa.RecordBatch]:
        yield from self.options.records(partition)


class HourStreamReader(DataSourceStreamReader):
    """Offsets: ``first``, the first hour with a file, ``next``, the hour after the last one, and ``missing``, the hours between without one.

    Which hours a batch reads follows from its two offsets alone. Files of hours before the first aren't read.
    """

    def __init__(self, options: dict[str, str]):
        self.options = _Options(options)

    def initialOffset(self) -> dict:
        return {"first": None, "next": None, "missing": []}

    def latestOffset(self) -> dict:
        found = hours_of(self.options.path)
        if not found:
            return self.initialOffset()
        end = max(found) + HOUR
        first = max(min(found), end - REMEMBERED * HOUR)
        missing = [h for h in _hours(first, end) if h not in found]
        return {"first": first.isoformat(), "next": end.isoformat(), "missing": [h.isoformat() for h in missing]}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if end["next"] is None:
            return []
        last, missing = datetime.fromisoformat(end["next"]), {datetime.fromisoformat(h) for h in end["missing"]}
        floor, waited = last - self.options.late_hours * HOUR, []
        begin = datetime.fromisoformat(start["next"] or end["first"])
        if start["next"]:  # hours below the floor of that time have been told
            waited = [h for h in map(datetime.fromisoformat, start["missing"]) if h >= begin - self.options.late_hours * HOUR]
        found, out = hours_of(self.options.path), []
        for late, h in [*((True, h) for h in waited), *((False, h) for h in _hours(begin, last))]:
            if h not in missing:
                out.append(Hour(h, self.options.at(found[h]), ["late-file"] * late))
            elif h < floor:
                out.append(Hour(h, None, ["missing-file"]))
        return out

    def read(self, partition: Hour) -> Iterator[pa.RecordBatch]:
        yield from self.options.records(partition)

    def commit(self, end: dict) -> None:
        pass


class HourlyArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return RECORD

    def reader(self, schema: StructType) -> HourReader:
        return HourReader(self.options)

    def streamReader(self, schema: StructType) -> HourStreamReader:
        return HourStreamReader(self.options)


def write_hours(rows: DataFrame, folder: str) -> None:
    """Write ``rows`` (hour, place, text) as an archive: a gzip file for each hour, its texts as lines in order of place; files appear whole.

    One task writes an hour, record by record. ``folder`` is a path for pyarrow's file systems.
    """

    def put(frames):
        import uuid

        import pandas as pd

        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        hour = fresh = out = None

        def closed():
            out.close()
            store.move(fresh, f"{root}/{hour:%Y-%m-%d}-{hour.hour}.json.gz")

        for frame in frames:
            for at, text in zip(frame["hour"], frame["text"], strict=True):
                if at != hour:
                    if out:
                        closed()
                    hour, fresh = at, f"{root}/.{uuid.uuid4().hex}"
                    out = store.open_output_stream(fresh, compression="gzip")
                out.write(f"{text}\n".encode())
        if out:
            closed()
        yield pd.DataFrame({"done": [True]})

    dealt = rows.select("hour", "place", "text").repartition("hour").sortWithinPartitions("hour", "place").select("hour", "text")
    dealt.mapInPandas(put, "done boolean").write.format("noop").mode("overwrite").save()


def registered(spark):
    """``spark`` with the source and with filters pushed down to Python sources."""
    spark.dataSource.register(HourlyArchive)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark
