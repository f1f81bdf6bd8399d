"""Hourly archives: gzip files of one JSON record a line, some broken over several lines.

A file is one task: gzip can't be split, and a record's line number and recovery depend on what came
before it in the file. A task holds the compressed file and one pending record; the text is read line by
line. Files outside the window that is asked for aren't opened.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.events import RECORD

# Bounds of a recovered record, and of a scan.
MAX_LINES, MAX_BYTES = 16, 1 << 20
MAX_HOURS, MAX_DAYS = 24, 7

_FILE = re.compile(r"(\d{4}-\d{2}-\d{2})-(\d{1,2})\.json\.gz$")


def hour_file(hour: Column) -> Column:
    """The name of an hour's file; the hour isn't padded."""
    return F.concat(F.date_format(hour, "yyyy-MM-dd-H"), F.lit(".json.gz"))


def hour_window(start: str, hours: int) -> tuple[datetime, datetime]:
    """First hour and the hour after the last, in UTC without a zone; 1 to 24 hours from a whole hour."""
    first = datetime.fromisoformat(start).astimezone(timezone.utc).replace(tzinfo=None)
    if first.minute or first.second or first.microsecond:
        raise ValueError("a window starts on a whole hour")
    if not 1 <= hours <= MAX_HOURS:
        raise ValueError(f"hours must be from 1 to {MAX_HOURS}")
    return first, first + timedelta(hours=hours)


def day_window(start: str, days: int) -> tuple[datetime, datetime]:
    """Like ``hour_window``, for 1 to 7 whole UTC days."""
    first, _ = hour_window(start, 1)
    if first.hour or not 1 <= days <= MAX_DAYS:
        raise ValueError(f"a window of days starts at midnight and has 1 to {MAX_DAYS} days")
    return first, first + timedelta(days=days)


def _refuse(name: str):
    raise ValueError(f"{name} isn't JSON")


def parse(text: str) -> tuple[dict | list | None, str]:
    """(value, error): objects and arrays are records, anything else is an error."""
    try:
        value = json.loads(text, parse_constant=_refuse)
    except (ValueError, RecursionError) as error:
        return None, str(error)
    return (value, "") if isinstance(value, (dict, list)) else (None, "the record isn't a JSON object")


_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*("?)|[{}\[\]]', re.S)


def ends_in_string(text: str) -> bool:
    """Whether ``text`` starts an object and ends inside one of its strings."""
    text = text.lstrip()
    if not text.startswith("{"):
        return False
    depth = {"{": 0, "[": 0}
    for token in _TOKEN.finditer(text):
        mark = token[0]
        if mark in "{[":
            depth[mark] += 1
        elif mark in "}]":
            opened = "{" if mark == "}" else "["
            depth[opened] -= 1
            if depth[opened] < 0:
                return False
        elif not token[1]:  # the string's end is missing, so it is the last token
            return depth["{"] > 0
    return False


def records(lines: Iterator[str], max_lines: int = MAX_LINES, max_bytes: int = MAX_BYTES) -> Iterator[dict]:
    """Records of a file with their lines, from 1.

    A line that doesn't parse and ends inside a string waits for the next one, joined by an escaped
    line break, within the bounds. A line that parses alone ends the wait as an error.
    """
    wait = None  # (text, first line, last line, number of lines, error)
    for n, line in enumerate(lines, 1):
        if wait is None and not line.strip():
            continue
        value, error = parse(line)
        if wait and value is not None:
            yield {"kind": "parse-error", "line": wait[1], "line_end": wait[2], "message": wait[4]}
            wait = None
        if wait is None:
            if value is not None:
                yield {"kind": "event", "line": n, "value": value}
            elif ends_in_string(line):
                wait = (line, n, n, 1, error)
            else:
                yield {"kind": "parse-error", "line": n, "message": error}
            continue
        text, joined = f"{wait[0]}\\n{line}", wait[3] + 1
        value, error = parse(text)
        if value is not None:
            yield {"kind": "event", "line": wait[1], "value": value, "recovered_lines": joined}
            wait = None
        elif joined < max_lines and len(text.encode()) < max_bytes and ends_in_string(text):
            wait = (text, wait[1], n, joined, error)
        else:
            yield {"kind": "parse-error", "line": wait[1], "line_end": n, "message": error}
            wait = None
    if wait:
        yield {"kind": "parse-error", "line": wait[1], "line_end": wait[2], "message": wait[4]}


_JSON_TYPES = {str: "string", bool: "boolean", int: "number", float: "number", type(None): "null", dict: "object", list: "array"}


def columns(record: dict) -> dict:
    """The record's flat columns; a field of another JSON type than text is null."""
    value = record.pop("value", None)
    event = value if isinstance(value, dict) else {}
    inner = lambda name, key: (event.get(name) or {}).get(key) if isinstance(event.get(name), dict) else None
    text = lambda x: x if isinstance(x, str) else None
    return record | {
        "type": text(event.get("type")),
        "id": text(event.get("id")),
        "id_type": _JSON_TYPES[type(event["id"])] if "id" in event else None,
        "action": text(inner("payload", "action")),
        "name": text(inner("repo", "name")),
        "created_at": text(event.get("created_at")),
    }


def file_names(window: tuple[datetime, datetime]) -> list[str]:
    """The names of the files of a window's hours."""
    first, last = window
    hours = int((last - first) / timedelta(hours=1))
    return [f"{h:%Y-%m-%d}-{h.hour}.json.gz" for h in (first + timedelta(hours=k) for k in range(hours))]


def read_archive(
    spark: SparkSession, path: str, window: tuple[datetime, datetime] | None = None, mark_files: bool = False, max_lines: int = MAX_LINES, max_bytes: int = MAX_BYTES
) -> DataFrame:
    """All records of the archive files under ``path``, with their file's hour; one task reads a file at a time.

    With a ``window`` (its first hour, and the hour after its last) only its hours' files are listed and
    read. With ``mark_files`` every file also gives a record of kind ``file`` on line 0, so that hours
    without records are known to have been read. A file that breaks off or is damaged keeps the records
    before the fault and adds a parse-error after them.
    """
    wanted = "{" + ",".join(file_names(window)) + "}" if window else "*.json.gz"
    files = spark.read.format("binaryFile").option("pathGlobFilter", wanted).load(path)
    kinds = {"timestamp": pa.timestamp("us", "UTC"), "long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in RECORD.split(", ")])

    def read(batches):
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                found = _FILE.search(name)
                if not found:
                    continue
                hour = datetime.fromisoformat(f"{found[1]}T{int(found[2]):02d}:00:00+00:00")
                rows = [{"kind": "file", "line": 0, "hour": hour}] if mark_files else []
                last = 0
                try:
                    with gzip.open(io.BytesIO(content), "rt", encoding="utf-8", errors="replace", newline="\n") as file:
                        for record in records((line.rstrip("\n").removesuffix("\r") for line in file), max_lines, max_bytes):
                            last = record.get("line_end") or record["line"]
                            rows.append(columns(record) | {"hour": hour})
                            if len(rows) >= 10_000:
                                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                                rows = []
                except (OSError, EOFError, zlib.error) as error:
                    rows.append({"kind": "parse-error", "line": last + 1, "message": str(error), "hour": hour})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "content").mapInArrow(read, RECORD)


def readme_text(content: Column, encoding: Column) -> Column:
    """The text of a base-64 README; null for another encoding or content that isn't base 64 of UTF-8."""
    raw = F.try_to_binary(F.regexp_replace(content, r"\s", ""), F.lit("base64"))
    return F.when(encoding == "base64", F.try_validate_utf8(raw.cast("string")))
