"""The archive as a data source: pushed filters, flat memory, hours as offsets."""

import gzip
import json
import os
import resource
from collections import Counter
from datetime import datetime

import pytest

from tidemark.operators import events
from tidemark.sources import archive, hourly


def event(i, hour=0, **more):
    return {"id": str(i), "type": "WatchEvent", "repo": {"name": "owner/a"}, "payload": {"action": "started"}, "created_at": f"2026-07-27T{hour:02d}:10:00Z"} | more


def put(folder, hour, rows, day="2026-07-27"):
    text = "\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows).encode()
    (folder / "part.tmp").write_bytes(gzip.compress(text))
    os.rename(folder / "part.tmp", folder / f"{day}-{hour}.json.gz")


@pytest.fixture
def source(spark):
    hourly.registered(spark)
    return lambda path, **options: spark.read.format(hourly.NAME).options(**options).load(str(path))


def test_same_as_the_other_reader(spark, source, tmp_path):
    put(tmp_path, 0, [event(1), "", "{broken", event(2), '{"id": "3", "note": "first', 'second"}', "[1]", "7"])
    put(tmp_path, 13, [])
    raw = gzip.compress("\n".join(json.dumps(event(i, 2, note=str(i * 7919 % 10007))) for i in range(3000)).encode())
    (tmp_path / "2026-07-27-2.json.gz").write_bytes(raw[: len(raw) // 2])
    (tmp_path / "2026-07-27-3.json.gz").write_bytes(b"no gzip at all")
    (tmp_path / "2026-07-27-4.json.gz").write_bytes(gzip.compress(json.dumps(event(5, 4)).encode() + b"\r\n") + gzip.compress(json.dumps(event(6, 4)).encode()))
    (tmp_path / "notes.txt").write_text("no archive")
    for k in range(10):
        bad = bytearray(raw)
        bad[20 + k * (len(raw) - 40) // 10] ^= 0xFF
        (tmp_path / f"2026-07-28-{k}.json.gz").write_bytes(bytes(bad))
    row = lambda r: tuple(r)[:5] + tuple(r)[6:]  # noqa: E731  messages of a fault may differ
    got, want = (Counter(map(row, df.collect())) for df in (source(tmp_path, markFiles="true"), archive.read_archive(spark, str(tmp_path), mark_files=True)))
    damaged = lambda c: Counter({r: n for r, n in c.items() if r[0].day == 28})
    assert got - damaged(got) == want - damaged(want)
    for rows in (got, want):  # how far a damaged file can be read depends on the chunks
        assert {r[0].hour for r in damaged(rows) if r[3] == "parse-error"} == set(range(10))


def test_filters_choose_the_files(spark, source, tmp_path):
    """One partition a chosen hour."""
    for h in range(4):
        put(tmp_path, h, [event(h, h)])
    (tmp_path / "2026-07-27-9.json.gz").write_bytes(b"no gzip at all")
    (tmp_path / "2026-07-27-8.json.gz").mkdir()
    rows = source(tmp_path)
    at = lambda h: datetime(2026, 7, 27, h)
    ids = lambda df: sorted(int(r.id) for r in df.collect())
    for condition, want in (
        ("hour >= '2026-07-27 01:00:00' and hour < '2026-07-27 03:00:00'", [1, 2]),
        ("hour > '2026-07-27 01:00:00' and hour <= '2026-07-27 03:00:00'", [2, 3]),
        ("hour = '2026-07-27 02:00:00'", [2]),
        ("hour in ('2026-07-27 00:00:00', '2026-07-27 03:00:00') and id <> '3'", [0]),
        ("hour = '2026-07-27 02:00:00' and hour = '2026-07-27 03:00:00'", []),
        ("hour < '2020-01-01'", []),
    ):
        assert ids(rows.filter(condition)) == want, condition
    window = rows.filter((rows.hour >= at(1)) & (rows.hour < at(3)))
    assert window.rdd.getNumPartitions() == 2
    assert rows.filter("kind = 'parse-error'").count() == 1  # only where hour 9 is read


def test_large_files_stay_in_flat_memory(tmp_path):
    """600 MB of text from a file of a few MB, read in one process that grows by less than a tenth of that."""
    line = (json.dumps(event(1, note="x" * 3000)) + "\n").encode()
    with gzip.open(tmp_path / "2026-07-27-5.json.gz", "wb", 1) as file:
        for _ in range(200):
            file.write(line * 1000)
    before, n = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, 0
    for batch in hourly.file_records(str(tmp_path / "2026-07-27-5.json.gz"), datetime(2026, 7, 27, 5), [], 16, 1 << 20):
        n += batch.num_rows
    assert n == 200_000 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 60_000


def test_hours_as_offsets(spark, source, tmp_path):
    given, out, notes = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "notes")
    given.mkdir()

    def run():
        rows = spark.readStream.format(hourly.NAME).option("lateHours", 6).load(str(given))
        query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", notes).trigger(availableNow=True).start()
        query.awaitTermination()
        return Counter((r.hour.hour, r.kind, r.id) for r in spark.read.schema(rows.schema).parquet(out).collect())

    for h in (0, 1, 4):
        put(given, h, [event(h, h)])
    want = Counter({(h, "event", str(h)): 1 for h in (0, 1, 4)})
    assert run() == want
    assert run() == want  # nothing new
    put(given, 2, [event(2, 2)])
    put(given, 5, [event(5, 5), event(50, 5)])
    want += Counter({(2, "late-file", None): 1, (2, "event", "2"): 1, (5, "event", "5"): 1, (5, "event", "50"): 1})
    assert run() == want
    put(given, 10, [event(10, 10)])  # hour 3 is more than six hours behind now
    want += Counter({(3, "missing-file", None): 1, (10, "event", "10"): 1})
    assert run() == want
    put(given, 3, [event(3, 3)])
    assert run() == want  # told to be missing already
    put(given, 7, [event(7, 7)])
    want += Counter({(7, "late-file", None): 1, (7, "event", "7"): 1})
    assert run() == want and run() == want


def test_a_replayed_batch_reads_the_same(tmp_path):
    """Partitions follow from the offsets, also when more files have come since."""
    reader = hourly.HourStreamReader({"path": str(tmp_path), "lateHours": "24"})
    assert reader.latestOffset() == reader.initialOffset() and reader.partitions(reader.initialOffset(), reader.latestOffset()) == []
    for h in (1, 2, 5):
        put(tmp_path, h, [event(h, h)])
    first = reader.latestOffset()
    hours = lambda a, b: [(p.hour.hour, p.marks) for p in reader.partitions(a, b)]
    want = hours(reader.initialOffset(), first)
    assert want == [(1, ()), (2, ()), (5, ())]
    for h in (3, 6):
        put(tmp_path, h, [event(h, h)])
    second = reader.latestOffset()
    assert hours(reader.initialOffset(), first) == want
    assert hours(first, second) == [(3, ("late-file",)), (6, ())] and json.loads(json.dumps(second)) == second


def test_through_the_operators(spark, source, tmp_path):
    put(tmp_path, 0, [event(1), event(1), event(2, 3)])
    put(tmp_path, 1, [event(1, 1), event(4, 1)])
    found = events.deduplicated(events.validated(source(tmp_path, markFiles="true")))
    assert Counter(r.status for r in found.collect()) == {"watch": 2, "duplicate": 2, "invalid": 1, "ignored": 2}
