import base64
import gzip
import json

import pytest

from tidemark.operators import events
from tidemark.sources import archive


def event(i, name="owner/a", at="2026-07-27T00:10:00Z", **more):
    return {"id": i, "type": "WatchEvent", "repo": {"name": name}, "payload": {"action": "started"}, "created_at": at} | more


def test_malformed_then_valid():
    found = list(archive.records(iter(["{oops", "", json.dumps(event("1"))])))
    assert [(r["kind"], r["line"]) for r in found] == [("parse-error", 1), ("event", 3)]


def test_record_broken_over_lines():
    whole = json.dumps(event("1", note="first\nsecond"))
    broken = whole.replace("\\n", "\n").split("\n")
    found = list(archive.records(iter([*broken, json.dumps(event("2"))])))
    assert [(r["kind"], r["line"], r.get("recovered_lines")) for r in found] == [("event", 1, 2), ("event", 3, None)]
    assert found[0]["value"]["note"] == "first\nsecond"


def test_bounds():
    lines = ['{"a": "never', "closed", json.dumps(event("3"))]
    found = list(archive.records(iter(lines), max_lines=2))
    assert [(r["kind"], r["line"], r.get("line_end")) for r in found] == [("parse-error", 1, 2), ("event", 3, None)]
    found = list(archive.records(iter(['{"a": "' + "x" * 80, "more", json.dumps(event("3"))]), max_bytes=64))
    assert [(r["kind"], r["line"]) for r in found] == [("parse-error", 1), ("event", 3)]
    found = list(archive.records(iter(['{"a": "open', json.dumps(event("4"))])))
    assert [(r["kind"], r["line"], r.get("line_end")) for r in found] == [("parse-error", 1, 1), ("event", 2, None)]
    assert [r["kind"] for r in archive.records(iter(["[1]", "3", "null", '{"a": NaN}', '{"a": 1} x']))] == ["event"] + ["parse-error"] * 4


def test_windows():
    first, last = archive.hour_window("2026-07-27T00:00:00Z", 24)
    assert (last - first).days == 1
    for bad in (("2026-07-27T00:30:00Z", 1), ("2026-07-27T00:00:00Z", 0), ("2026-07-27T00:00:00Z", 25)):
        with pytest.raises(ValueError):
            archive.hour_window(*bad)
    with pytest.raises(ValueError):
        archive.day_window("2026-07-27T00:00:00Z", 8)


def test_files_to_accepted_events(spark, tmp_path):
    hours = {
        "2026-07-27-0.json.gz": [
            event("9100", payload={"action": "stopped"}),
            {k: v for k, v in event("x").items() if k != "id"},
            event(9100),
            event("9100"),
            event("9100"),
            event("1" * 36, name="Owner/A"),
            "{broken",
            {"type": "PushEvent", "id": "5"},
        ],
        "2026-07-27-1.json.gz": [event("9100", at="2026-07-27T01:00:00Z"), event("7", at="2026-07-27T00:59:59Z"), event("8", name="bad name", at="2026-07-27T01:00:01Z"), event("9", at="soon")],
    }
    for name, rows in hours.items():
        (tmp_path / name).write_bytes(gzip.compress("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows).encode()))
    records = archive.read_archive(spark, str(tmp_path))
    found = events.deduplicated(events.validated(records)).cache()
    got = {(r.hour.hour, r.line): (r.status, r.reason) for r in found.collect()}
    assert got == {
        (0, 1): ("invalid", "invalid-action"),
        (0, 2): ("invalid", "missing-event-id"),
        (0, 3): ("invalid", "invalid-event-id"),
        (0, 4): ("watch", None),
        (0, 5): ("duplicate", None),
        (0, 6): ("watch", None),
        (0, 7): ("parse-error", None),
        (0, 8): ("ignored", None),
        (1, 1): ("duplicate", None),
        (1, 2): ("invalid", "outside-hour"),
        (1, 3): ("invalid", "invalid-repository"),
        (1, 4): ("invalid", "invalid-created-at"),
    }
    total = events.integrity(found).first()
    assert total.raw_watch_events_seen == total.unique_watch_events + total.duplicate_event_ids + total.invalid_watch_events == 10
    assert (total.unique_watch_events, total.duplicate_event_ids, total.missing_event_ids, total.invalid_event_ids, total.invalid_watch_events, total.malformed_records) == (2, 2, 1, 1, 6, 1)
    errors = {r.target for r in events.coverage_errors(found).collect()}
    assert "2026-07-27T00:00:00.000Z#line-7" in errors and len(errors) == 7


def test_file_that_breaks_off(spark, tmp_path):
    raw = gzip.compress("\n".join(json.dumps(event(str(i + 1))) for i in range(2000)).encode())
    (tmp_path / "2026-07-27-3.json.gz").write_bytes(raw[: len(raw) // 2])
    kinds = [r.kind for r in archive.read_archive(spark, str(tmp_path)).select("kind").collect()]
    assert kinds.count("parse-error") == 1 and kinds.count("event") > 100


def test_damaged_bytes_keep_what_was_read(spark, tmp_path):
    """One damaged byte anywhere never fails the read: records before it stay, and the fault is an error."""
    raw = gzip.compress("\n".join(json.dumps(event(str(i + 1), note=str(i * 7919 % 10007))) for i in range(3000)).encode())
    for k in range(20):
        bad = bytearray(raw)
        bad[20 + k * (len(raw) - 40) // 20] ^= 0xFF
        (tmp_path / f"2026-07-27-{k}.json.gz").write_bytes(bytes(bad))
    rows = archive.read_archive(spark, str(tmp_path)).groupBy("hour", "kind").count().collect()
    assert {r.hour.hour for r in rows if r.kind == "parse-error"} == set(range(20))
    assert sum(r["count"] for r in rows if r.kind == "event") > 5000


def test_only_the_window_is_read(spark, tmp_path):
    """A folder under an outside hour's name can't be read at all; empty files count as read."""
    for h in (1, 2):
        (tmp_path / f"2026-07-27-{h}.json.gz").write_bytes(gzip.compress(b"" if h == 2 else json.dumps(event("1", at="2026-07-27T01:10:00Z")).encode()))
    (tmp_path / "2026-07-27-3.json.gz").write_bytes(b"no gzip at all")
    (tmp_path / "2026-07-28-1.json.gz").symlink_to(tmp_path / "missing")
    window = archive.hour_window("2026-07-27T01:00:00Z", 2)
    assert archive.file_names(window) == ["2026-07-27-1.json.gz", "2026-07-27-2.json.gz"]
    rows = archive.read_archive(spark, str(tmp_path), window, mark_files=True).collect()
    assert sorted((r.hour.hour, r.kind) for r in rows) == [(1, "event"), (1, "file"), (2, "file")]
    found = events.validated(archive.read_archive(spark, str(tmp_path), window, mark_files=True))
    assert found.filter("kind = 'file' and status <> 'ignored'").count() == 0


def test_readme(spark):
    rows = [(base64.b64encode("héllo".encode()).decode(), "base64"), ("%%%", "base64"), ("aGk=", "none"), (base64.b64encode(b"\xff\xfe").decode(), "base64")]
    found = spark.createDataFrame(rows, "content string, encoding string").select(archive.readme_text(archive.F.col("content"), archive.F.col("encoding")).alias("t")).collect()
    assert [r.t for r in found] == ["héllo", None, None, None]
