"""The lifecycle as a stream: keyed state, a timer for the end of every week, and events as weeks close.

Rows are daily counts of entities and, in between, days with their coverage. Entities are dealt to a fixed
number of groups by a hash. A group's state holds the open weeks' counts and coverage, and what the fold
carries for each entity; days go to all groups, since every entity lives through every week, also without
events. When the watermark passes a week's end, its timer closes it: each of the group's entities moves by
one week, and gives a row with its state and the events it emits.

The fold is the same as ``operators.lifecycle.folded``, which has all weeks of an entity at once; tests replay
weeks as micro-batches, with a restart between, and get its states and events.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, datetime, timedelta, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import lifecycle

WEEK = timedelta(days=7)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What the fold carries of an entity: the fields of a final state, the breakout's week, the last week's speed, the
#: week before the last one and the last one (for growth), and how many events it has emitted.
CARRIED = (
    "status string, cooling_from string, qualified int, below int, first_detected date, changed_at date, last_qualified date, fast_ever boolean, "
    "breakout_status string, breakout_week date, last_fast boolean, n_before long, coverage_before string, n_last long, coverage_last string, emitted int"
)
FIELDS = [f.split()[0] for f in CARRIED.split(", ")]
START = dict.fromkeys(FIELDS) | {"qualified": 0, "below": 0, "fast_ever": False, "last_fast": False, "emitted": 0}
EMITTED = "array<struct<seq:int,type:string,week:date,previous_status:string,next_status:string>>"
OUTPUT = (
    "key string, week date, n long, max_daily long, active_days long, coverage string, main boolean, scout boolean, breakout boolean, "
    "status string, breakout_status string, qualified int, below int, cooling_from string, first_detected date, changed_at date, last_qualified date, fast_ever boolean, "
    f"events {EMITTED}"
)


def reached(observed: int, threshold: int, complete: bool) -> bool | None:
    """True if reached; false only if nothing can be missing; else unknown."""
    return True if observed >= threshold else False if complete else None


def next_status(s: dict, qualifies: bool, below: bool, confirmed: bool, pends: bool, grows: bool) -> str | None:
    status = s["status"]
    if qualifies:
        if status is None:
            return "active" if grows and not pends else "candidate"
        if status == "cooling":
            return s["cooling_from"] or "candidate"
        if status == "inactive":
            return "candidate"
        enough = confirmed or s["qualified"] + 1 >= lifecycle.CONFIRMING_WEEKS
        return "active" if status == "candidate" and enough else status
    if below and status in ("candidate", "active"):
        return "cooling"
    if below and status == "cooling" and s["below"] + 1 >= lifecycle.INACTIVATING_WEEKS:
        return "inactive"
    return status


def one_week(s: dict, w: dict) -> tuple[dict, list[tuple]]:
    """What is carried after week ``w`` (week, n, coverage, scout, breakout), and its events (type, week, status before, status after)."""
    status, week = s["status"], w["week"]
    qualifies, below = w["scout"] is True, w["scout"] is False
    pending = s["breakout_status"] == "pending"
    grows = s["coverage_before"] == s["coverage_last"] == "complete" and s["n_before"] < s["n_last"] < w["n"]
    seen = {"n_before": s["n_last"], "coverage_before": s["coverage_last"], "n_last": w["n"], "coverage_last": w["coverage"]}
    lost = w["coverage"] == "temporal-incomplete"
    doubtful = lost or (w["coverage"] == "record-warning" and not qualifies)
    events = [("data_incomplete", week, status, status)] if doubtful and (status is not None or pending) else []
    if lost:
        return s | seen | {"qualified": 0, "emitted": s["emitted"] + len(events)}, events

    waiting = pending and s["breakout_week"] != week
    confirmed, failed = waiting and qualifies, waiting and below
    fresh = w["breakout"] is True and not s["last_fast"]
    pends = fresh and status in (None, "inactive")
    after = next_status(s, qualifies, below, confirmed, pends, grows)
    for happens, kind in ((confirmed, "breakout_confirmed"), (failed, "breakout_unconfirmed"), (fresh, "breakout_detected")):
        if happens:
            events.append((kind, week, status, status))
    if after != status:
        kinds = {"active": "activated", "candidate": "revived" if status == "inactive" else "candidate_detected", "cooling": "cooling_started", "inactive": "inactivated"}
        events.append((kinds[after], week, status, after))

    here = status in ("candidate", "active")
    out = s | seen | {"status": after, "emitted": s["emitted"] + len(events), "fast_ever": s["fast_ever"] or fresh}
    out["qualified"] = (s["qualified"] + 1 if here else 1) if qualifies else 0
    if qualifies:
        out |= {"below": 0, "last_qualified": week, "last_fast": w["breakout"] is True}
    elif below:
        out |= {"below": 1 if here else s["below"] + 1 if status else s["below"], "last_fast": False}
    if below and here:
        out["cooling_from"] = status
    elif (qualifies and status == "cooling") or after == "inactive":
        out["cooling_from"] = None
    if after != status:
        out |= {"changed_at": week, "first_detected": s["first_detected"] or week}
    if fresh:
        out |= {"breakout_status": "pending" if pends else "confirmed", "breakout_week": week}
    elif confirmed or failed:
        out["breakout_status"] = "confirmed" if confirmed else "unconfirmed"
    return out, events


def monday(day: date) -> date:
    return day - timedelta(days=day.weekday())


class Weeks(StatefulProcessor):
    """Folds the weeks of one group of entities."""

    def __init__(self, limits: dict[str, int]):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "week date", "days int, hours boolean, records boolean")
        self.counts = handle.getMapState("counts", "week date, key string", "n long, max_daily long, active_days long")
        self.entities = handle.getMapState("entities", "key string", CARRIED)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        """Adds a micro-batch's counts and days to their open weeks."""
        days: dict[date, list] = {}
        counts: dict[tuple[date, str], list] = {}
        weeks = set()
        for r in rows:
            week = monday(r.date)
            if r.key is not None:
                held = counts.setdefault((week, r.key), [0, 0, 0])
                held[0], held[1], held[2] = held[0] + r.n, max(held[1], r.n), held[2] + (r.n > 0)
            elif r.hours_collected is not None:
                held = days.setdefault(week, [0, True, True])
                held[0], held[1], held[2] = held[0] + 1, held[1] and r.hours_collected == 24, held[2] and bool(r.records_complete)
            else:
                continue
            weeks.add(week)
        for week, (n, hours, records) in days.items():
            old = self.days.getValue((week,)) if self.days.containsKey((week,)) else (0, True, True)
            self.days.updateValue((week,), (old[0] + n, old[1] and hours, old[2] and records))
        for at, (n, most, active) in counts.items():
            old = self.counts.getValue(at) if self.counts.containsKey(at) else (0, 0, 0)
            self.counts.updateValue(at, (old[0] + n, max(old[1], most), old[2] + active))
        for week in weeks:
            end = datetime.combine(week + WEEK, datetime.min.time(), timezone.utc)
            self.handle.registerTimer(int(end.timestamp() * 1000))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        """Closes, in their order, the weeks that have ended."""
        now = datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, timezone.utc).date()
        for week in sorted(w for (w,) in list(self.days.keys()) if w + WEEK <= now):
            n_days, hours, records = self.days.getValue((week,))
            self.days.removeKey((week,))
            coverage = "temporal-incomplete" if n_days < 7 or not hours else "complete" if records else "record-warning"
            yield from self._close(week, coverage)
        for at, _ in list(self.counts.iterator()):
            if at[0] + WEEK <= now:  # of a week without any day
                self.counts.removeKey(tuple(at))

    def _close(self, week: date, coverage: str) -> Iterator[Row]:
        counted = {at[1]: tuple(value) for at, value in list(self.counts.iterator()) if at[0] == week}
        for name in counted:
            self.counts.removeKey((week, name))
        known = {k[0]: dict(zip(FIELDS, tuple(value), strict=True)) for k, value in list(self.entities.iterator())}
        for name, (n, *_) in counted.items():
            if n > 0:
                known.setdefault(name, dict(START))
        complete = coverage == "complete"
        for name, before in known.items():
            n, most, active = counted.get(name, (0, 0, 0))
            w = {
                "week": week, "n": n, "max_daily": most, "active_days": active, "coverage": coverage, "main": reached(most, self.limits["main"], complete),
                "scout": reached(n, self.limits["scout"], complete), "breakout": reached(n, self.limits["breakout"], complete),
            }
            after, events = one_week(before, w)
            self.entities.updateValue((name,), tuple(after[f] for f in FIELDS))
            told = {f: after[f] for f in ("status", "breakout_status", "qualified", "below", "cooling_from", "first_detected", "changed_at", "last_qualified", "fast_ever")}
            yield Row(key=name, **w, **told, events=[(before["emitted"] + k, *e) for k, e in enumerate(events)])

    def close(self) -> None:
        pass


def followed(observations: DataFrame, limits: dict[str, int] | None = None, groups: int = 256, late: str = "0 seconds") -> DataFrame:
    """A row for each entity and closed week (OUTPUT) from a stream of daily counts and days; append mode.

    ``observations``: key, date, n of an entity's day (each once), or, with a null key, date,
    hours_collected and records_complete of a day of the calendar (each once); rows with neither key nor
    hours only move the watermark. A week closes once a row's date is ``late`` after its end; rows for a
    closed week are dropped by the watermark. Weeks without any day of the calendar have no rows, as in the batch.
    Memory of a task: the entities of one group. Uses RocksDB for the session's streaming state.
    """
    observations.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    every = F.sequence(F.lit(0), F.lit(groups - 1))
    dealt = observations.select(
        F.explode(F.when(F.col("key").isNull(), every).otherwise(F.array(F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int")))).alias("group"),
        F.col("date").cast("timestamp").alias("at"),
        "key",
        F.col("date").cast("date").alias("date"),
        F.col("n").cast("long").alias("n"),
        F.col("hours_collected").cast("int").alias("hours_collected"),
        "records_complete",
    )
    grouped = dealt.withWatermark("at", late).groupBy("group")
    return grouped.transformWithState(Weeks(limits or lifecycle.rules()), OUTPUT, outputMode="Append", timeMode="EventTime")


def shown_weeks(rows: DataFrame) -> DataFrame:
    """Of closed weeks, those of ``lifecycle.lifecycle_weeks``: with events, a status, or a breakout that waits."""
    pending: Column = F.coalesce(F.col("breakout_status") == "pending", F.lit(False))
    columns = ("key", "week", "n", "max_daily", "active_days", "coverage", "main", "scout", "breakout", "status", "breakout_status", "qualified", "below")
    return rows.filter((F.col("n") > 0) | F.col("status").isNotNull() | pending).select(*columns)


def emitted_events(rows: DataFrame) -> DataFrame:
    """key, seq, type, week, previous_status, next_status, as ``lifecycle.lifecycle_events``."""
    return rows.select("key", F.inline("events"))


def last_states(rows: DataFrame) -> DataFrame:
    """The state of each entity after its last closed week, as ``lifecycle.final_states``."""
    fields = ("status", "cooling_from", "qualified", "below", "first_detected", "changed_at", "last_qualified", "fast_ever", "breakout_status")
    return rows.groupBy("key").agg(F.max_by(F.struct(*fields), "week").alias("s")).select("key", "s.*")
