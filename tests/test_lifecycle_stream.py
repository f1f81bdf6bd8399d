"""The streaming lifecycle against the batch fold: weeks replayed as micro-batches, with a restart between."""

import random
from datetime import date, timedelta

import pytest

from tidemark.operators import lifecycle
from tidemark.streaming import lifecycle as stream

START = date(2026, 6, 1)
SCHEMA = "key string, date date, n long, hours_collected int, records_complete boolean"


def history(seed, entities=60, weeks=9):
    """Daily counts (key, date, n) and days (date, hours, complete); some weeks have short, doubtful or missing days."""
    rng = random.Random(seed)
    short, doubtful, missing = (set(rng.sample(range(7 * weeks), 2)) for _ in range(3))
    days = [(START + timedelta(d), 20 if d in short else 24, d not in doubtful) for d in range(7 * weeks) if d not in missing]
    counts = []
    for k in range(entities):
        mood = 0
        for d in range(7 * weeks):
            if d % 7 == 0:
                mood = rng.choice([0, 0, 1, 1, 2, 4])
            if n := rng.choice([0, 0, 0, 1, 1, 3]) * mood // 2:
                counts.append((f"e{k}", START + timedelta(d), n))
    return counts, days


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_replay_with_a_restart(spark, tmp_path, seed):
    counts, days = history(seed)
    coverage = lifecycle.week_coverage(spark.createDataFrame(days, "date date, hours_collected int, records_complete boolean"))
    states = lifecycle.folded(lifecycle.tracked_weeks(spark.createDataFrame(counts, "key string, date date, n long"), coverage))
    source, out, notes = (str(tmp_path / d) for d in ("in", "out", "notes"))

    def arrive(first, last):
        """Rows of a few weeks, a file a week; the last file only moves the watermark."""
        for w in range(first, last):
            inside = lambda d: START + timedelta(7 * w) <= d < START + timedelta(7 * w + 7)  # noqa: E731, B023
            rows = [(k, d, n, None, None) for k, d, n in counts if inside(d)] + [(None, d, None, h, c) for d, h, c in days if inside(d)]
            random.Random(w).shuffle(rows)
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run():
        rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        query = stream.followed(rows, groups=4).writeStream.format("parquet").option("path", out).option("checkpointLocation", notes).trigger(availableNow=True).start()
        query.awaitTermination()

    arrive(0, 4)
    run()
    before = spark.read.parquet(out).count()
    arrive(4, 9)
    spark.createDataFrame([(None, START + timedelta(70), None, None, None)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    run()
    rows = spark.read.parquet(out)
    assert 0 < before < rows.count()
    assert collected(stream.emitted_events(rows)) == collected(lifecycle.lifecycle_events(states).select("key", "seq", "type", "week", "previous_status", "next_status"))
    weeks = lifecycle.lifecycle_weeks(states)
    assert collected(stream.shown_weeks(rows).select(weeks.columns)) == collected(weeks)
    final = lifecycle.final_states(states)
    assert collected(stream.last_states(rows).select(final.columns)) == collected(final)
    kinds = {r.type for r in stream.emitted_events(rows).collect()}
    assert len(kinds) >= 8, kinds


def test_steps_against_the_batch_fold(spark):
    """Many random histories through the plain step and the JVM fold."""
    rng, tracked = random.Random(9), []
    coverages = ["complete"] * 6 + ["record-warning", "temporal-incomplete"]
    for k in range(400):
        for w in range(12):
            coverage = rng.choice(coverages)
            n = rng.choice([0, 0, 1, 2, 3, 4, 9, 10, 14])
            flag = lambda limit: stream.reached(n, limit, coverage == "complete")  # noqa: E731, B023
            tracked.append((f"k{k}", START + timedelta(7 * w), n, n, int(n > 0), coverage, flag(5), flag(3), flag(10)))
    schema = "key string, week date, n long, max_daily long, active_days long, coverage string, main boolean, scout boolean, breakout boolean"
    want = {r.key: r.state for r in lifecycle.folded(spark.createDataFrame(tracked, schema)).collect()}
    names = [c.split()[0] for c in schema.split(", ")]
    for k in range(400):
        s, events = dict(stream.START), []
        for row in tracked[12 * k : 12 * k + 12]:
            s, new = stream.one_week(s, dict(zip(names, row, strict=True)))
            events += new
        state = want[f"k{k}"]
        assert events == [tuple(e) for e in state.events]
        assert all(s[f] == state[f] for f in ("status", "cooling_from", "qualified", "below", "first_detected", "changed_at", "last_qualified", "fast_ever", "breakout_status", "breakout_week", "last_fast"))
