from datetime import date, timedelta

import pytest

from tidemark.operators import lifecycle

START = date(2026, 6, 1)


def states(spark, entities, weeks, short=None, warned=None):
    days = [(START + timedelta(d), 23 if d == short else 24, d != warned) for d in range(7 * weeks)]
    coverage = lifecycle.week_coverage(spark.createDataFrame(days, "date date, hours_collected int, records_complete boolean"))
    daily = [(key, START + timedelta(d), n) for key, by_day in entities.items() for d, n in by_day.items() if n]
    frame = spark.createDataFrame(daily, "key string, date date, n long")
    return lifecycle.folded(lifecycle.tracked_weeks(frame, coverage))


def weekly(*totals):
    return {7 * i: n for i, n in enumerate(totals)}


@pytest.mark.parametrize(
    "totals,more,want,events",
    [
        ((3, 0, 0, 3), {}, ["candidate", "cooling", "inactive", "candidate"], ["candidate_detected", "cooling_started", "inactivated", "revived"]),
        ((1, 2, 3, 10), {}, [None, None, "active", "active"], ["activated", "breakout_detected"]),
        ((12, 4), {}, ["candidate", "active"], ["breakout_detected", "candidate_detected", "breakout_confirmed", "activated"]),
        ((12, 1), {}, ["candidate", "cooling"], ["breakout_detected", "candidate_detected", "breakout_unconfirmed", "cooling_started"]),
        ((3, 3, 0, 0), {"short": 15}, ["candidate", "active", "active", "cooling"], ["candidate_detected", "activated", "data_incomplete", "cooling_started"]),
        ((3, 3, 0, 0), {"warned": 15}, ["candidate", "active", "active", "cooling"], ["candidate_detected", "activated", "data_incomplete", "cooling_started"]),
        ((3, 3, 3), {"short": 8}, ["candidate", "candidate", "candidate"], ["candidate_detected", "data_incomplete"]),
        ((12, 1, 3), {"warned": 8}, ["candidate", "candidate", "active"], ["breakout_detected", "candidate_detected", "data_incomplete", "breakout_confirmed", "activated"]),
    ],
)
def test_sequences(spark, totals, more, want, events):
    state = states(spark, {"a": weekly(*totals)}, len(totals), **more).first().state
    assert [w.status for w in state.weeks] == want
    assert [e.type for e in state.events] == events
    assert [w.week for w in state.weeks] == [START + timedelta(7 * i) for i in range(len(totals))]


def test_entities_are_independent(spark):
    found = {r.key: r.state for r in states(spark, {"main": weekly(5, 3), "scout": {0: 1, 1: 1, 2: 1, 7: 1, 8: 1, 9: 1}, "tail": weekly(1, 1)}, 2).collect()}
    assert {k: s.status for k, s in found.items()} == {"main": "active", "scout": "active", "tail": None}
    assert found["main"].weeks[0].main is True and found["scout"].weeks[0].main is False


def test_thresholds_are_tri_state(spark):
    state = states(spark, {"a": weekly(3, 1, 4)}, 3, warned=8).first().state
    assert [w.scout for w in state.weeks] == [True, None, True]
    with pytest.raises(ValueError):
        lifecycle.rules(breakout=2)


def test_windows(spark):
    day = lambda i, d: (i, START + timedelta(d))
    frame = lambda rows: spark.createDataFrame(rows, "input int, date date")
    assert lifecycle.check_windows(frame([day(1, 0), day(1, 1), day(2, 2)])).count() == 0
    assert lifecycle.check_windows(frame([day(1, 0), day(1, 2)])).count() == 1
    assert lifecycle.check_windows(frame([day(1, 5), day(2, 0)])).count() == 1


def test_identity(spark):
    rows = [(1, "Old/name", 7, "2026-01-01", "2026-01-02", 2), (2, "new/name", 7, "2026-02-01", "2026-02-02", 3), (3, "NEW/name", None, "2026-03-01", "2026-03-02", 4), (3, "other/x", None, "2026-03-01", "2026-03-01", 1)]
    found = {r.identity: r for r in lifecycle.merged_identities(spark.createDataFrame(rows, "input int, name string, id long, first_at string, last_at string, n long")).collect()}
    assert found.keys() == {"id:7", "name:other/x"}
    assert (found["id:7"].full_name, found["id:7"].n, found["id:7"].first_at) == ("NEW/name", 9, "2026-01-01")
