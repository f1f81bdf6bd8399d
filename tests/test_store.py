"""Relations with versions: whole for every reader, nothing lost between writers."""

import threading

import pytest
from pyspark.sql import functions as F

from tidemark.sources import store


def numbers(spark, a, b, value="x"):
    return spark.range(a, b).select("id", F.lit(value).alias("value"))


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert store.current(spark, path) is None and store.read(spark, path) is None
    assert store.merged(numbers(spark, 0, 5), path, ["id"]).number == 1
    old = store.read(spark, path)
    store.merged(numbers(spark, 3, 8, "y"), path, ["id"])
    rows = {r.id: r.value for r in store.read(spark, path).collect()}
    assert rows == {0: "x", 1: "x", 2: "x", 3: "y", 4: "y", 5: "y", 6: "y", 7: "y"}
    assert old.count() == 5  # who has begun to read goes on with what there was
    store.changed(spark, path, lambda before: before.filter("id < 2"))
    store.vacuum(spark, path, keep=1)
    assert store.current(spark, path).number == 3 and store.read(spark, path).count() == 2
    assert len(list((tmp_path / "t" / "_versions").iterdir())) == 1


def test_a_failed_writer_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    store.merged(numbers(spark, 0, 5), path, ["id"])
    with pytest.raises(Exception, match="lost"):
        store.merged(spark.range(3).selectExpr("id", "raise_error('lost') value"), path, ["id"])
    assert store.current(spark, path).number == 1 and store.read(spark, path).count() == 5


def test_checked_on_read(spark, tmp_path):
    path = str(tmp_path / "t")
    store.merged(numbers(spark, 0, 5), path, ["id"])
    assert store.read(spark, path, lambda rows: rows.filter("id > 9")).count() == 5
    with pytest.raises(ValueError, match="version 1"):
        store.read(spark, path, lambda rows: rows.filter("id > 3"))


def test_readers_and_writers_at_once(spark, tmp_path):
    """Four writers add three rows each and a fifth replaces values, while readers look: every look is one whole version, and no row is lost."""
    path, looks, errors, done = str(tmp_path / "t"), [], [], threading.Event()
    store.merged(numbers(spark, 1000, 1010), path, ["id"])

    def guarded(work):
        def run():
            try:
                work()
            except Exception as error:  # told by the test's own thread
                errors.append(error)

        return threading.Thread(target=run)

    def write(k):
        return lambda: [store.merged(numbers(spark, 10 * k + i, 10 * k + i + 1), path, ["id"]) for i in range(3)]

    def look():
        while not done.is_set():
            looks.append(sorted(r.id for r in store.read(spark, path).collect()))

    writers, reader = [guarded(write(k)) for k in range(4)], guarded(look)
    writers.append(guarded(lambda: [store.merged(numbers(spark, 1000, 1010, v), path, ["id"]) for v in "ab"]))
    for t in [*writers, reader]:
        t.start()
    for t in writers:
        t.join()
    done.set()
    reader.join()
    assert not errors, errors
    want = sorted([*range(1000, 1010), *(10 * k + i for k in range(4) for i in range(3))])
    assert sorted(r.id for r in store.read(spark, path).collect()) == want and store.current(spark, path).number == 15
    for seen in looks:
        assert len(seen) == len(set(seen)) and set(range(1000, 1010)) <= set(seen)
        assert all(10 * k + i - 1 in seen for k in range(4) for i in (1, 2) if 10 * k + i in seen)


def test_a_pointer_is_made_once(spark, tmp_path):
    path = str(tmp_path / "t")
    store.merged(numbers(spark, 0, 1), path, ["id"])
    made = []
    threads = [threading.Thread(target=lambda k=k: made.append(store._point(spark, path, 2, f"{k}"))) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(made) == [False] * 7 + [True]
