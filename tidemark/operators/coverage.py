"""Coverage carried along: what is missing, at which level, and what that makes incomplete.

A level (archive, metadata, candidate, model, ...) is complete if it has no error row. Commands take the coverage of
what they read and give it on with their own: error rows are the union, and a result is complete only if all
of its levels are.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: level, source, code, target, message of an error.
ERROR = {"level": "string", "source": "string", "code": "string", "target": "string", "message": "string"}

# The status of a part that isn't there, which is no error.
ABSENT = 404


class Coverage(NamedTuple):
    """Levels that were looked at, and what went wrong in them."""

    levels: tuple[str, ...]
    errors: DataFrame

    def merged(self, *others: Coverage) -> Coverage:
        """Of all together: each level once, every error once for each source that told it."""
        every = [self, *others]
        levels = tuple(dict.fromkeys(level for c in every for level in c.levels))
        return Coverage(levels, reduce(lambda a, b: a.unionByName(b), (c.errors for c in every)).distinct())

    def summary(self) -> DataFrame:
        """level, errors, complete: one row for each level, and one for all of them (null)."""
        found = self.errors.groupBy("level").agg(F.count(F.lit(1)).alias("errors"))
        looked = self.errors.sparkSession.createDataFrame([(level,) for level in self.levels], "level string")
        rows = looked.join(found, "level", "full").select("level", F.coalesce("errors", F.lit(0)).alias("errors"))
        return rows.groupingSets([["level"], []], "level").agg(F.sum("errors").alias("errors")).withColumn("complete", F.col("errors") == 0)


def covered(level: str, errors: DataFrame, code: Column | None = None) -> Coverage:
    """Coverage of one level from an error relation (source, target, message, perhaps code)."""
    own = code if code is not None else F.col("code") if "code" in errors.columns else F.lit(None)
    return Coverage((level,), errors.select(F.lit(level).alias("level"), "source", own.cast("string").alias("code"), "target", "message"))


def optional_part(rows: DataFrame, key: str, part: str, status: str, value: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``value`` null where the optional part isn't there or failed; and error rows for those that failed.

    ``status``: the answer's number; ABSENT is a normal absence, null or another one beyond 399 a failure, any other found.
    """
    failed = F.coalesce((F.col(status) >= 400) & (F.col(status) != ABSENT), F.lit(True))
    outcome = F.when(failed, "failed").when(F.col(status) == ABSENT, "missing").otherwise("found")
    told = rows.withColumn("outcome", outcome).withColumn(value, F.when(F.col("outcome") == "found", F.col(value)))
    message = F.concat(F.lit(f"{part}: "), F.coalesce(F.col(status).cast("string"), F.lit("no answer")))
    return told, told.filter("outcome = 'failed'").select(F.lit("metadata").alias("source"), F.col(key).cast("string").alias("target"), F.col(status).cast("string").alias("code"), message.alias("message"))
