"""Sizes of Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, and Arrow batches of a size that suits texts: Python tasks hold a few of them.

    Spark's own sizes suit rows of numbers; settings that a user has changed stay.
    """
    conf = df.sparkSession.conf
    for key, usual, own in (("maxRecordsPerBatch", "10000", "1000"), ("maxBytesPerBatch", "67108864b", str(4 << 20))):
        if conf.get(f"spark.sql.execution.arrow.{key}", usual) == usual:
            conf.set(f"spark.sql.execution.arrow.{key}", own)
    return df
