"""What the operators share: the documents' columns, the shared folder and written tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import small_batches
from ..scratch import dropped, new_path, saved, shared_dir

__all__ = ["by_batch", "documents", "dropped", "fold", "id_text", "labels", "new_path", "ranges_for", "saved", "shared_dir", "small_batches"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def id_text(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The id, the text (null: empty) and the columns ``keep``, whatever other columns there are."""
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *keep)


#: Bytes of a task's share where a range partitioning states its number of ranges.
RANGE_BYTES = 256 << 20


def ranges_for(spark: SparkSession, size: int | None) -> int:
    """Partitions for ``size`` bytes: the session's number, or as many more as the size needs."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // RANGE_BYTES))


def fold(modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def by_batch(make: Callable[[pa.RecordBatch], dict], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: ``make`` gives the columns for a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(make(batch), schema=schema)

    return run
