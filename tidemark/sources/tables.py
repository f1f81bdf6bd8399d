"""Result tables: Parquet relations of one run, with a version; JSON documents of other tools."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import store

VERSION = "version"


def fingerprint(*identity: str | None, length: int = 12) -> str:
    """A suffix that tells runs of different models or settings apart: the beginning of a digest of the parts."""
    return hashlib.sha256("/".join(p or "" for p in identity).encode()).hexdigest()[:length]


def fingerprint_of(*identity: Column, length: int = 12) -> Column:
    """``fingerprint`` of columns."""
    return F.substring(F.sha2(F.concat_ws("/", *(F.coalesce(c, F.lit("")) for c in identity)), 256), 1, length)


def run_path(root: str, start: str, end: str, suffix: str = "", identity: tuple[str | None, ...] = ()) -> str:
    """A run's folder, named after its window and, if there is one, the fingerprint of its identity; colons, which some stores refuse, become hyphens."""
    suffix += f"_{fingerprint(*identity)}" if identity else ""
    return f"{root.rstrip('/')}/{start}_{end}{suffix}".replace(":", "-") if "://" not in root else f"{root.rstrip('/')}/{f'{start}_{end}{suffix}'.replace(':', '-')}"


def write_relation(df: DataFrame, path: str, version: str, mode: str = "error") -> None:
    """Write a relation with its version. Mode ``ignore`` never touches what is there."""
    df.withColumn(VERSION, F.lit(version)).write.mode(mode).parquet(path)


def replace_relation(df: DataFrame, path: str, version: str) -> None:
    """Replace a relation as a whole: readers see the old one until the new one is there (``store``)."""
    store.changed(df.sparkSession, path, lambda before: df.withColumn(VERSION, F.lit(version)))


def read_relation(spark: SparkSession, path: str, version: str) -> DataFrame:
    """A relation of the given version, from its last replacement if there is one; rows of any other version fail the read when they are met."""
    replaced = store.current(spark, path)
    rows = spark.read.parquet(replaced.folder if replaced else path)
    checked = F.when(F.col(VERSION) == version, True).otherwise(F.raise_error(F.concat(F.lit(f"{path}: expected version {version}, found "), F.coalesce(VERSION, F.lit("none")))))
    return rows.filter(checked.cast("boolean")).drop(VERSION)


def read_documents(spark: SparkSession, path: str, schema: StructType | str, version: str) -> DataFrame:
    """JSON documents, one a file, with a declared schema; fields that older ones lack are null."""
    docs = spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")
    checked = F.when(F.col("schema_version") == version, True).otherwise(F.raise_error(F.lit(f"{path}: expected {version}")))
    return docs.filter(checked.cast("boolean"))


def write_documents(df: DataFrame, path: str) -> None:
    """One JSON object a row, dates and times as ISO text."""
    df.write.mode("error").option("ignoreNullFields", "false").json(path)
