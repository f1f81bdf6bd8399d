"""Relations that are replaced and merged as wholes: versions side by side, switched by one atomic pointer.

    <path>/_versions/<number>-<random>/    Parquet files of one version, never changed
    <path>/_current/<number>               a small file that names the folder of version <number>

The highest pointer is the relation. A writer writes a new folder, then creates the next pointer, which only one
writer can: by a hard link on a local disk, else by a rename that refuses to overwrite. Who comes second starts
again from what the first has written. Readers have listed a folder that nobody changes, so they see one whole
version before, during and after a replace; folders go only by ``vacuum``.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from typing import NamedTuple
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

#: How often a writer starts again after others were faster.
ATTEMPTS = 20


class Current(NamedTuple):
    number: int
    folder: str


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _files(spark, path)
    return files.exists(at)


def sizes(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """The files of a folder (or the file itself) and their bytes, without hidden ones."""
    at, files = _files(spark, path)
    found = [s for s in files.listStatus(at) if s.isFile()]
    return [(s.getPath().toString(), s.getLen()) for s in found if s.getPath().getName()[0] not in "._"]


def current(spark: SparkSession, path: str) -> Current | None:
    """The relation's last version, None if it has none."""
    at, files = _files(spark, f"{path.rstrip('/')}/_current")
    if not files.exists(at):
        return None
    numbers = [s.getPath().getName() for s in files.listStatus(at)]
    numbers = [int(n) for n in numbers if n.isdigit()]
    if not numbers:
        return None
    stream = files.open(_files(spark, f"{path.rstrip('/')}/_current/{max(numbers):010d}")[0])
    try:
        name = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Current(max(numbers), f"{path.rstrip('/')}/_versions/{name}")


def _point(spark: SparkSession, path: str, number: int, name: str) -> bool:
    """Make version ``number`` the folder ``name``; False if another writer has made that version."""
    base = f"{path.rstrip('/')}/_current"
    fresh, (at, files) = f"{base}/.{uuid.uuid4().hex}", _files(spark, f"{base}/{number:010d}")
    temporary = _files(spark, fresh)[0]
    out = files.create(temporary, False)
    out.write(bytearray(name.encode()))
    out.close()
    try:
        if files.exists(at):
            return False
        if files.getScheme() == "file":
            local = lambda p: unquote(urlparse(p.toUri().toString()).path)
            try:
                os.link(local(files.makeQualified(temporary)), local(files.makeQualified(at)))
            except FileExistsError:
                return False
            return True
        jvm = spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(files.makeQualified(temporary), files.makeQualified(at), options)
        except Exception as error:
            if files.exists(at) and "FileAlreadyExistsException" in str(error):
                return False
            raise
        return True
    finally:
        if files.exists(temporary):
            files.delete(temporary, False)


def changed(spark: SparkSession, path: str, make: Callable[[DataFrame | None], DataFrame]) -> Current:
    """Write ``make`` of the current relation (None if there is none) as the next version; again, from the new one, where another writer was faster."""
    for _ in range(ATTEMPTS):
        before = current(spark, path)
        rows = make(spark.read.parquet(before.folder) if before else None)
        number = before.number + 1 if before else 1
        name = f"{number:010d}-{uuid.uuid4().hex}"
        folder = f"{path.rstrip('/')}/_versions/{name}"
        rows.write.parquet(folder)
        if _point(spark, path, number, name):
            return Current(number, folder)
        at, files = _files(spark, folder)
        files.delete(at, True)
    raise OSError(f"{path}: other writers were faster {ATTEMPTS} times")


def merged(df: DataFrame, path: str, key: list[str]) -> Current:
    """Add ``df`` to the relation; of equal keys (one row each in ``df``) the new row stays. No row of another writer is lost."""

    def make(before: DataFrame | None) -> DataFrame:
        return df if before is None else before.join(df.select(*key), key, "left_anti").select(*df.columns).unionByName(df)

    return changed(df.sparkSession, path, make)


def read(spark: SparkSession, path: str, check: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame | None:
    """The relation as it is now, None if there is none. ``check`` gives the rows that are wrong: any are an error."""
    found = current(spark, path)
    if not found:
        return None
    rows = spark.read.parquet(found.folder)
    if check is not None and (bad := check(rows).limit(3).collect()):
        raise ValueError(f"{path}, version {found.number}, has rows that aren't valid, for example {[r.asDict() for r in bad]}")
    return rows


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete all versions but the last ``keep``, and folders that no pointer names and that are older than those. Readers of a deleted version fail."""
    found = current(spark, path)
    if not found or keep < 1:
        return
    base, files = _files(spark, f"{path.rstrip('/')}/_versions")
    for status in files.listStatus(base):
        if int(status.getPath().getName().partition("-")[0]) <= found.number - keep:
            files.delete(status.getPath(), True)
