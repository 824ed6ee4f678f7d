"""Intermediate tables in the folder that all executors see, and the package on the executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_own_folders: set[str] = set()
_made: list[str] = []


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once an application, so that Python steps find it there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    packed = Path(tempfile.mkdtemp(prefix="millrace-")) / "millrace.zip"
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(packed))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir.

    Where it is unset a temporary folder serves in local mode, as in tests; on a cluster that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        master = context.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
        held = context._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def new_folder(spark: SparkSession, label: str) -> str:
    """A new path below the application's own folder in the shared one; that folder is deleted when the application ends."""
    own = f"{shared_dir(spark)}/millrace/{spark.sparkContext.applicationId}"
    if own not in _own_folders:
        files, target = _file_system(spark, own)
        files.mkdirs(target)  # only what is there can be marked for deletion
        files.deleteOnExit(target)
        _own_folders.add(own)
    _made.append(f"{own}/{label}-{uuid.uuid4().hex}")
    return _made[-1]


@contextmanager
def tables(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables that are made inside are deleted at the end, so what is computed from them has to be written, or collected, before.

        with tables(spark):
            near_groups(docs).write.parquet(path)
    """
    first = len(_made)
    try:
        yield
    finally:
        own = _made[first:]
        del _made[first:]
        for path in own:
            drop_table(spark, path)


def write_table(df: DataFrame, label: str, partition_by: list[str] | None = None) -> str:
    """Write `df` as Parquet to a new folder and return its path."""
    path = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path, partitionBy=partition_by)
    return path


def cut(df: DataFrame, label: str) -> DataFrame:
    """`df`, computed once and reread from the shared folder: recomputation after a lost executor stops there."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, label))


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table that no result reads any more."""
    files, target = _file_system(spark, path)
    files.delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    files, target = _file_system(spark, path)
    return files.exists(target)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    files, target = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(target)) if files.exists(target) else []
