"""Tables written to the folder that driver and executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``: a lost executor then costs a reread, not a
recomputation. The setting is read from the session. Only a local session without it gets a folder of its own; elsewhere
that is an error, as executors would write to disks that nobody else can read.

A table is removed by ``drop`` once nothing reads it any more; what a result still reads goes when the session's JVM ends.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, else the context's checkpoint folder, else (local sessions only) a new one."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="auditloom-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) in the JVM."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there."""
    spark, schema = df.sparkSession, df.schema
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    _PATHS[out] = path
    for made in _SCOPES[-1:]:
        made.append(out)
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for what a session keeps there; it goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, where = hadoop_path(spark, path)
    files.deleteOnExit(where)
    return path


_SCOPES: list[list[DataFrame]] = []


@contextmanager
def temporary() -> Iterator[None]:
    """Tables that ``save`` gives meanwhile are removed at the end, but for those that ``keep`` was told of."""
    made: list[DataFrame] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.pop()
        drop(*made)


def keep(table: DataFrame) -> DataFrame:
    """Spares a table that a result still reads: it passes to the scope around this one, or goes when the session's JVM ends."""
    if _SCOPES:
        _SCOPES[-1][:] = [t for t in _SCOPES[-1] if t is not table]
        for around in _SCOPES[-2:-1]:
            around.append(table)
    return table


def drop(*tables: DataFrame) -> None:
    """Remove tables that ``save`` gave. Whatever was to be read from them must have been written."""
    for table in tables:
        path = _PATHS.pop(table, None)
        if path:
            files, where = hadoop_path(table.sparkSession, path)
            files.delete(where, True)
