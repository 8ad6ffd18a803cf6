"""Intermediate tables, in the folder that the cluster names for all executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_WRITTEN: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Unset, it is a temporary folder in local mode (tests); elsewhere that is an error, as executors would not see each other's files."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="kindling-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def fresh_folder(spark: SparkSession) -> str:
    """A new path in the shared folder, which goes as :func:`saved` tables do."""
    path = f"{shared_folder(spark)}/kindling-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def saved(df: DataFrame, outlives: bool = False) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: lineage ends there and a lost executor costs no recomputation
    of what stands above it. The table goes by :func:`release`, at the end of the :func:`scratch` around it (unless it ``outlives`` that), or by :func:`clear`."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kindling-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    if not outlives:
        _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return out


def delete(spark: SparkSession, path: str) -> None:
    """A file or folder, wherever Spark can reach it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(*tables: DataFrame | None) -> None:
    """Delete tables of :func:`saved` that nothing unwritten reads any more; others, and None, are passed over."""
    for df in tables:
        path = _PATHS.pop(df, None) if df is not None else None
        if path is not None:
            delete(df.sparkSession, path)
            mine = _WRITTEN.get(df.sparkSession.sparkContext.applicationId, [])
            if path in mine:
                mine.remove(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that were saved inside; write results before."""
    mine = _WRITTEN.setdefault(spark.sparkContext.applicationId, [])
    before = len(mine)
    try:
        yield
    finally:
        for path in mine[before:]:
            delete(spark, path)
        del mine[before:]


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application saved and that were not released; for when its results are written."""
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        delete(spark, path)
