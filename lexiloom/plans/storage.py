"""Materialised steps in the folder that all executors share.

A multi-stage operator writes an intermediate table once and reads it as often
as it needs, so lost executors cost a re-read and no recomputation, and plans
stay short.  The folder is ``spark.checkpoint.dir`` of the session, else the one
given to ``setCheckpointDir``.  Only a session whose executors are threads of
this process (tests, notebooks) may have neither, and gets a local folder.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_roots: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, as a Hadoop path; an error where executors are elsewhere and none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share (master {master})")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="lexiloom-")
    return _own[app]


def _root(spark: SparkSession) -> str:
    """This application's folder in the shared folder, which Hadoop deletes when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        path = f"{shared_dir(spark)}/lexiloom/{app}-{uuid.uuid4().hex}"
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(where)
        files.deleteOnExit(where)
        _roots[app] = path
    return _roots[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is written there is deleted by ``release`` or when the driver ends."""
    path = f"{_root(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    ``by`` names columns to sort by inside each file.  The table lives until
    ``release``, the end of a ``scope`` or the end of the driver.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if by:
        df = df.sortWithinPartitions(*by)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession | None = None, kept: int = 0) -> int:
    """Delete what was written since the first ``kept`` tables (of one session, if given); returns the number."""
    left, gone = _written[:kept], 0
    for session, path in _written[kept:]:
        if spark is not None and session is not spark:
            left.append((session, path))
            continue
        try:
            where = session._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(session._jsc.hadoopConfiguration()).delete(where, True)
            gone += 1
        except Exception:  # the session has ended, and its files with it
            pass
    _written[:] = left
    return gone


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was materialised inside; results must have been written or collected by then."""
    kept = len(_written)
    try:
        yield
    finally:
        release(spark, kept)


@atexit.register
def _at_exit() -> None:
    for path in _own.values():
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
