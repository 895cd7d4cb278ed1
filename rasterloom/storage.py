"""Intermediate tables in the folder that all executors share: they cut lineage, are computed once, and outlive executors."""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only in local mode, where the session names none. On a cluster that is an error:
    executors don't share the driver's disk."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or _own_dir()).rstrip("/")


@functools.cache
def _own_dir() -> str:
    path = tempfile.mkdtemp(prefix="rasterloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


_made: list[str] = []


@atexit.register
def _clear() -> None:
    """Local tables go with the process; on a cluster's store the folder's own retention removes what dropped() hasn't."""
    for path in _made:
        if path.startswith(("/", "file:")):
            shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)


def new_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_dir(spark)}/rasterloom-{name}-{uuid.uuid4().hex}")
    return _made[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["_own_path"] = path
    return out


#: Rows of a table that may be broadcast.
BROADCAST_ROWS = 200_000


def checked(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has BROADCAST_ROWS rows at most, else joined by shuffle."""
    from pyspark.sql import functions as F

    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def counted(df: DataFrame, name: str = "counted") -> DataFrame:
    """The frame written once, and checked."""
    return checked(written(df, name))


def dropped(*frames: DataFrame) -> None:
    """Deletes tables made by written() that no lazy result needs any more."""
    for df in frames:
        path = df.__dict__.get("_own_path")
        if path:
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
