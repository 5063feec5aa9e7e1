"""Staged tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_staged: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local folder that goes with the process, in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="tracewright-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{local}")
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, for files that ``clear_staged`` deletes."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _staged.append(path)
    return path


def stage(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts the lineage and survives lost executors. With ``by``,
    files lie apart by that column's value, so that a filter on it reads its own files only."""
    path = new_folder(df.sparkSession, label)
    (df.repartition(by).write.partitionBy(by) if by else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete tables that ``stage`` gave and nothing reads any more."""
    for table in tables:
        _staged.remove(table.staged_at)
        _delete(table.sparkSession, table.staged_at)


def _delete(spark: SparkSession, name: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))


def clear_staged(spark: SparkSession) -> int:
    """Delete the tables that this process has staged, once no result that reads them is needed any more."""
    n = 0
    while _staged:
        n += _delete(spark, _staged.pop())
    return n
