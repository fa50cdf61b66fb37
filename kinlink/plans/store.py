"""Tables that a plan writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of this machine where that is unset and Spark runs on this machine alone (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="kinlink-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


_OPEN: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that were written inside; what is still to be read from them must be written before."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; an open scratch deletes what is written there."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes df once as a table in the shared folder and reads it back: a cut of the lineage in compact form.

    path is one that fresh gave outside of an open scratch, for a table that outlasts it.
    """
    spark = df.sparkSession
    path = path or fresh(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
