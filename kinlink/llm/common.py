"""What the operators share: table reading, bounded Arrow batches and lineage cuts that survive lost executors."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.plans.store import fresh, scratch, shared_dir, written

__all__ = ["ARROW_BYTES", "WORD", "arrow", "bound_batches", "fresh", "remainder", "scratch", "shared_dir", "spread", "table", "written"]

#: Characters that separate words: space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of one Arrow batch sent to a Python worker; it bounds memory when single texts are very long.
ARROW_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, records: int = 1000) -> None:
    """Bounds Arrow batches by rows and bytes for this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


@contextmanager
def arrow(spark: SparkSession, records: int, size: int) -> Iterator[None]:
    """Other bounds of Arrow batches for what runs inside; the session's own come back at the end."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(records), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        for n, v in names.items():
            spark.conf.set(n, v)
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def remainder(column: str, by: int):
    """crc32 of the id as text, modulo by; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % by


def spread(df: DataFrame, *needed: str) -> DataFrame:
    """Only the needed columns; other columns of a table, whatever their names, never reach an operator."""
    return df.select(*needed)
