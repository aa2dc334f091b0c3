"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_ROWS = 20_000  # a key with more rows is hot


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Where the session names none, a session on one machine (master local) uses a
    local folder; any other raises an error, as executors couldn't see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"lodeweave-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_written: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove_all(spark: SparkSession) -> None:
    for path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the session has gone; the cluster's own cleaner remains
            return


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver ends, if not before."""
    if not _written:
        atexit.register(_remove_all, spark)
    path = f"{shared_dir(spark)}/lodeweave/{label}-{uuid.uuid4().hex}"
    _written.add(path)
    return path


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed = path
    return out


@contextmanager
def small_batches(spark: SparkSession, rows: int, name: str = "spark.sql.execution.arrow.maxRecordsPerBatch") -> Iterator[None]:
    """Jobs run within it hand Python at most so many rows at a time: for rows of hundreds of KB each."""
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(*stashed: DataFrame) -> None:
    """Remove what stash() wrote, once nothing reads it any more, and the shuffle files of finished steps.

    Spark removes these when the driver collects its garbage, so that is asked for."""
    for df in stashed:
        _remove(df.sparkSession, df._stashed)
        _written.discard(df._stashed)
    if stashed:
        stashed[0].sparkSession.sparkContext._jvm.System.gc()


def with_row_id(df: DataFrame, name: str = "__rid") -> DataFrame:
    """df with a number per row, so that repeated or null keys stay separate rows.

    Written once: numbers depend on how a scan was split, which may differ from
    one job to the next when executors come or go."""
    return stash(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], count: str, hot: int = HOT_ROWS, share: int = 100_000) -> DataFrame:
    """rows (stashed) that have a key in counted, with its other columns; counted says how many of rows have a key (column count, dropped).

    Keys with over hot rows, and over a share-th part of all, are at most share many,
    so they are broadcast and their rows stay where they are; the others meet by a
    shuffle in groups of at most that size."""
    many = max(hot, rows.count() // share)
    names = [c for c in counted.columns if c not in (*keys, count)]
    frequent = F.broadcast(counted.where(F.col(count) > many).select(*keys, *(F.col(c).alias(f"__{c}") for c in names), F.lit(True).alias("__hot")))
    marked = rows.join(frequent, keys, "left")
    dealt = marked.where("__hot is null").select(*rows.columns).join(counted.where(F.col(count) <= many).select(*keys, *names), keys)
    kept = marked.where("__hot").select(*rows.columns, *(F.col(f"__{c}").alias(c) for c in names))
    return dealt.select(*rows.columns, *names).union(kept)
