"""Folders and tables that the driver and every executor can reach."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfall.sources import tables

#: one list of written folders for each open :func:`scratch`
_open: list[list[str]] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share (:func:`tarnfall.sources.tables.shared_dir`)."""
    path = tables.shared_dir(spark, name)
    if _open:
        _open[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the shared folders that were made inside it. What is to last is written elsewhere before."""
    _open.append([])
    try:
        yield
    finally:
        for path in map(spark._jvm.org.apache.hadoop.fs.Path, _open.pop()):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = 20_000, width: Column | None = None, max_bytes: int = 64 << 20) -> DataFrame:
    """Hints a broadcast only if ``df`` (saved before, so counting is cheap) has at most ``max_rows`` rows; else a shuffle join.

    Tables with rows of any length state a row's bytes as ``width``: their sum is bounded as well.
    """
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(F.lit(0) if width is None else width), F.lit(0))).first()
    return F.broadcast(df) if n <= max_rows and size <= max_bytes else df


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, most: int = 10_000) -> DataFrame:
    """Inner join of rows with a saved table of one row for each key, however unlike the keys' shares of the rows are.

    The ``most`` largest groups by ``size`` are broadcast, so a key with a third of all rows stays where its rows are; of
    the others, which a shuffle deals out, none has over 1 / ``most`` of the rows.
    """
    top = F.broadcast(groups.orderBy(F.desc(size), key).limit(most))
    if groups.count() <= most:
        return rows.join(top, key)
    rest = rows.join(top.select(key), key, "left_anti")
    return rows.join(top, key).unionByName(rest.join(groups, key))


def unfolded(rows: DataFrame, times: str, name: str, step: int = 1 << 16) -> DataFrame:
    """Each row ``times`` times, numbered from 0 as ``name``. rows: saved, as rows repeated more than ``step`` times are
    dealt out again, so that no task unfolds one of them alone."""
    at, last = F.lit(0).cast("long"), F.col(times) - 1
    few = rows.where(F.col(times) <= step).withColumn(name, F.explode(F.sequence(at, last)))
    many = rows.where(F.col(times) > step).withColumn("__at", F.explode(F.sequence(at, last, F.lit(step).cast("long"))))
    many = many.repartition(*many.columns).withColumn(name, F.explode(F.sequence("__at", F.least(last, F.col("__at") + (step - 1))))).drop("__at")
    return few.unionByName(many)


def bound_batches(spark: SparkSession, megabytes: int = 16) -> None:
    """Arrow batches sent to Python hold at most so many MB, whatever the length of the texts. The setting is read when a
    query starts, so it stays in the session; a smaller one that the session has is left alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = spark.conf.get(key, None)
    if have is None or not have.isdigit() or int(have) > megabytes << 20:
        spark.conf.set(key, str(megabytes << 20))


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI, or of a local path, and the path in it."""
    return pafs.FileSystem.from_uri(uri.replace("file:/", "file:///") if uri.startswith("file:/") and not uri.startswith("file:///") else uri)


def write_file(uri: str, chunks) -> int:
    """Writes the chunks under a name of their own, then moves the whole file to ``uri``; returns its length."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part, size = f"{path}.{uuid.uuid4().hex}", 0
    with fs.open_output_stream(part) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    fs.move(part, path)
    return size
