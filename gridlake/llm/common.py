"""Helpers that the operators share: the shared folder, stored tables, Arrow access to texts and what a Python worker keeps."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOCAL_SHARED = "/tmp/checkpoints/gridlake"
FEW_ROWS = 100_000  # of a table of a few numbers a row that is broadcast
_WRITTEN: list[list[str]] = []  # stored tables of each open scratch()
_KEPT: dict = {}  # what this Python worker keeps between tasks


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session on one machine has a default."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = LOCAL_SHARED
    return found.rstrip("/")


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back.

    Within a scratch() the table goes at its end; with keep, at the end of the scratch() around that one, if there is one."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if len(_WRITTEN) > keep:
        _WRITTEN[-1 - keep].append(path)
    return spark.read.schema(df.schema).parquet(path)


def few(table: DataFrame) -> DataFrame:
    """A stored table of narrow rows, to be broadcast if it has at most FEW_ROWS; else Spark shuffles."""
    return F.broadcast(table) if table.count() <= FEW_ROWS else table


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored within are deleted at the end, so whatever outlives the block must read kept ones only."""
    _WRITTEN.append([])
    try:
        yield
    finally:
        for path in _WRITTEN.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def tidy() -> None:
    """Give memory that is free, but held for later use, back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def keep(key, make: Callable):
    """What make() gives, kept for this worker's later tasks. A worker keeps one thing only, so operators don't add up in memory."""
    if key not in _KEPT:
        let_go()
        _KEPT[key] = make()
    return _KEPT[key]


def let_go() -> None:
    """Drop what this worker keeps."""
    if _KEPT:
        _KEPT.clear()
        tidy()


def light(run: Callable) -> Callable:
    """A mapInArrow function that drops what other operators keep before it runs, and tidies up after it."""

    def tidied(batches):
        let_go()
        try:
            yield from run(batches)
        finally:
            tidy()

    return tidied


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, every other character as it is; null becomes the empty text."""
    some = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(some) == F.length(some), F.lower(some)).otherwise(F.translate(some, UPPER, UPPER.lower()))


def fold(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text with A-Z lower-cased; null becomes b""."""
    return [b"" if t is None else t.lower() for t in column.cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (multiply and xor-shift)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def slices(batches, rows: int = 256):
    """Cut record batches into short ones, so that a few very long texts don't meet in memory."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
