"""Helpers that several corpus operators share."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import shared_dir

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Paths that the innermost temporary() has written.
_written: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("written", default=None)


def materialise(df: DataFrame) -> DataFrame:
    """Write a narrow intermediate table to the shared folder and read it back,
    so that later stages neither recompute it nor lose it with an executor. The
    tables of an application are in one folder; see discard."""
    spark = df.sparkSession
    path = f"{tables_dir(spark)}/table-{uuid.uuid4().hex}"
    if (made := _written.get()) is not None:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[list[str]]:
    """The paths of tables that are written within, which are deleted at the end; take
    one out of the list to keep it. Those of others are left alone."""
    token = _written.set([])
    made = _written.get()
    try:
        yield made
    finally:
        _written.reset(token)
        delete(spark, *made)


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def tables_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"


def discard(spark: SparkSession, *keep: DataFrame) -> None:
    """Delete this application's intermediate tables but those that keep reads.
    What was built on a deleted one must have been written before."""
    at = spark._jvm.org.apache.hadoop.fs.Path(tables_dir(spark))
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    held = {name.rsplit("/", 2)[-2] for df in keep for name in df.inputFiles()}
    for found in files.listStatus(at) if files.exists(at) else []:
        if found.getPath().getName() not in held:
            files.delete(found.getPath(), True)


def free_name(df: DataFrame, name: str) -> str:
    """name, lengthened until it is no column of df, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release() -> None:
    """Give freed memory back at the end of a task: Python workers live on, and
    several may wait on one executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def text_of(text: Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(text.cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty. ASCII texts, most
    of a corpus, take the fast built-in path."""
    t = text_of(text)
    upper = "".join(map(chr, range(65, 91)))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(
        F.translate(t, upper, upper.lower())
    )


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
