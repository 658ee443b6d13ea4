"""Shared helpers: input tables, tables written between steps, and sizes that decide a join's form."""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the corpus operators: a maximal run without space, tab, newline, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Tasks that read a list of files at most; with more files a task reads several.
FILE_TASKS = 20_000
#: Bytes of an Arrow batch between the JVM and a Python worker, and of the texts that a worker splits at a time.
BATCH_BYTES, SPLIT_BYTES = 8 << 20, 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table, read through Spark only, so that any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine; every executor has the same package."""
    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where it is unset and Spark runs in one
    process, a folder of the warehouse, which both share as well; on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir isn't set")
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tideway-steps"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def fresh_dir(spark: SparkSession, tag: str) -> str:
    """A new folder name in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and safe when executors are lost.

    The shuffles of its computation are deleted with its end, not when the driver happens to collect garbage."""
    spark = df.sparkSession
    path = fresh_dir(spark, tag)
    with small_batches(spark), setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Within it, the session has this setting."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def small_batches(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Within it, tables that are computed send Arrow batches of BATCH_BYTES, whatever the session's own limit is."""
    return setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def runs(bodies: list[bytes], most: int = SPLIT_BYTES) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts that together have about ``most`` bytes."""
    at = 0
    while at < len(bodies):
        end, size = at, 0
        while end < len(bodies) and size < most:
            size += len(bodies[end])
            end += 1
        yield at, end
        at = end


def released() -> None:
    """Give a worker's freed memory back to the system: workers are reused, and their peaks would stay."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library that keeps its memory
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that no later step reads."""
    for df in tables:
        for name in df.inputFiles()[:1]:
            spark = df.sparkSession
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name).getParent()
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def utf8(text: str | Column) -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def by_file(files: DataFrame) -> DataFrame:
    """A written list of files, one a row, dealt to as many tasks: a number, else tiny rows end up in one task."""
    return files.repartition(max(1, min(files.count(), FILE_TASKS)))


def joined_small(left: DataFrame, right: DataFrame, on: str | list[str], how: str, rows: int, bound: int) -> DataFrame:
    """Join with ``right`` broadcast if its counted rows are within ``bound``, else by shuffle (AQE splits skew)."""
    return left.join(F.broadcast(right) if rows <= bound else right, on, how)
