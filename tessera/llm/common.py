"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_BYTES = 4 << 20
NO_ID = -(1 << 63)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of this session hold BATCH_BYTES at most, or one longer row.

    By default a batch has 10,000 rows however long they are, in the JVM and in the worker at once.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local one is made up in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (path or "file:///tmp/checkpoints/tessera").rstrip("/")


def stash(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def drop_stash(df: DataFrame) -> None:
    """Remove what stash() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stash_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2000, size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to so many rows and bytes of text, which bounds what a Python worker holds.

    A longer text is a slice of its own.
    """
    for batch in batches:
        texts = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type)]
        lengths = sum((pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in texts), np.zeros(batch.num_rows, np.int64))
        upto = np.concatenate([[0], np.cumsum(lengths)])
        a = 0
        while a < batch.num_rows:
            b = min(a + rows, max(a + 1, int(np.searchsorted(upto, upto[a] + size, "right")) - 1))
            yield batch.slice(a, b - a)
            a = b


def give_back() -> None:
    """Hand memory that is free again from this Python worker to the system.

    Workers are kept for later tasks, each in turn, with all that their allocators hold.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library, which has no such call
        pass


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a task over batches, and give_back() at its end."""

    @functools.wraps(run)
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df less the columns whose names an operator is about to add (case-insensitive)."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(quoted(c)) for c in df.columns if c.lower() not in gone])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def id_number(id_col: str) -> Column:
    """The id as a number, or a hash of one that is none; NO_ID for null."""
    number = F.expr(f"try_cast({quoted(id_col)} AS bigint)")
    return F.when(col(id_col).isNull(), NO_ID).otherwise(F.coalesce(number, F.xxhash64(col(id_col).cast("string"))))
