"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.storage import scratch, shared_dir

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like ``checkpointed``, as a table in the shared folder: for loops.

    A checkpoint keeps the optimizer's estimate of its size, the product of the sizes of
    what was joined; where each is built on the one before, the digits of that number
    multiply until planning takes longer than the work. A table's size is that of its files.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as make it none of ``df``'s columns."""
    taken = {c.lower() for c in df.columns}
    return [next(y for k in range(len(taken) + 1) if (y := name + "_" * k).lower() not in taken) for name in names]


def text_of(column: str = "text") -> Column:
    """The text, null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(column: Column) -> Column:
    """The blank-separated words of a text, in order."""
    return F.filter(F.split(column, BLANK), lambda w: w != "")


#: Arrow batches of texts are at most about so many bytes.
BATCH_BYTES = 2 << 20


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, for a session that sends Arrow batches of bounded bytes, however long the texts are.

    A worker holds a batch as Arrow and as Python strings; Spark's default of 10,000
    rows a batch lets that follow the length of texts. A smaller bound of the session stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = df.sparkSession.conf.get(name).lower().removesuffix("b")
    if not held.isdigit() or int(held) > BATCH_BYTES:
        df.sparkSession.conf.set(name, BATCH_BYTES)
    return df


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, handing what it has freed back to the system when a task ends: workers live on, and an executor's memory counts theirs."""

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim:
            trim(0)

    return freed
