"""What the operators share: tables in the shared folder, Arrow batch bounds, text helpers."""

from __future__ import annotations

import ctypes
import functools
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratadoc.functions.tables import discard, running, shared_dir, stage, with_hot

__all__ = ["discard", "running", "shared_dir", "stage", "bound_batches", "table", "text_or_empty", "chunks", "kept", "task", "with_hot", "SPACE", "WORD"]

#: The white space of the word definition `[^\x20\x09-\x0D]+`.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of one Arrow batch handed to Python; long texts make short batches.
ARROW_ROWS = 500
ARROW_BYTES = 4 << 20


def bound_batches(spark: SparkSession, times: int = 1) -> None:
    """Keep Arrow batches small, as one row can hold megabytes of text; ``times`` makes them larger where counts are merged by batch."""
    for key, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS * times),
        ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES * times),
    ):
        spark.conf.set(key, str(value))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def chunks(texts: list[str], most: int):
    """Cut a list into (start, end) ranges of about ``most`` characters, one text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


#: Tables that a worker process keeps from task to task, of one operator at a time.
_kept: dict[str, dict] = {}


def kept(operator: str) -> dict:
    """The process's tables of this operator. Those of other operators are dropped, as workers are used by all stages."""
    for other in [k for k in _kept if k != operator]:
        del _kept[other]
    return _kept.setdefault(operator, {})


def task(operator: str):
    """Decorates a function of Arrow batches: when its task ends, memory that is free goes back to the system."""

    def wrap(run):
        @functools.wraps(run)
        def guarded(batches):
            kept(operator)
            try:
                yield from run(batches)
            finally:
                gc.collect()
                pa.default_memory_pool().release_unused()
                if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                    trim(0)

        return guarded

    return wrap
