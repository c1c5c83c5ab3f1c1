"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.sources.shared import shared_folder

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one Arrow batch; with whole texts in the rows, far fewer than Spark's default.
BATCH_ROWS = "512"


def named(name: str) -> Column:
    """The column of that very name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def refuse_clash(df: DataFrame, *added: str) -> None:
    """An error where the rows already have a column of a name that is to be added."""
    if clash := sorted({c.lower() for c in df.columns} & {c.lower() for c in added}):
        raise ValueError(f"columns that would be there twice: {', '.join(clash)}")


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written as Parquet into the folder that all executors share, and read from there.

    Cuts the lineage: what is lost with an executor is read again instead of computed again.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def has_repeats(df: DataFrame, name: str) -> bool:
    """Whether any value of the column, null included, is in several rows."""
    return not df.groupBy(named(name)).count().where("count > 1").isEmpty()


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def text_batches(spark: SparkSession) -> SparkSession:
    """Small Arrow batches for the tasks of a session that pass whole texts to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def worker_state(name: str) -> dict:
    """A dict that lives as long as the Python worker, so later tasks of the worker find what earlier ones left."""
    module = sys.modules.setdefault("tallyframe_worker_state", types.ModuleType("tallyframe_worker_state"))
    return module.__dict__.setdefault(name, {})


def release_memory() -> None:
    """Gives memory that the allocators of this process hold, but no longer use, back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run):
    """The same function over Arrow batches, which at its end releases the memory it used.

    Python workers wait for further tasks; what their allocators hold would count against the executor.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped
