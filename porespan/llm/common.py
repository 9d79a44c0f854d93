"""Helpers that the corpus operators share: word syntax and scratch storage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..scratch import checkpointed, table_path

__all__ = ["BLANKS", "GAP", "WORD", "ascii_lower", "checkpointed", "connected_components", "count_words", "split_words", "table", "tidied", "written"]
#: A word is a run of characters other than ASCII white space; Java and DuckDB read the same class.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: as ``checkpointed``, but columnar and compressed."""
    path = table_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function on batches that hands a worker's free memory back when its task ends, as the worker may go on with the
    next stage beside an executor that needs it."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library can
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def split_words(text: Column) -> Column:
    """The words of a text as an array; empty for null, empty and blank texts."""
    core = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{GAP}|{GAP}$", "")
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, GAP))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character kept."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def count_words(text: Column) -> Column:
    """Number of words of a text, null counting 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


