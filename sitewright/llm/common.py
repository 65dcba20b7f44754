"""Helpers that the training-text operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.sources.tables import WHILE_WRITING, discard, release
from sitewright.sources.tables import saved as written

__all__ = ["NULL_ID", "ascii_lower", "discard", "doc_key", "hand_back", "key_back", "release", "slices", "small_batches", "small_side", "text_key", "written"]

#: A null id stands for one document before all others.
NULL_ID = -(2**63)


def small_side(df: DataFrame, most: int, size: Column | None = None, most_bytes: int = 32 << 20) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; else as it is, so that Spark shuffles both sides.

    size: the bytes of a row, where rows may be long; they must not exceed most_bytes together."""
    rows = df.limit(most + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.lit(0) if size is None else size), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if rows["n"] <= most and rows["b"] <= most_bytes else df


def text_key(text: Column) -> Column:
    """Tells the texts of rows with one id apart."""
    return F.xxhash64(text.cast("string"))


def small_batches(df: DataFrame) -> DataFrame:
    """df as it is; from now on its session hands Python at most 8 MB of rows at a time, unless it is set to less.

    Texts may be long: the default of 64 MB stands several times in memory, in both processes, for each task. The setting is
    the session's, as it counts when the rows are computed."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if conf.get(key) in ("67108864b", "64m", "-1", "-1b"):
        conf.set(key, WHILE_WRITING[key])
    return df


def doc_key(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def key_back(column: str) -> Column:
    return F.when(F.col(column) != NULL_ID, F.col(column))


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, all else as it is. Texts of ASCII alone, which have a byte a character, take the faster way."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many bytes of a text column, one row at least."""
    import numpy as np

    size = pc.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
    hand_back()


def hand_back() -> None:
    """Free memory goes back to the system, that of Arrow and that of the C library: workers stay, and what they hold for
    later adds up in an executor."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # other C libraries than GNU's have none
        trim(0)
