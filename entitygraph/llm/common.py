"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entitygraph.functions.storage import broadcast_if_small, discard, settle
from entitygraph.functions.storage import read_table as read

__all__ = ["broadcast_if_small", "crc_class", "discard", "fresh", "mix64", "read", "settle", "slices", "small_batches", "texts_of"]

#: Words of every operator here: maximal runs without ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Rows that cross into Python at once; texts are long, so this stays small.
BATCH_ROWS = 512


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows of an Arrow batch, as a batch of long texts must fit in a Python worker.

    The session's setting is lowered, never raised, so plans that wait keep their bound; whatever the rows, Spark ends a batch at 64 MB.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_class(column: str, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo ``parts``: the split between learning and held-out rows."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(parts)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null reads as empty."""
    return [t if t is not None else "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def slices(texts: list[str], limit: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of texts with about ``limit`` code points together; a longer text stands alone."""
    a, total = 0, 0
    for i, t in enumerate(texts):
        if i > a and total + len(t) > limit:
            yield a, i
            a, total = i, 0
        total += len(t)
    if a < len(texts):
        yield a, len(texts)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on 64-bit words (shift-multiply rounds), vectorized."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
