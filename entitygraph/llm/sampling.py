"""Bounded, repeatable samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A column with more distinct values is no label.
MOST_CLASSES = 1000


def place(key: str) -> Column:
    """A repeatable place of a row in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("sample"), F.col(key).cast("string")), 11).cast("double") / F.lit(float(1 << 53))


def per_class(rows: DataFrame, key: str, label: str, bound: int, most: int | None = None) -> tuple[DataFrame, dict]:
    """About ``bound`` rows of each class at most (the rows whose place lies below bound / class size), and the class sizes.

    Two passes over (key, label): one counts the classes, one filters.  No class is
    sorted or gathered, so a class that holds a third of all rows costs nothing more.
    ``most`` bounds the sample of all classes together.
    """
    sizes = {r[0]: r[1] for r in rows.where(F.col(label).isNotNull()).groupBy(label).count().limit(MOST_CLASSES + 1).collect()}
    if len(sizes) > MOST_CLASSES:
        raise ValueError(f"{label} has more than {MOST_CLASSES} distinct values")
    if most is not None and sizes:
        bound = max(1, min(bound, most // len(sizes)))
    share = F.lit(0.0)
    for value, n in sorted(sizes.items()):
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, bound / n))).otherwise(share)
    return rows.where(place(key) < share), sizes
