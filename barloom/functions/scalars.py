"""Scalar expressions over single bars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round2(value: Column) -> Column:
    """Two digits, halves up: features are positive ratios."""
    return F.floor(value * 100 + 0.5) / 100


def whole_part(value: Column) -> Column:
    """Integer part, toward zero."""
    return value.cast("int")


def weekday(date: Column) -> Column:
    """Monday = 0."""
    return F.weekday(date)


def positive(value: Column, what: str) -> Column:
    """The value itself; fails the job when it is zero or negative."""
    return F.when(value > 0, value).otherwise(
        F.raise_error(F.concat(F.lit(f"{what} must be positive, got "), value.cast("string")))
    )
