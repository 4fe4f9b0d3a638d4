"""Column builders over arrays of words; all of them run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often ``body`` uses it. Without
    this the optimiser may move an array's expression into a lambda, once per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    r"""Runs of ``[^\x20\x09-\x0D]+``; none of a null text."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.filter(F.split(flat, " "), lambda w: w != "")


def indexes(first: int | Column, past: Column) -> Column:
    """``first`` to ``past - 1``; empty where that is nothing."""
    start = F.lit(first) if isinstance(first, int) else first
    return F.when(past > start, F.sequence(start, past - 1)).otherwise(F.array().cast("array<int>"))


def total(numbers: Column, start: Column) -> Column:
    return F.aggregate(numbers, start, lambda a, x: a + x)
