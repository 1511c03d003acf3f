"""Helpers for row-local array work: no explode, no shuffle."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside higher-order functions.

    A plain column reference inside a lambda may be inlined by the optimizer and then runs once per element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def indexes(array: Column) -> Column:
    """0-based positions of ``array``; empty for an empty array."""
    size = F.size(array)
    return F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))


def at(array: Column, position: Column) -> Column:
    """0-based element, null outside the array."""
    return F.get(array, position)


def total(array: Column) -> Column:
    """Sum of an array of numbers as a long."""
    return F.aggregate(array, F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long"))
