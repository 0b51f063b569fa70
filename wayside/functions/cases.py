"""Small builders for CASE expressions from value tables."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, functions as F


def first_match(branches: Iterable[tuple[Column, object]], otherwise) -> Column:
    """CASE WHEN over ``(condition, value)`` pairs; null conditions fall through."""
    chained = reduce(lambda done, b: done.when(b[0], F.lit(b[1])), branches, F)
    return chained.otherwise(F.lit(otherwise))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
