"""Row-wise sums over equipment flags.  A null flag counts as absent."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

from wayside.functions.cases import first_match


def _present(flag: str) -> Column:
    return F.coalesce(F.col(flag), F.lit(False))


def count_true(flags: Iterable[str]) -> Column:
    return reduce(add, (_present(f).cast("int") for f in flags), F.lit(0))


def weighted_true(flags: Iterable[str], weights: Mapping[str, int]) -> Column:
    terms = (_present(f).cast("int") * weights[f] for f in flags if weights.get(f))
    return reduce(add, terms, F.lit(0))


def traffic_control(signal: str, stop: str) -> Column:
    return first_match(
        [
            (_present(signal) & _present(stop), "Multiple"),
            (_present(signal), "Signal"),
            (_present(stop), "Stop"),
        ],
        "None",
    )
