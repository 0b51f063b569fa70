"""Exact quantiles of any number of rows without sorting them or gathering them anywhere.

Each pass is one global aggregate.  A sketch places a bracket around the wanted rank and the
next pass counts exactly what lies below and inside it; a bracket shrinks several hundredfold
per pass.  Once few enough rows are left, a sketch that is large enough to keep all of them
gives the value itself.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import ROUND_CEILING, Decimal

from pyspark.sql import Column, DataFrame, functions as F

from wayside.operators.records import one_row

_STEPS = 500
_GRID = f"array({', '.join(f'{i / _STEPS}D' for i in range(_STEPS + 1))})"


def _rank(p: float, n: int) -> int:
    """The nearest rank: the first value with at least a share ``p`` at or below it."""
    return max(1, int((Decimal(str(p)) * n).to_integral_value(ROUND_CEILING)))


def _between(x: Column, low, high) -> Column:
    test = x.isNotNull()
    if low is not None:
        test = test & (x > F.lit(low))
    return test & (x < F.lit(high)) if high is not None else test


def exact_quantiles(
    df: DataFrame,
    wanted: Mapping[str, Sequence[float]],
    small: int = 50_000,
    accuracy: int = 10_000,
) -> dict[str, list]:
    """``{column: [value per probability]}``; null values are left out, None if all are."""
    brackets = {(c, p): (None, None) for c, ps in wanted.items() for p in ps}
    margin = dict.fromkeys(brackets, 2)
    found: dict[tuple, object] = {}
    last: dict[tuple, tuple] = {}  # target -> bracket and position inside it
    while brackets:
        places = list(dict.fromkeys((c, low, high) for (c, _), (low, high) in brackets.items()))
        aggregates: dict[str, Column] = {}
        for i, (c, low, high) in enumerate(places):
            x = F.col(c)
            aggregates[f"n{i}"] = F.count(x)
            nothing = F.lit(0).cast("bigint")
            aggregates[f"below{i}"] = F.count_if(x < F.lit(low)) if low is not None else nothing
            aggregates[f"low{i}"] = F.count_if(x == F.lit(low)) if low is not None else nothing
            aggregates[f"mid{i}"] = F.count_if(_between(x, low, high))
            aggregates[f"high{i}"] = F.count_if(x == F.lit(high)) if high is not None else nothing
            aggregates[f"grid{i}"] = F.percentile_approx(
                F.when(_between(x, low, high), x), F.expr(_GRID), accuracy
            )
        row = one_row(df, aggregates)
        for target, (low, high) in list(brackets.items()):
            c, p = target
            i = places.index((c, low, high))
            n, below, at_low, mid, at_high = (
                row[f"{name}{i}"] for name in ("n", "below", "low", "mid", "high")
            )
            if not n:
                found[target] = None
                del brackets[target]
                continue
            position = _rank(p, n) - below
            if position < 1 or position > at_low + mid + at_high:
                # the sketch was further off than the margin: start over with a wider one
                margin[target] *= 4
                brackets[target] = (None, None)
            elif position <= at_low:
                found[target] = low
                del brackets[target]
            elif position > at_low + mid:
                found[target] = high
                del brackets[target]
            elif mid <= small:
                last[target] = (low, high, (position - at_low - 0.5) / mid)
                del brackets[target]
            else:
                at = (position - at_low) / mid * _STEPS
                grid, m = row[f"grid{i}"], margin[target]
                first, final = int(at) - m, int(at) + 1 + m
                brackets[target] = (
                    grid[first] if first >= 0 else low,
                    grid[final] if final <= _STEPS else high,
                )
    if last:
        row = one_row(
            df,
            {
                f"v{i}": F.percentile_approx(
                    F.when(_between(F.col(c), low, high), F.col(c)), share, 4 * small
                )
                for i, ((c, _), (low, high, share)) in enumerate(last.items())
            },
        )
        found |= {target: row[f"v{i}"] for i, target in enumerate(last)}
    return {c: [found[c, p] for p in ps] for c, ps in wanted.items()}
