"""Turning one aggregated row into report rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, functions as F


def one_row(df: DataFrame, aggregates: Mapping[str, Column]) -> Row:
    """Run one global aggregate and fetch its single row."""
    return df.agg(*[c.alias(name) for name, c in aggregates.items()]).first()


def spread(row_df: DataFrame, records: Sequence[Mapping[str, Column]]) -> DataFrame:
    """One output row per record; every record builds its columns from the input row."""
    structs = [F.struct(*[c.alias(name) for name, c in r.items()]) for r in records]
    return row_df.select(F.inline(F.array(*structs)))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """``100 * part / whole``; 0 for an empty whole."""
    share = F.try_divide(part.cast("double"), whole.cast("double")) * 100
    return F.round(F.coalesce(share, F.lit(0.0)), digits)


def one_line(*frames: DataFrame) -> DataFrame:
    """Single-row frames with different columns as one row, without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for f in frames for c in f.columns])


def metric_rows(row_df: DataFrame, check: str, metrics: Mapping[str, Column]) -> DataFrame:
    """Long form ``(check, column, metric, value)`` of single-row metrics."""
    return spread(
        row_df,
        [
            {
                "check": F.lit(check),
                "column": F.lit(None).cast("string"),
                "metric": F.lit(name),
                "value": value.cast("double"),
            }
            for name, value in metrics.items()
        ],
    )
