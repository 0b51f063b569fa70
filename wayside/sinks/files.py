"""Partitioned file output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from wayside.model import INCIDENT, Roles
from wayside.operators.layout import balanced, partition_columns

BRONZE_PARTITIONS = ("partition_date", "partition_state")


def write_partitioned(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    format: str = "parquet",
    mode: str = "overwrite",
    compression: str | None = None,
    **options,
) -> None:
    """Write by partition values.  Rows are rebalanced on them first, so each value ends up
    in few, evenly sized files however frequent it is."""
    if partition_by:
        df = balanced(df, *partition_by)
    writer = df.write.mode(mode).format(format).options(**options)
    if compression:
        writer = writer.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_bronze(df: DataFrame, path: str, roles: Roles = INCIDENT) -> DataFrame:
    """Snappy Parquet by date and state; returns one row: rows and partitions written."""
    prepared = partition_columns(df, roles)
    write_partitioned(prepared, path, BRONZE_PARTITIONS, compression="snappy")
    written = df.sparkSession.read.parquet(path)
    return written.groupBy(*BRONZE_PARTITIONS).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records_written"),
        F.count(F.lit(1)).alias("partitions_created"),
    )
