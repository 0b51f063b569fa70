"""Bucketed, partitioned catalogue tables of the silver layer."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from wayside.model import INCIDENT, Roles
from wayside.operators.layout import balanced
from wayside.operators.silver import (
    infrastructure_features, silver_detail, weather_aggregated,
)


@dataclass(frozen=True)
class TableLayout:
    buckets: int
    bucket_by: tuple[str, ...]
    partition_by: tuple[str, ...]
    statistics: tuple[str, ...]


DETAIL = TableLayout(50, ("State",), ("accident_year", "accident_month"),
                     ("State", "Severity", "weather_category"))
WEATHER = TableLayout(20, ("State",), ("aggregation_year",), ("State", "weather_category"))
INFRASTRUCTURE = TableLayout(20, ("State",), ("analysis_year",), ("State",))


def write_bucketed_table(
    df: DataFrame, table: str, layout: TableLayout, path: str | None = None
) -> DataFrame:
    """Replace ``table`` by an ORC table, snappy, with bloom filters on the bucket columns;
    returns the new table.

    Rows are first hashed into as many partitions as there are buckets, by the function the
    buckets use, so that a bucket is one file per partition value.  The rebalance splits an
    oversized bucket into several files of the same bucket instead of one huge task."""
    spark = df.sparkSession
    if "." in table:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {table.split('.')[0]}")
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    parts = [c for c in layout.partition_by if c in df.columns]
    placed = balanced(df, *layout.bucket_by, partitions=layout.buckets)
    writer = (
        placed.write.mode("overwrite")
        .format("orc")
        .option("compression", "snappy")
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", ",".join(layout.bucket_by))
        .bucketBy(layout.buckets, *layout.bucket_by)
    )
    if parts:
        writer = writer.partitionBy(*parts)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return spark.table(table)


def silver_detail_table(df: DataFrame, table: str, roles: Roles = INCIDENT, path=None):
    return write_bucketed_table(silver_detail(df, roles), table, DETAIL, path)


def silver_weather_table(df: DataFrame, table: str, roles: Roles = INCIDENT, path=None):
    return write_bucketed_table(weather_aggregated(df, roles), table, WEATHER, path)


def silver_infrastructure_table(df: DataFrame, table: str, roles: Roles = INCIDENT, path=None):
    return write_bucketed_table(infrastructure_features(df, roles), table, INFRASTRUCTURE, path)


def analyze_table(spark: SparkSession, table: str, columns: Sequence[str] | None = None) -> None:
    """Collect table statistics, and column statistics for the given (none for an empty list) or
    all columns."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS")
    if columns is not None and not columns:
        return
    scope = f"COLUMNS {', '.join(f'`{c}`' for c in columns)}" if columns else "ALL COLUMNS"
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR {scope}")


def table_describe(spark: SparkSession, table: str) -> DataFrame:
    """``(col_name, data_type, comment)`` rows of DESCRIBE EXTENDED; one row ``exists=false``
    for a table that is not there."""
    if not spark.catalog.tableExists(table):
        return spark.createDataFrame(
            [("exists", "false", None)], "col_name string, data_type string, comment string"
        )
    return spark.sql(f"DESCRIBE EXTENDED {table}")


def table_layout(spark: SparkSession, table: str) -> DataFrame:
    """One row: existence, buckets, bucket and partition columns."""
    facts = table_describe(spark, table)
    value = lambda name: F.max(F.when(F.col("col_name") == name, F.col("data_type")))
    return facts.agg(
        F.coalesce(value("exists"), F.lit("true")).cast("boolean").alias("exists"),
        value("Num Buckets").cast("int").alias("buckets"),
        value("Bucket Columns").alias("bucket_columns"),
        value("Provider").alias("provider"),
    )
