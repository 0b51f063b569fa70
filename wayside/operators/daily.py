"""Quality figures that are kept by day and merged, so that a new day does not rescan the table.

A summary has one row per day and place: rows, nulls per column, and sketches of the distinct keys
and rows.  Counts and nulls add up exactly.  Distinct numbers come from HyperLogLog sketches, whose
union is the sketch of all days; with ``LOG_SIZE`` 14 their standard error is 0.8 %.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wayside.functions.digest import row_digest
from wayside.model import INCIDENT, QualityThresholds, Roles
from wayside.operators.records import percent, spread

#: Registers of a sketch, as a power of two, and the standard error that follows.
LOG_SIZE = 14
STANDARD_ERROR = 1.04 / 2 ** (LOG_SIZE / 2)


def daily_summary(
    df: DataFrame, day: Column | None = None, key: str | None = INCIDENT.id, roles: Roles = INCIDENT
) -> DataFrame:
    """``day``, ``place`` (the state, if the table has one), ``rows``, ``nulls`` (by column),
    ``row_sketch`` and ``key_sketch``; one scan, one row per day and place.  A null day or state is a
    group of its own."""
    day = F.to_date(roles.start) if day is None else day
    place = F.col(roles.state) if roles.state in df.columns else F.lit(None).cast("string")
    fields = {f.name: f for f in df.schema}
    nulls = F.create_map(*[
        x for c in df.columns for x in (F.lit(c), F.count_if(F.col(f"`{c}`").isNull()))])
    sketch = lambda digest: F.hll_sketch_agg(digest, F.lit(LOG_SIZE))
    held = row_digest([fields[key]]) if key in fields else F.lit(None).cast("binary")
    return df.groupBy(day.alias("day"), place.alias("place")).agg(
        F.count(F.lit(1)).alias("rows"), nulls.alias("nulls"),
        sketch(row_digest(fields.values())).alias("row_sketch"), sketch(held).alias("key_sketch"))


def keep_days(summary: DataFrame, path: str) -> None:
    """Write a summary by day; a day that comes again replaces itself, others stay."""
    (summary.repartition("day").write.mode("overwrite").partitionBy("day")
     .option("partitionOverwriteMode", "dynamic").parquet(path))


def kept_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merged_null_profile(
    summary: DataFrame, columns: Sequence[str], thresholds: QualityThresholds = QualityThresholds()
) -> DataFrame:
    """As ``null_profile`` of all the days' rows; exact.  Columns that a day did not have count as
    null there."""
    missing = lambda c: F.coalesce(F.col("nulls")[c], F.col("rows"))
    counted = summary.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        *[F.coalesce(F.sum(missing(c)), F.lit(0)).alias(f"null_{c}") for c in columns])
    share = {c: percent(F.col(f"`null_{c}`"), F.col("rows")) for c in columns}
    return spread(counted, [
        {"column": F.lit(c), "null_count": F.col(f"`null_{c}`"), "null_percentage": share[c],
         "high_null": share[c] > thresholds.max_null_percentage} for c in columns])


def merged_distribution(summary: DataFrame) -> DataFrame:
    """``(level, key, rows)`` per day, per place and in all, as ``distribution_analysis``; exact."""
    levels = F.array(
        F.struct(F.lit("date").alias("level"), F.col("day").cast("string").alias("key")),
        F.struct(F.lit("state").alias("level"), F.col("place").alias("key")),
        F.struct(F.lit("all").alias("level"), F.lit("all").alias("key")))
    return summary.select("rows", F.inline(levels)).groupBy("level", "key").agg(
        F.sum("rows").alias("rows"))


def merged_duplicates(
    summary: DataFrame, thresholds: QualityThresholds = QualityThresholds()
) -> DataFrame:
    """As ``duplicate_analysis`` of all the days' rows, with estimated distinct numbers:
    ``error_rows`` is three standard errors of ``distinct_rows``.  Copies on different days are found
    too, since sketches are united, not added."""
    united = summary.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"),
        F.hll_sketch_estimate(F.hll_union_agg("row_sketch")).alias("_rows"),
        F.hll_sketch_estimate(F.hll_union_agg("key_sketch")).alias("_keys"))
    total = F.col("total_rows")
    known = lambda c: F.least(F.coalesce(F.col(c), F.lit(0)), total)
    repeated = total - known("_rows")
    share = F.coalesce(F.try_divide(repeated.cast("double"), total.cast("double")) * 100, F.lit(0.0))
    return united.select(
        "total_rows", known("_rows").alias("distinct_rows"), repeated.alias("duplicate_rows"),
        F.round(share, 2).alias("duplicate_percentage"),
        F.when(F.col("_keys") > 0, total - known("_keys")).otherwise(F.lit(0)).cast("bigint").alias("id_duplicates"),
        F.ceil(3 * STANDARD_ERROR * known("_rows")).alias("error_rows"),
        (share <= thresholds.max_duplicate_percentage).alias("is_acceptable"))
