"""Typed CSV ingestion.

Columns are matched by header name, not by position: all fields are read as text and cast
to the wanted type, where text that does not fit becomes null.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from wayside import model

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
DATE_FORMAT = "yyyy-MM-dd"


def _typed(name: str, wanted: T.DataType) -> Column:
    text = F.nullif(F.col(f"`{name}`"), F.lit(""))
    if isinstance(wanted, T.StringType):
        return text
    if isinstance(wanted, (T.TimestampType, T.TimestampNTZType)):
        return F.try_to_timestamp(text, F.lit(TIMESTAMP_FORMAT)).cast(wanted)
    if isinstance(wanted, T.DateType):
        return F.try_to_timestamp(text, F.lit(DATE_FORMAT)).cast(wanted)
    return text.try_cast(wanted)


def csv_scan_strict(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType = model.INCIDENT_SCHEMA,
    multiline: bool | None = None,
    optional: tuple[str, ...] = model.OPTIONAL_COLUMNS,
) -> DataFrame:
    """The schema's columns, typed, plus optional known columns the file has.

    Schema columns the file lacks are null.  Files of one load must share a header; one that
    differs is an error rather than shifted columns.  Spark reads a file whose texts hold line
    breaks in one task (``multiline``); without a choice the files are looked through first, and
    only those that have such breaks are read so, all others in as many tasks as they have splits."""
    if multiline is None:
        broken, whole = files_by_breaks(spark, path)
        frames = [_raw(spark, files, breaks)
                  for files, breaks in ((whole, False), (broken, True)) if files]
        if len({tuple(f.columns) for f in frames}) > 1:
            raise ValueError("files of one load have different headers")
        raw = reduce(DataFrame.unionAll, frames) if frames else _raw(spark, path, False)
    else:
        raw = _raw(spark, path, multiline)
    have = set(raw.columns)
    columns = [
        (_typed(f.name, f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(
            f.name
        )
        for f in schema
    ]
    known = {f.name for f in schema}
    columns += [_typed(c, T.StringType()).alias(c) for c in optional
                if c in have and c not in known]
    return raw.select(*columns)


def _raw(spark: SparkSession, path: str | list[str], multiline: bool) -> DataFrame:
    return (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("enforceSchema", False)
        .option("multiLine", multiline)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .option("nullValue", "")
        .option("emptyValue", "")
        .csv(path)
    )


def files_by_breaks(spark: SparkSession, path: str | list[str]) -> tuple[list[str], list[str]]:
    """The files that have a line break inside quotes, and those that have none.

    Inside a record quotes come in pairs, doubled ones included.  A record that a break cuts in two
    therefore has a line with an odd number of quotes, and a file whose lines all have an even
    number has no such break.  Lines are counted where they are read, in all splits of all files."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    lines = lines.toDF("file", "quotes")
    found = lines.groupBy("file").agg(F.max(F.col("quotes") % 2).alias("odd"))
    # one row per file, as many as the reader lists on the driver anyway
    broken = {r.file: r.odd == 1 for r in found.collect()}
    return (sorted(f for f, odd in broken.items() if odd),
            sorted(f for f, odd in broken.items() if not odd))


def csv_scan_custom_schema(
    spark: SparkSession, path: str | list[str], schema: T.StructType, multiline: bool | None = None
) -> DataFrame:
    """Exactly the caller's columns."""
    return csv_scan_strict(spark, path, schema, multiline, optional=())


def with_ingestion_metadata(df: DataFrame, batch_id: str | None = None) -> DataFrame:
    """Add the ingestion time and date and one batch id for the whole load."""
    return df.withColumn("ingestion_timestamp", F.current_timestamp()).withColumns(
        {
            "ingestion_date": F.col("ingestion_timestamp").cast("date"),
            "batch_id": F.lit(batch_id or str(uuid.uuid4())),
        }
    )
