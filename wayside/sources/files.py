"""File scans, file checks and figures of a load."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from wayside import model
from wayside.operators.records import spread

KIBIBYTE, GIBIBYTE = 1024, 1024**3
MIN_ROWS = 1000


def bronze_scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_with_filters(
    spark: SparkSession,
    path: str,
    format: str = "parquet",
    schema: T.StructType | None = None,
    filters: Mapping[str, object] | None = None,
    **options,
) -> DataFrame:
    """Read any format; a list value keeps the rows whose column is in it, any other value
    the equal ones.  Catalyst turns these into partition pruning and pushed filters."""
    reader = spark.read.format(format).options(**options)
    df = (reader.schema(schema) if schema is not None else reader).load(path)
    for column, wanted in (filters or {}).items():
        if isinstance(wanted, (list, tuple, set)):
            df = df.filter(F.col(column).isin(list(wanted)))
        else:
            df = df.filter(F.col(column) == wanted)
    return df


def source_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The files at a path with their sizes.  The contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return listed.select(F.col("path").alias("file_path"), F.col("length").alias("file_size"))


def _verdict(min_bytes: int, max_bytes: int) -> Column:
    size = F.col("file_size")
    return (
        F.when(size < min_bytes, "too small").when(size > max_bytes, "too large")
        .otherwise("accepted")
    )


def source_file_gate(
    spark: SparkSession,
    path: str | list[str],
    df: DataFrame | None = None,
    min_bytes: int = KIBIBYTE,
    max_bytes: int = 10 * GIBIBYTE,
) -> DataFrame:
    """One row per file at the path: its size and whether it passes.  With the table ``df`` that is
    read from there also its rows, and a file without any is rejected.  Every listed file is
    judged; a path without files raises."""
    files = source_files(spark, path)
    if not files.take(1):
        raise ValueError(f"there is no file at {path}")
    verdict = _verdict(min_bytes, max_bytes)
    if df is None:
        return files.withColumn("verdict", verdict)
    counted = df.groupBy(F.col("_metadata.file_path").alias("file_path")).agg(
        F.count(F.lit(1)).alias("rows"))
    # both name the same file; only one of them writes the scheme's slashes out
    name = lambda c: F.regexp_replace(c, "^file:/+", "/")
    counted = counted.select(name("file_path").alias("_file"), "rows")
    joined = files.join(counted, name("file_path") == F.col("_file"), "left").drop("_file")
    rows = F.coalesce("rows", F.lit(0)).cast("bigint")
    return joined.withColumn("rows", rows).withColumn(
        "verdict", F.when((verdict == "accepted") & (rows == 0), "empty").otherwise(verdict))


def require_files(
    spark: SparkSession,
    path: str | list[str],
    min_bytes: int = KIBIBYTE,
    max_bytes: int = 10 * GIBIBYTE,
) -> None:
    """Raises when there is no file at the path, or one outside the limits."""
    seen = source_files(spark, path).withColumn("verdict", _verdict(min_bytes, max_bytes)).agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("verdict") != "accepted").alias("bad")
    ).first()
    if not seen.files or seen.bad:
        raise ValueError(f"{seen.bad} of {seen.files} source files are rejected")


def observed(df: DataFrame, name: str = "load") -> tuple[DataFrame, Observation]:
    """Count rows while the table is consumed, instead of in a scan of its own."""
    watch = Observation(name)
    return df.observe(watch, F.count(F.lit(1)).alias("records_read")), watch


def ingestion_metrics(
    df: DataFrame, expected_columns: int = len(model.INCIDENT_SCHEMA) + 3
) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("records_read")).select(
        "records_read",
        F.lit(len(df.columns)).alias("columns_read"),
        F.lit(expected_columns).alias("columns_expected"),
        F.lit(len(df.columns) == expected_columns).alias("column_count_ok"),
    )


def post_read_validation(
    df: DataFrame,
    required: Sequence[str] = model.CRITICAL_AT_INGEST,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """``(check, level, passed)``: not empty and required columns (error), size (warning)."""
    counted = df.agg(F.count(F.lit(1)).alias("rows"))
    missing = [c for c in required if c not in df.columns]
    return spread(
        counted,
        [
            {"check": F.lit("not_empty"), "level": F.lit("error"), "passed": F.col("rows") > 0},
            {"check": F.lit("required_columns"), "level": F.lit("error"),
             "passed": F.lit(not missing)},
            {"check": F.lit("enough_rows"), "level": F.lit("warning"),
             "passed": F.col("rows") >= min_rows},
        ],
    )


def require_valid_read(df: DataFrame, **rules) -> DataFrame:
    """``df`` unchanged; raises when a check of level error fails."""
    failed = post_read_validation(df, **rules).filter(
        (F.col("level") == "error") & ~F.col("passed")
    )
    names = [r["check"] for r in failed.select("check").collect()]
    if names:
        raise ValueError(f"the load is not valid: {', '.join(names)}")
    return df
