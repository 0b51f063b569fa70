"""The two end-to-end flows: delivered file to bronze, bronze to silver and reports."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wayside import model
from wayside.model import INCIDENT, QualityThresholds, Roles
from wayside.operators import cleaning, quality, schema_checks
from wayside.operators.features import FAMILIES, create_features
from wayside.operators.reports import all_reports
from wayside.sinks.files import write_bronze
from wayside.sinks.tables import (
    DETAIL, INFRASTRUCTURE, WEATHER, analyze_table, silver_detail_table,
    silver_infrastructure_table, silver_weather_table,
)
from wayside.sources.csv import csv_scan_strict, with_ingestion_metadata
from wayside.sources.files import observed, require_files, require_valid_read
from wayside.sources.scratch import discard, materialise, materialise_alone, released


# ----------------------------------------------------------------- cleaning


def corrections_made(columns) -> int:
    """How many column corrections the cleaning applies to a table with these columns."""
    tidied = ("State", "City", "Weather_Condition", "Wind_Direction", *model.TWILIGHT_COLUMNS)
    checked = ("temperature_fahrenheit", "wind_speed_mph", "distance_miles", "pressure_inches")
    renamed = {model.MEASURE_NAMES.get(c, c) for c in columns}
    return sum(c in renamed for c in (*tidied, *checked))


def _stages(
    df: DataFrame,
    roles: Roles,
    keep_nulls: bool,
    watch: Callable[[str, DataFrame], DataFrame] = lambda name, frame: frame,
) -> dict[str, DataFrame]:
    """The cleaning as named intermediate tables, each passed through ``watch`` before the next
    reads it.  Statistics are taken in several passes, so the deduplicated rows are written once
    and the passes read only what they need."""
    stages = {"input": df}
    written = materialise_alone(
        df.sparkSession, lambda: cleaning.dedup_by_key(df, [roles.id]), "deduplicated")
    stages["deduplicated"] = watch("deduplicated", written)
    stages["nulls_handled"] = watch(
        "nulls_handled", cleaning.adaptive_null_handling(stages["deduplicated"]))
    stages["in_range"] = watch("in_range", cleaning.physical_range_filter(
        cleaning.rename_measures(stages["nulls_handled"]), roles
    ))
    tidy = cleaning.null_out_impossible(
        cleaning.standardize_formats(stages["in_range"], roles), roles)
    stages["cleaned"] = watch(
        "cleaned", cleaning.zscore_filter_sequential(tidy, keep_nulls=keep_nulls))
    stages["written"] = written
    return stages


def clean_incidents(
    df: DataFrame, roles: Roles = INCIDENT, keep_nulls: bool = False
) -> DataFrame:
    """Deduplicate, treat nulls, rename, filter ranges, tidy texts, null the impossible,
    filter outliers.  ``keep_nulls`` spares rows the outlier filter would drop for a null."""
    return _stages(df, roles, keep_nulls)["cleaned"]


def cleaning_report(df: DataFrame, roles: Roles = INCIDENT) -> DataFrame:
    """One row: rows after each stage, retention and cleaning score.  The stages are counted while
    their rows pass on the way to the last one; the input alone is counted by itself."""
    seen = {}

    def watch(name: str, frame: DataFrame) -> DataFrame:
        frame, seen[name] = observed(frame, name)
        return frame

    stages = _stages(df, roles, False, watch)
    stages["cleaned"].write.format("noop").mode("overwrite").save()
    counts = {name: found.get["records_read"] for name, found in seen.items()}
    counts["input"] = df.count()
    discard(stages["written"])
    corrections = corrections_made(df.columns)
    score = cleaning.cleaning_score(counts["input"], counts["cleaned"], corrections)
    figures = {
        "input_records": counts["input"],
        "duplicates_removed": counts["input"] - counts["deduplicated"],
        "records_after_nulls": counts["nulls_handled"],
        "records_in_range": counts["in_range"],
        "outliers_removed": counts["in_range"] - counts["cleaned"],
        "output_records": counts["cleaned"],
        "retention_rate": round(100.0 * counts["cleaned"] / max(counts["input"], 1), 2),
        "data_corrections": corrections,
        "cleaning_score": score,
    }
    return df.sparkSession.createDataFrame(
        [tuple(figures.values())],
        ", ".join(f"{k} {'double' if isinstance(v, float) else 'bigint'}"
                  for k, v in figures.items()),
    )


def features_made(columns) -> int:
    return sum(c in columns for family in FAMILIES.values() for c in family)


def transformation_score(cleaning: float, features: int, tables: int) -> float:
    return round(0.4 * cleaning + 40 * min(features / 20, 1.0) + 20 * min(tables / 3, 1.0), 2)


# ------------------------------------------------------------------ to bronze


@dataclass
class Ingestion:
    schema: DataFrame
    quality: DataFrame
    written: DataFrame
    cleaned: bool


def ingest_to_bronze(
    spark: SparkSession,
    csv_path: str | list[str],
    bronze_path: str,
    schema: T.StructType = model.INCIDENT_SCHEMA,
    thresholds: QualityThresholds = QualityThresholds(),
    multiline: bool | None = None,
) -> Ingestion:
    """Read strictly, check schema and quality, drop corrupt rows when the score is below the
    threshold, write partitioned bronze.  The typed rows are written once in between, because
    the checks and the write each need them and CSV is slow to read."""
    require_files(spark, csv_path, min_bytes=1)
    with released(spark):
        made = _ingested(spark, csv_path, bronze_path, schema, thresholds, multiline)
    return made


def _ingested(spark, csv_path, bronze_path, schema, thresholds, multiline) -> Ingestion:
    scanned = csv_scan_strict(spark, csv_path, schema, multiline)
    loaded = materialise(with_ingestion_metadata(scanned), "ingested")
    require_valid_read(loaded)
    delivered = loaded.drop(*model.INGESTION_COLUMNS)
    schema_found = schema_checks.schema_report(
        delivered, schema, [f.name for f in schema], strict=True, optional=model.OPTIONAL_COLUMNS
    )
    report = _local(quality.quality_report(delivered, thresholds=thresholds))
    score = report.filter(F.col("metric") == "overall_quality_score").first()["value"]
    clean = score < thresholds.min_quality_score
    kept = cleaning.corrupt_row_filter(loaded) if clean else loaded
    return Ingestion(_local(schema_found), report, _local(write_bronze(kept, bronze_path)), clean)


def _local(report: DataFrame) -> DataFrame:
    """A report, a few rows per column of the table at most, that no longer reads the table."""
    return report.sparkSession.createDataFrame(report.collect(), report.schema)


# ------------------------------------------------------------------ to silver


SILVER_TABLES = {
    "accidents_clean": (silver_detail_table, DETAIL),
    "weather_aggregated": (silver_weather_table, WEATHER),
    "infrastructure_features": (silver_infrastructure_table, INFRASTRUCTURE),
}


@dataclass
class Silver:
    tables: Mapping[str, DataFrame]
    reports: Mapping[str, DataFrame]
    scores: DataFrame


def build_silver(
    bronze: DataFrame,
    database: str | None = None,
    location: str | None = None,
    roles: Roles = INCIDENT,
) -> Silver:
    """Clean, add features, write the three silver tables, prepare every report.  Tables go to
    ``location`` if one is given, else to the warehouse."""
    spark = bronze.sparkSession
    stages = _stages(bronze, roles, False)
    passing, seen = observed(create_features(stages["cleaned"], roles), "features")
    featured = materialise(passing, "featured")
    discard(stages["written"])
    tables = {}
    for name, (write, layout) in SILVER_TABLES.items():
        full = f"{database}.{name}" if database else name
        made = write(featured, full, roles, f"{location}/{name}" if location else None)
        tables[name] = made
        analyze_table(spark, full, [c for c in layout.statistics if c in made.columns])
    rows_in, rows_out = bronze.count(), seen.get["records_read"]
    cleaned_score = cleaning.cleaning_score(rows_in, rows_out, corrections_made(bronze.columns))
    made = features_made(featured.columns)
    scores = spark.createDataFrame(
        [(rows_in, rows_out, cleaned_score, made, len(tables),
          transformation_score(cleaned_score, made, len(tables)))],
        "records_in bigint, records_out bigint, cleaning_score double, features int,"
        " tables int, transformation_score double",
    )
    reports = all_reports(featured, roles)
    discard(featured)  # tables and the bases of the reports are written
    return Silver(tables, reports, scores)
