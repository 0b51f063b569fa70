"""The frames behind the silver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wayside.model import INCIDENT, Roles, present_flags
from wayside.operators.cleaning import project_available


def empty_like(df: DataFrame) -> DataFrame:
    """No rows, same columns."""
    return df.limit(0)


def silver_detail(df: DataFrame, roles: Roles = INCIDENT) -> DataFrame:
    """Incidents with year and month, projected to the silver columns they have."""
    if roles.start in df.columns:
        df = df.withColumns(
            {"accident_year": F.year(roles.start), roles.month: F.month(roles.start)}
        )
    return project_available(df)


def weather_aggregated(df: DataFrame, roles: Roles = INCIDENT) -> DataFrame:
    """Counts and conditions per state, weather class and year; empty when fewer than three
    of the six inputs exist."""
    inputs = (roles.state, roles.weather_category, roles.temperature, roles.humidity,
              roles.visibility, roles.start)
    if sum(c in df.columns for c in inputs) < 3:
        return empty_like(df)
    return df.groupBy(
        roles.state, roles.weather_category, F.year(roles.start).alias("aggregation_year")
    ).agg(
        F.count(F.lit(1)).alias("accident_count"),
        F.avg(roles.temperature).alias("avg_temperature"),
        F.avg(roles.humidity).alias("avg_humidity"),
        F.avg(roles.visibility).alias("avg_visibility"),
        F.min(roles.temperature).alias("min_temperature"),
        F.max(roles.temperature).alias("max_temperature"),
    )


def infrastructure_features(df: DataFrame, roles: Roles = INCIDENT) -> DataFrame:
    """Per state, urban class and year: incidents, count and rate of every flag, safety
    scores; empty when there is no flag."""
    flags = present_flags(df.columns)
    if not flags:
        return empty_like(df)
    keys = [F.col(roles.state)]
    if roles.urban_class in df.columns:
        keys.append(F.col(roles.urban_class))
    if roles.start in df.columns:
        keys.append(F.year(roles.start).alias("analysis_year"))
    measures = [F.count(F.lit(1)).alias("total_accidents")]
    for f in flags:
        as_number = F.col(f).cast("int")
        measures += [
            F.sum(as_number).alias(f"{f.lower()}_count"),
            F.avg(as_number).alias(f"{f.lower()}_rate"),
        ]
    if roles.safety_score in df.columns:
        measures += [
            F.avg(roles.safety_score).alias("avg_safety_score"),
            F.max(roles.safety_score).alias("max_safety_score"),
        ]
    return df.groupBy(*keys).agg(*measures)
