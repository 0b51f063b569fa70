"""Feature columns of an incident table, and categorical codes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from wayside import functions as X
from wayside.model import (
    ENCODED_COLUMNS, INCIDENT, Roles, SAFETY_WEIGHTS, present_flags,
)
from wayside.operators.layout import with_place
from wayside.operators.records import spread
from wayside.sources.scratch import materialise

FAMILIES = {
    "temporal": ("accident_hour", "accident_day_of_week", "accident_month", "accident_season",
                 "is_weekend", "is_rush_hour"),
    "weather": ("weather_category", "weather_severity_score", "visibility_category",
                "temperature_category"),
    "geographic": ("distance_to_city_center", "urban_rural_classification", "state_region",
                   "population_density_category"),
    "infrastructure": ("infrastructure_count", "safety_equipment_score",
                       "traffic_control_type"),
    "encoding": tuple(ENCODED_COLUMNS.values()),
}
# points per feature and ceiling of each family's part of the score
FAMILY_POINTS = {
    "temporal": (10, 60), "weather": (15, 60), "geographic": (15, 60),
    "infrastructure": (20, 60), "encoding": (10, 40),
}


def with_time_features(df: DataFrame, roles: Roles = INCIDENT) -> DataFrame:
    if roles.start not in df.columns:
        return df
    start = F.col(roles.start)
    return df.withColumns(
        {
            roles.hour: F.hour(start),
            roles.dow: F.dayofweek(start),
            roles.month: F.month(start),
        }
    ).withColumns(
        {
            roles.season: X.season(F.col(roles.month)),
            roles.weekend: X.is_weekend(F.col(roles.dow)),
            roles.rush_hour: X.is_rush_hour(F.col(roles.hour)),
        }
    )


def with_weather_features(df: DataFrame, roles: Roles = INCIDENT) -> DataFrame:
    if roles.weather in df.columns:
        df = df.withColumn(roles.weather_category, X.weather_category(F.col(roles.weather)))
        df = df.withColumn(roles.weather_score, X.weather_score(F.col(roles.weather_category)))
    classes = {}
    if roles.visibility in df.columns:
        classes[roles.visibility_class] = X.visibility_class(F.col(roles.visibility))
    if roles.temperature in df.columns:
        classes[roles.temperature_class] = X.temperature_class(F.col(roles.temperature))
    return df.withColumns(classes) if classes else df


def with_place_features(df: DataFrame, roles: Roles = INCIDENT) -> DataFrame:
    present = set(df.columns)
    if roles.state in present:
        df = df.withColumn(roles.region, X.state_region(F.col(roles.state)))
    if {roles.state, roles.lat, roles.lng} <= present:
        df = df.withColumn(
            roles.city_distance,
            X.city_distance(F.col(roles.state), F.col(roles.lat), F.col(roles.lng)),
        )
        df = df.withColumn(roles.urban_class, X.urban_class(F.col(roles.city_distance)))
        df = df.withColumn(roles.density_class, X.density_class(F.col(roles.urban_class)))
    return df


def with_equipment_features(df: DataFrame, roles: Roles = INCIDENT) -> DataFrame:
    flags = present_flags(df.columns)
    if not flags:
        return df
    added = {
        roles.equipment_count: X.count_true(flags),
        roles.safety_score: X.weighted_true(flags, SAFETY_WEIGHTS),
    }
    if roles.signal in flags and roles.stop in flags:
        added[roles.control] = X.traffic_control(roles.signal, roles.stop)
    return df.withColumns(added)


def derive_features(df: DataFrame, roles: Roles = INCIDENT) -> DataFrame:
    """Every row-local feature; one projection chain, no job is run."""
    for step in (
        with_time_features, with_weather_features, with_place_features, with_equipment_features
    ):
        df = step(df, roles)
    return df


def create_features(df: DataFrame, roles: Roles = INCIDENT) -> DataFrame:
    """All features, then the integer codes of the categorical ones."""
    return encode_categories(derive_features(df, roles))


# ----------------------------------------------------------------- categories


def category_values(df: DataFrame, columns) -> DataFrame:
    """Distinct ``(column, value)`` pairs, nulls left out, from one scan.

    Distinct combinations come first: they collapse on the map side, so only they are
    unpivoted."""
    combos = df.select(*[F.col(f"`{c}`") for c in columns]).distinct()
    pairs = spread(
        combos, [{"column": F.lit(c), "value": F.col(f"`{c}`").cast("string")} for c in columns]
    )
    return pairs.filter(F.col("value").isNotNull()).distinct()


def category_codes(values: DataFrame) -> DataFrame:
    """``(column, value, code)``: the position of each distinct value in the sorted order of its
    column, from 0.  All columns are numbered in one sort, and no task sees all values."""
    placed = with_place(values.orderBy("column", "value"), "_place")
    first = placed.groupBy("column").agg(F.min("_place").alias("_first"))
    return placed.join(F.broadcast(first), "column").select(
        "column", "value", (F.col("_place") - F.col("_first")).cast("int").alias("code")
    )


def encode_categories(
    df: DataFrame,
    encodings: Mapping[str, str] = ENCODED_COLUMNS,
    inline_limit: int = 2_000,
) -> DataFrame:
    """Add an integer code per listed column: 0, 1, … in sorted order, -1 for null.

    The values are found once and written.  Up to ``inline_limit`` of them, the codes become
    constants of the projection; beyond it each column is joined with its code table, which is
    broadcast only if its size allows.  The result is the same."""
    present = {c: e for c, e in encodings.items() if c in df.columns}
    if not present:
        return df
    values = materialise(category_values(df, list(present)), "categories")
    found = values.limit(inline_limit + 1).collect()
    if len(found) <= inline_limit:
        codes: dict[str, list[str]] = {c: [] for c in present}
        for column, value in sorted(found):
            codes[column].append(value)
        return df.withColumns(
            {
                e: _constant_code(F.col(f"`{c}`").cast("string"), codes[c])
                for c, e in present.items()
            }
        )
    numbered = materialise(category_codes(values), "codes")
    for column, encoded in present.items():
        own = numbered.filter(F.col("column") == column).select(
            F.col("value").alias("_wayside_value"), F.col("code").alias("_wayside_code"))
        match = F.col(f"`{column}`").cast("string") == F.col("_wayside_value")
        df = (
            df.join(own, match, "left")
            .withColumn(encoded, F.coalesce("_wayside_code", F.lit(-1)))
            .drop("_wayside_value", "_wayside_code")
        )
    return df


def _constant_code(value, ordered):
    if not ordered:
        return F.lit(-1)
    entries = [p for code, text in enumerate(ordered) for p in (F.lit(text), F.lit(code))]
    return F.coalesce(F.try_element_at(F.create_map(*entries), value), F.lit(-1))


# --------------------------------------------------------------------- report


def feature_score(columns) -> float:
    """Mean of the five capped family scores."""
    total = 0
    for family, (points, ceiling) in FAMILY_POINTS.items():
        made = sum(1 for c in FAMILIES[family] if c in columns)
        total += min(made * points, ceiling)
    return round(total / len(FAMILY_POINTS), 2)


def feature_report(df: DataFrame) -> DataFrame:
    """One row per feature present: family, rows filled, and the overall score."""
    named = [(fam, c) for fam, cols in FAMILIES.items() for c in cols if c in df.columns]
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"n_{c}") for _, c in named]
    )
    return spread(
        counted,
        [
            {
                "family": F.lit(family),
                "feature": F.lit(c),
                "filled_rows": F.col(f"n_{c}"),
                "total_rows": F.col("rows"),
                "feature_engineering_score": F.lit(feature_score(df.columns)),
            }
            for family, c in named
        ],
    )
