"""The report catalogue: what each report groups by and measures, stated as data.

A report run alone is one hash aggregate over the table.  ``all_reports`` runs the whole
catalogue from five shared scans: reports whose keys fit together are rolled up from one
pre-aggregated base whose size is bounded by the domain (hours, weekdays, states, …), not
by the number of incidents.  The bases are cut so that each has at most some ten thousand
groups (cities aside): few enough to collapse within every task, whatever the row order.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from wayside.model import INCIDENT, REPORT_EQUIPMENT, Roles, SEVERITY_PERCENTILES, present_flags
from wayside.operators.records import spread
from wayside.sources.scratch import materialise

ROWS = ("accident_count", "rows", None)
SEVERITY = ("avg_severity", "avg", "severity")


@dataclass(frozen=True)
class Report:
    """``measures`` are (alias, kind, role); ``keys`` and roles are fields of Roles."""

    name: str
    family: str
    base: str
    keys: tuple[str, ...]
    measures: tuple[tuple[str, str, str | None], ...]
    at_least: tuple[tuple[str, float], ...] = ()
    order: tuple[tuple[str, str], ...] = ()
    top: int | None = None
    ranks: tuple[tuple[str, str], ...] = field(default=())

    def inputs(self, roles: Roles) -> set[str]:
        named = set(self.keys) | {r for _, _, r in self.measures if r}
        return {getattr(roles, r) for r in named}


CATALOGUE = (
    # by time
    Report("hourly_patterns", "temporal", "region", ("hour",),
           (ROWS, SEVERITY, ("states_affected", "distinct", "state"),
            ("rush_hour_accidents", "true", "rush_hour")),
           order=(("hour", "asc"),)),
    Report("daily_patterns", "temporal", "time", ("dow",),
           (ROWS, SEVERITY, ("weekend_accidents", "true", "weekend"),
            ("weather_variety", "distinct", "weather_category")),
           order=(("dow", "asc"),)),
    Report("monthly_patterns", "temporal", "time", ("month",),
           (ROWS, SEVERITY, ("avg_temperature", "avg", "temperature"),
            ("weather_conditions", "distinct", "weather_category")),
           order=(("month", "asc"),)),
    Report("seasonal_patterns", "temporal", "time", ("season",),
           (ROWS, SEVERITY, ("avg_temperature", "avg", "temperature"),
            ("avg_visibility", "avg", "visibility"),
            ("max_weather_severity", "max", "weather_score"))),
    Report("hourly_daily_matrix", "temporal", "time", ("hour", "dow"),
           (ROWS, SEVERITY), order=(("dow", "asc"), ("hour", "asc"))),
    # by place
    Report("state_summary", "geographic", "place", ("state",),
           (ROWS, SEVERITY, ("avg_distance_to_city", "avg", "city_distance"),
            ("cities_affected", "distinct", "city"),
            ("total_infrastructure", "sum", "equipment_count"),
            ("avg_safety_score", "avg", "safety_score")),
           order=(("accident_count", "desc"), ("state", "asc"))),
    Report("regional_summary", "geographic", "region", ("region",),
           (ROWS, SEVERITY, ("states_in_region", "distinct", "state"),
            ("avg_temperature", "avg", "temperature"),
            ("weather_variety", "distinct", "weather_category"))),
    Report("urban_rural_analysis", "geographic", "place", ("urban_class",),
           (ROWS, SEVERITY, ("avg_distance_to_city", "avg", "city_distance"),
            ("avg_infrastructure", "avg", "equipment_count"),
            ("avg_safety_score", "avg", "safety_score"))),
    Report("city_hotspots", "geographic", "place", ("state", "city"),
           (ROWS, SEVERITY, ("avg_infrastructure", "avg", "equipment_count")),
           at_least=(("accident_count", 100),),
           order=(("accident_count", "desc"), ("state", "asc"), ("city", "asc")), top=50),
    Report("population_density_analysis", "geographic", "place", ("density_class",),
           (ROWS, SEVERITY, ("avg_infrastructure", "avg", "equipment_count"),
            ("traffic_control_variety", "distinct", "control"))),
    # by weather
    Report("weather_category_impact", "weather", "region", ("weather_category",),
           (ROWS, SEVERITY, ("avg_temperature", "avg", "temperature"),
            ("avg_humidity", "avg", "humidity"), ("avg_visibility", "avg", "visibility"),
            ("avg_wind_speed", "avg", "wind")),
           order=(("accident_count", "desc"), ("weather_category", "asc"))),
    Report("weather_severity_basic", "weather", "region", ("weather_score",),
           (ROWS, ("avg_accident_severity", "avg", "severity"),
            ("states_affected", "distinct", "state")),
           order=(("weather_score", "asc"),)),
    Report("temperature_impact", "weather", "classes", ("temperature_class",),
           (ROWS, SEVERITY, ("avg_temperature", "avg", "temperature"),
            ("min_temperature", "min", "temperature"),
            ("max_temperature", "max", "temperature"))),
    Report("visibility_impact", "weather", "classes", ("visibility_class",),
           (ROWS, SEVERITY, ("avg_visibility", "avg", "visibility"),
            ("weather_conditions", "distinct", "weather_category"))),
    Report("weather_seasonal_patterns", "weather", "time", ("weather_category", "season"),
           (ROWS, SEVERITY, ("avg_temperature", "avg", "temperature")),
           order=(("season", "asc"), ("accident_count", "desc"), ("weather_category", "asc"))),
    # by equipment
    Report("traffic_control_effectiveness", "infrastructure", "equipment", ("control",),
           (ROWS, SEVERITY, ("avg_safety_score", "avg", "safety_score"),
            ("states_with_control", "distinct", "state"))),
    Report("safety_score_impact", "infrastructure", "equipment", ("safety_score",),
           (ROWS, SEVERITY, ("control_types", "distinct", "control")),
           order=(("safety_score", "asc"),)),
    Report("infrastructure_density_impact", "infrastructure", "equipment",
           ("equipment_count",),
           (ROWS, SEVERITY, ("avg_safety_score", "avg", "safety_score")),
           order=(("equipment_count", "asc"),)),
    # advanced
    Report("state_rankings", "advanced", "region", ("state",),
           (("total_accidents", "rows", None), SEVERITY,
            ("avg_safety_score", "avg", "safety_score")),
           ranks=(("accident_rank", "total_accidents"), ("severity_rank", "avg_severity"),
                  ("safety_rank", "avg_safety_score"))),
    Report("weather_severity_correlation", "advanced", "region", ("weather_score",),
           (ROWS, ("avg_accident_severity", "avg", "severity"),
            ("avg_temperature", "avg", "temperature"),
            ("severity_stddev", "stddev", "severity"), ("min_severity", "min", "severity"),
            ("max_severity", "max", "severity")),
           order=(("weather_score", "asc"),)),
    Report("complex_temporal_patterns", "advanced", "time",
           ("hour", "weekend", "weather_category"), (ROWS, SEVERITY),
           at_least=(("accident_count", 10),),
           order=(("hour", "asc"), ("weekend", "asc"), ("accident_count", "desc"),
                  ("weather_category", "asc"))),
    Report("high_severity_locations", "advanced", "place", ("state", "city"),
           (ROWS, SEVERITY, ("max_severity", "max", "severity")),
           at_least=(("accident_count", 50), ("avg_severity", 3.0)),
           order=(("avg_severity", "desc"), ("accident_count", "desc"), ("state", "asc"),
                  ("city", "asc"))),
)
BY_NAME = {r.name: r for r in CATALOGUE}
# two reports of the catalogue have a shape of their own, below
OWN_SHAPE = {"individual_equipment_analysis": "infrastructure",
             "severity_percentiles_by_state": "advanced"}


# -------------------------------------------------------- one report, one scan

_FROM_ROWS = {
    "avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "stddev": F.stddev_samp,
    "distinct": F.count_distinct, "true": F.count_if,
}


def _finish(grouped: DataFrame, report: Report, roles: Roles) -> DataFrame:
    """Thresholds, ranks, order and limit, all on the aggregated rows."""
    if report.at_least:
        grouped = grouped.filter(
            reduce(and_, (F.col(alias) >= low for alias, low in report.at_least))
        )
    if report.ranks:
        grouped = grouped.withColumns(
            {
                rank: F.dense_rank().over(Window.orderBy(F.col(by).desc_nulls_last()))
                for rank, by in report.ranks
            }
        )
    if report.order:
        columns = [F.col(getattr(roles, name, name)) for name, _ in report.order]
        grouped = grouped.orderBy(
            *[
                c.desc_nulls_last() if way == "desc" else c.asc_nulls_last()
                for c, (_, way) in zip(columns, report.order)
            ]
        )
    return grouped.limit(report.top) if report.top else grouped


def run_report(df: DataFrame, name: str, roles: Roles = INCIDENT) -> DataFrame:
    """One report of the catalogue over a table with features."""
    report = BY_NAME[name]
    measures = [
        (F.count(F.lit(1)) if kind == "rows" else _FROM_ROWS[kind](getattr(roles, role)))
        .alias(alias)
        for alias, kind, role in report.measures
    ]
    keys = [getattr(roles, k) for k in report.keys]
    return _finish(df.groupBy(*keys).agg(*measures), report, roles)


def severity_percentiles_by_state(
    df: DataFrame, roles: Roles = INCIDENT, at_least: int = 100, accuracy: int = 10_000
) -> DataFrame:
    """Severity percentiles per state.

    For an integer severity the value counts per state are aggregated first, which makes
    the percentiles exact and leaves a handful of rows per state; any other type uses the
    mergeable sketch."""
    if not isinstance(df.schema[roles.severity].dataType, T.IntegralType):
        sketched = df.groupBy(roles.state).agg(
            F.count(F.lit(1)).alias("accident_count"),
            *[
                F.percentile_approx(roles.severity, p, accuracy).alias(_percentile_name(p))
                for p in SEVERITY_PERCENTILES
            ],
        )
        return sketched.filter(F.col("accident_count") >= at_least)
    counts = df.groupBy(roles.state, roles.severity).agg(F.count(F.lit(1)).alias("n"))
    return _percentiles_from_counts(counts, roles, at_least)


def _percentile_name(p: float) -> str:
    return f"severity_p{int(p * 100)}"


def _percentiles_from_counts(counts: DataFrame, roles: Roles, at_least: int) -> DataFrame:
    """Nearest-rank percentiles from ``(state, severity, n)``; null severities only count."""
    state, severity = F.col(roles.state), F.col(roles.severity)
    known = F.when(severity.isNotNull(), F.col("n")).otherwise(0)
    own = Window.partitionBy(state)
    upto = own.orderBy(severity.asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    running = counts.select(
        state, severity, "n", F.sum(known).over(upto).alias("upto"),
        F.sum(known).over(own).alias("known"),
    )
    picks = [
        F.min(
            F.when(F.col("upto") >= F.ceil(F.lit(Decimal(str(p))) * F.col("known")), severity)
        ).alias(_percentile_name(p))
        for p in SEVERITY_PERCENTILES
    ]
    return (
        running.groupBy(roles.state)
        .agg(F.sum("n").alias("accident_count"), *picks)
        .filter(F.col("accident_count") >= at_least)
    )


def individual_equipment_analysis(df: DataFrame, roles: Roles = INCIDENT) -> DataFrame:
    """For every flag value of every equipment flag: incidents and mean severity.

    The flags are grouped together first (at most 3^9 combinations), and only those rows
    are unpivoted, so the table itself is neither scanned nine times nor multiplied."""
    flags = present_flags(df.columns, REPORT_EQUIPMENT)
    combos = df.groupBy(*flags).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(roles.severity).alias("severity_sum"),
        F.count(roles.severity).alias("severity_n"),
    )
    return _equipment_from_combinations(combos, flags)


def _equipment_from_combinations(combos: DataFrame, flags) -> DataFrame:
    long = spread(
        combos,
        [
            {
                "equipment_type": F.lit(f), "equipment_present": F.col(f), "n": F.col("n"),
                "severity_sum": F.col("severity_sum"), "severity_n": F.col("severity_n"),
            }
            for f in flags
        ],
    )
    return long.groupBy("equipment_type", "equipment_present").agg(
        F.sum("n").alias("accident_count"),
        F.try_divide(F.sum("severity_sum"), F.sum("severity_n")).alias("avg_severity"),
    )


# ------------------------------------------------ whole catalogue, shared scans


# what a base has to keep of a column for each kind of measure
_KEPT = {"avg": ("sum", "n"), "sum": ("sum",), "min": ("min",), "max": ("max",),
         "stddev": ("sum", "n", "sq")}
_KEEPERS = {
    "sum": lambda x: F.sum(x.cast("double")), "n": F.count, "min": F.min, "max": F.max,
    "sq": lambda x: F.sum(x.cast("double") * x),
}


class _Base:
    """One pre-aggregated table from which several reports are rolled up."""

    def __init__(self, reports: list[Report], roles: Roles, extra_dims=()):
        self.roles = roles
        dims, self.moments = set(), {(roles.severity, "sum"), (roles.severity, "n")}
        for r in reports:
            dims |= set(r.keys)
            for _, kind, role in r.measures:
                if kind in ("distinct", "true"):
                    dims.add(role)
                elif kind != "rows":
                    self.moments |= {(getattr(roles, role), kept) for kept in _KEPT[kind]}
        self.dims = sorted({getattr(roles, d) for d in dims} | set(extra_dims))

    def build(self, df: DataFrame) -> DataFrame:
        measures = [F.count(F.lit(1)).alias("n_rows")] + [
            _KEEPERS[kept](F.col(c)).alias(f"{kept}_{c}") for c, kept in sorted(self.moments)
        ]
        return df.groupBy(*self.dims).agg(*measures)

    def measure(self, kind: str, role: str | None, types: dict) -> Column:
        if kind == "rows":
            return F.sum("n_rows")
        c = getattr(self.roles, role)
        if kind == "distinct":
            return F.count_distinct(c)
        if kind == "true":
            return F.coalesce(F.sum(F.when(F.col(c), F.col("n_rows"))), F.lit(0))
        total, n = F.sum(f"sum_{c}"), F.sum(f"n_{c}")
        if kind == "avg":
            return F.try_divide(total, n)
        if kind == "sum":
            return total.cast("bigint") if isinstance(types[c], T.IntegralType) else total
        if kind == "stddev":
            spread_out = F.greatest(F.sum(f"sq_{c}") - total * total / n, F.lit(0.0))
            return F.when(n > 1, F.sqrt(spread_out / (n - 1)))
        return {"min": F.min, "max": F.max}[kind](f"{kind}_{c}")


def applicable(df: DataFrame, roles: Roles = INCIDENT) -> list[Report]:
    """The reports whose inputs this table has; each report is guarded on its own."""
    present = set(df.columns)
    return [r for r in CATALOGUE if r.inputs(roles) <= present]


def all_reports(df: DataFrame, roles: Roles = INCIDENT) -> dict[str, DataFrame]:
    """Every applicable report by name.  Each base is aggregated and written once."""
    made: dict[str, DataFrame] = {}
    by_base: dict[str, list[Report]] = {}
    for report in applicable(df, roles):
        by_base.setdefault(report.base, []).append(report)
    types = {f.name: f.dataType for f in df.schema}
    has_severity = roles.severity in types
    discrete = has_severity and isinstance(types[roles.severity], T.IntegralType)
    flags = present_flags(types, REPORT_EQUIPMENT) if has_severity else []
    if flags:
        by_base.setdefault("equipment", [])
    for name, reports in by_base.items():
        by_severity = name == "region" and discrete and roles.state in types
        extra = flags if name == "equipment" else [roles.severity] if by_severity else []
        base = _Base(reports, roles, extra)
        rows = materialise(base.build(df), f"report-{name}")
        for report in reports:
            measures = [
                base.measure(kind, role, types).alias(alias)
                for alias, kind, role in report.measures
            ]
            keys = [getattr(roles, k) for k in report.keys]
            made[report.name] = _finish(rows.groupBy(*keys).agg(*measures), report, roles)
        if name == "equipment" and flags:
            combos = rows.groupBy(*flags).agg(
                F.sum("n_rows").alias("n"),
                F.sum(f"sum_{roles.severity}").alias("severity_sum"),
                F.sum(f"n_{roles.severity}").alias("severity_n"),
            )
            made["individual_equipment_analysis"] = _equipment_from_combinations(combos, flags)
        if by_severity:
            counts = rows.groupBy(roles.state, roles.severity).agg(F.sum("n_rows").alias("n"))
            made["severity_percentiles_by_state"] = _percentiles_from_counts(counts, roles, 100)
    if "severity_percentiles_by_state" not in made and {roles.state, roles.severity} <= set(
        df.columns
    ):
        made["severity_percentiles_by_state"] = severity_percentiles_by_state(df, roles)
    return made


def report_family(name: str) -> str:
    return BY_NAME[name].family if name in BY_NAME else OWN_SHAPE[name]


def report_overview(reports: dict[str, DataFrame]) -> DataFrame:
    """One row per report: family, number of rows, incidents they cover, largest row."""
    parts = []
    for name, frame in sorted(reports.items()):
        size = "total_accidents" if "total_accidents" in frame.columns else "accident_count"
        parts.append(
            frame.agg(
                F.lit(report_family(name)).alias("family"),
                F.lit(name).alias("report"),
                F.count(F.lit(1)).alias("report_rows"),
                F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("incidents_covered"),
                F.max(size).cast("bigint").alias("largest_row"),
            )
        )
    return reduce(DataFrame.unionAll, parts)


def report_summary(reports: dict[str, DataFrame]) -> DataFrame:
    """Number of reports, and of report rows, per family."""
    return (
        report_overview(reports)
        .groupBy("family")
        .agg(
            F.count(F.lit(1)).alias("reports"), F.sum("report_rows").alias("report_rows")
        )
    )
