"""Configured chains of transformations.

A step is ``{"type": name, "config": {...}, "critical": bool}``.  The registry maps names to
functions ``(DataFrame, config) -> DataFrame``; users add their own with ``register``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, functions as F

from wayside.operators import cleaning

Transform = Callable[[DataFrame, Mapping], DataFrame]


def _nulls(df: DataFrame, config: Mapping) -> DataFrame:
    return cleaning.null_strategy(df, config.get("strategies", {}))


def _outliers(df: DataFrame, config: Mapping) -> DataFrame:
    return cleaning.zscore_filter_independent(
        df, config.get("columns", ()), config.get("z_threshold", 3.0)
    )


def _types(df: DataFrame, config: Mapping) -> DataFrame:
    return cleaning.type_convert(df, config.get("conversions", {}))


def _texts(df: DataFrame, config: Mapping) -> DataFrame:
    return cleaning.string_normalize(
        df, config.get("columns", ()), config.get("operations", ("trim",))
    )


def _ranges(df: DataFrame, config: Mapping) -> DataFrame:
    act = cleaning.range_clamp if config.get("action", "filter") == "clamp" else (
        cleaning.range_filter
    )
    return act(df, config.get("ranges", {}))


@dataclass(frozen=True)
class Kind:
    transform: Transform
    applies: Callable[[DataFrame, Mapping], bool] = lambda df, config: True


REGISTRY: dict[str, Kind] = {
    "null_handling": Kind(_nulls),
    "outlier_removal": Kind(_outliers),
    "data_type_conversion": Kind(_types),
    "string_normalization": Kind(_texts),
    "range_validation": Kind(_ranges),
}


def register_transformation(
    name: str,
    transform: Transform,
    applies: Callable[[DataFrame, Mapping], bool] | None = None,
) -> None:
    """Add a kind of step; where ``applies`` is false the step is skipped."""
    if not callable(transform):
        raise TypeError("a transformation is a function of a DataFrame and a config")
    REGISTRY[name] = Kind(transform, applies) if applies else Kind(transform)


@dataclass
class StepRecord:
    position: int
    type: str | None
    status: str  # applied, skipped, failed
    config: Mapping = field(default_factory=dict)
    rows: Observation | None = None


def apply_steps(
    df: DataFrame,
    steps: Sequence[Mapping],
    records: list[StepRecord] | None = None,
    count_rows: bool = False,
) -> DataFrame:
    """Fold the steps over ``df``.  An unknown type raises; a step without type, or that does
    not apply, is skipped; a failing step raises if critical and is skipped otherwise.

    ``count_rows`` counts the rows behind each step while the result is consumed.  It costs
    no scan, but no filter moves past a counting point."""
    for position, step in enumerate(steps):
        name, config = step.get("type"), step.get("config", {})
        record = StepRecord(position, name, "skipped", config)
        if records is not None:
            records.append(record)
        if not name:
            continue
        if name not in REGISTRY:
            raise ValueError(f"unknown transformation {name!r}; known: {sorted(REGISTRY)}")
        kind = REGISTRY[name]
        if not kind.applies(df, config):
            continue
        try:
            changed = kind.transform(df, config)
            changed.schema  # analysis errors surface here
        except Exception as error:
            record.status = "failed"
            if step.get("critical", False):
                raise ValueError(f"critical step {position} ({name}) failed") from error
            continue
        record.status = "applied"
        if count_rows:
            record.rows = Observation(f"step {position}")
            changed = changed.observe(record.rows, F.count(F.lit(1)).alias("rows"))
        df = changed
    return df


def step_summary(df: DataFrame, steps: Sequence[Mapping]) -> DataFrame:
    """Run the steps and list them: status, configuration, rows behind each applied one."""
    records: list[StepRecord] = []
    result = apply_steps(df, steps, records, count_rows=True)
    result.agg(F.count(F.lit(1))).first()
    rows = [
        (r.position, r.type, r.status, json.dumps(r.config, sort_keys=True),
         r.rows.get["rows"] if r.rows is not None else None)
        for r in records
    ]
    return df.sparkSession.createDataFrame(
        rows, "position int, type string, status string, config string, rows_after bigint"
    )


# fixed values: the chain for delivered incident tables
_SPAN = {
    "Start_Lat": (-90, 90), "Start_Lng": (-180, 180), "Severity": (1, 4),
    "Temperature(F)": (-50, 150), "Humidity(%)": (0, 100), "Visibility(mi)": (0, 50),
    "Wind_Speed(mph)": (0, 200),
}
_DOUBLES = ("Start_Lat", "Start_Lng", "Distance(mi)", "Temperature(F)", "Humidity(%)",
            "Visibility(mi)", "Wind_Speed(mph)")


def incident_steps_preset() -> list[dict]:
    """Null strategies, range filter, text tidying, z-score filter, casts."""
    keys_dropped = dict.fromkeys(cleaning.model.CRITICAL_AT_CLEANING, "drop")
    return [
        {"type": "null_handling", "critical": True,
         "config": {"strategies": keys_dropped | {
             "Severity": "fill_zero", "Temperature(F)": "fill_mean",
             "Humidity(%)": "fill_mean", "Weather_Condition": "fill_unknown"}}},
        {"type": "range_validation", "config": {"ranges": _SPAN, "action": "filter"}},
        {"type": "string_normalization",
         "config": {"columns": ["State", "City", "Weather_Condition", "Wind_Direction"],
                    "operations": ["trim", "upper", "remove_extra_spaces"]}},
        {"type": "outlier_removal",
         "config": {"columns": ["Distance(mi)", "Temperature(F)", "Wind_Speed(mph)",
                                "Visibility(mi)"], "z_threshold": 3.0}},
        {"type": "data_type_conversion",
         "config": {"conversions": {"Severity": "integer"} | dict.fromkeys(_DOUBLES, "double")}},
    ]
