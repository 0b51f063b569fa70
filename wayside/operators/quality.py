"""Data-quality and profiling reports.

Each report is one aggregate over the table (two where a bound has to be known before rows
can be counted against it), spread into rows afterwards.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from wayside import functions as X
from wayside import model
from wayside.functions.digest import row_digest
from wayside.model import INCIDENT, QualityThresholds, Roles, US_BOX, WORLD_BOX
from wayside.operators.quantiles import exact_quantiles
from wayside.operators.records import metric_rows, one_line, one_row, percent, spread

DEFAULT = QualityThresholds()


def _total() -> Column:
    return F.count(F.lit(1))


def _blank(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


# ------------------------------------------------------------------- nulls


def null_profile(df: DataFrame, thresholds: QualityThresholds = DEFAULT) -> DataFrame:
    """Per column: null count, percentage, and whether it exceeds the limit."""
    counted = df.agg(
        _total().alias("rows"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{c}") for c in df.columns],
    )
    share = {c: percent(F.col(f"`null_{c}`"), F.col("rows")) for c in df.columns}
    return spread(
        counted,
        [
            {
                "column": F.lit(c),
                "null_count": F.col(f"`null_{c}`"),
                "null_percentage": share[c],
                "high_null": share[c] > thresholds.max_null_percentage,
            }
            for c in df.columns
        ],
    )


def null_overview(df: DataFrame, thresholds: QualityThresholds = DEFAULT) -> DataFrame:
    """Whole-table null figures, from the per-column profile."""
    profile = null_profile(df, thresholds)
    return profile.agg(
        F.count(F.lit(1)).alias("total_columns"),
        F.sum("null_count").alias("total_null_values"),
        F.round(F.avg("null_percentage"), 2).alias("average_null_percentage"),
        F.count_if("high_null").alias("high_null_columns"),
    )


# --------------------------------------------------------------- geography


def _bad_start(roles: Roles, box: model.GeoBox) -> Column:
    lat, lng = F.col(roles.lat), F.col(roles.lng)
    return lat.isNull() | lng.isNull() | X.outside(lat, lng, box)


def geo_validation(
    df: DataFrame, roles: Roles = INCIDENT, box: model.GeoBox = US_BOX
) -> DataFrame:
    """Rows whose start lies outside the box or is unknown; ends outside the box."""
    has_end = roles.end_lat in df.columns and roles.end_lng in df.columns
    bad_end = (
        F.count_if(X.outside(F.col(roles.end_lat), F.col(roles.end_lng), box))
        if has_end
        else _blank("bigint")
    )
    counted = df.agg(
        _total().alias("total_validated"),
        F.count_if(_bad_start(roles, box)).alias("invalid_coordinates"),
        bad_end.alias("invalid_end_coordinates"),
    )
    return counted.select(
        "total_validated",
        "invalid_coordinates",
        percent(F.col("invalid_coordinates"), F.col("total_validated")).alias(
            "invalid_percentage"
        ),
        "invalid_end_coordinates",
        F.when(
            F.col("invalid_end_coordinates").isNotNull(),
            percent(F.col("invalid_end_coordinates"), F.col("total_validated")),
        ).alias("end_coord_error_percentage"),
        (F.col("invalid_coordinates") == 0).alias("is_valid"),
    )


def top_regions(df: DataFrame, key: str = INCIDENT.state, top: int = 10) -> DataFrame:
    """The ``top`` most frequent keys; equal counts in key order."""
    return (
        df.groupBy(key)
        .agg(_total().alias("count"))
        .orderBy(F.col("count").desc(), F.col(key).asc_nulls_last())
        .limit(top)
    )


def geo_distribution(df: DataFrame, roles: Roles = INCIDENT) -> DataFrame:
    """Extent and centre of the start coordinates."""
    lat, lng = roles.lat, roles.lng
    return df.agg(
        F.min(lat).alias("min_latitude"), F.max(lat).alias("max_latitude"),
        F.min(lng).alias("min_longitude"), F.max(lng).alias("max_longitude"),
        F.round(F.avg(lat), 4).alias("center_latitude"),
        F.round(F.avg(lng), 4).alias("center_longitude"),
    )


# ------------------------------------------------------------------- codes


def code_set_difference(
    df: DataFrame, column: str, codes: Sequence[str] | DataFrame
) -> DataFrame:
    """Each distinct non-null value with its row count and whether it is a known code.

    ``codes`` is a fixed list, or a one-column table of any size."""
    found = df.groupBy(F.col(column).alias("code")).agg(_total().alias("rows"))
    found = found.filter(F.col("code").isNotNull())
    if isinstance(codes, DataFrame):
        known = codes.select(F.col(codes.columns[0]).alias("code")).distinct()
        known = known.withColumn("_known", F.lit(True))
        joined = found.join(known, "code", "left")
        return joined.select("code", "rows", F.col("_known").isNotNull().alias("is_known"))
    return found.withColumn("is_known", F.col("code").isin(*codes))


def state_code_validation(
    df: DataFrame, roles: Roles = INCIDENT, codes: Sequence[str] = model.STATE_CODES
) -> DataFrame:
    """Invalid or missing state codes and the coverage of the code list."""
    per_code = df.groupBy(F.col(roles.state).alias("code")).agg(_total().alias("rows"))
    known = F.coalesce(F.col("code").isin(*codes), F.lit(False))
    filled = F.coalesce(F.col("code") != "", F.lit(False))
    summed = per_code.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(~known, F.col("rows"))), F.lit(0)).alias("invalid_state_count"),
        F.count_if(filled).alias("total_unique_states"),
        F.count_if(known).alias("valid_states_found"),
        F.count_if(filled & ~known).alias("invalid_codes_found"),
    )
    return summed.select(
        "invalid_state_count",
        percent(F.col("invalid_state_count"), F.col("total")).alias("invalid_percentage"),
        "total_unique_states", "valid_states_found", "invalid_codes_found",
        percent(F.col("valid_states_found"), F.lit(len(codes))).alias("coverage_percentage"),
        (F.col("invalid_state_count") == 0).alias("is_valid"),
    )


# ----------------------------------------------------------------- numbers


def numeric_range_validation(df: DataFrame, ranges: Mapping | None = None) -> DataFrame:
    """Per ranged measure: rows out of range or null, and its distribution."""
    used = model.present_ranges(df.columns, ranges)
    aggregates = [_total().alias("rows")]
    for i, (c, (low, high)) in enumerate(used.items()):
        x = F.col(c)
        aggregates += [
            F.count_if(x.isNull() | ~x.between(low, high)).alias(f"bad_{i}"),
            F.min(x).cast("double").alias(f"min_{i}"), F.max(x).cast("double").alias(f"max_{i}"),
            F.round(F.avg(x), 2).alias(f"mean_{i}"),
            F.round(F.stddev_samp(x), 2).alias(f"sd_{i}"),
        ]
    return spread(
        df.agg(*aggregates),
        [
            {
                "column": F.lit(c),
                "out_of_range_count": F.col(f"bad_{i}"),
                "out_of_range_percentage": percent(F.col(f"bad_{i}"), F.col("rows")),
                "range_min": F.lit(float(low)), "range_max": F.lit(float(high)),
                "actual_min": F.col(f"min_{i}"), "actual_max": F.col(f"max_{i}"),
                "mean": F.col(f"mean_{i}"), "std_dev": F.col(f"sd_{i}"),
                "is_valid": F.col(f"bad_{i}") == 0,
            }
            for i, (c, (low, high)) in enumerate(used.items())
        ],
    )


def numeric_score(validation: DataFrame) -> DataFrame:
    """Share of measures without any violation; 100 when there are none to check."""
    passed = F.count_if("is_valid")
    share = F.try_divide(passed.cast("double"), F.count(F.lit(1)).cast("double")) * 100
    return validation.agg(
        F.round(F.coalesce(share, F.lit(100.0)), 2).alias("numeric_validation_score"),
        F.count(F.lit(1)).alias("columns_validated"),
        passed.alias("columns_passed"),
    )


def iqr_outliers(
    df: DataFrame, columns: Sequence[str] | None = None, accuracy: int | None = None
) -> DataFrame:
    """Values beyond 1.5 interquartile ranges.  The quartiles are exact; with ``accuracy`` they
    come from one sketch of rank error 1/accuracy instead.  Counting against the bounds is a
    pass of its own."""
    wanted = columns or [
        c for n in model.IQR_COLUMNS
        if (c := model.delivered_or_renamed(df.columns, n)) is not None
    ]
    if accuracy is None:
        quartiles = exact_quantiles(df, {c: (0.25, 0.75) for c in wanted})
    else:
        quartiles = one_row(
            df, {c: F.percentile_approx(c, [0.25, 0.75], accuracy) for c in wanted}
        ).asDict()
    bounds = {c: [float(v) for v in q] for c, q in quartiles.items() if q and q[0] is not None}
    counted = df.agg(
        _total().alias("rows"),
        *[
            F.count_if(
                (F.col(c) < q1 - 1.5 * (q3 - q1)) | (F.col(c) > q3 + 1.5 * (q3 - q1))
            ).alias(f"out_{i}")
            for i, (c, (q1, q3)) in enumerate(bounds.items())
        ],
    )
    return spread(
        counted,
        [
            {
                "column": F.lit(c),
                "outlier_count": F.col(f"out_{i}"),
                "outlier_percentage": percent(F.col(f"out_{i}"), F.col("rows")),
                "q1": F.round(F.lit(float(q1)), 2), "q3": F.round(F.lit(float(q3)), 2),
                "iqr": F.round(F.lit(float(q3 - q1)), 2),
                "lower_bound": F.round(F.lit(float(q1 - 1.5 * (q3 - q1))), 2),
                "upper_bound": F.round(F.lit(float(q3 + 1.5 * (q3 - q1))), 2),
            }
            for i, (c, (q1, q3)) in enumerate(bounds.items())
        ],
    )


# -------------------------------------------------------------------- time


def temporal_validation(df: DataFrame, roles: Roles = INCIDENT) -> DataFrame:
    """Rows that end before they start, and rows without a start."""
    backwards = (
        F.count_if(F.col(roles.end) < F.col(roles.start))
        if roles.end in df.columns
        else F.lit(0).cast("bigint")
    )
    counted = df.agg(
        _total().alias("rows"), backwards.alias("invalid_count"),
        F.count_if(F.col(roles.start).isNull()).alias("null_start_time"),
    )
    return counted.select(
        "invalid_count",
        percent(F.col("invalid_count"), F.col("rows")).alias("invalid_percentage"),
        "null_start_time",
        percent(F.col("null_start_time"), F.col("rows")).alias("null_percentage"),
        (F.col("invalid_count") == 0).alias("is_valid"),
    )


def temporal_distribution(df: DataFrame, time: str = INCIDENT.start) -> DataFrame:
    """Counts by year, by month and by day of week, in long form.  The table is counted per
    day first; only the days are multiplied by three."""
    days = df.groupBy(F.to_date(time).alias("day")).agg(_total().alias("n"))
    units = {"year": F.year, "month": F.month, "day_of_week": F.dayofweek}
    long = spread(
        days,
        [{"unit": F.lit(u), "value": f("day"), "n": F.col("n")} for u, f in units.items()],
    )
    return long.groupBy("unit", "value").agg(F.sum("n").alias("count")).orderBy("unit", "value")


# -------------------------------------------------------------- duplicates


def duplicate_analysis(
    df: DataFrame, key: str | None = INCIDENT.id, thresholds: QualityThresholds = DEFAULT
) -> DataFrame:
    """Duplicate rows and repeated keys from one scan.  Rows are compared by their SHA-256, so
    32 bytes per distinct row are shuffled however wide the rows or long the texts are, and
    copies collapse on the map side.  Keys are then counted over the distinct rows."""
    fields = {f.name: f for f in df.schema}
    whole = row_digest(fields.values()).alias("_row")
    if key in fields:
        distinct = df.select(row_digest([fields[key]]).alias("_key"), whole).groupBy(
            "_key", "_row"
        ).agg(_total().alias("_copies"))
        summed = distinct.groupBy("_key").agg(
            F.sum("_copies").alias("rows"), _total().alias("distinct_rows")
        )
        totals = summed.agg(
            F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"),
            F.coalesce(F.sum("distinct_rows"), F.lit(0)).alias("distinct_rows"),
            _total().alias("keys"),
        ).withColumn("id_duplicates", F.col("total_rows") - F.col("keys"))
    else:
        totals = df.select(whole).groupBy("_row").agg(_total().alias("_copies")).agg(
            F.coalesce(F.sum("_copies"), F.lit(0)).alias("total_rows"),
            _total().alias("distinct_rows"),
        ).withColumn("id_duplicates", F.lit(0).cast("bigint"))
    repeated = F.col("total_rows") - F.col("distinct_rows")
    share = F.coalesce(
        F.try_divide(repeated.cast("double"), F.col("total_rows").cast("double")) * 100,
        F.lit(0.0),
    )
    return totals.select(
        "total_rows", "distinct_rows", repeated.alias("duplicate_rows"),
        F.round(share, 2).alias("duplicate_percentage"), "id_duplicates",
        (share <= thresholds.max_duplicate_percentage).alias("is_acceptable"),
    )


# ------------------------------------------------------- composed report


def _scan_checks(df: DataFrame, roles: Roles, box: model.GeoBox, ranges) -> dict[str, Column]:
    """The aggregates of all row-local checks, to run in one scan."""
    found: dict[str, Column] = {"rows": _total()}
    for c in df.columns:
        found[f"null::{c}"] = F.count_if(F.col(f"`{c}`").isNull())
    if roles.lat in df.columns and roles.lng in df.columns:
        found["geo"] = F.count_if(_bad_start(roles, box))
    if roles.state in df.columns:
        state = F.col(roles.state)
        found["state"] = F.count_if(~F.coalesce(state.isin(*model.STATE_CODES), F.lit(False)))
    for c, (low, high) in model.present_ranges(df.columns, ranges).items():
        found[f"range::{c}"] = F.count_if(F.col(c).isNull() | ~F.col(c).between(low, high))
    if roles.start in df.columns:
        found["no_start"] = F.count_if(F.col(roles.start).isNull())
        if roles.end in df.columns:
            found["backwards"] = F.count_if(F.col(roles.end) < F.col(roles.start))
    return found


def quality_figures(
    df: DataFrame,
    roles: Roles = INCIDENT,
    box: model.GeoBox = US_BOX,
    ranges: Mapping | None = None,
    thresholds: QualityThresholds = DEFAULT,
) -> DataFrame:
    """One row: the figures the score and the issues are made of.  All row-local checks
    share a scan; duplicates need their own shuffle."""
    checks = _scan_checks(df, roles, box, ranges)
    row = df.agg(*[c.alias(n) for n, c in checks.items()])
    rows = F.col("rows")
    nulls = [percent(F.col(f"`{n}`"), rows) for n in checks if n.startswith("null::")]
    ranged = [F.col(f"`{n}`") for n in checks if n.startswith("range::")]
    passed = reduce(lambda a, b: a + b, [(c == 0).cast("int") for c in ranged], F.lit(0))
    figures = row.select(
        rows.alias("total_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("total_columns"),
        F.round(reduce(lambda a, b: a + b, nulls) / len(nulls), 2).alias(
            "average_null_percentage"
        ),
        (F.col("geo") if "geo" in checks else _blank("bigint")).alias("invalid_coordinates"),
        (percent(F.col("geo"), rows) if "geo" in checks else _blank("double")).alias(
            "geo_invalid_percentage"
        ),
        (F.col("state") if "state" in checks else _blank("bigint")).alias(
            "invalid_state_count"
        ),
        (percent(F.col("state"), rows) if "state" in checks else _blank("double")).alias(
            "state_invalid_percentage"
        ),
        (F.round(passed * 100.0 / len(ranged), 2) if ranged else F.lit(100.0)).alias(
            "numeric_validation_score"
        ),
        (F.col("backwards") if "backwards" in checks else _blank("bigint")).alias(
            "time_order_violations"
        ),
    )
    copies = duplicate_analysis(df, roles.id, thresholds).select(
        "duplicate_rows", "duplicate_percentage", "id_duplicates"
    )
    return one_line(figures, copies)


def _score_of(figures: DataFrame) -> Column:
    """Mean of the parts that exist; each is 100 minus a percentage, not below 0."""
    parts = [
        F.greatest(F.lit(0.0), 100 - F.col("average_null_percentage")),
        F.greatest(F.lit(0.0), 100 - F.col("geo_invalid_percentage")),
        F.greatest(F.lit(0.0), 100 - F.col("state_invalid_percentage")),
        F.col("numeric_validation_score"),
        F.greatest(F.lit(0.0), 100 - F.col("duplicate_percentage")),
    ]
    exists = [
        F.lit(True), F.col("geo_invalid_percentage").isNotNull(),
        F.col("state_invalid_percentage").isNotNull(), F.lit(True), F.lit(True),
    ]
    total = reduce(
        lambda a, b: a + b, [F.when(e, p).otherwise(0.0) for p, e in zip(parts, exists)]
    )
    return F.round(total / reduce(lambda a, b: a + b, [e.cast("int") for e in exists]), 2)


def quality_score(figures: DataFrame) -> DataFrame:
    return figures.select(_score_of(figures).alias("overall_quality_score"))


def quality_issues(
    figures: DataFrame, thresholds: QualityThresholds = DEFAULT
) -> DataFrame:
    """The problems found, typed and graded."""
    def issue(kind: str, severity: str, count: Column, holds: Column) -> dict[str, Column]:
        return {
            "type": F.lit(kind), "severity": F.lit(severity),
            "amount": count.cast("double"), "holds": F.coalesce(holds, F.lit(False)),
        }

    geo, state = F.col("invalid_coordinates"), F.col("invalid_state_count")
    share = F.col("duplicate_percentage")
    rows = spread(
        figures,
        [
            issue("validation_error", "high", F.lit(None), geo.isNull() | state.isNull()),
            issue("geographic_validation", "medium", geo, geo > 0),
            issue("state_validation", "medium", state, state > 0),
            issue("duplicate_data", "low", share, share > thresholds.max_duplicate_percentage),
        ],
    )
    return rows.filter("holds").drop("holds")


def quality_recommendations(figures: DataFrame) -> DataFrame:
    """The advice lines of the band the score falls into."""
    score = _score_of(figures)
    lines = first_match_array(score)
    return figures.select(
        score.alias("overall_quality_score"), F.explode(lines).alias("recommendation")
    )


def first_match_array(score: Column) -> Column:
    chosen = F
    for floor, lines in model.QUALITY_ADVICE:
        chosen = chosen.when(score >= floor, F.array(*[F.lit(t) for t in lines]))
    return chosen.otherwise(F.array(*[F.lit(t) for t in model.QUALITY_ADVICE[-1][1]]))


def quality_report(
    df: DataFrame,
    detailed: bool = True,
    roles: Roles = INCIDENT,
    box: model.GeoBox = US_BOX,
    ranges: Mapping | None = None,
    thresholds: QualityThresholds = DEFAULT,
) -> DataFrame:
    """All figures in long form ``(check, column, metric, value)``.  The shared figures are
    spread from one row; outlier bounds are added when ``detailed``."""
    figures = quality_figures(df, roles, box, ranges, thresholds)
    scored = figures.withColumn("overall_quality_score", _score_of(figures))
    report = metric_rows(
        scored,
        "summary",
        {
            c: F.col(c)
            for c in (
                "overall_quality_score", "total_rows", "total_columns",
                "average_null_percentage", "invalid_coordinates", "geo_invalid_percentage",
                "invalid_state_count", "state_invalid_percentage", "numeric_validation_score",
                "time_order_violations", "duplicate_rows", "duplicate_percentage",
                "id_duplicates",
            )
        },
    )
    if detailed:
        outliers = iqr_outliers(df).select(
            F.lit("outliers").alias("check"), "column",
            F.inline(
                F.array(
                    *[
                        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                        for m in ("outlier_count", "outlier_percentage")
                    ]
                )
            ),
        )
        report = report.unionByName(outliers)
    return report


# --------------------------------------------------------------- row level


def row_issues(
    df: DataFrame,
    roles: Roles = INCIDENT,
    box: model.GeoBox = US_BOX,
    ranges: Mapping | None = None,
) -> DataFrame:
    """Every row with the list of its issues and ``is_valid``.  Null measures are fine."""
    checks = []
    if roles.lat in df.columns and roles.lng in df.columns:
        checks.append(F.when(_bad_start(roles, box), F.lit("start outside the area")))
    if roles.state in df.columns:
        state = F.col(roles.state)
        checks.append(
            F.when(
                ~F.coalesce(state.isin(*model.STATE_CODES), F.lit(False)),
                F.concat(F.lit("unknown state "), F.coalesce(state, F.lit("null"))),
            )
        )
    for c, bounds in model.present_ranges(df.columns, ranges).items():
        checks.append(
            F.when(
                ~F.col(c).between(*bounds),
                F.concat(F.lit(f"{c} beyond its limits: "), F.col(c).cast("string")),
            )
        )
    issues = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
    return df.withColumn("issues", issues).withColumn("is_valid", F.size("issues") == 0)


def quality_gate(
    df: DataFrame, roles: Roles = INCIDENT, **rules
) -> tuple[DataFrame, DataFrame]:
    """Split into sound rows and quarantined rows; the latter keep their issue list."""
    judged = row_issues(df, roles, **rules)
    good = judged.filter("is_valid").drop("issues", "is_valid")
    return good, judged.filter(~F.col("is_valid")).drop("is_valid")


def require_quality(df: DataFrame, thresholds: QualityThresholds = DEFAULT, **kw) -> float:
    """The overall score; raises when it is below the threshold."""
    score = quality_score(quality_figures(df, thresholds=thresholds, **kw)).first()[0]
    if score < thresholds.min_quality_score:
        raise ValueError(f"quality score {score} is below {thresholds.min_quality_score}")
    return score


# --------------------------------------------------------- rule-based check


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: nulls, and extremes for numbers or blank counts for texts."""
    aggregates = [_total().alias("rows")]
    records = []
    for i, field in enumerate(df.schema.fields):
        x = F.col(f"`{field.name}`")
        aggregates.append(F.count_if(x.isNull()).alias(f"null_{i}"))
        numeric = isinstance(field.dataType, T.NumericType)
        text = isinstance(field.dataType, T.StringType)
        if numeric:
            aggregates += [
                F.min(x).cast("double").alias(f"min_{i}"),
                F.max(x).cast("double").alias(f"max_{i}"),
                F.round(F.avg(x).cast("double"), 2).alias(f"avg_{i}"),
            ]
        elif text:
            aggregates += [
                F.count_if(x == "").alias(f"empty_{i}"),
                F.count_if(x.rlike(r"^\s*$")).alias(f"blank_{i}"),
            ]
        nulls = F.col(f"null_{i}")
        records.append(
            {
                "column": F.lit(field.name),
                "null_count": nulls,
                "null_percentage": percent(nulls, F.col("rows")),
                "non_null_count": F.col("rows") - nulls,
                "min_value": F.col(f"min_{i}") if numeric else _blank("double"),
                "max_value": F.col(f"max_{i}") if numeric else _blank("double"),
                "avg_value": F.col(f"avg_{i}") if numeric else _blank("double"),
                "empty_strings": F.col(f"empty_{i}") if text else _blank("bigint"),
                "whitespace_only": F.col(f"blank_{i}") if text else _blank("bigint"),
            }
        )
    return spread(df.agg(*aggregates), records)


def _check_row(df: DataFrame, kind: str, bad: Column) -> DataFrame:
    counted = df.agg(_total().alias("rows"), F.count_if(bad).alias("invalid_count"))
    return counted.select(
        F.lit(kind).alias("type"), "invalid_count",
        percent(F.col("invalid_count"), F.col("rows")).alias("invalid_percentage"),
        (F.col("invalid_count") == 0).alias("is_valid"),
    )


def _bad_severity(roles: Roles) -> Column:
    return F.col(roles.severity).isNull() | ~F.col(roles.severity).between(1, 4)


def _backwards(roles: Roles) -> Column:
    return F.col(roles.end) < F.col(roles.start)


def severity_check(df: DataFrame, roles: Roles = INCIDENT) -> DataFrame:
    return _check_row(df, "severity_validation", _bad_severity(roles))


def world_geo_check(df: DataFrame, roles: Roles = INCIDENT) -> DataFrame:
    return _check_row(df, "geographic_validation", _bad_start(roles, WORLD_BOX))


def time_order_check(df: DataFrame, roles: Roles = INCIDENT) -> DataFrame:
    return _check_row(df, "time_consistency_validation", _backwards(roles))


def state_check(
    df: DataFrame, roles: Roles = INCIDENT, codes: Sequence[str] = model.STATE_CODES
) -> DataFrame:
    bad = ~F.coalesce(F.col(roles.state).isin(*codes), F.lit(False))
    return _check_row(df, "state_validation", bad)


def rule_quality_check(
    df: DataFrame, max_null_percentage: float = 30.0, roles: Roles = INCIDENT
) -> DataFrame:
    """One row: -5 per column with too many nulls, -10 for each failing check, floor 0."""
    present = set(df.columns)
    checks = {}
    if roles.severity in present:
        checks["severity"] = _bad_severity(roles)
    if {roles.lat, roles.lng} <= present:
        checks["geo"] = _bad_start(roles, WORLD_BOX)
    if {roles.start, roles.end} <= present:
        checks["time"] = _backwards(roles)
    row = df.agg(
        _total().alias("rows"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{i}")
          for i, c in enumerate(df.columns)],
        *[F.count_if(bad).alias(f"bad_{name}") for name, bad in checks.items()],
    )
    high = reduce(
        lambda a, b: a + b,
        [
            (percent(F.col(f"null_{i}"), F.col("rows")) > max_null_percentage).cast("int")
            for i in range(len(df.columns))
        ],
    )
    failed = reduce(
        lambda a, b: a + b, [(F.col(f"bad_{n}") > 0).cast("int") for n in checks], F.lit(0)
    )
    return row.select(
        F.col("rows").alias("total_rows"),
        high.alias("high_null_columns"),
        failed.alias("failed_checks"),
        F.greatest(F.lit(0.0), 100.0 - 5 * high - 10 * failed).alias("quality_score"),
    )


def full_quality_report(
    df: DataFrame, schema_valid: bool, roles: Roles = INCIDENT
) -> DataFrame:
    """Schema, rule and state checks; overall is the share of the three that pass."""
    rules = rule_quality_check(df, roles=roles).select("quality_score", "total_rows")
    states = state_check(df, roles).select(F.col("is_valid").alias("states_valid"))
    both = one_line(rules, states)
    passed = (
        F.lit(int(schema_valid))
        + (F.col("quality_score") > 70).cast("int")
        + F.col("states_valid").cast("int")
    )
    return both.select(
        "total_rows", F.lit(schema_valid).alias("schema_valid"), "quality_score",
        "states_valid", (passed / 3 * 100).alias("overall_score"),
    )
