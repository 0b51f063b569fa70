"""Row filters, null treatment, corrections and deduplication.

Filters are plain predicates.  Operators that need statistics fetch one aggregated row and
put it into the plan as constants, so that the following filter can still be pushed down.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F, types as T

from wayside import model
from wayside import functions as X
from wayside.functions.cases import all_of
from wayside.model import INCIDENT, Roles
from wayside.operators.quantiles import exact_quantiles
from wayside.operators.records import one_row, spread
from wayside.sources.scratch import materialise

Bounds = Mapping[str, tuple[float, float]]


# ------------------------------------------------------------- projections


def rename_measures(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in model.MEASURE_NAMES.items() if a in df.columns})


def project_available(
    df: DataFrame, wanted: Iterable[str] = model.SILVER_DETAIL_COLUMNS
) -> DataFrame:
    """The wanted columns this table has, in the wanted order, each once."""
    present = set(df.columns)
    return df.select(*dict.fromkeys(c for c in wanted if c in present))


def standardize_formats(df: DataFrame, roles: Roles = INCIDENT) -> DataFrame:
    """Trim and case the state, city, weather and wind texts; unify day/night words."""
    rules = {
        roles.state: lambda c: X.normalise_text(c, ("trim", "upper")),
        roles.city: lambda c: X.normalise_text(c, ("trim", "remove_extra_spaces")),
        roles.weather: lambda c: X.normalise_text(c, ("trim",)),
        "Wind_Direction": lambda c: X.normalise_text(c, ("trim", "upper")),
    } | {name: X.day_or_night for name in model.TWILIGHT_COLUMNS}
    changed = {c: rule(F.col(c)) for c, rule in rules.items() if c in df.columns}
    return df.withColumns(changed) if changed else df


def string_normalize(
    df: DataFrame, columns: Iterable[str], operations: Sequence[str] = ("trim",)
) -> DataFrame:
    changed = {
        c: X.normalise_text(F.col(c), operations) for c in columns if c in df.columns
    }
    return df.withColumns(changed) if changed else df


_CASTS = {"double": "double", "integer": "int", "string": "string", "boolean": "boolean"}


def type_convert(df: DataFrame, conversions: Mapping[str, str]) -> DataFrame:
    """Cast listed columns; a value that cannot be converted becomes null."""
    changed = {
        c: F.col(c).try_cast(_CASTS[kind])
        for c, kind in conversions.items()
        if c in df.columns and kind in _CASTS
    }
    return df.withColumns(changed) if changed else df


def null_out_impossible(df: DataFrame, roles: Roles = INCIDENT) -> DataFrame:
    """Null temperatures, winds and pressures that cannot be; flip negative distances."""
    def nulled(column: str, bad: Column) -> Column:
        return F.when(bad, None).otherwise(F.col(column))

    t, w, d, p = (F.col(c) for c in (roles.temperature, roles.wind, roles.distance,
                                     roles.pressure))
    rules = {
        roles.temperature: nulled(roles.temperature, (t < -50) | (t > 150)),
        roles.wind: nulled(roles.wind, w > 200),
        roles.distance: F.abs(d),
        roles.pressure: nulled(roles.pressure, (p < 25) | (p > 35)),
    }
    changed = {c: rule for c, rule in rules.items() if c in df.columns}
    return df.withColumns(changed) if changed else df


# ------------------------------------------------------------------ filters


def drop_null_keys(
    df: DataFrame, critical: Iterable[str] = model.CRITICAL_AT_CLEANING
) -> DataFrame:
    return df.dropna(subset=[c for c in critical if c in df.columns])


def range_filter(df: DataFrame, ranges: Bounds) -> DataFrame:
    """Keep rows with every listed measure in its range; null is not in range."""
    tests = [F.col(c).between(*b) for c, b in ranges.items() if c in df.columns]
    return df.filter(all_of(tests)) if tests else df


def range_clamp(df: DataFrame, ranges: Bounds, null_to_max: bool = False) -> DataFrame:
    """Pull values back into their range.  ``null_to_max`` gives the literal
    greatest(least()) rule, under which a null becomes the upper bound."""
    changed = {}
    for c, (low, high) in ranges.items():
        if c in df.columns:
            held = F.greatest(F.least(F.col(c), F.lit(high)), F.lit(low))
            changed[c] = held if null_to_max else F.when(F.col(c).isNotNull(), held)
    return df.withColumns(changed) if changed else df


def physical_range_filter(df: DataFrame, roles: Roles = INCIDENT) -> DataFrame:
    """World coordinates, severity 1 to 4, no negative measures, humidity 0 to 100."""
    return range_filter(
        df,
        {
            roles.lat: (model.WORLD_BOX.min_lat, model.WORLD_BOX.max_lat),
            roles.lng: (model.WORLD_BOX.min_lng, model.WORLD_BOX.max_lng),
            roles.severity: (1, 4),
            roles.distance: (0.0, float("inf")),
            roles.visibility: (0.0, float("inf")),
            roles.wind: (0.0, float("inf")),
            roles.humidity: (0.0, 100.0),
        },
    )


def sound_row(
    columns: Sequence[str],
    roles: Roles = INCIDENT,
    box: model.GeoBox = model.US_BOX,
    states: Sequence[str] = model.STATE_CODES,
    ranges: Bounds | None = None,
) -> Column:
    """True for rows inside the box, with a known state, and no measure out of range."""
    tests = []
    if roles.lat in columns and roles.lng in columns:
        tests.append(X.inside(F.col(roles.lat), F.col(roles.lng), box))
    if roles.state in columns:
        tests.append(F.col(roles.state).isin(*states))
    for c, bounds in model.present_ranges(columns, ranges).items():
        tests.append(F.col(c).between(*bounds) | F.col(c).isNull())
    return F.coalesce(all_of(tests), F.lit(False)) if tests else F.lit(True)


def corrupt_row_filter(
    df: DataFrame, aggressive: bool = False, roles: Roles = INCIDENT, **rules
) -> DataFrame:
    """Drop rows that are not sound.  Aggressive: also full duplicates and rows with fewer
    than half of the columns filled."""
    kept = df.filter(sound_row(df.columns, roles, **rules))
    if aggressive:
        kept = kept.dropna(thresh=int(len(df.columns) * 0.5)).dropDuplicates()
    return kept


# ------------------------------------------------------------ deduplication


def dedup_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def dedup_by_key(
    df: DataFrame, keys: Sequence[str] = ("ID",), order: Sequence[Column] | None = None
) -> DataFrame:
    """One row per key: the smallest by ``order`` and then by all other columns.

    Usually few keys repeat.  Only keys are counted first; rows with a key of their own pass
    through, without a sort or shuffle as long as the written table of repeated keys is small
    enough to broadcast.  The rest is an aggregate rather than a window: copies of a key collapse
    on the map side, so a key that fills a large part of the table costs one row per task."""
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.dropDuplicates()
    named = {f"_key_{i}": c for i, c in enumerate(keys)}
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    repeated = materialise(
        counted.select(*[F.col(c).alias(k) for k, c in named.items()]), "repeated-keys"
    )
    same = all_of([F.col(c).eqNullSafe(F.col(k)) for k, c in named.items()])
    ordering = [c.alias(f"_order_{i}") for i, c in enumerate(order or [])]
    first = F.min(F.struct(*ordering, *[F.col(c) for c in others])).alias("_row")
    kept = df.join(repeated, same, "left_semi").groupBy(*keys).agg(first)
    kept = kept.select(
        *[F.col(c) if c in keys else F.col("_row").getField(c).alias(c) for c in df.columns]
    )
    return df.join(repeated, same, "left_anti").unionAll(kept)


# -------------------------------------------------------------------- nulls


def _is_measure(field: T.StructField) -> bool:
    return field.name in model.MEASURE_NAMES or isinstance(field.dataType, T.NumericType)


@dataclass
class NullDecision:
    """What was done to one column and on which evidence."""

    column: str
    action: str  # keep, drop, fill
    null_count: int
    null_percentage: float
    fill: object = None


def _null_statistics(df: DataFrame, fields, critical, limit) -> dict:
    """Null counts of several columns in one job, then the exact medians of those to be filled.

    Columns are treated in order and a critical column drops its null rows, so each
    column is measured only over rows whose earlier critical columns are filled."""
    aggregates, seen, inside = {}, F.lit(True), {}
    for i, field in enumerate(fields):
        x = F.col(f"`{field.name}`")
        aggregates[f"rows_{i}"] = F.count_if(seen)
        aggregates[f"null_{i}"] = F.count_if(seen & x.isNull())
        if field.name in critical:
            seen = seen & x.isNotNull()
        elif _is_measure(field):
            inside[i] = F.when(seen, x)
    stats = one_row(df, aggregates).asDict()
    filled = {}
    for i, field in enumerate(fields):
        nulls, rows = stats[f"null_{i}"], stats[f"rows_{i}"]
        few = (100.0 * nulls / rows if rows else 0.0) < limit
        if i in inside and nulls and few:
            filled[f"median_{i}"] = inside[i]
        elif nulls and not few and field.name not in critical and (
            i in inside or isinstance(field.dataType, T.StringType)
        ):
            break  # its rows are dropped, and later columns measured again
    if filled:
        columns = df.select(*[x.alias(k) for k, x in filled.items()])
        found = exact_quantiles(columns, {k: (0.5,) for k in filled})
        stats |= {k: values[0] for k, values in found.items()}
    return stats


def adaptive_null_handling(
    df: DataFrame,
    critical: Sequence[str] = model.CRITICAL_AT_CLEANING,
    flags: Sequence[str] = model.EQUIPMENT_FLAGS,
    max_null_percentage: float = 30.0,
    decisions: list[NullDecision] | None = None,
) -> DataFrame:
    """Per column, in column order: drop rows with null keys; below the limit fill measures
    (numbers of any type) with the exact median, text with 'Unknown'; at or above it drop the rows; null flags are False.

    Each percentage and median refers to the table as reduced by the columns before it.
    One job serves all columns up to the next one whose drop depends on the data; only
    then are the remaining columns measured again."""
    pending = list(df.schema.fields)
    while pending:
        stats = _null_statistics(df, pending, critical, max_null_percentage)
        fills: dict[str, object] = {}
        keep: list[Column] = []
        remeasure = None
        for i, field in enumerate(pending):
            rows, nulls = stats[f"rows_{i}"], stats[f"null_{i}"]
            share = 100.0 * nulls / rows if rows else 0.0
            decision = NullDecision(field.name, "keep", nulls, share)
            if decisions is not None:
                decisions.append(decision)
            if not nulls:
                continue
            if field.name in critical:
                decision.action = "drop"
                keep.append(F.col(field.name).isNotNull())
            elif _is_measure(field):
                decision.fill = stats.get(f"median_{i}") if share < max_null_percentage else None
            elif field.name in flags:
                decision.fill = False
            elif isinstance(field.dataType, T.StringType):
                decision.fill = "Unknown" if share < max_null_percentage else None
            else:
                continue  # timestamps and other types stay as they are
            if decision.fill is not None:
                decision.action = "fill"
                fills[field.name] = decision.fill
            elif decision.action != "drop":
                decision.action = "drop"
                keep.append(F.col(field.name).isNotNull())
                remeasure = i + 1
                break
        if keep:
            df = df.filter(all_of(keep))
        decimals = {c: v for c, v in fills.items() if isinstance(v, Decimal)}
        if decimals:
            df = df.withColumns({
                c: F.coalesce(F.col(f"`{c}`"), F.lit(v).cast(df.schema[c].dataType))
                for c, v in decimals.items()
            })
        if len(fills) > len(decimals):
            df = df.fillna({c: v for c, v in fills.items() if c not in decimals})
        pending = pending[remeasure:] if remeasure is not None else []
    return df


def null_strategy(df: DataFrame, strategies: Mapping[str, str]) -> DataFrame:
    """Per column ``drop``, ``fill_zero``, ``fill_mean`` or ``fill_unknown``; other columns
    are untouched.  All means come from the input table, in one job."""
    used = {c: s for c, s in strategies.items() if c in df.columns}
    means = {c for c, s in used.items() if s == "fill_mean"}
    found = one_row(df, {c: F.avg(F.col(c)) for c in means}).asDict() if means else {}
    fills = {c: m for c, m in found.items() if m is not None}
    fills |= {c: 0 for c, s in used.items() if s == "fill_zero"}
    fills |= {c: "Unknown" for c, s in used.items() if s == "fill_unknown"}
    dropped = [c for c, s in used.items() if s == "drop"]
    kept = df.dropna(subset=dropped) if dropped else df
    return kept.fillna(fills) if fills else kept


# ----------------------------------------------------------------- outliers


def _moments(columns: Iterable[str]) -> dict[str, Column]:
    found = {}
    for c in columns:
        found[f"mean_{c}"] = F.avg(c)
        found[f"sd_{c}"] = F.stddev_samp(c)
    return found


def _within(column: str, mean, sd, threshold: float, keep_nulls: bool) -> Column | None:
    """``|x - mean| / sd <= threshold``; no test without statistics or for a constant."""
    if mean is None or sd is None or sd == 0:
        return None
    test = F.abs((F.col(column) - F.lit(mean)) / F.lit(sd)) <= threshold
    return test | F.col(column).isNull() if keep_nulls else test


def zscore_filter_sequential(
    df: DataFrame,
    columns: Sequence[str] = model.ZSCORE_COLUMNS,
    threshold: float = 3.0,
    keep_nulls: bool = False,
) -> DataFrame:
    """Column after column, each with the statistics of the rows kept so far: one job per
    column, reading only the columns treated up to it."""
    for c in columns:
        if c in df.columns:
            row = one_row(df, _moments([c]))
            test = _within(c, row[f"mean_{c}"], row[f"sd_{c}"], threshold, keep_nulls)
            df = df.filter(test) if test is not None else df
    return df


def zscore_filter_independent(
    df: DataFrame,
    columns: Sequence[str] = model.ZSCORE_COLUMNS,
    threshold: float = 3.0,
    keep_nulls: bool = False,
) -> DataFrame:
    """All statistics from the input table: one job and one filter."""
    used = [c for c in columns if c in df.columns]
    if not used:
        return df
    row = one_row(df, _moments(used))
    tests = [
        t
        for c in used
        if (t := _within(c, row[f"mean_{c}"], row[f"sd_{c}"], threshold, keep_nulls)) is not None
    ]
    return df.filter(all_of(tests)) if tests else df


# --------------------------------------------------------------- validation

EXPECTED_AFTER_CLEANING = {
    "Severity": "int", "Start_Lat": "double", "Start_Lng": "double", "distance_miles": "double",
}


def post_clean_validation(
    df: DataFrame, critical: Sequence[str] = model.CRITICAL_AT_CLEANING
) -> DataFrame:
    """Nulls left in critical columns and unexpected types; rows are not changed."""
    names = [c for c in critical if c in df.columns]
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in names])
    records = [
        {"check": F.lit("critical_nulls"), "column": F.lit(c), "issues": F.col(f"n_{c}")}
        for c in names
    ]
    types = dict(df.dtypes)
    records += [
        {"check": F.lit("type_mismatch"), "column": F.lit(c),
         "issues": F.lit(int(types[c] != expected)).cast("bigint")}
        for c, expected in EXPECTED_AFTER_CLEANING.items()
        if c in types
    ]
    return spread(counted, records)


def cleaning_score(input_rows: int, output_rows: int, corrections: int) -> float:
    if input_rows <= 0:
        return 0.0
    retained = 100.0 * output_rows / input_rows
    score = min(retained, 95.0) + min(corrections * 2, 10)
    if retained < 80:
        score -= 2 * (80 - retained)
    return round(max(0.0, min(100.0, score)), 2)
