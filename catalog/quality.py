"""Profiling, data-quality and schema reports."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from catalog.base import FLAGS, STATES, incidents, query, r, table, tidy, with_incidents
from catalog.cleaning import SCORE_SQL, SOUND, delivered
from wayside.model import DELIVERED_COLUMNS, QualityThresholds
from wayside.operators import daily as D, layout, quality as Q, schema_checks as S
from wayside.operators.features import create_features
from wayside.operators.records import one_line
from wayside.plans import flows
from wayside.plans.incidents import INCIDENT_RULES
from wayside.sources.scratch import scratch_path

COLUMNS = list(INCIDENT_RULES)


def _pct(condition: str, digits: int = 2) -> str:
    return f"round(100.0e0 * count(*) filter (where {condition}) / count(*), {digits})"


def _count(condition: str) -> str:
    return f"count(*) filter (where {condition})"


BAD_GEO = ("(Start_Lat is null or Start_Lng is null or Start_Lat not between 24 and 71"
           " or Start_Lng not between -180 and -66)")
BAD_STATE = f"(State is null or State not in ({STATES}))"

# ------------------------------------------------------------------- nulls

_NULLS = " union all ".join(
    f"select '{c}' as \"column\", {_count(f'{c} is null')} as null_count,"
    f" {_pct(f'{c} is null')} as null_percentage, {_pct(f'{c} is null')} > 30 as high_null"
    f" from incidents" for c in COLUMNS
)


@query("null_profile", with_incidents(_NULLS))
def _null_profile(spark, sf):
    return Q.null_profile(incidents(spark, sf))


@query("null_overview", with_incidents(
    f"select count(*) as total_columns, cast(sum(null_count) as bigint) as total_null_values,"
    f" round(avg(null_percentage), 2) as average_null_percentage,"
    f" count(*) filter (where high_null) as high_null_columns from ({_NULLS})"))
def _null_overview(spark, sf):
    return Q.null_overview(incidents(spark, sf))


def _kept_days(spark, sf):
    """Summaries of the incidents, a day at a time in two deliveries; one day comes twice."""
    path, source = scratch_path(spark, "days"), incidents(spark, sf)
    day = F.dayofmonth("Start_Time")
    for part in (day <= 20, day > 19):
        D.keep_days(D.daily_summary(source.where(part)), path)
    return D.kept_days(spark, path)


@query("null_profile_by_day", with_incidents(_NULLS))
def _nulls_by_day(spark, sf):
    return D.merged_null_profile(_kept_days(spark, sf), COLUMNS)


@query("distribution_by_day", with_incidents("""
select 'date' as level, cast(cast(Start_Time as date) as varchar) as key, count(*) as rows
from incidents group by 2
union all select 'state', State, count(*) from incidents group by 2
union all select 'all', 'all', count(*) from incidents"""))
def _distribution_by_day(spark, sf):
    return D.merged_distribution(_kept_days(spark, sf))


@query("duplicates_by_day", with_incidents("""
select count(*) as total_rows, true as rows_within_error, true as ids_within_error from incidents"""))
def _duplicates_by_day(spark, sf):
    """The sketches' figures against the exact ones of the same rows."""
    exact = Q.duplicate_analysis(incidents(spark, sf)).select(
        F.col("distinct_rows").alias("d"), F.col("id_duplicates").alias("i"))
    seen = D.merged_duplicates(_kept_days(spark, sf))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.col("error_rows")
    return one_line(seen, exact).select("total_rows", near("distinct_rows", "d").alias("rows_within_error"),
                                        near("id_duplicates", "i").alias("ids_within_error"))


# --------------------------------------------------------------- geography

@query("geo_validation", with_incidents(f"""
select count(*) as total_validated, {_count(BAD_GEO)} as invalid_coordinates,
 {_pct(BAD_GEO)} as invalid_percentage,
 {_count('End_Lat not between 24 and 71 or End_Lng not between -180 and -66')}
  as invalid_end_coordinates,
 {_pct('End_Lat not between 24 and 71 or End_Lng not between -180 and -66')}
  as end_coord_error_percentage, {_count(BAD_GEO)} = 0 as is_valid from incidents"""))
def _geo(spark, sf):
    return Q.geo_validation(incidents(spark, sf))


@query("geo_distribution", with_incidents("""
select min(Start_Lat) as min_latitude, max(Start_Lat) as max_latitude,
 min(Start_Lng) as min_longitude, max(Start_Lng) as max_longitude,
 round(avg(Start_Lat), 4) as center_latitude, round(avg(Start_Lng), 4) as center_longitude
from incidents"""))
def _distribution(spark, sf):
    return Q.geo_distribution(incidents(spark, sf))


@query("top_regions", with_incidents(
    "select State, count(*) as count from incidents group by State"
    " order by count desc, State asc nulls last limit 10"))
def _top(spark, sf):
    return Q.top_regions(incidents(spark, sf))


@query("state_code_validation", with_incidents(f"""
select {_count(BAD_STATE)} as invalid_state_count, {_pct(BAD_STATE)} as invalid_percentage,
 count(distinct State) filter (where State <> '') as total_unique_states,
 count(distinct State) filter (where State in ({STATES})) as valid_states_found,
 count(distinct State) filter (where State <> '' and State not in ({STATES}))
  as invalid_codes_found,
 round(100.0e0 * count(distinct State) filter (where State in ({STATES})) / 51, 2)
  as coverage_percentage, {_count(BAD_STATE)} = 0 as is_valid from incidents"""))
def _states(spark, sf):
    return Q.state_code_validation(incidents(spark, sf))


@query("code_set_difference", """
select cast(c_nationkey + (c_custkey % 3) as int) as code, count(*) as rows,
 c_nationkey + (c_custkey % 3) in (select n_nationkey from nation) as is_known
from customer group by 1, 3""")
def _codes(spark, sf):
    """Every third customer keeps its code; the others' last codes are in no table."""
    known = table(spark, sf, "nation").select("n_nationkey")
    coded = table(spark, sf, "customer").select(
        (F.col("c_nationkey") + F.col("c_custkey") % 3).cast("int").alias("code"))
    return Q.code_set_difference(coded, "code", known)


@query("code_set_difference_fixed", """
select event_type as code, count(*) as rows, event_type in ('view', 'click', 'purchase')
 as is_known from events group by event_type""")
def _fixed_codes(spark, sf):
    return Q.code_set_difference(
        table(spark, sf, "events"), "event_type", ["view", "click", "purchase"])


# ----------------------------------------------------------------- numbers

RANGES = {
    "Severity": (1, 4), "distance_miles": (0, 100), "temperature_fahrenheit": (-50, 130),
    "wind_speed_mph": (0, 200), "humidity_percent": (0, 100), "pressure_inches": (25, 35),
    "visibility_miles": (0, 50),
}


def _range_rows(source: str, ranges) -> str:
    return " union all ".join(
        f"select '{c}' as \"column\", {_count(f'{c} is null or {c} not between {a} and {b}')}"
        f" as out_of_range_count, {_pct(f'{c} is null or {c} not between {a} and {b}')}"
        f" as out_of_range_percentage, {a}::double as range_min, {b}::double as range_max,"
        f" cast(min({c}) as double) as actual_min, cast(max({c}) as double) as actual_max,"
        f" round(avg({c}), 2) as mean, round(stddev_samp({c}), 2) as std_dev,"
        f" {_count(f'{c} is null or {c} not between {a} and {b}')} = 0 as is_valid from {source}"
        for c, (a, b) in ranges.items()
    )


@query("numeric_range_validation", with_incidents(_range_rows("incidents", RANGES)))
def _ranges(spark, sf):
    return Q.numeric_range_validation(incidents(spark, sf))


_LINE_RANGES = {"l_quantity": (1, 50), "l_discount": (0, 0.05), "l_extendedprice": (1000, 90000)}


@query("numeric_range_validation_lineitem", _range_rows("lineitem", _LINE_RANGES))
def _line_ranges(spark, sf):
    return Q.numeric_range_validation(table(spark, sf, "lineitem"), _LINE_RANGES)


@query("numeric_score", with_incidents(f"""
select round(100.0e0 * count(*) filter (where is_valid) / count(*), 2)
  as numeric_validation_score, count(*) as columns_validated,
 count(*) filter (where is_valid) as columns_passed
from ({_range_rows('incidents', RANGES)})"""))
def _numeric_score(spark, sf):
    return Q.numeric_score(Q.numeric_range_validation(incidents(spark, sf)))


_IQR = ("distance_miles", "temperature_fahrenheit", "wind_speed_mph", "humidity_percent",
        "pressure_inches")


def _iqr_sql() -> str:
    return " union all ".join(
        f"""select '{c}' as "column",
 count(*) filter (where {c} < q1 - 1.5e0 * (q3 - q1) or {c} > q3 + 1.5e0 * (q3 - q1))
  as outlier_count,
 {_pct(f'{c} < q1 - 1.5e0 * (q3 - q1) or {c} > q3 + 1.5e0 * (q3 - q1)')} as outlier_percentage,
 round(any_value(q1), 2) as q1, round(any_value(q3), 2) as q3,
 round(any_value(q3 - q1), 2) as iqr, round(any_value(q1 - 1.5e0 * (q3 - q1)), 2) as lower_bound,
 round(any_value(q3 + 1.5e0 * (q3 - q1)), 2) as upper_bound
from incidents, (select quantile_disc({c}, 0.25) as q1, quantile_disc({c}, 0.75) as q3
 from incidents)""" for c in _IQR
    )


@query("iqr_outliers", with_incidents(_iqr_sql()))
def _outliers(spark, sf):
    return Q.iqr_outliers(incidents(spark, sf))


# -------------------------------------------------------------------- time

@query("temporal_validation", with_incidents(f"""
select {_count('End_Time < Start_Time')} as invalid_count,
 {_pct('End_Time < Start_Time')} as invalid_percentage,
 {_count('Start_Time is null')} as null_start_time,
 {_pct('Start_Time is null')} as null_percentage,
 {_count('End_Time < Start_Time')} = 0 as is_valid from incidents"""))
def _temporal(spark, sf):
    return Q.temporal_validation(incidents(spark, sf))


def _time_units(column: str, source: str) -> str:
    units = {"year": f"year({column})", "month": f"month({column})",
             "day_of_week": f"dayofweek({column}) + 1"}
    return " union all ".join(
        f"select '{u}' as unit, cast({e} as int) as value, count(*) as count from {source}"
        f" group by 1, 2" for u, e in units.items()
    )


@query("temporal_distribution", _time_units("o_orderdate", "orders"))
def _time_distribution(spark, sf):
    return Q.temporal_distribution(table(spark, sf, "orders"), "o_orderdate")


# -------------------------------------------------------------- duplicates

_COPIES = """select count(*) as total_rows, count(distinct {row}) as distinct_rows,
 count(*) - count(distinct {row}) as duplicate_rows,
 round(100.0e0 * (count(*) - count(distinct {row})) / count(*), 2) as duplicate_percentage,
 {ids} as id_duplicates,
 100.0e0 * (count(*) - count(distinct {row})) / count(*) <= 5 as is_acceptable from {source}"""


@query("duplicate_analysis", _COPIES.format(
    row="{'t': text, 'l': lang, 's': source}", ids="count(*) - count(distinct text)",
    source="documents"))
def _duplicates(spark, sf):
    return Q.duplicate_analysis(
        table(spark, sf, "documents").select("text", "lang", "source"), key="text")


_ROW = "{" + ", ".join(f"'{c}': {c}" for c in COLUMNS) + "}"


@query("duplicate_analysis_incidents", with_incidents(_COPIES.format(
    row=_ROW, ids="count(*) - count(distinct ID)", source="incidents")))
def _incident_duplicates(spark, sf):
    return Q.duplicate_analysis(incidents(spark, sf))


# --------------------------------------------------------- composed report

def _avg_nulls() -> str:
    return "round((" + " + ".join(_pct(f"{c} is null") for c in COLUMNS) \
        + f") / {len(COLUMNS)}, 2)"


def _passed() -> str:
    return " + ".join(
        f"(case when {_count(f'{c} is null or {c} not between {a} and {b}')} = 0 then 1 else 0"
        f" end)" for c, (a, b) in RANGES.items()
    )


FIGURES = f"""figures as (select count(*) as total_rows,
 cast({len(COLUMNS)} as bigint) as total_columns, {_avg_nulls()} as average_null_percentage,
 {_count(BAD_GEO)} as invalid_coordinates, {_pct(BAD_GEO)} as geo_invalid_percentage,
 {_count(BAD_STATE)} as invalid_state_count, {_pct(BAD_STATE)} as state_invalid_percentage,
 round(({_passed()}) * 100.0e0 / {len(RANGES)}, 2) as numeric_validation_score,
 {_count('End_Time < Start_Time')} as time_order_violations,
 count(*) - count(distinct {_ROW}) as duplicate_rows,
 round(100.0e0 * (count(*) - count(distinct {_ROW})) / count(*), 2) as duplicate_percentage,
 count(*) - count(distinct ID) as id_duplicates from incidents),
scored as (select *, round(((100 - average_null_percentage) + (100 - geo_invalid_percentage)
 + (100 - state_invalid_percentage) + numeric_validation_score + (100 - duplicate_percentage)) / 5,
 2) as overall_quality_score from figures)"""


@query("quality_score", with_incidents("select overall_quality_score from scored", FIGURES))
def _score(spark, sf):
    return Q.quality_score(Q.quality_figures(incidents(spark, sf)))


@query("quality_issues", with_incidents("""
select 'geographic_validation' as type, 'medium' as severity,
 cast(invalid_coordinates as double) as amount from scored where invalid_coordinates > 0
union all select 'state_validation', 'medium', cast(invalid_state_count as double) from scored
 where invalid_state_count > 0
union all select 'duplicate_data', 'low', duplicate_percentage from scored
 where duplicate_percentage > 5""", FIGURES))
def _issues(spark, sf):
    return Q.quality_issues(Q.quality_figures(incidents(spark, sf)))


@query("quality_recommendations", with_incidents("""
select overall_quality_score, unnest(case
 when overall_quality_score >= 90 then ['Excellent data quality - no immediate actions required']
 when overall_quality_score >= 80 then ['Good data quality - minor improvements possible',
  'Consider reviewing columns with high null percentages']
 when overall_quality_score >= 70 then ['Acceptable data quality - some improvements needed',
  'Focus on geographic and state code validation', 'Review and clean outlier values']
 when overall_quality_score >= 50 then
  ['Poor data quality - significant improvements required',
   'Implement data cleaning pipeline', 'Validate data sources and collection processes']
 else ['Critical data quality issues - immediate action required',
  'Consider data source replacement or major cleanup',
  'Implement comprehensive data validation'] end) as recommendation from scored""", FIGURES))
def _advice(spark, sf):
    return Q.quality_recommendations(Q.quality_figures(incidents(spark, sf)))


_SUMMARY = ("overall_quality_score", "total_rows", "total_columns", "average_null_percentage",
            "invalid_coordinates", "geo_invalid_percentage", "invalid_state_count",
            "state_invalid_percentage", "numeric_validation_score", "time_order_violations",
            "duplicate_rows", "duplicate_percentage", "id_duplicates")


@query("quality_report", with_incidents(
    " union all ".join(
        f"select 'summary' as \"check\", null::varchar as \"column\", '{m}' as metric,"
        f" cast({m} as double) as value from scored" for m in _SUMMARY
    ) + " union all " + " union all ".join(
        f"select 'outliers', \"column\", '{m}', cast({m} as double) from ({_iqr_sql()})"
        for m in ("outlier_count", "outlier_percentage")
    ), FIGURES))
def _report(spark, sf):
    return Q.quality_report(incidents(spark, sf))


# --------------------------------------------------------------- row level

def _issue_text() -> str:
    parts = [f"case when {BAD_GEO} then 'start outside the area' end",
             f"case when {BAD_STATE} then concat('unknown state ', coalesce(State, 'null'))"
             f" end"]
    parts += [
        f"case when {c} not between {a} and {b}"
        f" then concat('{c} beyond its limits: ', cast({c} as varchar)) end"
        for c, (a, b) in RANGES.items()
    ]
    return f"concat_ws('; ', {', '.join(parts)})"


@query("row_issues", with_incidents(
    f"select ID, Start_Time, {_issue_text()} as issues, {_issue_text()} = '' as is_valid"
    f" from incidents"))
def _row_issues(spark, sf):
    return Q.row_issues(incidents(spark, sf)).select(
        "ID", "Start_Time", F.concat_ws("; ", "issues").alias("issues"), "is_valid")


@query("quality_gate", with_incidents(f"""
select ID, Start_Time, case when {SOUND} then 'good' else 'quarantine' end as part
from incidents"""))
def _gate(spark, sf):
    good, held = Q.quality_gate(incidents(spark, sf))
    return good.select("ID", "Start_Time", F.lit("good").alias("part")).unionAll(
        held.select("ID", "Start_Time", F.lit("quarantine")))


# --------------------------------------------------------- rule-based check

def _profile(source: str, numbers, texts, others) -> str:
    parts = []
    for c in (*numbers, *texts, *others):
        number, text = c in numbers, c in texts
        blank = rf"regexp_matches({c}, '^\s*$')"
        parts.append(
            f"select '{c}' as \"column\", {_count(f'{c} is null')} as null_count,"
            f" {_pct(f'{c} is null')} as null_percentage, count({c}) as non_null_count,"
            + (f" cast(min({c}) as double) as min_value, cast(max({c}) as double) as max_value,"
               f" round(avg({c}), 2) as avg_value" if number else
               " null::double as min_value, null::double as max_value, null::double as avg_value")
            + "," + (f" {_count(c + chr(32) + '=' + chr(32) + chr(39) * 2)} as empty_strings,"
                     f" {_count(blank)} as whitespace_only" if text else
                     " null::bigint as empty_strings, null::bigint as whitespace_only")
            + f" from {source}"
        )
    return " union all ".join(parts)


_NUMBERS = ("Severity", "Start_Lat", "Start_Lng", "End_Lat", "End_Lng", "distance_miles",
            "temperature_fahrenheit", "humidity_percent", "pressure_inches", "visibility_miles",
            "wind_speed_mph")
_TEXTS = ("ID", "Source", "State", "County", "City", "Wind_Direction", "Weather_Condition",
          "Sunrise_Sunset")


@query("column_profile", with_incidents(
    _profile("incidents", _NUMBERS, _TEXTS, ("Start_Time", "End_Time", *FLAGS))))
def _column_profile(spark, sf):
    return Q.column_profile(incidents(spark, sf))


@query("column_profile_documents", _profile("documents", ("doc_id", "n_chars"),
                                            ("text", "lang", "source"), ()))
def _document_profile(spark, sf):
    return Q.column_profile(table(spark, sf, "documents"))


def _check(kind: str, bad: str) -> str:
    return with_incidents(
        f"select '{kind}' as type, {_count(bad)} as invalid_count,"
        f" {_pct(bad)} as invalid_percentage, {_count(bad)} = 0 as is_valid from incidents")


BAD_SEVERITY = "(Severity is null or Severity not between 1 and 4)"
BAD_WORLD = ("(Start_Lat is null or Start_Lng is null or Start_Lat not between -90 and 90"
             " or Start_Lng not between -180 and 180)")


@query("severity_check", _check("severity_validation", BAD_SEVERITY))
def _severity(spark, sf):
    return Q.severity_check(incidents(spark, sf))


@query("world_geo_check", _check("geographic_validation", BAD_WORLD))
def _world(spark, sf):
    return Q.world_geo_check(incidents(spark, sf))


@query("time_order_check", _check("time_consistency_validation", "End_Time < Start_Time"))
def _order(spark, sf):
    return Q.time_order_check(incidents(spark, sf))


@query("state_check", _check("state_validation", BAD_STATE))
def _state(spark, sf):
    return Q.state_check(incidents(spark, sf))


_HIGH = " + ".join(f"(case when {_pct(f'{c} is null')} > 30 then 1 else 0 end)" for c in COLUMNS)
_FAILED = " + ".join(f"(case when {_count(b)} > 0 then 1 else 0 end)"
                     for b in (BAD_SEVERITY, BAD_WORLD, "End_Time < Start_Time"))
_RULES = f"""rules as (select count(*) as total_rows, {_HIGH} as high_null_columns,
 {_FAILED} as failed_checks, greatest(0.0e0, 100.0e0 - 5 * ({_HIGH}) - 10 * ({_FAILED}))
 as quality_score, {_count(BAD_STATE)} = 0 as states_valid from incidents)"""


@query("rule_quality_check", with_incidents(
    "select total_rows, high_null_columns, failed_checks, quality_score from rules", _RULES))
def _rules(spark, sf):
    return Q.rule_quality_check(incidents(spark, sf))


@query("full_quality_report", with_incidents(f"""
select total_rows, false as schema_valid, quality_score, states_valid,
 {r('''100.0e0 * ((case when quality_score > 70 then 1 else 0 end)
  + (case when states_valid then 1 else 0 end)) / 3''')} as overall_score from rules""", _RULES))
def _full(spark, sf):
    source = delivered(spark, sf)
    return tidy(Q.full_quality_report(source, S.schema_is_valid(source)))


# ------------------------------------------------------------------ schema

_EXPECTED = T.StructType([
    T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.IntegerType()),
    T.StructField("o_orderstatus", T.BooleanType()), T.StructField("o_totalprice", T.DoubleType()),
    T.StructField("o_orderdate", T.TimestampType()), T.StructField("o_clerk", T.StringType()),
])


@query("schema_diff", """
select * from (values
 ('o_custkey', 'type_mismatch', 'IntegerType', 'LongType', (select count(o_custkey) from orders),
  (select count(try_cast(o_custkey as int)) from orders)),
 ('o_orderstatus', 'type_mismatch', 'BooleanType', 'StringType',
  (select count(o_orderstatus) from orders),
  (select count(*) filter (where lower(o_orderstatus) in ('t', 'f', 'y', 'n', '0', '1'))
   from orders)),
 ('o_orderdate', 'type_mismatch', 'TimestampType', 'TimestampNTZType',
  (select count(o_orderdate) from orders), (select count(o_orderdate) from orders)),
 ('o_clerk', 'missing', 'StringType', null, 0, 0),
 ('o_orderpriority', 'extra', null, 'StringType', (select count(o_orderpriority) from orders),
  (select count(o_orderpriority) from orders)))
as t("column", status, expected, actual, filled_rows, castable_rows)""")
def _diff(spark, sf):
    return S.schema_diff(table(spark, sf, "orders"), _EXPECTED, counts=True)


@query("schema_type_analysis", """
select * from (values
 ('o_orderkey', 'match', 'LongType', 'LongType', (select count(o_orderkey) from orders),
  (select count(o_orderkey) from orders)),
 ('o_custkey', 'convertible', 'IntegerType', 'LongType', (select count(o_custkey) from orders),
  (select count(try_cast(o_custkey as int)) from orders)),
 ('o_orderstatus', 'convertible', 'BooleanType', 'StringType',
  (select count(o_orderstatus) from orders),
  (select count(*) filter (where lower(o_orderstatus) in ('t', 'f', 'y', 'n', '0', '1'))
   from orders)),
 ('o_totalprice', 'match', 'DoubleType', 'DoubleType', (select count(o_totalprice) from orders),
  (select count(o_totalprice) from orders)),
 ('o_orderdate', 'issue', 'TimestampType', 'TimestampNTZType',
  (select count(o_orderdate) from orders), (select count(o_orderdate) from orders)))
as t("column", status, expected, actual, filled_rows, castable_rows)""")
def _types(spark, sf):
    return S.schema_type_analysis(table(spark, sf, "orders"), _EXPECTED, counts=True)


_NAMES = [f.name for f in _EXPECTED]


@query("schema_conformity", """
select count(*) as total_rows, 100.0e0 - 5 - 2 - 20 - 10 + 2 * 2 as conformity_score
from orders""")
def _conformity(spark, sf):
    orders = table(spark, sf, "orders")
    score = S.schema_conformity(orders, _EXPECTED, _NAMES, critical=("o_clerk", "o_orderkey"))
    return orders.agg(F.count(F.lit(1)).alias("total_rows"),
                      F.lit(score).alias("conformity_score"))


@query("schema_report", """
select count(*) as total_rows, false as is_valid, 6 as total_columns, 1 as missing_columns,
 1 as extra_columns, 0 as missing_critical, 2 as type_matches, 2 as convertible_types,
 1 as type_issues, 87.0e0 as conformity_score, 'MEDIUM' as severity_level,
 'missing 1 o_clerk; surplus 1 o_orderpriority; wrong type 1 ; castable type 2 '
  as recommendations from orders""")
def _schema(spark, sf):
    report = S.schema_report(table(spark, sf, "orders"), _EXPECTED, _NAMES,
                             critical=("o_orderkey",))
    shown = F.transform("recommendations", lambda x: F.concat_ws(
        " ", x["kind"], x["count"].cast("string"), x["columns"]))
    return report.withColumn("recommendations", F.concat_ws("; ", shown))


@query("column_set_difference", " union all ".join(
    f"select '{c}' as \"column\", '{'common' if c in COLUMNS else 'missing'}' as status,"
    f" (select count(*) from events) as total_rows" for c in DELIVERED_COLUMNS
) + "".join(
    f" union all select '{c}', 'extra', (select count(*) from events)"
    for c in COLUMNS if c not in DELIVERED_COLUMNS
))
def _names(spark, sf):
    source = incidents(spark, sf)
    total = source.count()
    return S.column_set_difference(source).withColumn("total_rows", F.lit(total).cast("bigint"))


@query("column_names_check", """
select count(*) as total_rows, false as as_delivered, true as as_expected from orders""")
def _names_check(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.lit(S.column_names_check(orders)).alias("as_delivered"),
        F.lit(S.column_names_check(orders, orders.columns)).alias("as_expected"))


# ------------------------------------------------------------------ scores

@query("transformation_score", f"""
select cleaning_score, round(0.4 * cleaning_score + 40.0e0 + 20.0e0, 2) as score
from ({SCORE_SQL})""")
def _transformation(spark, sf):
    """Cleaning score of the whole table with the features and tables a silver build makes."""
    cleaned = flows.cleaning_report(delivered(spark, sf))
    score = cleaned.first()["cleaning_score"]
    made = flows.features_made(create_features(incidents(spark, sf)).columns)
    total = flows.transformation_score(score, made, len(flows.SILVER_TABLES))
    return cleaned.select("cleaning_score", F.lit(total).alias("score"))


@query("dataframe_metrics", """
select count(*) as record_count, 11 as column_count from lineitem""")
def _metrics(spark, sf):
    return layout.dataframe_metrics(table(spark, sf, "lineitem")).drop("partitions_with_rows")


@query("quality_thresholds", with_incidents(f"""
select "column", null_count, null_percentage, null_percentage > 5 as high_null from ({_NULLS})"""))
def _thresholds(spark, sf):
    return Q.null_profile(incidents(spark, sf), QualityThresholds(max_null_percentage=5.0))
