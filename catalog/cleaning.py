"""Projections, filters, null treatment, deduplication, outliers, configured steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import STATES, incidents, query, r, table, tidy, with_incidents
from wayside.model import MEASURE_NAMES
from wayside.operators import cleaning as C
from wayside.plans import flows, steps

_DELIVERED = {new: old for old, new in MEASURE_NAMES.items()}


def delivered(spark, sf):
    """The incidents under the names a delivered file has."""
    return incidents(spark, sf).withColumnsRenamed(_DELIVERED)


# ------------------------------------------------------------ projections

@query("rename_measures", with_incidents(
    "select ID, Start_Time, distance_miles, temperature_fahrenheit, humidity_percent,"
    " pressure_inches, visibility_miles, wind_speed_mph from incidents"))
def _rename(spark, sf):
    return C.rename_measures(delivered(spark, sf)).select(
        "ID", "Start_Time", "distance_miles", "temperature_fahrenheit", "humidity_percent",
        "pressure_inches", "visibility_miles", "wind_speed_mph")


@query("project_available", with_incidents(
    "select ID, Severity, Start_Time, End_Time, Start_Lat, Start_Lng, State, City, County,"
    " distance_miles, temperature_fahrenheit, humidity_percent, visibility_miles,"
    " wind_speed_mph from incidents"))
def _project(spark, sf):
    return C.project_available(incidents(spark, sf))


@query("standardize_formats", with_incidents(r"""
select ID, Start_Time, upper(trim(State)) as State,
 regexp_replace(trim(City), '\s+', ' ', 'g') as City, trim(Weather_Condition) as Weather_Condition,
 upper(trim(Wind_Direction)) as Wind_Direction,
 case when Sunrise_Sunset in ('Day', 'day', 'DAY') then 'Day'
  when Sunrise_Sunset in ('Night', 'night', 'NIGHT') then 'Night' else Sunrise_Sunset end
  as Sunrise_Sunset
from incidents"""))
def _formats(spark, sf):
    return C.standardize_formats(incidents(spark, sf)).select(
        "ID", "Start_Time", "State", "City", "Weather_Condition", "Wind_Direction",
        "Sunrise_Sunset")


@query("string_normalize", r"""
select p_partkey, regexp_replace(upper(trim(p_name)), '\s+', ' ', 'g') as p_name,
 regexp_replace(upper(trim(p_type)), '\s+', ' ', 'g') as p_type from part""")
def _normalize(spark, sf):
    return C.string_normalize(
        table(spark, sf, "part"), ["p_name", "p_type"],
        ["trim", "upper", "lower", "remove_extra_spaces"],
    ).select("p_partkey", "p_name", "p_type")


@query("type_convert", """
select doc_id, try_cast(lang as double) as lang, try_cast(n_chars as int) as n_chars,
 cast(quality as varchar) as quality, cast(toxic as boolean) as toxic
from documents join labels using (doc_id)""")
def _convert(spark, sf):
    both = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return C.type_convert(
        both, {"lang": "double", "n_chars": "integer", "quality": "string", "toxic": "boolean"}
    ).select("doc_id", "lang", "n_chars", "quality", "toxic")


@query("null_out_impossible", with_incidents("""
select ID, Start_Time,
 case when temperature_fahrenheit < -50 or temperature_fahrenheit > 150 then null
  else temperature_fahrenheit end as temperature_fahrenheit,
 case when wind_speed_mph > 200 then null else wind_speed_mph end as wind_speed_mph,
 case when distance_miles - 30 < 0 then abs(distance_miles - 30) else distance_miles - 30 end
  as distance_miles,
 case when pressure_inches - 4 < 25 or pressure_inches - 4 > 35 then null
  else pressure_inches - 4 end as pressure_inches
from incidents"""))
def _impossible(spark, sf):
    # shifted so that negative distances and impossible pressures occur
    shifted = incidents(spark, sf).withColumns(
        {"distance_miles": F.col("distance_miles") - 30,
         "pressure_inches": F.col("pressure_inches") - 4}
    )
    return C.null_out_impossible(shifted).select(
        "ID", "Start_Time", "temperature_fahrenheit", "wind_speed_mph", "distance_miles",
        "pressure_inches")


# ----------------------------------------------------------------- filters

@query("drop_null_keys", with_incidents(
    "select ID, Start_Time, State, Start_Lat from incidents where ID is not null and Start_Time"
    " is not null and Start_Lat is not null and Start_Lng is not null and State is not null"))
def _keys(spark, sf):
    return C.drop_null_keys(incidents(spark, sf)).select("ID", "Start_Time", "State", "Start_Lat")


PHYSICAL = """Start_Lat between -90 and 90 and Start_Lng between -180 and 180
 and Severity between 1 and 4 and distance_miles >= 0 and visibility_miles >= 0
 and wind_speed_mph >= 0 and humidity_percent between 0 and 100"""


@query("physical_range_filter", with_incidents(
    f"select ID, Start_Time, Severity, humidity_percent from incidents where {PHYSICAL}"))
def _physical(spark, sf):
    return C.physical_range_filter(incidents(spark, sf)).select(
        "ID", "Start_Time", "Severity", "humidity_percent")


SOUND = f"""Start_Lat between 24 and 71 and Start_Lng between -180 and -66
 and State in ({STATES}) and (Severity between 1 and 4 or Severity is null)
 and (distance_miles between 0 and 100 or distance_miles is null)
 and (temperature_fahrenheit between -50 and 130 or temperature_fahrenheit is null)
 and (wind_speed_mph between 0 and 200 or wind_speed_mph is null)
 and (humidity_percent between 0 and 100 or humidity_percent is null)
 and (pressure_inches between 25 and 35 or pressure_inches is null)
 and (visibility_miles between 0 and 50 or visibility_miles is null)"""


@query("corrupt_row_filter", with_incidents(
    f"select ID, Start_Time, State, Severity from incidents where {SOUND}"))
def _corrupt(spark, sf):
    return C.corrupt_row_filter(delivered(spark, sf)).select(
        "ID", "Start_Time", "State", "Severity")


@query("corrupt_row_filter_aggressive", with_incidents(f"""
select distinct State, City, Severity, Wind_Direction, humidity_percent, visibility_miles
from incidents
where State in ({STATES}) and (Severity between 1 and 4 or Severity is null)
 and (humidity_percent between 0 and 100 or humidity_percent is null)
 and (visibility_miles between 0 and 50 or visibility_miles is null)
 and (case when State is null then 0 else 1 end) + (case when City is null then 0 else 1 end)
  + (case when Severity is null then 0 else 1 end)
  + (case when Wind_Direction is null then 0 else 1 end)
  + (case when humidity_percent is null then 0 else 1 end)
  + (case when visibility_miles is null then 0 else 1 end) >= 3"""))
def _aggressive(spark, sf):
    few = incidents(spark, sf).select(
        "State", "City", "Severity", "Wind_Direction", "humidity_percent", "visibility_miles")
    return C.corrupt_row_filter(few, aggressive=True)


@query("range_filter", """
select l_orderkey, l_linenumber, l_quantity, l_discount from lineitem
where l_quantity between 5 and 45 and l_discount between 0.02 and 0.08""")
def _range(spark, sf):
    return C.range_filter(
        table(spark, sf, "lineitem"), {"l_quantity": (5, 45), "l_discount": (0.02, 0.08)}
    ).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query("range_clamp", with_incidents("""
select ID, Start_Time,
 case when humidity_percent is not null then greatest(least(humidity_percent, 90.0e0), 10.0e0) end
  as humidity_percent,
 case when temperature_fahrenheit is not null
  then greatest(least(temperature_fahrenheit, 100.0e0), 0.0e0) end as temperature_fahrenheit
from incidents"""))
def _clamp(spark, sf):
    return C.range_clamp(
        incidents(spark, sf),
        {"humidity_percent": (10.0, 90.0), "temperature_fahrenheit": (0.0, 100.0)},
    ).select("ID", "Start_Time", "humidity_percent", "temperature_fahrenheit")


@query("range_clamp_null_to_max", with_incidents("""
select ID, Start_Time,
 greatest(least(coalesce(humidity_percent, 90.0e0), 90.0e0), 10.0e0) as humidity_percent
from incidents"""))
def _clamp_null(spark, sf):
    return C.range_clamp(
        incidents(spark, sf), {"humidity_percent": (10.0, 90.0)}, null_to_max=True
    ).select("ID", "Start_Time", "humidity_percent")


# ----------------------------------------------------------- deduplication

_ALL_COLUMNS = [
    "Source", "Severity", "Start_Time", "End_Time", "State", "County", "City", "Start_Lat",
    "Start_Lng", "End_Lat", "End_Lng", "distance_miles", "temperature_fahrenheit",
    "humidity_percent", "pressure_inches", "visibility_miles", "wind_speed_mph",
    "Wind_Direction", "Weather_Condition", "Sunrise_Sunset", "Traffic_Signal", "Stop",
    "Crossing", "Junction", "Railway", "Amenity", "Roundabout", "Traffic_Calming",
]
DEDUPLICATED = "deduplicated as (select * exclude (rn) from (select *, row_number() over (" \
    "partition by ID order by " + ", ".join(f"{c} nulls first" for c in _ALL_COLUMNS) \
    + ") as rn from incidents) where rn = 1)"


@query("dedup_by_key", with_incidents(
    "select ID, Severity, Start_Time, State, City, distance_miles from deduplicated",
    DEDUPLICATED))
def _dedup(spark, sf):
    return C.dedup_by_key(incidents(spark, sf)).select(
        "ID", "Severity", "Start_Time", "State", "City", "distance_miles")


@query("dedup_rows", "select distinct text, lang, source from documents")
def _rows(spark, sf):
    return C.dedup_rows(table(spark, sf, "documents").select("text", "lang", "source"))


# ------------------------------------------------------------------- nulls

@query("null_strategy", with_incidents("""
select ID, Start_Time, coalesce(Severity, 0) as Severity,
 round(coalesce(temperature_fahrenheit, (select avg(temperature_fahrenheit) from incidents)), 6)
  as temperature_fahrenheit,
 round(coalesce(humidity_percent, (select avg(humidity_percent) from incidents)), 6)
  as humidity_percent,
 coalesce(Weather_Condition, 'Unknown') as Weather_Condition, visibility_miles
from incidents where State is not null and Start_Lat is not null"""))
def _strategy(spark, sf):
    treated = C.null_strategy(
        incidents(spark, sf),
        {"State": "drop", "Start_Lat": "drop", "Severity": "fill_zero",
         "temperature_fahrenheit": "fill_mean", "humidity_percent": "fill_mean",
         "Weather_Condition": "fill_unknown"},
    )
    return tidy(treated.select(
        "ID", "Start_Time", "Severity", "temperature_fahrenheit", "humidity_percent",
        "Weather_Condition", "visibility_miles"))


def null_chain(source: str) -> tuple[list[str], str]:
    """CTEs treating the incident columns with nulls one after the other, and the last name.

    Every step measures its own column on the result of the step before."""
    ctes, last = [], source

    def step(sql: str):
        nonlocal last
        name = f"nulls_{len(ctes)}"
        ctes.append(f"{name} as materialized ({sql.format(last=last)})")
        last = name

    share = "100.0e0 * count(*) filter (where {c} is null) / count(*)"

    def filled(column: str, value: str):
        measure = share.replace("{c}", column)
        step(f"select * replace (case when s.pct < 30 then coalesce({column}, s.fill)"
             f" else {column} end as {column}) from {{last}},"
             f" (select {measure} as pct, {value} as fill from {{last}}) s"
             f" where not (s.pct >= 30 and {column} is null)")

    def measure(column: str):
        filled(column, f"quantile_disc({column}, 0.5)")

    def text(column: str):
        filled(column, "'Unknown'")

    def key(column: str):
        step(f"select * from {{last}} where {column} is not null")

    columns = "ID Source Severity Start_Time End_Time State County City Start_Lat Start_Lng" \
        " End_Lat End_Lng distance_miles temperature_fahrenheit humidity_percent" \
        " pressure_inches visibility_miles wind_speed_mph Wind_Direction Weather_Condition" \
        " Sunrise_Sunset".split()
    keys = {"ID", "State", "Start_Lat", "Start_Lng", "Start_Time"}
    texts = {"Source", "County", "City", "Wind_Direction", "Weather_Condition", "Sunrise_Sunset"}
    for c in columns:
        if c in keys:
            key(c)
        elif c in texts:
            text(c)
        elif c != "End_Time":
            measure(c)
    step("select * replace (coalesce(Traffic_Signal, false) as Traffic_Signal) from {last}")
    return ctes, last


def _null_sql() -> str:
    ctes, last = null_chain("incidents")
    return with_incidents(
        f"select ID, Source, Severity, Start_Time, State, temperature_fahrenheit,"
        f" humidity_percent, visibility_miles, Wind_Direction, Weather_Condition, Traffic_Signal,"
        f" End_Lat from {last}", *ctes)


@query("adaptive_null_handling", _null_sql())
def _adaptive(spark, sf):
    return C.adaptive_null_handling(incidents(spark, sf)).select(
        "ID", "Source", "Severity", "Start_Time", "State", "temperature_fahrenheit",
        "humidity_percent", "visibility_miles", "Wind_Direction", "Weather_Condition",
        "Traffic_Signal", "End_Lat")


# ---------------------------------------------------------------- outliers

def _z(column: str, source: str) -> str:
    return (f"abs(({column} - (select avg({column}) from {source}))"
            f" / (select stddev_samp({column}) from {source})) <= 3")


@query("zscore_filter_independent", "select l_orderkey, l_linenumber, l_extendedprice, l_quantity"
       f" from lineitem where {_z('l_extendedprice', 'lineitem')}"
       f" and {_z('l_quantity', 'lineitem')}")
def _independent(spark, sf):
    return C.zscore_filter_independent(
        table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"]
    ).select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")


def zscore_chain(source: str) -> tuple[list[str], str]:
    ctes, last = [], source
    for i, c in enumerate(
        ("distance_miles", "temperature_fahrenheit", "wind_speed_mph", "visibility_miles")
    ):
        ctes.append(f"zscore_{i} as materialized (select * from {last} where {_z(c, last)})")
        last = f"zscore_{i}"
    return ctes, last


@query("zscore_filter_sequential", with_incidents(
    f"select ID, Start_Time, distance_miles, temperature_fahrenheit, wind_speed_mph"
    f" from {zscore_chain('incidents')[1]}", *zscore_chain("incidents")[0]))
def _sequential(spark, sf):
    return C.zscore_filter_sequential(incidents(spark, sf)).select(
        "ID", "Start_Time", "distance_miles", "temperature_fahrenheit", "wind_speed_mph")


# ------------------------------------------------------------ whole cleaning

@query("post_clean_validation", with_incidents(" union all ".join(
    f"select 'critical_nulls' as \"check\", '{c}' as \"column\","
    f" count(*) filter (where {c} is null) as issues from incidents"
    for c in ("ID", "Start_Time", "Start_Lat", "Start_Lng", "State")
) + " union all " + " union all ".join(
    f"select 'type_mismatch', '{c}', cast(0 as bigint)"
    for c in ("Severity", "Start_Lat", "Start_Lng", "distance_miles")
)))
def _validation(spark, sf):
    return C.post_clean_validation(incidents(spark, sf))


def cleaned_ctes() -> tuple[list[str], str]:
    """CTEs of the whole cleaning; the last name holds the cleaned incidents."""
    nulls, treated = null_chain("deduplicated")
    tidied = r"""tidied as materialized (select * replace (
 upper(trim(State)) as State, regexp_replace(trim(City), '\s+', ' ', 'g') as City,
 trim(Weather_Condition) as Weather_Condition, upper(trim(Wind_Direction)) as Wind_Direction,
 case when Sunrise_Sunset in ('Day', 'day', 'DAY') then 'Day'
  when Sunrise_Sunset in ('Night', 'night', 'NIGHT') then 'Night' else Sunrise_Sunset end
  as Sunrise_Sunset,
 case when temperature_fahrenheit < -50 or temperature_fahrenheit > 150 then null
  else temperature_fahrenheit end as temperature_fahrenheit,
 case when wind_speed_mph > 200 then null else wind_speed_mph end as wind_speed_mph)
""" + f" from {treated} where {PHYSICAL})"
    outliers, last = zscore_chain("tidied")
    return [DEDUPLICATED, *nulls, tidied, *outliers], last


_CLEAN_CTES, _CLEANED = cleaned_ctes()


@query("clean_incidents", with_incidents(
    f"select ID, Severity, Start_Time, State, City, Weather_Condition, distance_miles,"
    f" temperature_fahrenheit, humidity_percent, wind_speed_mph, visibility_miles,"
    f" Sunrise_Sunset, Traffic_Signal from {_CLEANED}", *_CLEAN_CTES))
def _clean(spark, sf):
    return flows.clean_incidents(delivered(spark, sf)).select(
        "ID", "Severity", "Start_Time", "State", "City", "Weather_Condition", "distance_miles",
        "temperature_fahrenheit", "humidity_percent", "wind_speed_mph", "visibility_miles",
        "Sunrise_Sunset", "Traffic_Signal")


SCORE_SQL = with_incidents(f"""
select n_in as input_records, n_in - n_dedup as duplicates_removed,
 n_nulls as records_after_nulls, n_ranged as records_in_range,
 n_ranged - n_out as outliers_removed, n_out as output_records,
 round(100.0e0 * n_out / n_in, 2) as retention_rate, cast(9 as bigint) as data_corrections,
 round(greatest(0.0e0, least(100.0e0, least(100.0e0 * n_out / n_in, 95.0e0)
  - case when 100.0e0 * n_out / n_in < 80 then 2 * (80 - 100.0e0 * n_out / n_in) else 0 end + 10)),
  2) as cleaning_score
from (select (select count(*) from incidents) as n_in,
 (select count(*) from deduplicated) as n_dedup,
 (select count(*) from {null_chain('deduplicated')[1]}) as n_nulls,
 (select count(*) from tidied) as n_ranged, (select count(*) from {_CLEANED}) as n_out)""",
    *_CLEAN_CTES)


@query("cleaning_score", SCORE_SQL)
def _score(spark, sf):
    return flows.cleaning_report(delivered(spark, sf))


# ---------------------------------------------------------------- own steps

_STEPS = [
    {"type": "null_handling", "critical": True,
     "config": {"strategies": {"State": "drop", "Severity": "fill_zero",
                               "temperature_fahrenheit": "fill_mean"}}},
    {"config": {"note": "no type, so it is skipped"}},
    {"type": "range_validation", "config": {"ranges": {"Start_Lat": (-90, 90),
                                                       "Severity": (1, 4)}}},
    {"type": "string_normalization",
     "config": {"columns": ["State", "City"], "operations": ["trim", "upper",
                                                             "remove_extra_spaces"]}},
    {"type": "data_type_conversion", "config": {"conversions": {"Severity": "double"}}},
    {"type": "range_validation", "config": {"action": "clamp",
                                            "ranges": {"wind_speed_mph": (0.0, 100.0)}}},
    {"type": "outlier_removal", "config": {"columns": ["distance_miles"]}},
]
_STEP_CTES = r"""filled as (select * replace (coalesce(Severity, 0) as Severity,
  coalesce(temperature_fahrenheit, (select avg(temperature_fahrenheit) from incidents))
   as temperature_fahrenheit) from incidents where State is not null),
ranged as (select * replace (regexp_replace(upper(trim(State)), '\s+', ' ', 'g') as State,
  regexp_replace(upper(trim(City)), '\s+', ' ', 'g') as City,
  cast(Severity as double) as Severity,
  greatest(least(wind_speed_mph, 100.0e0), 0.0e0) as wind_speed_mph)
 from filled where Start_Lat between -90 and 90 and Severity between 1 and 4),
final as (select * from ranged where """ + _z("distance_miles", "ranged") + ")"


@query("transformation_steps", with_incidents(
    f"select ID, Start_Time, State, City, Severity, wind_speed_mph,"
    f" {r('temperature_fahrenheit')} as temperature_fahrenheit from final", _STEP_CTES))
def _apply(spark, sf):
    done = steps.apply_steps(incidents(spark, sf), _STEPS)
    return tidy(done.select("ID", "Start_Time", "State", "City", "Severity", "wind_speed_mph",
                            "temperature_fahrenheit"))


@query("step_summary", with_incidents("""
select * from (values
 (0, 'null_handling', 'applied', (select count(*) from filled)),
 (1, null, 'skipped', null),
 (2, 'range_validation', 'applied', (select count(*) from ranged)),
 (3, 'string_normalization', 'applied', (select count(*) from ranged)),
 (4, 'data_type_conversion', 'applied', (select count(*) from ranged)),
 (5, 'range_validation', 'applied', (select count(*) from ranged)),
 (6, 'outlier_removal', 'applied', (select count(*) from final)))
 as t(position, type, status, rows_after)""", _STEP_CTES))
def _summary(spark, sf):
    return steps.step_summary(incidents(spark, sf), _STEPS).drop("config")


_PRESET_CTES = r"""filled as (select * replace (coalesce(Severity, 0) as Severity,
  coalesce(Weather_Condition, 'Unknown') as Weather_Condition,
  coalesce(temperature_fahrenheit, (select avg(temperature_fahrenheit) from incidents))
   as temperature_fahrenheit,
  coalesce(humidity_percent, (select avg(humidity_percent) from incidents)) as humidity_percent)
 from incidents where ID is not null and Start_Time is not null and Start_Lat is not null
  and Start_Lng is not null and State is not null),
ranged as (select * replace (regexp_replace(upper(trim(State)), '\s+', ' ', 'g') as State,
  regexp_replace(upper(trim(City)), '\s+', ' ', 'g') as City,
  regexp_replace(upper(trim(Weather_Condition)), '\s+', ' ', 'g') as Weather_Condition)
 from filled where Start_Lat between -90 and 90 and Start_Lng between -180 and 180
  and Severity between 1 and 4 and temperature_fahrenheit between -50 and 150
  and humidity_percent between 0 and 100 and visibility_miles between 0 and 50
  and wind_speed_mph between 0 and 200),
final as (select * from ranged where """ + " and ".join(
    _z(c, "ranged") for c in ("distance_miles", "temperature_fahrenheit", "wind_speed_mph",
                              "visibility_miles")) + ")"


@query("incident_steps_preset", with_incidents(f"""
select ID, Start_Time, State, City, Weather_Condition, Severity,
 {r('humidity_percent')} as humidity, {r('temperature_fahrenheit')} as temperature from final""",
    _PRESET_CTES))
def _preset(spark, sf):
    done = steps.apply_steps(delivered(spark, sf), steps.incident_steps_preset())
    return tidy(done.select(
        "ID", "Start_Time", "State", "City", "Weather_Condition", "Severity",
        F.col("Humidity(%)").alias("humidity"), F.col("Temperature(F)").alias("temperature")))


@query("register_transformation", with_incidents(
    "select ID, Start_Time, distance_miles * 1.609344e0 as distance_km from incidents"
    " where distance_miles is not null"))
def _register(spark, sf):
    steps.register_transformation(
        "to_kilometres",
        lambda df, config: df.withColumn(
            "distance_km", F.col(config["column"]) * F.lit(config["factor"])
        ).filter(F.col("distance_km").isNotNull()),
        applies=lambda df, config: config["column"] in df.columns,
    )
    chain = [{"type": "to_kilometres", "config": {"column": c, "factor": 1.609344}}
             for c in ("distance_miles", "no_such_column")]
    return steps.apply_steps(incidents(spark, sf), chain).select(
        "ID", "Start_Time", "distance_km")
