"""Registration of queries, the tables they read, and common parts of the checking SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from wayside import model
from wayside.operators.features import derive_features
from wayside.plans.incidents import incidents_from_events, rule_text


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    """Register ``(spark, sf_dir) -> DataFrame`` under a name, with its checking SQL."""
    def add(run):
        if name in CATALOG:
            raise ValueError(f"{name} is registered twice")
        CATALOG[name] = Entry(run, sql)
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents_from_events(table(spark, sf_dir, "events"))


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_features(incidents(spark, sf_dir))


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show."""
    doubles = [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(F.col(c), digits) for c in doubles}) if doubles else df


# ------------------------------------------------------------- checking SQL

FLAGS = ("Traffic_Signal", "Stop", "Crossing", "Junction", "Railway", "Amenity", "Roundabout",
         "Traffic_Calming")

INCIDENTS = "incidents as (select " + ", ".join(
    f'{rule} as "{name}"' for name, rule in rule_text("varchar").items()
) + " from events)"

CENTRES = "centres(code, c_lat, c_lng) as (values " + ", ".join(
    f"('{code}', {lat!r}e0, {lng!r}e0)" for code, (lat, lng) in model.CITY_CENTRES.items()
) + ")"

STATES = ", ".join(f"'{code}'" for code in sorted(model.STATE_CODES))


_REGIONS = " ".join(
    "when State in (" + ", ".join(f"'{code}'" for code in codes) + f") then '{region}'"
    for region, codes in model.STATE_REGIONS.items())
_VISIBILITY = " ".join(
    f"when visibility_miles >= {floor} then '{name}'" for floor, name in model.VISIBILITY_FLOORS)
_TEMPERATURE = " ".join(
    f"when temperature_fahrenheit <= {top} then '{name}'"
    for top, name in model.TEMPERATURE_CEILINGS)


def features_of(source: str, name: str = "featured") -> str:
    """CTEs that add the feature columns to ``source``."""
    return f"""{name}_1 as (
 select i.*,
  cast(hour(Start_Time) as int) as accident_hour,
  cast(dayofweek(Start_Time) + 1 as int) as accident_day_of_week,
  cast(month(Start_Time) as int) as accident_month,
  case when lower(Weather_Condition) like '%clear%' then 'Clear'
       when lower(Weather_Condition) like '%rain%' then 'Rain'
       when lower(Weather_Condition) like '%snow%' then 'Snow'
       when lower(Weather_Condition) like '%fog%' then 'Fog'
       when lower(Weather_Condition) like '%cloud%' then 'Cloudy'
       when lower(Weather_Condition) like '%wind%' then 'Windy' else 'Other' end
   as weather_category,
  case {_VISIBILITY} else '{model.VISIBILITY_REST}' end as visibility_category,
  case {_TEMPERATURE} else '{model.TEMPERATURE_REST}' end as temperature_category,
  case {_REGIONS} else 'Unknown' end as state_region,
  case when c_lat is not null and Start_Lat is not null and Start_Lng is not null then
   2 * 3956 * asin(sqrt(power(sin((radians(c_lat) - radians(Start_Lat)) / 2), 2)
    + cos(radians(Start_Lat)) * cos(radians(c_lat))
      * power(sin((radians(c_lng) - radians(Start_Lng)) / 2), 2))) end as distance_to_city_center,
  {" + ".join(f"(case when {f} then 1 else 0 end)" for f in FLAGS)} as infrastructure_count,
  (case when Traffic_Signal then 3 else 0 end) + (case when Stop then 3 else 0 end)
   + (case when Traffic_Calming then 2 else 0 end) + (case when Railway then 2 else 0 end)
   + (case when Crossing then 2 else 0 end) + (case when Junction then 1 else 0 end)
   + (case when Roundabout then 1 else 0 end) as safety_equipment_score,
  case when Traffic_Signal and Stop then 'Multiple' when Traffic_Signal then 'Signal'
       when Stop then 'Stop' else 'None' end as traffic_control_type
 from {source} i left join centres on State = code),
{name} as (
 select *,
  case when accident_month in (12, 1, 2) then 'Winter' when accident_month in (3, 4, 5)
   then 'Spring' when accident_month in (6, 7, 8) then 'Summer'
   when accident_month in (9, 10, 11) then 'Fall' else 'Unknown' end as accident_season,
  accident_day_of_week in (1, 7) as is_weekend,
  (accident_hour >= 7 and accident_hour < 9) or (accident_hour >= 17 and accident_hour < 19)
   as is_rush_hour,
  case weather_category when 'Clear' then 1 when 'Cloudy' then 3 when 'Rain' then 6
   when 'Fog' then 7 when 'Snow' then 8 when 'Windy' then 5 else 4 end
   as weather_severity_score,
  case when distance_to_city_center <= 10 then 'Urban' when distance_to_city_center <= 50
   then 'Suburban' else 'Rural' end as urban_rural_classification,
  case when distance_to_city_center <= 10 then 'High' when distance_to_city_center <= 50
   then 'Medium' else 'Low' end as population_density_category
 from {name}_1)"""


FEATURED = f"{CENTRES}, {INCIDENTS}, {features_of('incidents')}"


def with_incidents(sql: str, *more: str) -> str:
    return f"with {', '.join([INCIDENTS, *more])} {sql}"


def with_features(sql: str, *more: str) -> str:
    return f"with {', '.join([FEATURED, *more])} {sql}"


def r(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits})"


N = "count(*) as accident_count"
SEV = "round(avg(Severity), 6) as avg_severity"
