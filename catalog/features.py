"""Feature columns (one query each), categorical codes and the feature report."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    featured, incidents, query, r, table, tidy, with_features, with_incidents,
)
from wayside import functions as X
from wayside.operators import features as O

_FEATURES = tuple(
    c for family, columns in O.FAMILIES.items() if family != "encoding" for c in columns
)


def _feature_query(feature: str):
    shown = r(feature) + f" as {feature}" if feature == "distance_to_city_center" else feature

    @query(feature, with_features(f"select ID, Start_Time, {shown} from featured"))
    def run(spark, sf):
        return tidy(featured(spark, sf).select("ID", "Start_Time", feature))


for _name in _FEATURES:
    _feature_query(_name)


def _codes_of(column: str, name: str) -> str:
    return (f"{name} as (select {column}, row_number() over (order by {column}) - 1 as c"
            f" from (select distinct {column} from featured where {column} is not null))")


@query("create_features", with_features(f"""
select f.ID, f.Start_Time, accident_hour, accident_season, is_rush_hour, weather_severity_score,
  {r('distance_to_city_center')} as distance_to_city_center, f.traffic_control_type,
  safety_equipment_score,
  cast(coalesce(o.c, -1) as int) as source_encoded, cast(w.c as int) as weather_category_encoded,
  cast(g.c as int) as state_region_encoded, cast(u.c as int) as urban_rural_encoded,
  cast(t.c as int) as traffic_control_encoded
from featured f left join origins o on f.Source = o.Source
 left join weathers w on f.weather_category = w.weather_category
 left join regions g on f.state_region = g.state_region
 left join urbans u on f.urban_rural_classification = u.urban_rural_classification
 left join controls t on f.traffic_control_type = t.traffic_control_type""",
    _codes_of("Source", "origins"), _codes_of("weather_category", "weathers"),
    _codes_of("state_region", "regions"), _codes_of("urban_rural_classification", "urbans"),
    _codes_of("traffic_control_type", "controls")))
def _create(spark, sf):
    made = O.create_features(incidents(spark, sf))
    return tidy(
        made.select(
            "ID", "Start_Time", "accident_hour", "accident_season", "is_rush_hour",
            "weather_severity_score", "distance_to_city_center", "traffic_control_type",
            "safety_equipment_score", "source_encoded", "weather_category_encoded",
            "state_region_encoded", "urban_rural_encoded", "traffic_control_encoded",
        )
    )


@query("categorical_encode", """
with codes as (select p_type, row_number() over (order by p_type) - 1 as c
  from (select distinct p_type from part)),
 brands as (select p_brand, row_number() over (order by p_brand) - 1 as c
  from (select distinct p_brand from part))
select p_partkey, cast(t.c as int) as type_code, cast(b.c as int) as brand_code
from part join codes t using (p_type) join brands b using (p_brand)""")
def _encode(spark, sf):
    coded = O.encode_categories(
        table(spark, sf, "part"), {"p_type": "type_code", "p_brand": "brand_code"}
    )
    return coded.select("p_partkey", "type_code", "brand_code")


@query("categorical_encode_many_values", """
select o_orderkey, cast(dense_rank() over (order by o_clerk) - 1 as int) as clerk_code
from (select o_orderkey, cast(o_custkey as varchar) as o_clerk from orders)""")
def _encode_many(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("o_clerk")
    )
    coded = O.encode_categories(orders, {"o_clerk": "clerk_code"}, inline_limit=100)
    return coded.select("o_orderkey", "clerk_code")


_REPORTED = [(fam, c) for fam, cols in O.FAMILIES.items() if fam != "encoding" for c in cols]


@query("feature_report", with_features(" union all ".join(
    f"select '{fam}' as family, '{c}' as feature, count({c}) as filled_rows,"
    f" count(*) as total_rows, 48.0e0 as feature_engineering_score from featured"
    for fam, c in _REPORTED
)))
def _report(spark, sf):
    return O.feature_report(featured(spark, sf))


@query("feature_score", with_features(
    "select 48.0e0 as feature_engineering_score, count(*) as total_rows from featured"))
def _score(spark, sf):
    made = featured(spark, sf)
    return made.agg(
        F.lit(O.feature_score(made.columns)).alias("feature_engineering_score"),
        F.count(F.lit(1)).alias("total_rows"),
    )


@query("haversine_miles", with_incidents(f"""
select ID, Start_Time, {r('''2 * 3956 * asin(sqrt(
   power(sin((radians(End_Lat) - radians(Start_Lat)) / 2), 2)
   + cos(radians(Start_Lat)) * cos(radians(End_Lat))
     * power(sin((radians(End_Lng) - radians(Start_Lng)) / 2), 2)))''')} as miles
from incidents"""))
def _haversine(spark, sf):
    X.register_sql_functions(spark)
    return tidy(
        incidents(spark, sf).selectExpr(
            "ID", "Start_Time", "haversine_miles(Start_Lat, Start_Lng, End_Lat, End_Lng) as miles"
        )
    )
