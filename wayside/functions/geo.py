"""Distances, boxes and place classes."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F

from wayside import model
from wayside.functions.cases import first_match
from wayside.model import GeoBox


def haversine_miles(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle miles; null when any coordinate is null."""
    half_lat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    half_lng = F.sin((F.radians(lng2) - F.radians(lng1)) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * (
        half_lng * half_lng
    )
    return F.asin(F.sqrt(F.when(chord > 1.0, 1.0).otherwise(chord))) * 2 * F.lit(
        model.EARTH_RADIUS_MILES
    )


def great_circle_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Spherical law of cosines in km.  The cosine is held to [-1, 1] so that rounding
    on identical points gives 0 rather than NaN."""
    cosine = F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(
        F.radians(lng2) - F.radians(lng1)
    ) + F.sin(F.radians(lat1)) * F.sin(F.radians(lat2))
    held = F.when(cosine > 1.0, 1.0).when(cosine < -1.0, -1.0).otherwise(cosine)
    return F.acos(held) * model.EARTH_RADIUS_KM


def inside(lat: Column, lng: Column, box: GeoBox) -> Column:
    """True or false inside/outside the box, null when a coordinate is null."""
    return lat.between(box.min_lat, box.max_lat) & lng.between(box.min_lng, box.max_lng)


def outside(lat: Column, lng: Column, box: GeoBox) -> Column:
    """A known coordinate lies beyond the box; null coordinates are not outside."""
    return F.coalesce(~lat.between(box.min_lat, box.max_lat), F.lit(False)) | F.coalesce(
        ~lng.between(box.min_lng, box.max_lng), F.lit(False)
    )


def city_distance(state: Column, lat: Column, lng: Column) -> Column:
    """Miles to the city centre of the row's own state; null for states without one."""
    centres = F.create_map(
        *[
            part
            for code, (c_lat, c_lng) in model.CITY_CENTRES.items()
            for part in (F.lit(code), F.struct(F.lit(c_lat).alias("lat"), F.lit(c_lng).alias("lng")))
        ]
    )
    centre = F.try_element_at(centres, state)
    return haversine_miles(lat, lng, centre["lat"], centre["lng"])


def state_region(state: Column) -> Column:
    return first_match(
        [(state.isin(*codes), region) for region, codes in model.STATE_REGIONS.items()], "Unknown"
    )


def urban_class(miles_to_centre: Column) -> Column:
    return first_match(
        [(miles_to_centre <= top, name) for top, name in model.CITY_DISTANCE_CEILINGS],
        model.CITY_DISTANCE_REST,
    )


def density_class(urban: Column) -> Column:
    return first_match(
        [(urban == name, density) for name, density in model.DENSITY_OF_CLASS.items()],
        model.DENSITY_REST,
    )


def register_sql_functions(spark: SparkSession) -> None:
    """Make ``haversine_miles`` and ``great_circle_km`` callable from SQL text."""
    args = "lat1 DOUBLE, lng1 DOUBLE, lat2 DOUBLE, lng2 DOUBLE"
    known = "lat1 IS NOT NULL AND lng1 IS NOT NULL AND lat2 IS NOT NULL AND lng2 IS NOT NULL"
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION haversine_miles({args}) RETURNS DOUBLE
        RETURN CASE WHEN {known} THEN {model.EARTH_RADIUS_MILES} * 2 * asin(sqrt(least(1.0D,
            pow(sin((radians(lat2) - radians(lat1)) / 2), 2)
            + cos(radians(lat1)) * cos(radians(lat2))
              * pow(sin((radians(lng2) - radians(lng1)) / 2), 2)))) END"""
    )
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION great_circle_km({args}) RETURNS DOUBLE
        RETURN CASE WHEN {known} THEN {model.EARTH_RADIUS_KM} * acos(greatest(-1.0D, least(1.0D,
            cos(radians(lat1)) * cos(radians(lat2)) * cos(radians(lng2) - radians(lng1))
            + sin(radians(lat1)) * sin(radians(lat2))))) END"""
    )
