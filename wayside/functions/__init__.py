"""Column expressions; all of them stay inside whole-stage code generation."""

from wayside.functions.equipment import count_true, traffic_control, weighted_true
from wayside.functions.geo import (
    city_distance, density_class, great_circle_km, haversine_miles, inside, outside,
    register_sql_functions, state_region, urban_class,
)
from wayside.functions.text import day_or_night, normalise_text, squeeze_spaces
from wayside.functions.temporal import is_rush_hour, is_weekend, season
from wayside.functions.weather import (
    temperature_class, visibility_class, weather_category, weather_score,
)

__all__ = [
    "city_distance", "count_true", "day_or_night", "density_class", "great_circle_km",
    "haversine_miles", "inside", "is_rush_hour", "is_weekend", "normalise_text", "outside",
    "register_sql_functions", "season", "squeeze_spaces", "state_region", "temperature_class",
    "traffic_control", "urban_class", "visibility_class", "weather_category", "weather_score",
    "weighted_true",
]
