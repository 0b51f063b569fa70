"""Column roles, schemas and fixed domain values of the incident model.

Everything in this module is a plain value.  The blocks marked "fixed values"
define results and must not be changed without changing the reports.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Roles:
    """Which column plays which part; every operator takes one of these."""

    id: str = "ID"
    severity: str = "Severity"
    start: str = "Start_Time"
    end: str = "End_Time"
    lat: str = "Start_Lat"
    lng: str = "Start_Lng"
    end_lat: str = "End_Lat"
    end_lng: str = "End_Lng"
    state: str = "State"
    city: str = "City"
    county: str = "County"
    source: str = "Source"
    weather: str = "Weather_Condition"
    distance: str = "distance_miles"
    temperature: str = "temperature_fahrenheit"
    humidity: str = "humidity_percent"
    pressure: str = "pressure_inches"
    visibility: str = "visibility_miles"
    wind: str = "wind_speed_mph"
    signal: str = "Traffic_Signal"
    stop: str = "Stop"
    # feature columns
    hour: str = "accident_hour"
    dow: str = "accident_day_of_week"
    month: str = "accident_month"
    season: str = "accident_season"
    weekend: str = "is_weekend"
    rush_hour: str = "is_rush_hour"
    weather_category: str = "weather_category"
    weather_score: str = "weather_severity_score"
    visibility_class: str = "visibility_category"
    temperature_class: str = "temperature_category"
    city_distance: str = "distance_to_city_center"
    urban_class: str = "urban_rural_classification"
    region: str = "state_region"
    density_class: str = "population_density_category"
    equipment_count: str = "infrastructure_count"
    safety_score: str = "safety_equipment_score"
    control: str = "traffic_control_type"


INCIDENT = Roles()

# ---------------------------------------------------------------- fixed values
# The complete incident record: both published column lists merged.
_STRING = T.StringType()
_DOUBLE = T.DoubleType()
_STAMP = T.TimestampType()
_FLAG = T.BooleanType()

EQUIPMENT_FLAGS = (
    "Amenity", "Bump", "Crossing", "Give_Way", "Junction", "No_Exit", "Railway",
    "Roundabout", "Station", "Stop", "Traffic_Calming", "Traffic_Signal", "Turning_Loop",
)

INCIDENT_SCHEMA = T.StructType(
    [T.StructField("ID", _STRING, False),
     T.StructField("Severity", T.IntegerType())]
    + [T.StructField(n, _STAMP) for n in ("Start_Time", "End_Time")]
    + [T.StructField(n, _DOUBLE) for n in
       ("Start_Lat", "Start_Lng", "End_Lat", "End_Lng", "Distance(mi)")]
    + [T.StructField("Description", _STRING), T.StructField("Number", _DOUBLE)]
    + [T.StructField(n, _STRING) for n in
       ("Street", "Side", "City", "County", "State", "Zipcode", "Country", "Timezone",
        "Airport_Code")]
    + [T.StructField("Weather_Timestamp", _STAMP)]
    + [T.StructField(n, _DOUBLE) for n in
       ("Temperature(F)", "Wind_Chill(F)", "Humidity(%)", "Pressure(in)", "Visibility(mi)")]
    + [T.StructField("Wind_Direction", _STRING)]
    + [T.StructField(n, _DOUBLE) for n in ("Wind_Speed(mph)", "Precipitation(in)")]
    + [T.StructField("Weather_Condition", _STRING)]
    + [T.StructField(n, _FLAG) for n in EQUIPMENT_FLAGS]
    + [T.StructField(n, _STRING) for n in
       ("Sunrise_Sunset", "Civil_Twilight", "Nautical_Twilight", "Astronomical_Twilight")]
)

# Columns a file may carry on top of INCIDENT_SCHEMA, or leave out, without harm.
OPTIONAL_COLUMNS = ("Source", "Number", "Side")

# The names a delivered file is expected to have.
DELIVERED_COLUMNS = tuple(
    ["ID", "Source"] + [f.name for f in INCIDENT_SCHEMA if f.name not in ("ID", "Number", "Side")]
)

INGESTION_COLUMNS = ("ingestion_timestamp", "ingestion_date", "batch_id")

CRITICAL_AT_INGEST = ("ID", "Severity", "Start_Time", "Start_Lat", "Start_Lng", "State")
CRITICAL_AT_CLEANING = ("ID", "Start_Time", "Start_Lat", "Start_Lng", "State")

MEASURE_NAMES = {
    "Distance(mi)": "distance_miles",
    "Temperature(F)": "temperature_fahrenheit",
    "Wind_Chill(F)": "wind_chill_fahrenheit",
    "Humidity(%)": "humidity_percent",
    "Pressure(in)": "pressure_inches",
    "Visibility(mi)": "visibility_miles",
    "Wind_Speed(mph)": "wind_speed_mph",
    "Precipitation(in)": "precipitation_inches",
}

TWILIGHT_COLUMNS = (
    "Sunrise_Sunset", "Civil_Twilight", "Nautical_Twilight", "Astronomical_Twilight",
)


@dataclass(frozen=True)
class GeoBox:
    min_lat: float
    max_lat: float
    min_lng: float
    max_lng: float


US_BOX = GeoBox(24.0, 71.0, -180.0, -66.0)
WORLD_BOX = GeoBox(-90.0, 90.0, -180.0, 180.0)

STATE_CODES = (
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA",
    "KS", "KY", "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ",
    "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT",
    "VA", "WA", "WV", "WI", "WY", "DC",
)

# Keyed by the delivered name; operators also find the renamed column.
QUALITY_RANGES = {
    "Severity": (1, 4),
    "Distance(mi)": (0.0, 100.0),
    "Temperature(F)": (-50.0, 130.0),
    "Wind_Speed(mph)": (0.0, 200.0),
    "Humidity(%)": (0.0, 100.0),
    "Pressure(in)": (25.0, 35.0),
    "Visibility(mi)": (0.0, 50.0),
    "Precipitation(in)": (0.0, 20.0),
}

IQR_COLUMNS = (
    "Distance(mi)", "Temperature(F)", "Wind_Speed(mph)", "Humidity(%)", "Pressure(in)",
)

ZSCORE_COLUMNS = (
    "distance_miles", "temperature_fahrenheit", "wind_speed_mph", "visibility_miles",
)


@dataclass(frozen=True)
class QualityThresholds:
    max_null_percentage: float = 30.0
    max_duplicate_percentage: float = 5.0
    min_quality_score: float = 70.0


SEASON_MONTHS = {
    "Winter": (12, 1, 2),
    "Spring": (3, 4, 5),
    "Summer": (6, 7, 8),
    "Fall": (9, 10, 11),
}
WEEKEND_DAYS = (1, 7)
RUSH_HOURS = ((7, 9), (17, 19))

WEATHER_WORDS = (
    ("clear", "Clear"), ("rain", "Rain"), ("snow", "Snow"), ("fog", "Fog"),
    ("cloud", "Cloudy"), ("wind", "Windy"),
)
WEATHER_OTHER = "Other"
WEATHER_SCORES = {"Clear": 1, "Cloudy": 3, "Rain": 6, "Fog": 7, "Snow": 8, "Windy": 5}
WEATHER_OTHER_SCORE = 4

VISIBILITY_FLOORS = ((10, "Good"), (5, "Fair"), (1, "Poor"))
VISIBILITY_REST = "Very Poor"
TEMPERATURE_CEILINGS = ((32, "Cold"), (70, "Mild"), (90, "Warm"))
TEMPERATURE_REST = "Hot"
CITY_DISTANCE_CEILINGS = ((10, "Urban"), (50, "Suburban"))
CITY_DISTANCE_REST = "Rural"
DENSITY_OF_CLASS = {"Urban": "High", "Suburban": "Medium"}
DENSITY_REST = "Low"

STATE_REGIONS = {
    "Northeast": ("CT", "ME", "MA", "NH", "NJ", "NY", "PA", "RI", "VT"),
    "Southeast": ("AL", "AR", "DE", "FL", "GA", "KY", "LA", "MD", "MS", "NC", "SC", "TN", "VA",
                  "WV"),
    "Midwest": ("IL", "IN", "IA", "KS", "MI", "MN", "MO", "NE", "ND", "OH", "SD", "WI"),
    "Southwest": ("AZ", "NM", "OK", "TX"),
    "West": ("AK", "CA", "CO", "HI", "ID", "MT", "NV", "OR", "UT", "WA", "WY"),
    "Other": ("DC",),
}

CITY_CENTRES = {
    "CA": (34.0522, -118.2437),
    "NY": (40.7128, -74.0060),
    "TX": (29.7604, -95.3698),
    "FL": (25.7617, -80.1918),
    "IL": (41.8781, -87.6298),
    "PA": (39.9526, -75.1652),
    "OH": (39.9612, -82.9988),
    "GA": (33.7490, -84.3880),
    "NC": (35.2271, -80.8431),
    "MI": (42.3314, -83.0458),
}

EARTH_RADIUS_MILES = 3956
EARTH_RADIUS_KM = 6371

SAFETY_WEIGHTS = {
    "Traffic_Signal": 3, "Stop": 3,
    "Traffic_Calming": 2, "Railway": 2, "Crossing": 2,
    "Junction": 1, "Roundabout": 1, "Give_Way": 1, "Station": 1,
    "Amenity": 0, "Bump": 0, "No_Exit": 0, "Turning_Loop": 0,
}

REPORT_EQUIPMENT = (
    "Traffic_Signal", "Stop", "Traffic_Calming", "Railway", "Crossing", "Junction",
    "Roundabout", "Give_Way", "Station",
)

SEVERITY_PERCENTILES = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)

ENCODED_COLUMNS = {
    "Source": "source_encoded",
    "weather_category": "weather_category_encoded",
    "state_region": "state_region_encoded",
    "urban_rural_classification": "urban_rural_encoded",
    "traffic_control_type": "traffic_control_encoded",
}

SILVER_DETAIL_COLUMNS = (
    "ID", "Severity", "Start_Time", "End_Time", "Start_Lat", "Start_Lng", "State", "City",
    "County", "distance_miles", "temperature_fahrenheit", "humidity_percent",
    "visibility_miles", "wind_speed_mph", "accident_hour", "accident_day_of_week",
    "accident_month", "accident_season", "is_weekend", "is_rush_hour", "weather_category",
    "weather_severity_score", "visibility_category", "temperature_category",
    "distance_to_city_center", "urban_rural_classification", "state_region",
    "infrastructure_count", "safety_equipment_score", "traffic_control_type", "accident_year",
)

# Types a delivered column may have and still be brought to the expected type.
CONVERTIBLE_TYPES = {
    "StringType": ("StringType",),
    "IntegerType": ("IntegerType", "LongType", "DoubleType"),
    "DoubleType": ("DoubleType", "FloatType", "IntegerType"),
    "TimestampType": ("TimestampType", "StringType"),
    "BooleanType": ("BooleanType", "StringType"),
}

QUALITY_ADVICE = (
    (90, ("Excellent data quality - no immediate actions required",)),
    (80, ("Good data quality - minor improvements possible",
          "Consider reviewing columns with high null percentages")),
    (70, ("Acceptable data quality - some improvements needed",
          "Focus on geographic and state code validation",
          "Review and clean outlier values")),
    (50, ("Poor data quality - significant improvements required",
          "Implement data cleaning pipeline",
          "Validate data sources and collection processes")),
    (0, ("Critical data quality issues - immediate action required",
         "Consider data source replacement or major cleanup",
         "Implement comprehensive data validation")),
)

KPI_WINDOW_DAYS = {"daily": 30, "weekly": 84, "monthly": 365, "yearly": 1095}
RISK_COLOUR_STEPS = ((0.5, "yellow"), (0.7, "orange"), (0.85, "red"), (1.0, "darkred"))
# ------------------------------------------------------------ end fixed values


def delivered_or_renamed(columns, name: str) -> str | None:
    """The column that carries measure ``name`` in a table: as delivered or as renamed."""
    if name in columns:
        return name
    renamed = MEASURE_NAMES.get(name)
    return renamed if renamed in columns else None


def present_ranges(columns, ranges=None) -> dict[str, tuple[float, float]]:
    """``{column: (low, high)}`` for the ranged measures this table has."""
    found = {}
    for name, bounds in (ranges or QUALITY_RANGES).items():
        column = delivered_or_renamed(columns, name)
        if column is not None:
            found[column] = bounds
    return found


def present_flags(columns, flags=EQUIPMENT_FLAGS) -> list[str]:
    return [f for f in flags if f in columns]
