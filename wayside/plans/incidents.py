"""An incident table derived from a plain event table.

The events carry no road-incident columns, so each one is a fixed expression over
``event_id``, ``user_id``, ``ts`` and ``value``.  The expressions produce every defect the
cleaning and quality operators treat: nulls, repeated ids, impossible values, padded text.
The text of a rule is plain SQL; ``{text}`` stands for the engine's string type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

_STATE_BY_USER = "CA NY TX FL IL PA OH GA WA MI DC ZZ".split()
_WEATHER_BY_EVENT = (
    "Clear", "Light Rain", "Heavy Snow", "Fog", "Mostly Cloudy", "Windy", "Rain / Windy", "Haze",
    " CLEAR ", None,
)


def _choose(subject: str, values) -> str:
    arms = " ".join(
        f"when {subject} = {i} then '{v}'" for i, v in enumerate(values) if v is not None
    )
    return arms


INCIDENT_RULES = {
    "ID": "concat('A-', cast(event_id - (case when event_id % 97 = 96 then 1 else 0 end)"
          " as {text}))",
    "Source": "case when event_id % 3 = 0 then 'Source1' when event_id % 3 = 1 then 'Source2'"
              " else null end",
    "Severity": "cast(case when event_id % 211 = 210 then 5 when event_id % 193 = 192 then null"
                " when user_id % 10 = 3 then 3 + event_id % 2"
                " else 1 + (event_id + user_id) % 4 end as int)",
    "Start_Time": "ts",
    "End_Time": "case when event_id % 50 = 49 then ts - interval '10' minute"
                " else ts + interval '30' minute end",
    "State": "case when event_id % 101 = 100 then null when event_id % 61 = 60 then ' ca ' "
             + _choose("user_id % 12", _STATE_BY_USER) + " end",
    "County": "concat('County ', cast(user_id % 4 as {text}))",
    "City": "case when event_id % 31 = 30 then"
            " concat('  City   ', cast(user_id % 20 as {text}), ' ')"
            " else concat('City ', cast(user_id % 20 as {text})) end",
    "Start_Lat": "case when event_id % 89 = 88 then null when event_id % 83 = 82 then 95.0e0"
                 " else 30.0e0 + cast((event_id * 7919) % 1500 as double) / 100 end",
    "Start_Lng": "case when event_id % 89 = 88 then null"
                 " else -120.0e0 + cast((event_id * 104729) % 5000 as double) / 100 end",
    "End_Lat": "case when event_id % 4 = 3 then null when event_id % 79 = 78 then 12.0e0"
               " else 30.0e0 + cast((event_id * 7919) % 1500 as double) / 100 end",
    "End_Lng": "case when event_id % 4 = 3 then null"
               " else -120.0e0 + cast((event_id * 104729) % 5000 as double) / 100 end",
    "distance_miles": "value",
    "temperature_fahrenheit": "case when event_id % 20 = 19 then null"
                              " when event_id % 307 = 306 then 180.0e0"
                              " else cast((event_id * 37) % 140 as double) - 15 end",
    "humidity_percent": "case when event_id % 3 = 2 then null"
                        " else cast((event_id * 13) % 101 as double) end",
    "pressure_inches": "28.0e0 + cast((event_id * 3) % 40 as double) / 10",
    "visibility_miles": "case when event_id % 25 = 24 then null"
                        " else cast((event_id * 11) % 120 as double) / 10 end",
    "wind_speed_mph": "case when event_id % 401 = 400 then 250.0e0"
                      " else cast((event_id * 17) % 60 as double) end",
    "Wind_Direction": "case when event_id % 9 = 8 then null when event_id % 9 < 4 then ' sw'"
                      " else 'NE ' end",
    "Weather_Condition": "case " + _choose("event_id % 10", _WEATHER_BY_EVENT) + " end",
    "Sunrise_Sunset": "case when event_id % 8 < 3 then 'day' when event_id % 8 = 3 then 'DAY'"
                      " when event_id % 8 < 7 then 'NIGHT' else 'Dusk' end",
    "Traffic_Signal": "case when event_id % 43 = 42 then null else event_id % 5 = 0 end",
    "Stop": "event_id % 7 = 0",
    "Crossing": "event_id % 6 = 0",
    "Junction": "event_id % 11 = 0",
    "Railway": "event_id % 29 = 0",
    "Amenity": "event_id % 13 = 0",
    "Roundabout": "event_id % 37 = 0",
    "Traffic_Calming": "event_id % 17 = 0",
}


def rule_text(string_type: str) -> dict[str, str]:
    return {name: rule.format(text=string_type) for name, rule in INCIDENT_RULES.items()}


def incidents_from_events(events: DataFrame) -> DataFrame:
    """The whole event table as incidents; a projection only."""
    return events.selectExpr(
        *[f"{rule} as `{name}`" for name, rule in rule_text("string").items()]
    )
