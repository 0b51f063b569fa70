"""Small hand-made incident tables."""

import datetime as dt

FIXTURE = [
    ("A-1", 2, "2023-06-15 14:30", 40.7128, -74.0060, "NY", "New York", 0.5, 75.0, 65.0, "Clear",
     False, True),
    ("A-2", 3, "2023-06-15 08:15", 34.0522, -118.2437, "CA", "Los Angeles", 1.2, 80.0, 70.0,
     "Rain", True, False),
    ("A-3", 1, "2023-06-15 18:45", 41.8781, -87.6298, "IL", "Chicago", 0.8, 68.0, 55.0, "Snow",
     False, True),
    ("A-4", 4, "2023-06-15 22:10", 29.7604, -95.3698, "TX", "Houston", 2.1, 85.0, 80.0, "Fog",
     True, True),
    ("A-5", 2, "2023-06-16 06:30", 39.9526, -75.1652, "PA", "Philadelphia", 0.3, 72.0, 60.0,
     "Clear", False, False),
]


def five_incidents(spark):
    rows = [r[:2] + (dt.datetime.strptime(r[2], "%Y-%m-%d %H:%M"),) + r[3:] for r in FIXTURE]
    return spark.createDataFrame(
        rows,
        "ID string, Severity int, Start_Time timestamp_ntz, Start_Lat double, Start_Lng double,"
        " State string, City string, `Distance(mi)` double, `Temperature(F)` double,"
        " `Humidity(%)` double, Weather_Condition string, Amenity boolean,"
        " Traffic_Signal boolean",
    )


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
