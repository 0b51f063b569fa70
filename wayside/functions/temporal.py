"""Calendar classes of an event time."""

from pyspark.sql import Column

from wayside.functions.cases import any_of, first_match
from wayside.model import RUSH_HOURS, SEASON_MONTHS, WEEKEND_DAYS


def season(month: Column) -> Column:
    return first_match(
        [(month.isin(*months), name) for name, months in SEASON_MONTHS.items()], "Unknown"
    )


def is_weekend(day_of_week: Column) -> Column:
    """Day 1 is Sunday."""
    return day_of_week.isin(*WEEKEND_DAYS)


def is_rush_hour(hour: Column) -> Column:
    return any_of((hour >= start) & (hour < stop) for start, stop in RUSH_HOURS)
