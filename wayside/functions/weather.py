"""Weather, visibility and temperature classes.  Null falls into the last class."""

from pyspark.sql import Column, functions as F

from wayside.functions.cases import first_match
from wayside import model


def weather_category(condition: Column) -> Column:
    text = F.lower(condition)
    return first_match(
        [(text.contains(word), name) for word, name in model.WEATHER_WORDS], model.WEATHER_OTHER
    )


def weather_score(category: Column) -> Column:
    return first_match(
        [(category == name, score) for name, score in model.WEATHER_SCORES.items()],
        model.WEATHER_OTHER_SCORE,
    )


def visibility_class(miles: Column) -> Column:
    return first_match(
        [(miles >= floor, name) for floor, name in model.VISIBILITY_FLOORS],
        model.VISIBILITY_REST,
    )


def temperature_class(fahrenheit: Column) -> Column:
    return first_match(
        [(fahrenheit <= top, name) for top, name in model.TEMPERATURE_CEILINGS],
        model.TEMPERATURE_REST,
    )
