import datetime as dt

from pyspark.sql import functions as F

from tests.frames import executed, five_incidents, values
from wayside import functions as X
from wayside.operators import features as O
from wayside.operators.cleaning import rename_measures


def test_known_features_of_the_five_incidents(spark):
    made = O.derive_features(rename_measures(five_incidents(spark)))
    assert values(made, "accident_hour", "accident_month", "accident_season", "is_rush_hour",
                  "is_weekend") == [
        (14, 6, "Summer", False, False), (8, 6, "Summer", True, False),
        (18, 6, "Summer", True, False), (22, 6, "Summer", False, False),
        (6, 6, "Summer", False, False)]
    assert [r[0] for r in values(made, "weather_severity_score")] == [1, 6, 8, 7, 1]
    assert values(made, "distance_to_city_center", "urban_rural_classification") == [
        (0.0, "Urban")] * 5
    assert values(made, "infrastructure_count", "safety_equipment_score") == [
        (1, 3), (1, 0), (1, 3), (2, 3), (0, 0)]


def test_bounds_and_nulls_of_classes(spark):
    df = spark.createDataFrame(
        [(10.0, 32.0, 10.0), (9.9, 32.1, 10.1), (5.0, 70.0, 50.0), (4.9, 90.0, 50.1),
         (1.0, 90.1, None), (0.9, None, None), (None, None, None)],
        "v double, t double, d double")
    shown = df.select(X.visibility_class(F.col("v")), X.temperature_class(F.col("t")),
                      X.urban_class(F.col("d")))
    assert [tuple(r) for r in shown.collect()] == [
        ("Good", "Cold", "Urban"), ("Fair", "Mild", "Suburban"), ("Fair", "Mild", "Suburban"),
        ("Poor", "Warm", "Rural"), ("Poor", "Hot", "Rural"), ("Very Poor", "Hot", "Rural"),
        ("Very Poor", "Hot", "Rural")]


def test_rush_hour_is_half_open_and_weekend_starts_on_sunday(spark):
    hours = spark.range(24).select(F.col("id").alias("h"), X.is_rush_hour(F.col("id")).alias("r"))
    assert {r.h for r in hours.collect() if r.r} == {7, 8, 17, 18}
    days = spark.createDataFrame([(dt.date(2024, 1, 7 + i),) for i in range(7)], "d date")
    flags = days.select(X.is_weekend(F.dayofweek("d"))).collect()
    assert [r[0] for r in flags] == [True, False, False, False, False, False, True]


def test_weather_takes_the_first_word_and_null_is_other(spark):
    df = spark.createDataFrame([("Rain / Windy",), ("CLEAR",), ("Mostly Cloudy",), ("Haze",),
                                (None,)], "w string")
    category = X.weather_category(F.col("w"))
    assert [tuple(r) for r in df.select(category, X.weather_score(category)).collect()] == [
        ("Rain", 6), ("Clear", 1), ("Cloudy", 3), ("Other", 4), ("Other", 4)]


def test_null_flags_count_as_absent_and_both_controls_are_multiple(spark):
    df = spark.createDataFrame(
        [(True, True), (True, False), (None, True), (None, None)],
        "Traffic_Signal boolean, Stop boolean")
    made = O.with_equipment_features(df)
    assert values(made, "infrastructure_count", "safety_equipment_score",
                  "traffic_control_type") == [
        (2, 6, "Multiple"), (1, 3, "Signal"), (1, 3, "Stop"), (0, 0, "None")]


def test_haversine_is_null_for_null_and_survives_antipodes(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 180.0), (None, 0.0, 0.0, 0.0)],
                               "a double, b double, c double, d double")
    found = [r[0] for r in df.select(X.haversine_miles(*[F.col(c) for c in "abcd"])).collect()]
    assert abs(found[0] - 3956 * 3.141592653589793) < 1e-6 and found[1] is None


def test_features_are_one_projection_without_python(spark):
    plan = executed(O.derive_features(rename_measures(five_incidents(spark))))
    assert "Python" not in plan and "Exchange" not in plan and "Join" not in plan


def test_codes_are_the_same_inline_and_joined(spark):
    df = spark.range(500).select(
        F.col("id"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("v"), F.col("id") % 60))
        .alias("c"))
    inline = O.encode_categories(df, {"c": "code"}).orderBy("id").collect()
    joined = O.encode_categories(df, {"c": "code"}, inline_limit=5).orderBy("id").collect()
    named = df.withColumnsRenamed({"c": "value"}).withColumn("column", F.lit("x"))
    for limit in (1, 2_000):
        coded = O.encode_categories(named, {"value": "code", "column": "place"}, limit)
        assert [(r.id, r.value, r.code, r.place) for r in coded.orderBy("id").collect()] == [
            (r.id, r.c, r.code, 0) for r in inline]
    expected = {v: i for i, v in enumerate(sorted({r.c for r in inline if r.c is not None}))}
    assert [r.code for r in inline] == [expected.get(r.c, -1) for r in inline]
    assert [(r.id, r.c, r.code) for r in inline] == [(r.id, r.c, r.code) for r in joined]


def test_sql_functions(spark):
    X.register_sql_functions(spark)
    row = spark.sql("SELECT great_circle_km(1D, 1D, 1D, 1D) a, haversine_miles(NULL, 1D, 1D, 1D) b")
    assert row.first()[:] == (0.0, None)
