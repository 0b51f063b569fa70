import pytest
from pyspark.sql import functions as F

from tests.frames import executed, five_incidents, values
from wayside.operators import cleaning as C
from wayside.plans import flows, steps


def test_nulls_are_dropped_by_range_filter_but_kept_by_corrupt_row_filter(spark):
    df = spark.createDataFrame(
        [("TX", 30.0, -95.0, None), ("TX", 30.0, -95.0, 3), ("TX", 30.0, -95.0, 9),
         ("XX", 30.0, -95.0, 1), (None, 30.0, -95.0, 1), ("TX", None, -95.0, 1)],
        "State string, Start_Lat double, Start_Lng double, Severity int")
    assert values(C.range_filter(df, {"Severity": (1, 4)}), "Severity").count((None,)) == 0
    kept = values(C.corrupt_row_filter(df), "State", "Severity")
    assert sorted(kept, key=str) == [("TX", 3), ("TX", None)]


def test_clamp_keeps_null_unless_told(spark):
    df = spark.createDataFrame([(None,), (-5.0,), (50.0,), (500.0,)], "x double")
    assert values(C.range_clamp(df, {"x": (0.0, 100.0)}), "x") == [(None,), (0.0,), (50.0,),
                                                                   (100.0,)]
    literal = C.range_clamp(df, {"x": (0.0, 100.0)}, null_to_max=True)
    assert values(literal, "x")[0] == (100.0,)


def test_null_limit_is_strict_and_columns_are_treated_in_order(spark):
    # 10 rows; b has exactly 30 % nulls: its rows go.  c then is measured on 7 rows.
    rows = [(f"k{i}", None if i < 3 else float(i), None if i in (0, 1, 3, 4) else "x", None)
            for i in range(10)]
    df = spark.createDataFrame(rows, "ID string, b double, c string, Stop boolean")
    decisions = []
    done = C.adaptive_null_handling(df, decisions=decisions)
    assert done.count() == 7
    by_name = {d.column: d for d in decisions}
    assert by_name["b"].action == "drop" and by_name["b"].null_percentage == 30.0
    # 2 of 7 is below 30 %, although 4 of 10 would not have been
    assert by_name["c"].action == "fill" and by_name["c"].null_count == 2
    assert set(values(done, "c")) == {("x",), ("Unknown",)}
    assert set(values(done, "Stop")) == {(False,)}


def test_critical_nulls_drop_and_median_fills(spark):
    df = spark.createDataFrame(
        [("a", None), (None, 100.0), ("c", 1.0), ("d", 2.0), ("e", 3.0)], "ID string, x double")
    done = C.adaptive_null_handling(df)
    # the row without ID is gone before the median of x is taken
    assert sorted(values(done, "ID", "x")) == [("a", 2.0), ("c", 1.0), ("d", 2.0), ("e", 3.0)]


def test_empty_input_passes_through(spark):
    empty = five_incidents(spark).limit(0)
    assert C.adaptive_null_handling(empty).count() == 0
    assert C.zscore_filter_independent(C.rename_measures(empty)).count() == 0
    assert flows.clean_incidents(empty).count() == 0


def test_zscore_keeps_constant_columns_and_can_keep_nulls(spark):
    df = spark.createDataFrame([(1.0, 5.0)] * 20 + [(None, 5.0), (1000.0, 5.0)],
                               "a double, b double")
    assert C.zscore_filter_independent(df, ["a", "b"]).count() == 20
    assert C.zscore_filter_independent(df, ["a", "b"], keep_nulls=True).count() == 21
    assert C.zscore_filter_sequential(df, ["b"]).count() == 22


def test_sequential_statistics_follow_the_filter(spark):
    # once the outlier in a is gone, its b no longer stretches the deviation of b
    rows = [(float(i % 5), float(i % 3)) for i in range(60)] + [(1000.0, 500.0), (2.0, 40.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    assert C.zscore_filter_sequential(df, ["a", "b"]).count() == 60
    assert C.zscore_filter_independent(df, ["a", "b"]).count() == 61


def test_dedup_keeps_one_row_per_key_and_shrinks_on_the_map_side(spark):
    df = spark.createDataFrame([("a", 2, None), ("a", 1, "z"), ("b", 5, "y"), ("a", 1, "b")],
                               "ID string, n int, t string")
    assert sorted(values(C.dedup_by_key(df), "ID", "n", "t")) == [("a", 1, "b"), ("b", 5, "y")]
    newest = C.dedup_by_key(df, order=[-F.col("n")])
    assert ("a", 2, None) in values(newest, "ID", "n", "t")
    plan = executed(C.dedup_by_key(df))
    assert "partial_min" in plan and "Window" not in plan


def test_impossible_values(spark):
    df = spark.createDataFrame([(-51.0, 201.0, -2.0, 24.9), (150.0, 200.0, 2.0, 35.0)],
                               "temperature_fahrenheit double, wind_speed_mph double,"
                               " distance_miles double, pressure_inches double")
    assert [tuple(r) for r in C.null_out_impossible(df).collect()] == [
        (None, None, 2.0, None), (150.0, 200.0, 2.0, 35.0)]


def test_cleaning_score_bands():
    assert C.cleaning_score(0, 0, 9) == 0.0
    assert C.cleaning_score(100, 100, 9) == 100.0
    assert C.cleaning_score(100, 90, 2) == 94.0
    assert C.cleaning_score(100, 70, 0) == 50.0
    assert C.cleaning_score(100, 10, 0) == 0.0


def test_steps_unknown_missing_failing_and_critical(spark):
    df = five_incidents(spark)
    with pytest.raises(ValueError, match="unknown"):
        steps.apply_steps(df, [{"type": "no such thing"}])
    bad = {"type": "breaks"}
    steps.register_transformation("breaks", lambda d, c: d.select("no_such_column"))
    records = []
    assert steps.apply_steps(df, [bad, {}], records).columns == df.columns
    assert [r.status for r in records] == ["failed", "skipped"]
    with pytest.raises(ValueError, match="critical"):
        steps.apply_steps(df, [bad | {"critical": True}])
    with pytest.raises(TypeError):
        steps.register_transformation("not callable", "text")


def test_numeric_constants_are_pushed_into_the_scan(spark, tmp_path):
    path = str(tmp_path / "n")
    spark.range(100).select(F.col("id").cast("double").alias("x")).write.parquet(path)
    plan = executed(C.range_filter(spark.read.parquet(path), {"x": (10.0, 20.0)}))
    assert "GreaterThanOrEqual(x,10.0)" in plan and "LessThanOrEqual(x,20.0)" in plan


def test_nulls_of_any_number_are_filled_with_the_exact_median(spark):
    df = spark.range(1, 1001).selectExpr(
        "id as k", "case when id % 5 > 0 then id * 3 end as big",
        "cast(case when id % 5 > 0 then id end as decimal(9, 2)) as dec",
        "cast(case when id % 4 > 0 then id end as float) as flt")
    found = C.adaptive_null_handling(df, critical=("k",), flags=())
    assert found.dtypes == df.dtypes and found.count() == 1000
    filled = found.filter("k = 20").first()
    assert (filled.big, float(filled.dec), filled.flt) == (1497, 499.0, 499.0)


def test_only_repeated_keys_are_aggregated(spark):
    df = spark.createDataFrame(
        [("a", 2, "x"), ("a", 1, "y"), (None, 5, "n"), (None, 4, "m"), ("b", 3, "z")],
        "ID string, v int, w string")
    kept = C.dedup_by_key(df)
    assert sorted(map(str, (tuple(r) for r in kept.collect()))) == sorted(map(str, [
        ("a", 1, "y"), (None, 4, "m"), ("b", 3, "z")]))
    unique = C.dedup_by_key(spark.range(1000).selectExpr("cast(id as string) as ID", "id as v"))
    plan = executed(unique)
    # rows with a key of their own meet a broadcast table: no sort, no shuffle of theirs
    assert "LeftAnti" in plan and "SortMergeJoin" not in plan and unique.count() == 1000
