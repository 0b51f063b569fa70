import random

import pytest
from pyspark.sql import functions as F

from tests.frames import executed, five_incidents, values
from wayside.model import DELIVERED_COLUMNS, INCIDENT_SCHEMA, QualityThresholds
from wayside.operators import quality as Q, schema_checks as S
from wayside.operators.quantiles import exact_quantiles


def test_null_profile_is_one_scan_and_rounds_to_two_digits(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "x")], "a int, b string")
    profile = Q.null_profile(df)
    assert sorted(values(profile, "column", "null_count", "null_percentage", "high_null")) == [
        ("a", 0, 0.0, False), ("b", 2, 66.67, True)]
    assert executed(profile).count("Exchange") == 1


def test_row_issues_lists_every_issue_and_ignores_null_measures(spark):
    df = spark.createDataFrame(
        [("CA", 34.0, -118.0, 2, 10.0), ("ZZ", 95.0, -118.0, 7, None), (None, None, 1.0, 1, 0.0)],
        "State string, Start_Lat double, Start_Lng double, Severity int,"
        " visibility_miles double")
    found = values(Q.row_issues(df), "issues", "is_valid")
    assert found[0] == ([], True)
    assert found[1] == (["start outside the area", "unknown state ZZ",
                         "Severity beyond its limits: 7"], False)
    assert found[2] == (["start outside the area", "unknown state null"], False)
    good, held = Q.quality_gate(df)
    assert (good.count(), held.count()) == (1, 2)


def test_duplicates_count_null_keys_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), (None, 1), (None, 1)],
                               "ID string, x int")
    row = Q.duplicate_analysis(df).first()
    assert (row.total_rows, row.distinct_rows, row.duplicate_rows, row.id_duplicates) == (
        5, 3, 2, 3)
    assert not row.is_acceptable
    empty = Q.duplicate_analysis(df.limit(0)).first()
    assert (empty.total_rows, empty.duplicate_percentage, empty.is_acceptable) == (0, 0.0, True)


def test_instants_and_maps_are_told_apart(spark, setting):
    setting("spark.sql.session.timeZone", "America/New_York")
    # 01:30 comes twice when the clocks go back
    two = spark.range(2).select(
        F.timestamp_seconds(F.col("id") * 3600 + 1_762_061_400).alias("at"),
        F.array(F.timestamp_seconds(F.col("id") * 3600 + 1_762_061_400)).alias("list"))
    assert two.select(F.date_format("at", "HH:mm")).distinct().count() == 1
    for c in ("at", "list"):
        assert Q.duplicate_analysis(two.select(c)).first().distinct_rows == 2
    maps = spark.sql("select map('a', 1, 'b', 2) as m union all select map('b', 2, 'a', 1)"
                     " union all select map('a', 1, 'b', 3) union all select null")
    assert Q.duplicate_analysis(maps).first().distinct_rows == 3


def test_outliers_and_profile_of_other_numbers(spark):
    df = spark.range(100).selectExpr(
        "cast(case when id = 99 then 9000 else id end as decimal(12, 2)) as d",
        "case when id = 99 then 9000 else id end as n", "cast(id as float) as f")
    found = {r.column: r for r in Q.iqr_outliers(df, ["d", "n"]).collect()}
    assert found["d"].outlier_count == found["n"].outlier_count == 1
    assert found["d"].q1 == found["n"].q1
    profile = {r.column: r for r in Q.column_profile(df).collect()}
    assert [(profile[c].min_value, profile[c].max_value) for c in "dnf"] == [
        (0.0, 9000.0), (0.0, 9000.0), (0.0, 99.0)]


def test_score_uses_only_the_parts_that_exist(spark):
    df = spark.createDataFrame([("a", None), ("b", None)], "ID string, note string")
    # nulls 100 - 50, numeric 100, duplicates 100
    score = Q.quality_score(Q.quality_figures(df)).first()[0]
    assert score == 83.33
    with pytest.raises(ValueError):
        Q.require_quality(df, QualityThresholds(min_quality_score=90))
    issues = values(Q.quality_issues(Q.quality_figures(df)), "type", "severity")
    assert issues == [("validation_error", "high")]


@pytest.mark.parametrize("small", [20, 1000, 100_000])
def test_exact_quantiles_against_sorting(spark, small):
    rng = random.Random(small)
    data = [(rng.gauss(0, 1), rng.choice([1.0, 2.0, 7.0]), None) for _ in range(5000)]
    data += [(None, None, None)] * 100
    df = spark.createDataFrame(data, "a double, b double, c double").repartition(7)
    wanted = {"a": (0.001, 0.25, 0.5, 0.999), "b": (0.1, 0.5, 0.9), "c": (0.5,)}
    found = exact_quantiles(df, wanted, small=small)
    for i, c in enumerate("ab"):
        ordered = sorted(r[i] for r in data if r[i] is not None)
        ranks = [max(1, -(-round(p * 1000) * len(ordered) // 1000)) for p in wanted[c]]
        assert found[c] == [ordered[k - 1] for k in ranks]
    assert found["c"] == [None]


def test_schema_diff_and_conformity(spark):
    df = five_incidents(spark).withColumn("extra", F.lit(1)).withColumn(
        "Severity", F.col("Severity").cast("bigint"))
    status = {(r.column, r.status) for r in S.schema_diff(df).collect()}
    assert {("extra", "extra"), ("Severity", "type_mismatch"), ("ID", "nullable_mismatch"),
            ("End_Time", "missing")} <= status
    assert not S.schema_is_valid(df)
    assert S.schema_conformity(df) == 0.0
    kinds = {r.column: r.status for r in S.schema_type_analysis(df).collect()}
    assert kinds["Severity"] == "convertible" and kinds["Start_Time"] == "issue"
    with pytest.raises(ValueError):
        S.schema_report(df, strict=True)


def test_complete_delivery_is_valid(spark):
    empty = spark.createDataFrame([], INCIDENT_SCHEMA).withColumn("Source", F.lit("s"))
    report = S.schema_report(empty, optional=("Source", "Number", "Side")).first()
    assert report.is_valid and report.conformity_score == 100.0
    assert report.severity_level == "LOW" and report.total_rows == 0
    assert S.column_names_check(empty.drop("Number", "Side"))
    assert len(DELIVERED_COLUMNS) == 46 and len(INCIDENT_SCHEMA) == 47


def test_severity_levels():
    assert [S.schema_severity(s, False) for s in (95, 80, 60, 10)] == [
        "LOW", "MEDIUM", "HIGH", "CRITICAL"]
    assert S.schema_severity(100, True) == "CRITICAL"


def test_digest_tells_rows_apart_as_distinct_does(spark):
    parts = [None, "", "n", "1:", "a", "1:a", "a1:a", "é"]
    rows = [(a, b, x, [a] if x else None) for a in parts for b in parts
            for x in (None, 0.0, -0.0, float("nan"), 1.5)] * 2
    df = spark.createDataFrame(rows, "a string, b string, x double, l array<string>")
    row = Q.duplicate_analysis(df, key=None).first()
    assert row.total_rows == len(rows) and row.distinct_rows == df.distinct().count()
    keyed = Q.duplicate_analysis(df, key="a").first()
    assert keyed.distinct_rows == row.distinct_rows
    assert keyed.id_duplicates == len(rows) - len(parts)


def test_duplicates_shuffle_digests_only(spark):
    df = spark.createDataFrame([("a", "some long text")], "ID string, note string")
    shuffled = [line for line in executed(Q.duplicate_analysis(df)).splitlines()
                if "Exchange" in line]
    assert shuffled and all("note" not in line for line in shuffled)
