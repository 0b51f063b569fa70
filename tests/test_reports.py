import datetime as dt

import pytest
from pyspark.sql import functions as F

from catalog.base import featured, tidy
from tests.frames import executed, values
from wayside.model import Roles
from wayside.operators import reports as R, serving as G, silver

SF = "/root/testdata/sf0.001"


def test_shared_scans_give_the_same_reports_as_single_runs(spark):
    source = featured(spark, SF).persist()
    shared = R.all_reports(source)
    assert len(shared) == 24
    for name, frame in shared.items():
        single = R.run_report(source, name) if name in R.BY_NAME else getattr(R, name)(source)
        a = sorted(map(str, tidy(single.select(*sorted(single.columns))).collect()))
        b = sorted(map(str, tidy(frame.select(*sorted(frame.columns))).collect()))
        assert a == b, name
        assert dict(single.dtypes) == dict(frame.dtypes), name
    source.unpersist()


def test_shared_reports_read_small_bases_only(spark):
    shared = R.all_reports(featured(spark, SF))
    plan = executed(shared["hourly_patterns"])
    assert "report-region" in plan and "events.parquet" not in plan


def test_reports_are_guarded_one_by_one(spark):
    df = spark.createDataFrame([("CA", 2)], "State string, Severity int")
    assert R.applicable(df) == []
    made = R.all_reports(df.withColumn("City", F.lit("x")))
    assert set(made) == {"severity_percentiles_by_state", "high_severity_locations"}


def test_other_column_names(spark):
    roles = Roles(severity="value", state="kind", hour="h", rush_hour="rush")
    df = spark.createDataFrame([(1, "a", 9, True), (2, "b", 9, False)],
                               "value int, kind string, h int, rush boolean")
    assert values(R.run_report(df, "hourly_patterns", roles), "h", "accident_count",
                  "avg_severity", "states_affected", "rush_hour_accidents") == [(9, 2, 1.5, 2, 1)]


def test_thresholds_and_null_keys(spark):
    df = spark.range(200).select(
        F.when(F.col("id") < 100, "CA").when(F.col("id") < 199, "TX").alias("State"),
        F.lit("c").alias("City"), F.lit(3).alias("Severity"),
        F.lit(1).alias("infrastructure_count"))
    assert values(R.run_report(df, "city_hotspots"), "State", "accident_count") == [("CA", 100)]
    assert values(R.run_report(df, "high_severity_locations"), "State") == [("CA",), ("TX",)]
    percentiles = R.severity_percentiles_by_state(df)
    assert values(percentiles, "State", "severity_p50") == [("CA", 3)]


def test_percentiles_of_a_continuous_measure_use_the_sketch(spark):
    df = spark.range(1000).select(F.lit("CA").alias("State"),
                                  (F.col("id") * 1.0).alias("Severity"))
    row = R.severity_percentiles_by_state(df).first()
    assert abs(row.severity_p50 - 499) <= 1 and row.accident_count == 1000


def test_equipment_is_aggregated_before_it_is_unpivoted(spark):
    plan = executed(R.individual_equipment_analysis(featured(spark, SF)))
    assert plan.index("Generate") < plan.index("FileScan")  # printed top down
    assert plan.count("FileScan") == 1
    below_generate = plan[plan.index("Generate"):]
    assert "HashAggregate" in below_generate


def test_silver_frames_are_empty_without_inputs(spark):
    df = spark.createDataFrame([(1,)], "x int")
    assert silver.weather_aggregated(df).count() == 0
    assert silver.infrastructure_features(df).count() == 0


def test_silver_detail_has_each_column_once(spark):
    made = silver.silver_detail(featured(spark, SF))
    assert len(made.columns) == len(set(made.columns)) == 31


def test_listing_checks_and_retention_is_complete(spark):
    df = spark.createDataFrame(
        [(dt.date(2020, 1, 1), True), (dt.date(2020, 1, 1), None), (None, True),
         (dt.date(2024, 1, 1), True)], "d date, ok boolean")
    kept, old = G.retention_split(df, "d", dt.date(2022, 1, 1), F.col("ok"))
    assert (kept.count(), old.count()) == (3, 1)
    with pytest.raises(ValueError):
        G.incident_listing(featured(spark, SF), from_date=dt.date(2024, 2, 1),
                           to_date=dt.date(2024, 1, 1))
    with pytest.raises(ValueError):
        G.hotspot_map(df, 1, 2, 3, 4)


def test_risk_score_bounds(spark):
    df = spark.createDataFrame([(9.0, 10**9), (1.0, 0), (None, 5)], "s double, n long")
    scores = [r[0] for r in df.select(G.risk_score(F.col("s"), F.col("n"))).collect()]
    assert scores == [1.0, 0.0, 0.1667]


def test_kpi_windows():
    day = dt.date(2024, 6, 1)
    assert [(day - G.kpi_window(p, day)[0]).days for p in
            ("daily", "weekly", "monthly", "yearly")] == [30, 84, 365, 1095]


def test_severity_model(spark):
    from wayside.operators.severity_model import train_severity_model

    source = featured(spark, SF)
    model = train_severity_model(source, trees=3, depth=3)
    scored = model.score(source)
    assert scored.count() == source.count()
    bounds = scored.agg(F.min("predicted_severity"), F.max("predicted_severity"),
                        F.min("confidence_score"), F.max("confidence_score")).first()
    assert 1 <= bounds[0] <= bounds[1] <= 4 and 0 < bounds[2] <= bounds[3] <= 1
    assert abs(sum(model.importance().values()) - 1) < 1e-6


def _kpi_rows(spark):
    rows = [  # two places of one state, one without a county, one without a state
        ("a", 2, "2024-01-01 07:30", 40.0, -80.0, "CA", "K", "X", 6, 0, True),
        ("b", 4, "2024-01-01 12:00", 40.0, -80.0, "CA", "K", "Y", 1, 1, False),
        ("c", 3, "2024-01-03 12:00", None, None, "CA", None, "X", 1, 0, False),
        ("d", 1, "2024-01-03 12:00", 10.0, 10.0, None, "K", None, 1, 0, False),
        ("e", 1, None, 10.0, 10.0, "CA", "K", "X", 1, 0, False),
    ]
    return spark.createDataFrame(
        rows, "ID string, Severity int, t string, Start_Lat double, Start_Lng double, State string,"
        " County string, City string, weather_severity_score int, infrastructure_count int,"
        " is_rush_hour boolean").withColumn("Start_Time", F.col("t").cast("timestamp_ntz"))


def test_kpi_scopes(spark):
    at = dt.datetime(2024, 2, 1, 6)
    kpis = G.kpi_long_table(_kpi_rows(spark), hotspot_min=2, calculated_at=at)
    daily = {(r.metric_name, str(r.period_start), r.scope_level, r.geographic_scope): r.metric_value
             for r in kpis.where("time_period = 'daily'").collect()}
    scopes = {(k[2], k[3]) for k in daily}
    assert scopes == {
        ("state", "CA"), ("state", "?"), ("county", "CA/K"), ("county", "CA/?"), ("county", "?/K"),
        ("city", "CA/K/X"), ("city", "CA/K/Y"), ("city", "CA/?/X"), ("city", "?/K/?")}
    first = "2024-01-01"
    assert daily["severite_moyenne", first, "state", "CA"] == 3
    assert daily["severite_moyenne", first, "city", "CA/K/X"] == 2
    assert daily["hotspots_count", first, "county", "CA/K"] == 1
    assert daily["hotspots_count", first, "city", "CA/K/X"] == 0  # the cell is split there
    assert daily["temporal_patterns", first, "county", "CA/K"] == 0.5
    assert {r.calculated_at for r in kpis.collect()} == {at}
    # the hierarchy is expanded after the rows were summed per place
    plan = G._by_scope(spark.createDataFrame([], "day date, state string, county string, n long"),
                       ["day"], ["state", "county"], ("n",))._jdf.queryExecution().toString()
    assert plan.count("Expand ") >= 1
    without = G.kpi_long_table(_kpi_rows(spark).drop("County", "City"))
    assert {r.scope_level for r in without.select("scope_level").distinct().collect()} == {"state"}


def test_kpi_recalculation_and_gaps(spark):
    one = G.kpi_long_table(_kpi_rows(spark), calculated_at=dt.datetime(2024, 2, 1))
    again = G.kpi_long_table(_kpi_rows(spark).where("ID <> 'a'"),
                             calculated_at=dt.datetime(2024, 2, 2))
    both = one.unionByName(again)
    found = G.kpi_lookup(both, "severite_moyenne", "daily", "CA", size=3).collect()
    assert [(r.calculated_at.day, str(r.period_start), r.metric_value) for r in found] == [
        (2, "2024-01-03", 3.0), (2, "2024-01-01", 4.0), (1, "2024-01-03", 3.0)]
    now = {r.period_start.day: r.metric_value for r in G.kpi_current(both).where(
        "metric_name = 'severite_moyenne' and time_period = 'daily' and geographic_scope = 'CA'"
    ).collect()}
    assert now == {1: 4.0, 3: 3.0}
    board = G.kpi_dashboard(both).where("metric_name = 'severite_moyenne'").collect()
    assert {r.geographic_scope: (r.current_value, r.max_value) for r in board}["CA"] == (3.0, 4.0)
    # 2 January is missing, so 3 January has no previous day; weeks and months follow each other
    series = spark.createDataFrame(
        [("m", p, "CA", dt.date.fromisoformat(d), v) for p, d, v in (
            ("daily", "2024-01-01", 2.0), ("daily", "2024-01-03", 3.0), ("daily", "2024-01-04", 6.0),
            ("weekly", "2024-01-01", 1.0), ("weekly", "2024-01-08", 2.0), ("weekly", "2024-01-22", 2.0),
            ("monthly", "2024-01-01", 0.0), ("monthly", "2024-02-01", 5.0),
            ("yearly", "2023-01-01", 5.0), ("yearly", "2024-01-01", 4.0))],
        "metric_name string, time_period string, geographic_scope string, period_start date,"
        " metric_value double")
    got = {(r.time_period, str(r.period_start)): (r.previous_value, r.change_percentage)
           for r in G.kpi_vs_previous(series).collect()}
    assert got == {
        ("daily", "2024-01-01"): (None, None), ("daily", "2024-01-03"): (None, None),
        ("daily", "2024-01-04"): (3.0, 100.0), ("weekly", "2024-01-01"): (None, None),
        ("weekly", "2024-01-08"): (1.0, 100.0), ("weekly", "2024-01-22"): (None, None),
        ("monthly", "2024-01-01"): (None, None), ("monthly", "2024-02-01"): (0.0, None),
        ("yearly", "2023-01-01"): (None, None), ("yearly", "2024-01-01"): (5.0, -20.0)}
