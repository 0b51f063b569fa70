"""Gold tables, KPI queries, listings, retention, and the severity model."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from catalog.base import FLAGS, featured, incidents, query, r, table, tidy, with_features, \
    with_incidents
from wayside.operators import joins as J, serving as G, severity_model as M
from wayside.sinks.retention import archived_rows, move_old_rows
from wayside.sources.scratch import scratch_path

CELL = 5.0


def _hotspots(spark, sf):
    return G.geo_hotspots(featured(spark, sf), CELL)


def _risk(severity: str, count: str) -> str:
    return (f"round(0.5e0 * greatest(0.0e0, least(1.0e0, coalesce(({severity} - 1) / 3, 0.0e0)))"
            f" + 0.5e0 * {count} / ({count} + 10.0e0), 4)")


_BY_NAME = sorted(FLAGS)
_DOMINANT = "case " + " ".join(
    f"when n_{f} > 0 and n_{f} >= greatest({', '.join(f'n_{g}' for g in _BY_NAME)}) then '{f}'"
    for f in _BY_NAME
) + " end"
HOTSPOTS = f"""cells as (select
 round((floor(Start_Lat / 5.0e0) + 0.5e0) * 5.0e0, 6) as latitude,
 round((floor(Start_Lng / 5.0e0) + 0.5e0) * 5.0e0, 6) as longitude, State, County, City,
 count(*) as accident_count, avg(Severity) as severity_avg,
 {', '.join(f'count(*) filter (where {f}) as n_{f}' for f in _BY_NAME)}
 from incidents where Start_Lat is not null and Start_Lng is not null group by all),
hotspots as (select latitude, longitude, State, County, City, accident_count, severity_avg,
 {_DOMINANT} as infrastructure_type, {_risk('severity_avg', 'accident_count')} as risk_score,
 1000 as radius_meters from cells)"""

_SPOT_COLUMNS = ("latitude, longitude, State, County, City, accident_count,"
                 f" {r('severity_avg')} as severity_avg, infrastructure_type, risk_score,"
                 " radius_meters")
_SPOT_ORDER = ("order by risk_score desc, accident_count desc, State asc nulls last,"
               " County asc nulls last, City asc nulls last, latitude asc nulls last,"
               " longitude asc nulls last")


@query("geo_hotspots", with_incidents(f"select {_SPOT_COLUMNS} from hotspots", HOTSPOTS))
def _geo(spark, sf):
    return tidy(_hotspots(spark, sf))


@query("hotspot_listing", with_incidents(f"""
select {_SPOT_COLUMNS} from (select * from hotspots where risk_score >= 0.45
 and accident_count >= 5 and infrastructure_type = 'Traffic_Signal' {_SPOT_ORDER}
 limit 40 offset 40)""", HOTSPOTS))
def _listing(spark, sf):
    return tidy(G.hotspot_listing(_hotspots(spark, sf), min_risk=0.45, min_accidents=5,
                                  infrastructure="Traffic_Signal", page=2, size=40))


@query("hotspots_by_state_topk", with_incidents(f"""
select {_SPOT_COLUMNS} from (select * from hotspots where State = 'TX' {_SPOT_ORDER} limit 10)""",
    HOTSPOTS))
def _top(spark, sf):
    return tidy(G.hotspots_by_state_topk(_hotspots(spark, sf), "TX"))


@query("hotspot_map", with_incidents(f"""
select cast(floor(latitude * 32.0e0 / 360) as bigint) as cell_lat,
 cast(floor(longitude * 32.0e0 / 360) as bigint) as cell_lng, count(*) as hotspots,
 cast(sum(accident_count) as bigint) as accident_count, {r('avg(risk_score)')} as avg_risk,
 max(risk_score) as max_risk, case when max(risk_score) < 0.5 then 'yellow'
  when max(risk_score) < 0.7 then 'orange' when max(risk_score) < 0.85 then 'red'
  else 'darkred' end as colour
from hotspots where latitude between 30 and 44 and longitude between -115 and -80
group by 1, 2""", HOTSPOTS))
def _map(spark, sf):
    return tidy(G.hotspot_map(_hotspots(spark, sf), 44, 30, -80, -115, zoom=5))


@query("radius_search_hotspots", with_incidents(f"""
select State, County, City, latitude, longitude, {r('km')} as distance_km, risk_score from (
 select *, 6371 * acos(least(1.0e0, cos(radians(39.9526e0)) * cos(radians(latitude))
  * cos(radians(longitude) - radians(-75.1652e0))
  + sin(radians(39.9526e0)) * sin(radians(latitude)))) as km from hotspots
 where latitude between -90 and 90)
where km < 600""", HOTSPOTS))
def _near(spark, sf):
    near = J.radius_search(_hotspots(spark, sf), 39.9526, -75.1652, 600,
                           order=[F.col("risk_score").desc()])
    return tidy(near.select("State", "County", "City", "latitude", "longitude", "distance_km",
                            "risk_score"))


# ------------------------------------------------------------ time patterns

PATTERNS = f"""patterns as (select accident_hour as hour_of_day, accident_day_of_week as day_of_week,
 accident_month as month, accident_season as season, Weather_Condition as weather_condition,
 count(*) as accident_count, avg(Severity) as severity_avg,
 avg(temperature_fahrenheit) as temperature_avg, avg(visibility_miles) as visibility_avg,
 avg(humidity_percent) as humidity_avg, avg(wind_speed_mph) as wind_speed_avg
 from featured group by all)"""


@query("temporal_patterns", with_features(
    "select hour_of_day, day_of_week, month, season, weather_condition, accident_count, "
    + ", ".join(f"{r(c)} as {c}" for c in ("severity_avg", "temperature_avg", "visibility_avg",
                                           "humidity_avg", "wind_speed_avg")) + " from patterns",
    PATTERNS))
def _patterns(spark, sf):
    return tidy(G.temporal_patterns(featured(spark, sf)))


@query("peak_accident_times", with_features(f"""
select hour_of_day, day_of_week, {r('avg(accident_count)')} as avg_accidents,
 {r('avg(severity_avg)')} as avg_severity, count(*) as data_points from patterns
group by hour_of_day, day_of_week
having avg(accident_count) > 1.2 * (select avg(accident_count) from patterns)""", PATTERNS))
def _peaks(spark, sf):
    # the derived events are spread evenly, so a lower factor than the default 1.5
    return tidy(G.peak_accident_times(G.temporal_patterns(featured(spark, sf)), factor=1.2))


@query("temporal_hotspots", with_features(f"""
select accident_hour as hour_of_day, accident_day_of_week as day_of_week, State, County,
 count(*) as accident_count, {r('avg(Severity)')} as severity_avg,
 {_risk('avg(Severity)', 'count(*)')} as risk_score from featured group by all"""))
def _time_spots(spark, sf):
    return tidy(G.temporal_hotspots(featured(spark, sf)))


# ---------------------------------------------------- equipment and weather

def _infrastructure_sql(by: str) -> str:
    long = " union all ".join(
        f"select '{f}' as infrastructure_type, {by}, City, accident_hour, Severity,"
        f" weather_severity_score from featured where {f}" for f in FLAGS
    )
    match = " and ".join(f"g.{c} is not distinct from p.{c}" for c in by.split(", "))
    return f"""equipped as ({long}),
places as (select {by}, avg(Severity) as place_mean from featured group by all),
hours as (select infrastructure_type, {by}, accident_hour, count(*) as n from equipped group by all),
peaks as (select infrastructure_type, {by}, accident_hour as peak_hour from (select *,
 row_number() over (partition by infrastructure_type, {by} order by n desc, accident_hour) as rn
 from hours) where rn = 1),
grouped as (select infrastructure_type, {by}, count(*) as total_accidents,
 count(*) * 1.0e0 / count(distinct City) as per_place, avg(Severity) as avg_severity,
 corr(weather_severity_score, Severity) as weather_correlation from equipped group by all),
infrastructure as (select g.infrastructure_type, {', '.join('g.' + c for c in by.split(', '))},
 total_accidents, per_place as accidents_per_infrastructure,
 avg_severity / nullif(place_mean, 0) as severity_impact_factor, avg_severity, peak_hour,
 case when isnan(weather_correlation) then null else weather_correlation end
  as weather_correlation
 from grouped g join places p on {match} join peaks k on g.infrastructure_type =
  k.infrastructure_type and {match.replace('p.', 'k.')})"""


@query("infrastructure_analysis", with_features(
    "select infrastructure_type, State, County, total_accidents, peak_hour, "
    + ", ".join(f"{r(c)} as {c}" for c in ("accidents_per_infrastructure",
                                           "severity_impact_factor", "avg_severity",
                                           "weather_correlation")) + " from infrastructure",
    _infrastructure_sql("State, County")))
def _infrastructure(spark, sf):
    return tidy(G.infrastructure_analysis(featured(spark, sf)))


WEATHER = """by_weather as (select Weather_Condition as weather_condition,
 min(temperature_fahrenheit) as temperature_range_min,
 max(temperature_fahrenheit) as temperature_range_max,
 min(visibility_miles) as visibility_range_min, max(visibility_miles) as visibility_range_max,
 min(humidity_percent) as humidity_range_min, max(humidity_percent) as humidity_range_max,
 count(*) as accident_count, avg(Severity) / (select avg(Severity) from incidents)
  as severity_multiplier, cast(min(Start_Time) as date) as analysis_period_start,
 cast(max(Start_Time) as date) as analysis_period_end from incidents group by all),
by_state as (select Weather_Condition as weather_condition, concat('{', string_agg(
 concat('"', State, '":', n), ',' order by State), '}') as state_breakdown from (
 select Weather_Condition, State, count(*) as n from incidents where State is not null
 group by all) group by all)"""


@query("weather_impact", with_incidents(f"""
select w.* replace ({r('severity_multiplier')} as severity_multiplier), state_breakdown
from by_weather w join by_state s on w.weather_condition is not distinct from s.weather_condition""",
    WEATHER))
def _weather(spark, sf):
    return tidy(G.weather_impact(incidents(spark, sf)))


@query("critical_hotspots", with_features(f"""
select latitude, longitude, h.State, County, City, accident_count,
 {r('severity_avg')} as severity_avg, h.infrastructure_type, risk_score, radius_meters,
 {r('severity_impact_factor')} as severity_impact_factor,
 (select {r('severity_multiplier')} from by_weather where weather_condition = 'Light Rain')
  as severity_multiplier
from hotspots h left join infrastructure i on h.infrastructure_type = i.infrastructure_type
 and h.State = i.State where risk_score > 0.6""",
    HOTSPOTS, WEATHER, _infrastructure_sql("State")))
def _critical(spark, sf):
    source = featured(spark, sf)
    return tidy(G.critical_hotspots(
        G.geo_hotspots(source, CELL), G.infrastructure_analysis(source, ["State"]),
        G.weather_impact(source), condition="Light Rain", min_risk=0.6))


# --------------------------------------------------------------------- KPIs

def _kpi_sql() -> str:
    units = {"daily": ("day", "1 day"), "weekly": ("week", "7 days"),
             "monthly": ("month", "1 month"), "yearly": ("year", "12 months")}
    state, county, city = (f"coalesce({c}, '?')" for c in ("State", "County", "City"))
    scoped = f"""select f.*, scope_level, case scope_level when 'state' then {state}
 when 'county' then {state} || '/' || {county} else {state} || '/' || {county} || '/' || {city} end
 as geographic_scope from featured f, (values ('state'), ('county'), ('city')) l(scope_level)"""
    tagged = " union all ".join(
        f"select *, '{p}' as time_period, cast(date_trunc('{u}', Start_Time) as date) as"
        f" period_start, date_diff('hour', date_trunc('{u}', Start_Time)::timestamp,"
        f" date_trunc('{u}', Start_Time)::timestamp + interval '{length}') as hours from scoped"
        for p, (u, length) in units.items()
    )
    keys = "time_period, period_start, scope_level, geographic_scope"
    values = {
        "accidents_par_heure": "count(*) * 1.0e0 / any_value(hours)",
        "severite_moyenne": "avg(Severity)",
        "weather_impact": "avg(Severity) filter (where weather_severity_score >= 5)"
                          " / nullif(avg(Severity), 0)",
        "infrastructure_risk": "avg(Severity) filter (where infrastructure_count > 0) / 4",
        "temporal_patterns": "count(*) filter (where is_rush_hour) * 1.0e0 / count(*)",
    }
    sums = ", ".join(f"{v} as {m}" for m, v in values.items())
    parts = [f"select '{m}' as metric_name, {m} as metric_value, {keys} from summed" for m in values]
    parts.append(
        f"""select 'hotspots_count', cast(count(*) filter (where n >= 5) as double), {keys}
 from (select {keys}, floor(Start_Lat / 2.0e0) as row, floor(Start_Lng / 2.0e0) as col,
  count(*) as n from tagged where Start_Lat is not null and Start_Lng is not null group by all)
 group by all""")
    return f"""scoped as materialized ({scoped}), tagged as materialized ({tagged}),
 summed as materialized (select {keys}, {sums} from tagged group by all),
 kpis as materialized (select *, timestamp '{CALCULATED}' as calculated_at
 from ({' union all '.join(parts)}) where metric_value is not null)"""


CALCULATED = dt.datetime(2024, 2, 1, 6)
KPIS = _kpi_sql()
_KPI_COLUMNS = ("metric_name, round(metric_value, 6) as metric_value, time_period, period_start,"
                " scope_level, geographic_scope, calculated_at")


def _kpis(spark, sf):
    found = G.kpi_long_table(featured(spark, sf), cell_degrees=2.0, calculated_at=CALCULATED)
    return found.withColumn("calculated_at", F.col("calculated_at").cast("timestamp_ntz"))


@query("kpi_long_table", with_features(f"select {_KPI_COLUMNS} from kpis", KPIS))
def _kpi(spark, sf):
    return tidy(_kpis(spark, sf))


@query("kpi_lookup", with_features(f"""
select {_KPI_COLUMNS} from (select * from kpis where metric_name = 'severite_moyenne'
 and time_period = 'daily' and geographic_scope like 'CA%'
 order by calculated_at desc, period_start desc, geographic_scope limit 20 offset 20)""", KPIS))
def _lookup(spark, sf):
    return tidy(G.kpi_lookup(_kpis(spark, sf), "severite_moyenne", "daily", "CA%", 2, 20))


@query("kpi_evolution", with_features("""
select period_start as date, round(avg(metric_value), 6) as avg_value,
 round(min(metric_value), 6) as min_value, round(max(metric_value), 6) as max_value from kpis
where metric_name = 'accidents_par_heure'
 and period_start >= date '2024-01-31' - interval '14' day group by 1""", KPIS))
def _evolution(spark, sf):
    return tidy(G.kpi_evolution(_kpis(spark, sf), "accidents_par_heure", 14,
                                dt.date(2024, 1, 31)))


@query("kpi_evolution_orders", """
select cast(o_orderdate as date) as date, round(avg(o_totalprice), 6) as avg_value,
 min(o_totalprice) as min_value, max(o_totalprice) as max_value from orders
where o_orderdate >= date '1998-12-31' - interval '900' day group by 1""")
def _order_evolution(spark, sf):
    values = table(spark, sf, "orders").select(
        F.lit("order value").alias("metric_name"), F.col("o_totalprice").alias("metric_value"),
        F.col("o_orderdate").alias("period_start"))
    return tidy(G.kpi_evolution(values, "order value", 900, dt.date(1998, 12, 31)))


@query("kpi_window_defaults", with_features(f"""
select {_KPI_COLUMNS} from kpis where period_start between
 case time_period when 'daily' then date '2024-01-31' - interval '30' day
  when 'weekly' then date '2024-01-31' - interval '84' day
  when 'monthly' then date '2024-01-31' - interval '365' day
  else date '2024-01-31' - interval '1095' day end and date '2024-01-31'""", KPIS))
def _window(spark, sf):
    return tidy(G.kpi_in_window(_kpis(spark, sf), dt.date(2024, 1, 31)))


@query("kpi_trend", with_features("""
select metric_name, time_period, geographic_scope, points,
 round(slope, 6) as slope_per_day, case when round(slope, 9) > 0 then 'rising'
  when round(slope, 9) < 0 then 'falling' when round(slope, 9) = 0 then 'flat' end as trend
from (select metric_name, time_period, geographic_scope, count(*) as points,
 case when count(*) > 1 then regr_slope(metric_value, epoch(period_start) / 86400) end as slope
 from kpis group by all)""", KPIS))
def _trend(spark, sf):
    return tidy(G.kpi_trend(_kpis(spark, sf)))


@query("kpi_vs_previous", with_features("""
select k.metric_name, round(k.metric_value, 6) as metric_value, k.time_period, k.period_start,
 scope_level, k.geographic_scope, calculated_at, round(previous_value, 6) as previous_value,
 round((k.metric_value - previous_value) / nullif(previous_value, 0) * 100, 4) as change_percentage
from kpis k left join (select metric_name, time_period, geographic_scope,
  metric_value as previous_value, cast(period_start + case time_period
   when 'daily' then interval 1 day when 'weekly' then interval 7 day
   when 'monthly' then interval 1 month else interval 1 year end as date) as period_start
  from kpis) b on k.metric_name = b.metric_name and k.time_period = b.time_period
 and k.geographic_scope = b.geographic_scope and b.period_start = k.period_start""", KPIS))
def _previous(spark, sf):
    compared = G.kpi_vs_previous(_kpis(spark, sf))
    return tidy(compared.withColumn("change_percentage", F.round("change_percentage", 4)))


@query("kpi_dashboard", with_features("""
select metric_name, geographic_scope,
 round(max_by(metric_value, period_start), 6) as current_value,
 max(period_start) as period_start, round(avg(metric_value), 6) as avg_value,
 round(min(metric_value), 6) as min_value, round(max(metric_value), 6) as max_value
from kpis where time_period = 'weekly' group by metric_name, geographic_scope""", KPIS))
def _dashboard(spark, sf):
    return tidy(G.kpi_dashboard(_kpis(spark, sf), "weekly"))


# ----------------------------------------------------------------- listings

@query("incident_listing", with_incidents("""
select ID, Start_Time, State, Severity from incidents
where State = 'CA' and Severity = 3 and Start_Time >= date '2024-01-05'
 and Start_Time < date '2024-01-21' and Traffic_Signal
order by Start_Time desc, ID limit 30 offset 0"""))
def _incidents(spark, sf):
    return G.incident_listing(
        incidents(spark, sf), "CA", 3, dt.date(2024, 1, 5), dt.date(2024, 1, 20),
        infrastructure="Traffic_Signal", size=30,
    ).select("ID", "Start_Time", "State", "Severity")


def _section(name: str, item: str, top: bool) -> str:
    ranked = f"""select '{name}' as section, {item} as item, count(*) as incidents,
 {r('avg(Severity)')} as avg_severity from incidents group by 2"""
    return (f"(select * from ({ranked}) order by incidents desc, item asc nulls last limit 10)"
            if top else ranked)


@query("incident_summary", with_incidents(" union all ".join((
    f"select 'total' as section, 'all' as item, count(*) as incidents,"
    f" {r('avg(Severity)')} as avg_severity from incidents",
    _section("severity", "cast(Severity as varchar)", False),
    f"select * from {_section('state', 'State', True)}",
    f"select * from {_section('weather', 'Weather_Condition', True)}",
))))
def _summary(spark, sf):
    return tidy(G.incident_summary(incidents(spark, sf)))


@query("retention_split", """
select case when l_shipdate < date '1996-06-01' and l_returnflag = 'R' then 'archived'
 else 'kept' end as part, l_returnflag, count(*) as lines, round(sum(l_quantity), 2) as quantity
from lineitem group by all""")
def _retention(spark, sf):
    kept, archived = G.retention_split(
        table(spark, sf, "lineitem"), "l_shipdate", dt.date(1996, 6, 1),
        F.col("l_returnflag") == "R")
    both = kept.withColumn("part", F.lit("kept")).unionAll(
        archived.withColumn("part", F.lit("archived")))
    return tidy(both.groupBy("part", "l_returnflag").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity")), 2)


@query("retention_move", """
select case when l_shipdate < date '1996-06-10' then 'archived' else 'kept' end as part,
 l_returnflag, count(*) as lines, round(sum(l_quantity), 2) as quantity
from lineitem group by all""")
def _retention_move(spark, sf):
    """Lines by the month they were shipped in; one month is split by the date."""
    path, archive = scratch_path(spark, "lines"), scratch_path(spark, "archive")
    month = F.to_date(F.date_trunc("month", "l_shipdate"))
    (table(spark, sf, "lineitem").withColumn("shipped", month).repartition("shipped")
     .write.partitionBy("shipped").parquet(path))
    for _ in range(2):  # the second run finds nothing to move
        move_old_rows(spark, path, archive, "l_shipdate", dt.date(1996, 6, 10), "shipped", "month")
    both = spark.read.parquet(path).withColumn("part", F.lit("kept")).unionByName(
        archived_rows(spark, archive).withColumn("part", F.lit("archived")))
    return tidy(both.groupBy("part", "l_returnflag").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity")), 2)


@query("month_bucket_key", """
select cast(year(o_orderdate) * 100 + month(o_orderdate) as int) as bucket, count(*) as orders
from orders group by 1""")
def _bucket(spark, sf):
    return table(spark, sf, "orders").groupBy(
        G.month_bucket_key(F.col("o_orderdate")).alias("bucket")
    ).agg(F.count(F.lit(1)).alias("orders"))


_FLAG_ORDER = "case " + " ".join(f"when {f} then '{f}'" for f in sorted(FLAGS)) + " end"
_HELD = "coalesce(cast('0x' || substr(md5(ID), 1, 8) as bigint) % 5 = 0, true)"


@query("severity_model", with_features(f"""
select ID, Severity as actual_severity, coalesce(Severity between 1 and 4, false) as is_validated,
 {r('Start_Lat')} as input_latitude, {r('Start_Lng')} as input_longitude,
 Weather_Condition as input_weather_condition, temperature_fahrenheit as input_temperature,
 accident_hour as input_hour, {_FLAG_ORDER} as input_infrastructure_type,
 'RandomForestClassificationModel' as model_type, '1' as model_version
from featured"""))
def _model(spark, sf):
    """The prediction table but for what the forest itself says, which tests recompute."""
    source = featured(spark, sf)
    return tidy(M.train_severity_model(source).score(source).select(
        "ID", "actual_severity", "is_validated", "input_latitude", "input_longitude",
        "input_weather_condition", "input_temperature", "input_hour", "input_infrastructure_type",
        "model_type", "model_version"))


@query("severity_evaluation", with_features(f"""
select severity, rows, case when severity = (select severity from held group by severity
  order by count(*) desc, severity limit 1) then 1.0e0 else 0.0e0 end as majority_recall
from (select severity, count(*) as rows from held group by severity)""",
    f"held as (select Severity as severity from featured where {_HELD} and Severity between 1 and 4)"))
def _evaluation(spark, sf):
    """Held-out rows by class, and what a constant answer would reach; recall, precision and
    calibration of the forest are recomputed in tests/test_severity_model.py."""
    classes = M.per_class(M.evaluated(featured(spark, sf)))
    return classes.where("rows > 0").select("severity", "rows", "majority_recall")


@query("severity_calibration")
def _calibration(spark, sf):
    return tidy(M.calibration(M.evaluated(featured(spark, sf))))


@query("hotspot_tiles", with_incidents(f"""
select zoom, cast(floor(latitude * pow(2, zoom) / 360) as bigint) as cell_lat,
 cast(floor(longitude * pow(2, zoom) / 360) as bigint) as cell_lng, count(*) as hotspots,
 cast(sum(accident_count) as bigint) as accident_count,
 {r('cast(sum(cast(risk_score as decimal(18,6))) as double) / count(*)')} as avg_risk,
 max(risk_score) as max_risk
from hotspots, (select unnest(range(1, 19))::int as zoom) group by all""", HOTSPOTS))
def _tiles(spark, sf):
    path = scratch_path(spark, "tiles")
    G.write_tiles(G.hotspot_tiles(_hotspots(spark, sf)), path)
    return tidy(spark.read.parquet(path).drop("tile", "colour"))
