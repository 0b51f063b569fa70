"""Reading, writing and streaming: every query writes what it reads back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F, types as T

from catalog.base import (
    CENTRES, INCIDENTS, featured, features_of, incidents, query, r, table, tidy, with_features,
    with_incidents,
)
from catalog.cleaning import _CLEAN_CTES, _CLEANED, SOUND, delivered
from catalog.layout import PLACED
from catalog.reports import INFRASTRUCTURE_SQL, WEATHER_SQL
from wayside import model
from wayside.plans import flows
from wayside.plans.incidents import incidents_from_events
from wayside.sinks import files as W, tables as S
from wayside.sources import csv as V, files as R, jdbc
from wayside.sources.scratch import scratch_path
from wayside.streaming import ingest as I


def _wall_clock(df):
    """Timestamps without zone, as the check has them."""
    stamps = [c for c, t in df.dtypes if t == "timestamp"]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in stamps})


def _write_csv(df, spark, label: str) -> str:
    path = scratch_path(spark, label)
    (df.write.option("header", True).option("timestampNTZFormat", V.TIMESTAMP_FORMAT)
     .option("timestampFormat", V.TIMESTAMP_FORMAT).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def _table_name(base: str) -> str:
    return f"{base}_{uuid.uuid4().hex[:12]}"


# --------------------------------------------------------------------- CSV

_CSV_COLUMNS = ("ID", "Source", "Severity", "Start_Time", "State", "City", "Start_Lat",
                "Weather_Condition", "Traffic_Signal", "Stop")


@query("csv_scan_strict", with_incidents("""
select ID, Source, Severity, date_trunc('second', Start_Time) as Start_Time, State, City,
 Start_Lat, Weather_Condition, Traffic_Signal, Stop, humidity_percent as humidity,
 null::varchar as Description from incidents"""))
def _csv(spark, sf):
    # the file has its own column order, optional columns, and lacks some of the schema
    path = _write_csv(delivered(spark, sf), spark, "csv")
    loaded = V.csv_scan_strict(spark, path)
    return _wall_clock(loaded.select(*_CSV_COLUMNS, F.col("Humidity(%)").alias("humidity"),
                                     "Description"))


_ORDER_SCHEMA = T.StructType([
    T.StructField("o_totalprice", T.DoubleType()), T.StructField("o_orderkey", T.LongType()),
    T.StructField("o_orderdate", T.TimestampType()), T.StructField("o_orderstatus", T.IntegerType()),
    T.StructField("o_orderpriority", T.StringType()),
])


@query("csv_scan_custom_schema", """
select o_totalprice, o_orderkey, date_trunc('second', o_orderdate) as o_orderdate,
 cast(null as int) as o_orderstatus, o_orderpriority from orders""")
def _csv_custom(spark, sf):
    # statuses are letters, so as integers they are all null
    path = _write_csv(table(spark, sf, "orders"), spark, "csv-orders")
    return _wall_clock(V.csv_scan_custom_schema(spark, path, _ORDER_SCHEMA, multiline=False))


@query("with_ingestion_metadata", """
select count(*) as rows, cast(1 as bigint) as batches, cast(1 as bigint) as dates,
 cast(0 as bigint) as incomplete from events""")
def _metadata(spark, sf):
    tagged = V.with_ingestion_metadata(table(spark, sf, "events"))
    return tagged.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("batch_id").alias("batches"),
        F.count_distinct("ingestion_date").alias("dates"),
        F.count_if(F.col("ingestion_timestamp").isNull() | (F.length("batch_id") != 36))
        .alias("incomplete"))


# --------------------------------------------------------- checks of a load

@query("source_file_gate", """
select verdict, files, rows from (values
 ('accepted', 1, (select count(*) from lineitem)), ('empty', 1, 0), ('too small', 1, 1))
as t(verdict, files, rows)""")
def _gate(spark, sf):
    """Three deliveries, each a folder of part files: all lines, a long header without rows, and one
    short line.  Every part file is judged; a delivery counts once for each verdict of its parts."""
    path = scratch_path(spark, "gate")
    lines = table(spark, sf, "lineitem").select(
        F.concat_ws(",", "l_orderkey", "l_linenumber", "l_extendedprice").alias("value"))
    lines.hint("rebalance").write.text(f"{path}/lines")  # even parts of bounded size
    header = F.rpad(F.lit("#"), 2000, "-").alias("value")
    spark.range(1).select(header).coalesce(1).write.text(f"{path}/header")
    spark.range(1).select(F.lit("1,1,0.5").alias("value")).coalesce(1).write.text(f"{path}/short")
    read = spark.read.option("comment", "#").schema("k long, n int, p double").csv(f"{path}/*/*.txt")
    gate = R.source_file_gate(spark, f"{path}/*/*.txt", read)
    delivery = F.regexp_extract("file_path", "([^/]*)/[^/]*$", 1)
    return gate.groupBy("verdict").agg(
        F.count_distinct(delivery).cast("int").alias("files"), F.sum("rows").alias("rows"))


@query("ingestion_metrics", with_incidents("""
select count(*) as records_read, 31 as columns_read, 50 as columns_expected,
 false as column_count_ok from incidents"""))
def _metrics(spark, sf):
    return R.ingestion_metrics(V.with_ingestion_metadata(incidents(spark, sf).drop("Source")))


@query("post_read_validation", """
select * from (values ('not_empty', 'error', (select count(*) > 0 from customer)),
 ('required_columns', 'error', false),
 ('enough_rows', 'warning', (select count(*) >= 1000 from customer)))
 as t("check", level, passed)""")
def _validation(spark, sf):
    return R.post_read_validation(table(spark, sf, "customer"),
                                  required=("c_custkey", "c_segment"))


# -------------------------------------------------------------------- scans

@query("scan_with_filters", """
select l_orderkey, l_linenumber, l_quantity from lineitem
where l_returnflag in ('A', 'R') and l_linestatus = 'F'""")
def _scan(spark, sf):
    return R.scan_with_filters(
        spark, f"{sf}/lineitem.parquet", "parquet",
        filters={"l_returnflag": ["A", "R"], "l_linestatus": "F"},
    ).select("l_orderkey", "l_linenumber", "l_quantity")


@query("bronze_scan", with_incidents("""
select partition_date, partition_state, count(*) as rows, count(Severity) as rated from placed
group by all""", PLACED))
def _bronze(spark, sf):
    path = scratch_path(spark, "bronze")
    W.write_bronze(incidents(spark, sf), path)
    found = R.bronze_scan(spark, path)
    return found.groupBy("partition_date", "partition_state").agg(
        F.count(F.lit(1)).alias("rows"), F.count("Severity").alias("rated"))


# -------------------------------------------------------------------- sinks

@query("write_bronze", with_incidents("""
select count(*) as records_written,
 count(distinct (partition_date, partition_state)) as partitions_created from placed""", PLACED))
def _write_bronze(spark, sf):
    return W.write_bronze(incidents(spark, sf), scratch_path(spark, "bronze"))


@query("write_partitioned", """
select o_orderkey, o_totalprice, o_orderstatus, o_orderpriority from orders""")
def _write(spark, sf):
    path = scratch_path(spark, "orders")
    W.write_partitioned(
        table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus",
                                          "o_orderpriority"),
        path, ["o_orderstatus", "o_orderpriority"], "orc", compression="snappy")
    return spark.read.orc(path)


@query("write_bucketed_table", """
select c_mktsegment, c_nationkey, count(*) as customers from customer group by all""")
def _bucketed(spark, sf):
    layout = S.TableLayout(8, ("c_nationkey",), ("c_mktsegment",), ("c_nationkey",))
    made = S.write_bucketed_table(table(spark, sf, "customer"), _table_name("customers"), layout,
                                  scratch_path(spark, "customers"))
    return made.groupBy("c_mktsegment", "c_nationkey").agg(
        F.count(F.lit(1)).alias("customers"))


@query("silver_detail_table", with_features(f"""
select ID, Severity, Start_Time, End_Time, round(Start_Lat, 6) as Start_Lat,
 round(Start_Lng, 6) as Start_Lng, State, City, County, distance_miles, temperature_fahrenheit, humidity_percent, visibility_miles, wind_speed_mph,
 accident_hour, accident_day_of_week, accident_month, accident_season, is_weekend, is_rush_hour,
 weather_category, weather_severity_score, visibility_category, temperature_category,
 {r('distance_to_city_center')} as distance_to_city_center, urban_rural_classification,
 state_region, infrastructure_count, safety_equipment_score, traffic_control_type,
 cast(year(Start_Time) as int) as accident_year from featured"""))
def _detail(spark, sf):
    return tidy(S.silver_detail_table(featured(spark, sf), _table_name("accidents_clean"),
                                      path=scratch_path(spark, "detail")))


@query("silver_weather_table", with_features(WEATHER_SQL))
def _weather(spark, sf):
    return tidy(S.silver_weather_table(featured(spark, sf), _table_name("weather_aggregated"),
                                       path=scratch_path(spark, "weather")))


@query("silver_infrastructure_table", with_features(INFRASTRUCTURE_SQL))
def _infrastructure(spark, sf):
    return tidy(S.silver_infrastructure_table(
        featured(spark, sf), _table_name("infrastructure_features"),
        path=scratch_path(spark, "infrastructure")))


def _analysed(spark, sf):
    layout = S.TableLayout(4, ("o_custkey",), ("o_orderstatus",), ("o_orderkey",))
    name = _table_name("orders")
    S.write_bucketed_table(table(spark, sf, "orders"), name, layout,
                           scratch_path(spark, "analysed"))
    S.analyze_table(spark, name, ["o_orderkey", "o_orderpriority"])
    return name


@query("analyze_table", """
select count(distinct o_orderkey) > 0 as has_distinct_counts, count(*) as row_count,
 min(o_orderkey) as min_key, max(o_orderkey) as max_key from orders""")
def _analyze(spark, sf):
    name = _analysed(spark, sf)
    facts = spark.sql(f"DESCRIBE EXTENDED {name} o_orderkey")
    value = lambda k: F.max(F.when(F.col("info_name") == k, F.col("info_value")))
    statistics = spark.sql(f"DESCRIBE EXTENDED {name}").filter("col_name = 'Statistics'")
    rows = F.regexp_extract(F.max("data_type"), r"(\d+) rows", 1).cast("bigint")
    total = statistics.agg(rows.alias("row_count")).first()[0]
    return facts.agg(
        (value("distinct_count").cast("bigint") > 0).alias("has_distinct_counts"),
        F.lit(total).cast("bigint").alias("row_count"), value("min").cast("bigint").alias("min_key"),
        value("max").cast("bigint").alias("max_key"))


@query("table_describe", """
select true as exists, 4 as buckets, '[`o_custkey`]' as bucket_columns, 'orc' as provider
from orders limit 1""")
def _describe(spark, sf):
    return S.table_layout(spark, _analysed(spark, sf))


@query("jdbc_sink_new_rows", """
select c_custkey, any_value(c_mktsegment) as c_mktsegment from customer
where c_custkey not in (select o_custkey + 40 from orders)
group by c_custkey""")
def _new_rows(spark, sf):
    """The rows a sink that ignores duplicates would append; keys are moved so that there are some."""
    existing = table(spark, sf, "orders").select((F.col("o_custkey") + 40).alias("c_custkey"))
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return jdbc.without_existing(customers.unionAll(customers), existing, ["c_custkey"])


# ---------------------------------------------------------------- streaming

def _arriving(spark, sf):
    """The events by day in eight parts, of as many even files as their size asks for; a quarter of the
    files makes a micro-batch, so there are about four, whatever the size."""
    events = table(spark, sf, "events")
    path = scratch_path(spark, "arriving")
    for part in range(8):
        day = F.dayofmonth("ts")
        arriving = events.filter((day > 4 * part) & (day <= 4 * part + 4)).hint("rebalance")
        arriving.write.mode("append").parquet(path)
    files = R.source_files(spark, path).count()
    return I.stream_source(spark, path, events.schema, files_per_batch=max(1, -(-files // 4)))


def _incident_stream(spark, sf):
    return incidents_from_events(_arriving(spark, sf))


@query("stream_ingest", with_incidents(f"""
select ID, Start_Time, State, cast(Start_Time as date) as partition_date,
 State as partition_state, 'batch-1' as batch_id from incidents where {SOUND}"""))
def _stream(spark, sf):
    path = scratch_path(spark, "stream")
    run = I.stream_ingest(_incident_stream(spark, sf), path, scratch_path(spark, "stream-state"),
                          batch_id="batch-1")
    run.awaitTermination()
    return spark.read.parquet(path).select("ID", "Start_Time", "State", "partition_date",
                                           "partition_state", "batch_id")


@query("stream_hourly_patterns", with_incidents(f"""
select date_trunc('hour', Start_Time) as window_start, count(*) as accident_count,
 {r('avg(Severity)')} as avg_severity from incidents group by 1"""))
def _stream_hourly(spark, sf):
    """Update mode with a watermark that closes hours, into a current table by day; the events come
    in the order of days."""
    path = scratch_path(spark, "hourly")
    run = I.stream_upsert(
        I.stream_hourly_patterns(_incident_stream(spark, sf), "9 days"),
        scratch_path(spark, "hourly-state"),
        I.ranged_upsert(path, ["window_start"], F.to_date("window_start")))
    run.awaitTermination()
    return tidy(_wall_clock(I.current_rows(spark, path)))


@query("stream_gold_upsert", """
select user_id, count(*) as events, cast(sum(cast(round(value * 100) as bigint)) as bigint) as cents,
 max(ts) as last_seen from events group by user_id""")
def _upsert(spark, sf):
    """A current row per user, kept through four batches in which users come again and again."""
    current = scratch_path(spark, "current")
    stream = _arriving(spark, sf)
    users = stream.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"),
        F.max("ts").alias("last_seen"))
    run = I.stream_upsert(users, scratch_path(spark, "current-state"),
                          I.ranged_upsert(current, ["user_id"], ranges=8))
    run.awaitTermination()
    return I.current_rows(spark, current)


@query("stream_dedup", with_incidents("select distinct ID from incidents"))
def _stream_dedup(spark, sf):
    path = scratch_path(spark, "dedup")
    kept = I.stream_dedup(_incident_stream(spark, sf), "9 days").select("ID")
    run = (kept.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
           .option("checkpointLocation", scratch_path(spark, "dedup-state")).start(path))
    run.awaitTermination()
    return spark.read.parquet(path)


# ------------------------------------------------------------- whole flows

@query("ingest_to_bronze", with_incidents(
    f"select State as partition_state, count(*) as rows, count(humidity_percent) as humid"
    f" from incidents where {SOUND} group by all"))
def _ingest(spark, sf):
    """Delivered CSV to bronze; the threshold is set so high that cleaning is triggered."""
    path = _write_csv(delivered(spark, sf), spark, "delivered")
    bronze = scratch_path(spark, "bronze")
    present = set(delivered(spark, sf).columns)
    schema = T.StructType([f for f in model.INCIDENT_SCHEMA if f.name in present])
    flows.ingest_to_bronze(
        spark, path, bronze, schema, model.QualityThresholds(min_quality_score=99.9),
        multiline=False)
    return spark.read.parquet(bronze).groupBy("partition_state").agg(
        F.count(F.lit(1)).alias("rows"), F.count("Humidity(%)").alias("humid"))


@query("build_silver", f"with {CENTRES}, {INCIDENTS}, {', '.join(_CLEAN_CTES)},"
       f" {features_of(_CLEANED, 'enriched')}"
       " select ID, State, accident_hour, weather_category, infrastructure_count,"
       " traffic_control_type, state_region, urban_rural_classification from enriched")
def _silver(spark, sf):
    made = flows.build_silver(delivered(spark, sf), None, scratch_path(spark, "silver"))
    return made.tables["accidents_clean"].select(
        "ID", "State", "accident_hour", "weather_category", "infrastructure_count",
        "traffic_control_type", "state_region", "urban_rural_classification")
