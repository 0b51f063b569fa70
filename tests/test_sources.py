import datetime as dt
import os

import pytest
from pyspark.sql import functions as F, types as T

from wayside.model import INCIDENT_SCHEMA
from wayside.sources import csv as V, files as R, jdbc, scratch
from wayside.streaming import ingest as I

HEADER = ("ID,Source,Severity,Start_Time,End_Time,Start_Lat,Start_Lng,State,Weather_Condition,"
          "Description,Traffic_Signal,Wind_Chill(F)")
LINES = [
    'A-1,Origin,2,2016-02-08 05:46:00,2016-02-08 11:00:00,39.865147,-84.058723,OH,Light Rain,'
    '"Accident, with ""quotes""\nand a second line",True,',
    'A-2,Origin,x,not a time,,39.9,,AL,Clear,,False,NaN',
]


@pytest.fixture
def delivered(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("\n".join([HEADER, *LINES]) + "\n")
    return tmp_path / "in"


def test_csv_is_matched_by_name_and_bad_values_are_null(spark, delivered):
    df = V.csv_scan_strict(spark, str(delivered))
    assert df.columns == [f.name for f in INCIDENT_SCHEMA] + ["Source"]
    assert [f.dataType for f in df.schema][:47] == [f.dataType for f in INCIDENT_SCHEMA]
    first, second = df.orderBy("ID").collect()
    assert first.Severity == 2 and first.State == "OH" and first.Traffic_Signal is True
    assert first.Start_Time == dt.datetime(2016, 2, 8, 5, 46)
    assert first.Description == 'Accident, with "quotes"\nand a second line'
    assert first["Wind_Chill(F)"] is None and first.Street is None
    assert (second.Severity, second.Start_Time, second.Start_Lng) == (None, None, None)
    assert second["Wind_Chill(F)"] != second["Wind_Chill(F)"]  # NaN


def test_files_with_another_header_are_refused(spark, delivered):
    (delivered / "b.csv").write_text("ID,State\nA-3,TX\n")
    with pytest.raises(Exception, match="header"):
        V.csv_scan_strict(spark, str(delivered)).collect()


def test_custom_schema(spark, delivered):
    schema = T.StructType([T.StructField("State", T.StringType()),
                           T.StructField("Start_Lat", T.DecimalType(8, 3)),
                           T.StructField("Start_Time", T.DateType())])
    rows = V.csv_scan_custom_schema(spark, str(delivered), schema).orderBy("State").collect()
    assert [r.State for r in rows] == ["AL", "OH"]
    assert str(rows[1].Start_Lat) == "39.865"


def test_gate_sees_sizes_without_reading(spark, delivered):
    R.require_files(spark, str(delivered), min_bytes=10)
    with pytest.raises(ValueError):
        R.require_files(spark, str(delivered), min_bytes=10_000)
    (delivered / "empty").mkdir()
    assert R.source_files(spark, str(delivered)).count() == 1


def test_one_batch_id_per_load(spark):
    tagged = V.with_ingestion_metadata(spark.range(100))
    assert tagged.select("batch_id").distinct().count() == 1
    assert V.with_ingestion_metadata(spark.range(1), "mine").first().batch_id == "mine"


def test_observed_counts_while_reading(spark):
    df, watch = R.observed(spark.range(123))
    df.write.format("noop").mode("overwrite").save()
    assert watch.get["records_read"] == 123


def test_post_read_checks(spark):
    with pytest.raises(ValueError, match="required_columns"):
        R.require_valid_read(spark.range(5))
    with pytest.raises(ValueError, match="not_empty"):
        R.require_valid_read(spark.range(0), required=())
    assert R.require_valid_read(spark.range(5), required=("id",)).count() == 5


def test_scan_filters_are_pushed(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(50).select("id", (F.col("id") % 5).alias("m")).write.partitionBy("m").parquet(path)
    found = R.scan_with_filters(spark, path, filters={"m": [1, 2], "id": 6})
    assert [r.id for r in found.collect()] == [6]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [m" in plan and "EqualTo(id,6)" in plan


def test_named_parameters_become_literals():
    text = jdbc.bind_parameters(
        "select ':a', x from t where a = :a and b > :b and c = :c and d = :unknown",
        {"a": "O'Hare", "b": 2.5, "c": None})
    assert text == ("select ':a', x from t where a = 'O''Hare' and b > 2.5 and c = NULL"
                    " and d = :unknown")


def test_rows_the_target_lacks(spark):
    new = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, "d")], "k int, v string")
    old = spark.createDataFrame([(1, "z")], "k int, v string")
    assert sorted(tuple(r) for r in jdbc.without_existing(new, old, ["k"]).collect()) == [
        (2, "b"), (3, "d")]


def test_keys_of_a_large_target_are_dealt_over_more_tasks(spark, setting, monkeypatch):
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    new = spark.range(0, 5_000, 1, 4).selectExpr(
        "if(id % 1000 = 999, null, id div 2) as k", "id as v", "string(id % 2) as w")
    old = spark.range(0, 40_000).selectExpr("id % 2000 as k")
    found = {}
    for most in (100, 1_000_000):
        monkeypatch.setattr(jdbc, "KEYS_PER_TASK", most)
        made = jdbc.without_existing(new, old, ["k"])
        found[most] = sorted((r.k is None, r.k, r.v) for r in made.collect() if r.k is not None)
        assert [r.v for r in made.collect() if r.k is None] == [999]
    assert found[100] == found[1_000_000] == [(False, k, 2 * k) for k in range(2000, 2500)
                                             if k != 2499] + [(False, 2499, 4998)]
    read = []
    monkeypatch.setattr(jdbc, "KEYS_PER_TASK", 100)
    monkeypatch.setattr(jdbc, "materialise", lambda df, label: read.append((label, scratch.materialise(df))) or read[-1][1])
    jdbc.without_existing(new, old, ["k"]).count()
    assert [label for label, _ in read] == ["keys", "keys", "lacking-keys", "fresh-rows"]
    # as many files as parts hold lacking keys: merged partitions would leave one
    assert len(read[2][1].inputFiles()) > 8


def test_scratch_is_in_the_configured_folder_and_released(spark):
    path = scratch.scratch_path(spark, "x")
    assert path.startswith(spark.conf.get("spark.checkpoint.dir"))
    df = scratch.materialise(spark.range(10))
    assert "Range" not in df._jdf.queryExecution().toString() and df.count() == 10
    assert scratch.release_scratch(spark) >= 2


def test_a_block_releases_its_own_copies_only(spark):
    before = scratch.materialise(spark.range(3))
    with scratch.released(spark):
        inside = scratch.materialise(spark.range(4))
        folder = inside.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
        assert inside.count() == 4 and os.path.isdir(folder)
    assert not os.path.isdir(folder) and before.count() == 3


def _small_parts(setting):
    setting("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2k")
    setting("spark.sql.adaptive.coalescePartitions.minPartitionSize", "2k")


def test_delivered_lines_are_written_by_several_tasks(spark, setting, monkeypatch):
    from catalog import sources as catalogued

    _small_parts(setting)
    made = []
    monkeypatch.setattr(catalogued, "scratch_path", lambda *a: made.append(scratch.scratch_path(*a)) or made[-1])
    found = {r.verdict: (r.files, r.rows) for r in catalogued._gate(spark, "/root/testdata/sf0.01").collect()}
    lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").count()
    assert found == {"accepted": (1, lines), "empty": (1, 0), "too small": (1, 1)}
    parts = R.source_file_gate(spark, f"{made[0]}/lines/*.txt", spark.read.text(f"{made[0]}/lines"))
    rows = sorted(r.rows for r in parts.collect())
    assert len(rows) > 3 and rows[-1] < lines / 2


def test_parts_of_the_stream_are_several_files_and_four_batches(spark, setting, monkeypatch):
    from catalog import sources as catalogued

    _small_parts(setting)
    made, asked = [], []
    monkeypatch.setattr(catalogued, "scratch_path", lambda *a: made.append(scratch.scratch_path(*a)) or made[-1])
    source = I.stream_source
    monkeypatch.setattr(I, "stream_source", lambda *a, **o: asked.append(o["files_per_batch"]) or source(*a, **o))
    catalogued._arriving(spark, "/root/testdata/sf0.01")
    files = R.source_files(spark, made[0]).count()
    assert files > 8 and asked == [-(-files // 4)]
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    assert spark.read.schema(events.schema).parquet(made[0]).exceptAll(events).count() == 0
    assert spark.read.parquet(made[0]).count() == events.count()


# ---------------------------------------------------------------- streaming

SCHEMA = ("ID string, Severity int, Start_Time timestamp_ntz, Start_Lat double, Start_Lng double,"
          " State string")


def _batch(spark, folder, name, rows):
    made = [(i, s, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), 40.0, -80.0, state)
            for i, s, m, state in rows]
    spark.createDataFrame(made, SCHEMA).coalesce(1).write.parquet(str(folder / name))


def _source(spark, folder, **more):
    schema = T._parse_datatype_string(SCHEMA)
    return I.stream_source(spark, str(folder) + "/*", schema, **more)


def test_stream_ingest_equals_batch_and_resumes(spark, tmp_path):
    folder, out, state = tmp_path / "s", str(tmp_path / "o"), str(tmp_path / "c")
    _batch(spark, folder, "1", [("a", 1, 0, "OH"), ("b", 2, 5, "ZZ"), ("c", 9, 6, "TX")])
    I.stream_ingest(_source(spark, folder), out, state, "b1").awaitTermination()
    _batch(spark, folder, "2", [("d", 3, 9, "TX")])
    I.stream_ingest(_source(spark, folder), out, state, "b2").awaitTermination()
    rows = spark.read.parquet(out).orderBy("ID").collect()
    assert [(r.ID, r.partition_state, r.batch_id) for r in rows] == [
        ("a", "OH", "b1"), ("d", "TX", "b2")]


def test_closed_hours_ignore_late_rows_and_ids_are_kept_once(spark, tmp_path):
    folder = tmp_path / "s"
    _batch(spark, folder, "1", [("a", 1, 10, "OH"), ("b", 3, 20, "OH"), ("z", 1, 300, "OH")])
    hours = I.stream_hourly_patterns(_source(spark, folder), "10 minutes")
    out, state = str(tmp_path / "h"), str(tmp_path / "hc")

    def run():
        (hours.writeStream.format("parquet").option("checkpointLocation", state)
         .outputMode("append").trigger(availableNow=True).start(out).awaitTermination())

    run()
    _batch(spark, folder, "2", [("late", 4, 30, "OH"), ("y", 1, 900, "OH"), ("a", 1, 899, "OH")])
    run()
    found = {r.window_start.hour: (r.accident_count, r.avg_severity)
             for r in spark.read.parquet(out).collect()}
    assert found[0] == (2, 2.0) and found[5] == (1, 1.0)

    kept = I.stream_dedup(_source(spark, folder), "2 days").select("ID")
    (kept.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "dc"))
     .trigger(availableNow=True).start(str(tmp_path / "d")).awaitTermination())
    assert sorted(r.ID for r in spark.read.parquet(str(tmp_path / "d")).collect()) == [
        "a", "b", "late", "y", "z"]


def test_csv_files_are_split_where_no_text_holds_a_break(spark, tmp_path, setting):
    """One file with breaks inside quotes, one without: the same rows either way, in more tasks."""
    setting("spark.sql.files.maxPartitionBytes", "20000")
    setting("spark.sql.files.openCostInBytes", "0")
    header = "ID,Severity,State,Description"
    plain = [f'A-{i},{i % 5},OH,"said ""{i}"", and more"' for i in range(3_000)]
    broken = [f'B-{i},{i % 5},CA,"line {i}\nand ""another"" one\n"' for i in range(3_000)]
    (tmp_path / "in").mkdir()
    for name, lines in (("plain", plain), ("broken", broken)):
        (tmp_path / "in" / f"{name}.csv").write_text("\n".join([header, *lines]) + "\n")
    where = str(tmp_path / "in")
    odd, even = V.files_by_breaks(spark, where)
    assert [f.rsplit("/", 1)[1] for f in odd + even] == ["broken.csv", "plain.csv"]
    schema = T.StructType([T.StructField("ID", T.StringType()), T.StructField("Severity", T.IntegerType()),
                           T.StructField("Description", T.StringType())])
    chosen = V.csv_scan_strict(spark, where, schema)
    whole = V.csv_scan_strict(spark, where, schema, multiline=True)
    assert chosen.count() == 6_000
    assert chosen.exceptAll(whole).isEmpty() and whole.exceptAll(chosen).isEmpty()
    tasks = lambda df, first: df.where(F.col("ID").startswith(first)).select(
        F.spark_partition_id()).distinct().count()
    assert tasks(whole, "A") == 1 and tasks(chosen, "A") > 3 and tasks(chosen, "B") == 1


def test_csv_of_two_headers_in_both_groups_is_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ID,State\nA-1,TX\n")
    (tmp_path / "b.csv").write_text('State,ID\n"T\nX",A-2\n')
    with pytest.raises(ValueError, match="header"):
        V.csv_scan_strict(spark, str(tmp_path))


def test_ranged_upsert(spark, tmp_path):
    path = str(tmp_path / "current")
    replace = I.ranged_upsert(path, ["k"], F.expr("k div 10"))
    frame = lambda rows: spark.createDataFrame(rows, "k int, v string")
    state = lambda: {r.k: r.v for r in I.current_rows(spark, path).collect()}
    files = lambda part: {f.name for f in (tmp_path / "current" / f"key_range={part}").glob("*.parquet")}
    replace(frame([(1, "a"), (2, "b"), (11, "c"), (25, None)]), 0)
    replace(frame([(2, "B"), (12, "d")]), 1)
    assert state() == {1: "a", 2: "B", 11: "c", 12: "d", 25: None}
    untouched, before = files(2), files(0)
    replace(frame([(2, "B"), (12, "d")]), 1)  # the batch comes again
    assert state() == {1: "a", 2: "B", 11: "c", 12: "d", 25: None}
    replace(frame([(1, "z")]), 2)
    assert state()[1] == "z" and files(2) == untouched and files(0) != before
    replace(frame([(1, "old"), (13, "e")]), 1)  # an earlier number does not undo a later one
    assert state() == {1: "z", 2: "B", 11: "c", 12: "d", 13: "e", 25: None}
    replace(frame([]), 3)
    assert len(state()) == 6
    # only the touched range is read: one of three folders
    read = spark.read.parquet(path).where("key_range = 0")._jdf.queryExecution().executedPlan().toString()
    assert "key_range" in read.split("PartitionFilters:")[1].split("]")[0]


def test_ranged_upsert_goes_on_after_a_break(spark, tmp_path, monkeypatch):
    """The replacement is lost half way: the repeated batch puts the merged rows in place."""
    path = str(tmp_path / "current")
    replace = I.ranged_upsert(path, ["k"], ranges=2)
    frame = lambda rows: spark.createDataFrame(rows, "k int, v string")
    replace(frame([(k, "old") for k in range(20)]), 0)
    monkeypatch.setattr(I, "_delete", lambda spark, path: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        replace(frame([(3, "new")]), 1)
    monkeypatch.undo()
    import shutil

    touched = spark.read.parquet(path).where("k = 3").first().key_range
    shutil.rmtree(tmp_path / "current" / f"key_range={touched}")  # as if not yet renamed
    replace(frame([(3, "new")]), 1)
    kept = {r.k: r.v for r in I.current_rows(spark, path).collect()}
    assert kept == {k: "new" if k == 3 else "old" for k in range(20)}
