"""Summaries by day against figures of the whole table, retention as a move, map tiles of all levels."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from catalog.base import featured, incidents
from wayside.operators import daily as D, layout as L, quality as Q, serving as G
from wayside.sinks.retention import archived_rows, move_old_rows

SF = "/root/testdata/sf0.001"


def same(a, b):
    assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(
        map(str, b.select(*sorted(b.columns)).collect()))


def test_merged_days_equal_one_run(spark, tmp_path):
    source = incidents(spark, SF)
    path = str(tmp_path / "days")
    for first in range(1, 32, 7):
        D.keep_days(D.daily_summary(source.where(
            F.dayofmonth("Start_Time").between(first, first + 6))), path)
    once = D.kept_days(spark, path)
    same(D.merged_null_profile(once, source.columns), Q.null_profile(source))
    days = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "days").rglob("*.parquet")}
    D.keep_days(D.daily_summary(source.where("day(Start_Time) = 3")), path)  # a day comes again
    again = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "days").rglob("*.parquet")}
    assert len(set(days) - set(again)) == 1  # the others keep their files
    same(D.merged_null_profile(D.kept_days(spark, path), source.columns), Q.null_profile(source))
    whole = L.distribution_analysis(L.partition_columns(source)).collect()
    assert {(r.level, r.key): r.rows for r in D.merged_distribution(D.kept_days(spark, path)).collect()
            if r.key} == {
        (r.level, r.key): r.rows for r in whole if r.key != "UNKNOWN"}


def test_sketches_find_copies_on_other_days(spark):
    rows = spark.range(60_000).selectExpr("concat('k', id % 40000) as ID", "id % 40000 as v",
                                          "timestamp'2024-01-01' + make_interval(0, 0, 0, int(id div 20000)) as at")
    exact = Q.duplicate_analysis(rows.drop("at")).first()
    parts = [D.daily_summary(rows.where(f"day(at) = {d}").drop("at"), F.lit(d)) for d in (1, 2, 3)]
    merged = D.merged_duplicates(parts[0].unionByName(parts[1]).unionByName(parts[2])).first()
    assert merged.total_rows == exact.total_rows == 60_000 and exact.distinct_rows == 40_000
    assert abs(merged.distinct_rows - exact.distinct_rows) <= merged.error_rows < 1_500
    assert abs(merged.id_duplicates - exact.id_duplicates) <= merged.error_rows


def test_summaries_of_nothing(spark):
    none = D.daily_summary(spark.createDataFrame([], "ID string, Start_Time timestamp, State string"))
    assert D.merged_null_profile(none, ["ID"]).first().null_count == 0
    assert tuple(D.merged_duplicates(none).first())[:3] == (0, 0, 0)
    assert D.merged_distribution(none).count() == 0
    late = D.daily_summary(spark.createDataFrame([(None, None)], "ID string, Start_Time timestamp"))
    assert D.merged_null_profile(late, ["ID", "new"]).select("null_count").collect()[1][0] == 1


def test_old_partitions_move_and_others_keep_their_files(spark, tmp_path):
    path, archive = str(tmp_path / "t"), str(tmp_path / "a")
    rows = spark.range(400).selectExpr("id", "date_add(date'2024-01-01', int(id % 120)) as at")
    rows = rows.unionByName(spark.createDataFrame([(-1, None)], "id long, at date"))
    rows.withColumn("month", F.to_date(F.date_trunc("month", "at"))).coalesce(1).write.partitionBy("month").parquet(path)
    files = lambda: {str(f): f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    before = files()
    move = lambda d, **o: move_old_rows(spark, path, archive, "at", d, "month", "month", **o)
    moved = move(dt.date(2024, 2, 10))
    assert moved.whole == ["month=2024-01-01"] and moved.split == ["month=2024-02-01"]
    after = files()
    untouched = [f for f in before if "2024-0" not in f or "2024-03" in f or "2024-04" in f]
    assert all(after[f] == before[f] for f in untouched) and len(untouched) == 3
    kept, old = spark.read.parquet(path), archived_rows(spark, archive)
    assert kept.count() + old.count() == 401 and old.agg(F.max("at")).first()[0] == dt.date(2024, 2, 9)
    assert kept.agg(F.min("at")).first()[0] == dt.date(2024, 2, 10)
    assert move(dt.date(2024, 2, 10)) == type(moved)() and files() == after  # nothing is left to move
    assert move(dt.date(2024, 2, 20)).split == ["month=2024-02-01"]
    assert move(dt.date(2024, 3, 1)).whole == ["month=2024-02-01"]
    spark.catalog.clearCache()
    kept, old = spark.read.parquet(path), archived_rows(spark, archive)
    assert sorted(r.id for r in old.unionByName(kept).collect()) == list(range(-1, 400))
    assert old.where("at >= date'2024-03-01'").isEmpty() and kept.where("at < date'2024-03-01'").isEmpty()


def test_a_condition_splits_old_partitions(spark, tmp_path):
    path, archive = str(tmp_path / "t"), str(tmp_path / "a")
    spark.range(60).selectExpr("id", "date_add(date'2024-01-01', int(id % 3)) as at").withColumn(
        "day", F.col("at")).write.partitionBy("day").parquet(path)
    moved = move_old_rows(spark, path, archive, "at", dt.date(2024, 1, 3), "day", only_if=F.col("id") < 30)
    assert moved.whole == [] and len(moved.split) == 2
    assert archived_rows(spark, archive).count() == 20 and spark.read.parquet(path).count() == 40


def test_a_move_that_broke_off_is_finished(spark, tmp_path, monkeypatch):
    from wayside.sinks import retention as R

    path, archive = str(tmp_path / "t"), str(tmp_path / "a")
    spark.range(62).selectExpr("id", "date_add(date'2024-01-01', int(id % 31)) as at").withColumn(
        "month", F.lit(dt.date(2024, 1, 1))).write.partitionBy("month").parquet(path)
    put = R._put_in_place
    calls = []

    def broken(files, where):
        calls.append(where)
        if len(calls) == 2:  # the staged rows are complete, the old ones still there
            raise OSError("lost")
        put(files, where)

    monkeypatch.setattr(R, "_put_in_place", broken)
    for attempt in (1, 2):
        try:
            move_old_rows(spark, path, archive, "at", dt.date(2024, 1, 11), "month", "month")
        except OSError:
            assert attempt == 1
    kept, old = spark.read.parquet(path), archived_rows(spark, archive)
    assert sorted(r.id for r in kept.select("id").unionByName(old.select("id")).collect()) == list(range(62))
    assert old.count() == 20


def test_tiles_of_all_levels_equal_single_maps(spark, tmp_path):
    spots = G.geo_hotspots(featured(spark, SF), 0.5).persist()
    tiles = G.hotspot_tiles(spots)
    plan = tiles._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") == 1
    path = str(tmp_path / "tiles")
    G.write_tiles(tiles, path)
    back = spark.read.parquet(path)
    for zoom in (1, 2, 5, 9, 14, 18):
        one = G.hotspot_map(spots, 100, -100, 180, -180, zoom)
        level = back.where(f"zoom = {zoom}").drop("zoom", "tile")
        rounded = [df.withColumn("avg_risk", F.round("avg_risk", 9)) for df in (one, level.select(*one.columns))]
        same(*rounded)
    # a window whose borders are those of tiles
    window = G.tiles_in_window(back, 44.9, 0.1, -45.1, -89.9, 5)
    cut = G.hotspot_map(spots, 45 - 1e-9, 0, -45 - 1e-9, -90, 5)
    same(window.select("cell_lat", "cell_lng", "hotspots"), cut.select("cell_lat", "cell_lng", "hotspots"))
    assert 0 < window.count() < back.where("zoom = 5").count()
    scan = window._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(tile" in scan and "zoom" in scan.split("PartitionFilters")[1][:60]
    with pytest.raises(ValueError):
        G.hotspot_tiles(spots, [0])
    spots.unpersist()


def test_tile_keys_are_nested(spark):
    at = spark.range(500).selectExpr("(id * 7919 % 262144) - 131072 as row", "(id * 104729 % 262144) - 131072 as col")
    key = G._interleaved(F.col("row"), F.col("col"))
    for r in at.select("row", "col", key.alias("k")).collect():
        x, y = r.row + 131072, r.col + 131072
        assert r.k == sum((x >> b & 1) << 2 * b + 1 | (y >> b & 1) << 2 * b for b in range(20))


def test_sizes_by_files(spark, tmp_path):
    path = tmp_path / "t"
    spark.range(40_000).selectExpr("id", "md5(string(id)) as m", "id % 4 as part").repartition(4).write.partitionBy(
        "part").parquet(str(path))
    size = lambda where: sum(f.stat().st_size for f in path.glob(where)) / 2**20
    df = spark.read.parquet(str(path))
    whole = L.estimate_size(df).first()
    assert whole.basis == "files" and whole.total_rows == 40_000
    assert whole.estimated_mb == pytest.approx(size("*/*.parquet"))
    part = L.estimate_size(df.where("part = 2").select("id")).first()
    assert part.estimated_mb == pytest.approx(size("part=2/*.parquet")) and part.total_rows == 10_000
    some = L.estimate_size(df.where("id < 4000")).first()
    assert some.total_rows == 4_000 and some.estimated_mb == pytest.approx(whole.estimated_mb / 10, rel=0.05)
    derived = L.estimate_size(df.distinct()).first()
    assert derived.basis == "rows" and derived.total_rows == 40_000 and 100 < derived.sampled_rows < 1_000
    json = df.distinct().select(F.avg(F.octet_length(F.to_json(F.struct("*"))))).first()[0]
    assert derived.mean_row_bytes == pytest.approx(json, rel=0.02)
    equal = L.estimate_size(spark.range(50_000).select(F.lit("x").alias("v"))).first()
    assert equal.estimated_mb == pytest.approx(50_000 * 9 / 2**20) and equal.sampled_rows in (
        spark.range(50_000).rdd.getNumPartitions(), 50_000)
    assert L.estimate_size(spark.range(0)).first().estimated_mb == 0


def test_scratch_of_the_flows_is_released(spark, tmp_path):
    from catalog.cleaning import delivered
    from wayside.plans import flows
    from wayside.sources import scratch

    source = delivered(spark, SF)
    made = lambda: scratch._made.get(spark.sparkContext.applicationId, [])
    before = len(made())
    report = flows.cleaning_report(source).first()
    assert len(made()) == before and report.input_records == source.count() >= report.records_after_nulls
    silver = flows.build_silver(source, None, str(tmp_path / "silver"))
    left = [p.rsplit("/", 1)[1] for p in made()[before:]]
    assert not any("featured" in p or "deduplicated" in p for p in left)
    assert silver.scores.first().records_out == silver.tables["accidents_clean"].count()
    for name, frame in silver.reports.items():
        frame.collect()
        assert not any("featured" in f for f in frame.inputFiles()), name
