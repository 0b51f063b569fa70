import math
import random

import pytest
from pyspark.sql import functions as F

from tests.frames import executed, values
from wayside.operators import joins as J, layout as L
from wayside.sinks import files as W, tables as S


def _skewed(spark, rows=200_000):
    """Half of the rows in one state."""
    return spark.range(0, rows, 1, 8).select(
        F.when(F.col("id") % 2 == 0, "CA").otherwise(F.concat(F.lit("S"), F.col("id") % 40))
        .alias("partition_state"),
        F.sha2(F.col("id").cast("string"), 256).alias("filler"))


def test_a_frequent_state_is_split_over_tasks(spark, setting, tmp_path):
    setting("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1MB")
    setting("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    placed = L.repartition_by_state(_skewed(spark), 8).withColumn("t", F.spark_partition_id())
    path = str(tmp_path / "w")
    placed.write.parquet(path)
    per_task = spark.read.parquet(path).groupBy("t", "partition_state").count().collect()
    assert sum(r["count"] for r in per_task) == 200_000
    frequent = [r["count"] for r in per_task if r.partition_state == "CA"]
    assert len(frequent) > 1 and max(frequent) < 60_000


def test_partition_columns_fall_back(spark):
    df = spark.createDataFrame([(None,)], "State string")
    row = L.partition_columns(df).first()
    assert row.partition_state == "UNKNOWN" and row.partition_date is not None
    dated = df.withColumn("ingestion_date", F.lit("2020-02-03").cast("date"))
    row = L.partition_columns(dated).first()
    assert (row.partition_year, row.partition_month, row.partition_day) == (2020, 2, 3)


def test_recommendation_and_unknown_strategy(spark):
    df = spark.range(1000).select(
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 120).cast("int"))
        .alias("partition_date"),
        F.concat(F.lit("s"), F.col("id") % 25).alias("partition_state"))
    assert L.distribution_summary(df).first().recommended_strategy == "hierarchical"
    few = df.filter("partition_state in ('s1', 's2')")
    assert L.distribution_summary(few).first().recommended_strategy == "simple"
    with pytest.raises(ValueError):
        L.apply_partitioning(df, "nonsense")


def test_partitions_for_state(spark):
    df = spark.range(300_000).select(F.concat(F.lit("s"), F.col("id") % 3)
                                     .alias("partition_state"))
    assert L.partitions_for_state(df).first()[0] == 2
    tight = L.LayoutRules(target_mb=1, max_partitions_per_state=2)
    assert L.partitions_for_state(df, tight).first()[0] == 6
    assert L.partitions_for_state(df.limit(0)).first()[0] == 200


def test_estimates_and_right_sizing(spark):
    df = spark.range(0, 50_000, 1, 6).select("id", F.lit("x" * 50).alias("t"))
    row = L.estimate_size(df).first()
    assert row.total_rows == 50_000 and 400 <= row.sampled_rows <= 600
    assert 60 < row.mean_row_bytes < 90
    assert L.estimate_size(df.limit(10)).first().estimated_mb > 0
    wide = df.filter("id >= 0")
    for sized, n in ((L.right_size_partitions(wide, size_mb=1), 1),
                     (L.coalesce_small_files(wide, size_mb=256), 2),
                     (L.repartition_to_size(wide, size_mb=128 * 9), 9)):
        plan = sized._jdf.queryExecution().toString()
        assert f"RoundRobinPartitioning({n})" in plan and "REBALANCE" in plan
        assert sized.count() == wide.count()


def test_cache_by_size_leaves_large_tables_alone(spark):
    df = spark.range(10)
    assert not L.cache_by_size(df, limit_mb=0.0).is_cached
    cached = L.cache_by_size(df)
    assert cached.is_cached
    cached.unpersist()


def test_broadcast_only_within_the_limit(spark, setting):
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    left = spark.range(1000).withColumnRenamed("id", "k")
    right = spark.range(10).withColumnRenamed("id", "k")
    assert "BroadcastHashJoin" in executed(J.sized_equi_join(left, right, "k"))
    over = J.sized_equi_join(left, right, "k", limit_mb=0)
    assert "Broadcast" not in executed(over) and over.count() == 10


def test_table_that_only_compression_makes_small_is_not_broadcast(spark, setting, tmp_path):
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    path = str(tmp_path / "even")
    spark.range(4_000_000).selectExpr("id div 1000000 as k", "7L as v").write.parquet(path)
    even = spark.read.parquet(path)
    assert J.planned_bytes(even) < J.MEGABYTE and J.unpacked_bytes(even) > 200 * J.MEGABYTE
    left = spark.range(10).withColumnRenamed("id", "k")
    joined = J.sized_equi_join(left, even, "k", "left")
    assert "Broadcast" not in executed(joined) and joined.count() == 4_000_006
    texts = spark.range(100).selectExpr("id as k", "repeat('x', 1000) as t", "array('y', null) as l")
    assert 100_000 < J.unpacked_bytes(texts) < 200_000
    assert J.unpacked_bytes(texts.limit(0)) == 0


def test_large_full_join_in_two_parts_equals_the_plain_one(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "n")], "k int, l string")
    right = spark.createDataFrame([(2, "x"), (2, "y"), (3, "z"), (None, "m")], "k int, r string")
    plain = left.join(right, ["k"], "full").select("k", "l", "r").collect()
    split = J.sized_equi_join(left, right, "k", "full", limit_mb=0)
    assert sorted(map(str, split.select("k", "l", "r").collect())) == sorted(map(str, plain))


@pytest.mark.parametrize("limit_mb", [0, 200])
def test_full_join_with_other_columns_of_one_name(spark, limit_mb):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    right = spark.createDataFrame([(2, "x"), (3, "z"), (None, "m")], "k int, v string")
    found = J.sized_equi_join(left, right, "k", "full", limit_mb=limit_mb)
    assert found.columns == ["k", "v", "v"]
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, [
        (1, "a", None), (2, "b", "x"), (3, None, "z"), (None, "n", None), (None, None, "m")]))


def test_frequent_key_of_a_bucketed_join_is_dealt_to_many_tasks(spark, setting, tmp_path):
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    setting("spark.sql.adaptive.coalescePartitions.enabled", "false")
    layout = S.TableLayout(4, ("k",), (), ("k",))
    left = spark.range(20_000).select(
        F.when(F.col("id") % 10 > 0, 7).otherwise(F.col("id")).cast("bigint").alias("k"),
        F.lit("same").alias("l"))
    right = spark.range(100).select(F.col("id").alias("k"), F.col("id").alias("r"))
    a = S.write_bucketed_table(left, "hot_a", layout, str(tmp_path / "a"))
    b = S.write_bucketed_table(right, "hot_b", layout, str(tmp_path / "b"))
    assert J.frequent_keys(a, "k", 1 / 4) == {7: 18_000}
    for frequent in (None, [7]):
        joined = J.bucketed_join(a, b, "k", 4, frequent)
        tasks = joined.groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in tasks) == 18_010
        assert max(r["count"] for r in tasks) < 18_010 / 4
    other = J.bucketed_join(b, a, "k", 4)
    assert other.count() == 18_010


def test_bucketed_join_has_no_shuffle_and_frequent_keys_go_beside_it(spark, setting, tmp_path):
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    layout = S.TableLayout(4, ("k",), (), ("k",))
    left = spark.range(400).select((F.col("id") % 100).alias("k"), F.col("id").alias("l"))
    right = spark.range(100).select(
        F.when(F.col("id") < 50, 7).otherwise(F.col("id")).cast("bigint").alias("k"),
        F.col("id").alias("r"))
    a = S.write_bucketed_table(left, "bucketed_a", layout, str(tmp_path / "a"))
    b = S.write_bucketed_table(right, "bucketed_b", layout, str(tmp_path / "b"))
    plain = J.bucketed_join(a, b, "k", 4, frequent=[])
    assert "Exchange" not in executed(plain)
    assert J.frequent_keys(b, "k", 1 / 4) == {7: 50}
    both = J.bucketed_join(a, b, "k", 4)
    assert sorted(values(both, "k", "l", "r")) == sorted(values(plain, "k", "l", "r"))


def test_places_of_a_sorted_table(spark):
    df = spark.range(0, 500, 1, 7).select(((F.col("id") * 37) % 500).alias("v"))
    placed = L.with_place(df.orderBy("v"))
    assert {(r.v, r.place) for r in placed.collect()} == {(i, i + 1) for i in range(500)}


@pytest.mark.parametrize("km", [3, 80, 900, 12_000])
def test_radius_join_against_all_pairs(spark, km):
    rng = random.Random(km)
    centres = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(20)]
    centres += [(20, 90.0, 0.0), (21, -90.0, 10.0), (22, 0.0, 180.0), (23, 89.9, -170.0)]
    places = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(300)]
    places += [(i, rng.choice((-1, 1)) * rng.uniform(80, 90), rng.uniform(-180, 180))
               for i in range(300, 400)]
    places += [(1000 + i, max(-90.0, min(90.0, la + rng.uniform(-.02, .02))), max(-180.0, min(180.0, lo + .01)))
               for i, la, lo in centres]
    a = spark.createDataFrame(centres, "c int, centre_lat double, centre_lng double")
    b = spark.createDataFrame(places, "p int, latitude double, longitude double")

    def distance(x, y):
        la, lo, mb, mo = map(math.radians, (x[1], x[2], y[1], y[2]))
        cosine = math.cos(la) * math.cos(mb) * math.cos(mo - lo) + math.sin(la) * math.sin(mb)
        return 6371 * math.acos(max(-1.0, min(1.0, cosine)))

    expected = {(x[0], y[0]) for x in centres for y in places if distance(x, y) < km}
    assert set(values(J.radius_join(a, b, km), "c", "p")) == expected
    found = J.radius_join(a, b, km)
    assert found.count() == len(expected)
    for c, lat, lng in (c for c in centres if abs(c[1]) < 65):
        near = J.radius_search(b, lat, lng, km)
        assert {r.p for r in near.collect()} == {p for q, p in expected if q == c}


def test_partitioned_write_reads_back_and_prunes(spark, tmp_path):
    path = str(tmp_path / "w")
    df = _skewed(spark, 2000)
    W.write_partitioned(df, path, ["partition_state"], compression="snappy")
    back = spark.read.parquet(path)
    assert back.count() == 2000
    plan = executed(back.filter("partition_state = 'CA'"))
    assert "PartitionFilters: [isnotnull(partition_state" in plan


def test_bucketed_table_is_described_and_missing_table_too(spark, tmp_path):
    layout = S.TableLayout(3, ("k",), ("p",), ("k",))
    df = spark.range(20).select(F.col("id").alias("k"), (F.col("id") % 2).alias("p"))
    S.write_bucketed_table(df, "described", layout, str(tmp_path / "d"))
    row = S.table_layout(spark, "described").first()
    assert (row.exists, row.buckets, row.provider) == (True, 3, "orc")
    assert not S.table_layout(spark, "not_there").first().exists


def test_a_bucket_is_one_file_unless_it_is_oversized(spark, setting, tmp_path):
    df = spark.range(0, 100_000, 1, 8).select(
        F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id") % 64).cast("bigint").alias("k"),
        F.sha2(F.col("id").cast("string"), 256).alias("filler"))
    layout = S.TableLayout(8, ("k",), (), ("k",))

    def files(name):
        made = S.write_bucketed_table(df, name, layout, str(tmp_path / name))
        buckets = [f.rsplit("_", 1)[1].split(".")[0] for f in made.inputFiles()]
        return [buckets.count(b) for b in set(buckets)]

    assert files("evenly") == [1] * 8
    setting("spark.sql.adaptive.advisoryPartitionSizeInBytes", "500KB")
    setting("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    spread = files("split")
    assert len(spread) == 8 and max(spread) > 1
