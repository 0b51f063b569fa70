"""Sharding by a two-pass external shuffle.

First pass: every record goes to one of many buckets, by a seeded hash of its number in the input,
and the buckets are written.  They are sized to fit in a task's memory.  Second pass: each bucket is
read, shuffled (Spark's ``shuffle`` is a Fisher-Yates shuffle) and put behind the buckets before it.
The records then stand in one uniformly random order, which is cut into shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wayside.llm.common import written, written_by

SEED, BUCKET_BYTES = 42, 4 << 20
#: Buckets that a task has on average: hashed numbers of buckets come out even only if there are some.
BUCKETS_A_TASK = 4
#: Buckets whose counts are added up together before the sums of such blocks are.
BLOCK = 1024


def shuffled(
    records: DataFrame, size: Column, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES
) -> tuple[DataFrame, int]:
    """The records in random order, as columns ``row`` (a struct of all columns of the input) and
    ``position`` (long, from 0 without gaps), and their number.

    ``size`` gives a record's bytes; null counts as 0.  Records are scattered by their place in the
    input, not by a key, so equal keys and repeated rows spread evenly; a record larger than a bucket
    makes one bucket larger.  A shuffle of the same partitions with the same seed gives the same
    order.  There are at least as many tasks as the session has shuffle partitions, and buckets grow
    beyond ``bucket_bytes`` only if there were more tasks than
    ``spark.sql.sources.bucketing.maxBuckets`` allows.
    """
    spark = records.sparkSession
    total = records.agg(F.sum(size)).first()[0] or 0
    tasks = max(-(-total // (bucket_bytes * BUCKETS_A_TASK)),
                int(spark.conf.get("spark.sql.shuffle.partitions")))
    tasks = min(tasks, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    buckets = tasks * BUCKETS_A_TASK
    numbered = records.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("number"))
    scattered = numbered.withColumn(
        "bucket", F.pmod(F.xxhash64(F.lit(seed), "number"), F.lit(buckets)).cast("int"))
    scattered = written_by(scattered.repartition(tasks, "bucket"), "scattered", "bucket", tasks,
                           sort=["bucket", "number"])
    counts = scattered.groupBy("bucket").agg(F.count("*").alias("n"))
    before = written(_running(counts), "bucket-offsets")
    held = scattered.groupBy("bucket").agg(F.collect_list("row").alias("rows"))
    placed = held.join(before, "bucket").select(
        "before", F.posexplode(F.shuffle("rows", seed)).alias("pos", "row"))
    n = before.agg(F.sum("n")).first()[0] or 0
    return placed.select("row", (F.col("before") + F.col("pos")).alias("position")), n


def _running(counts: DataFrame) -> DataFrame:
    """How many records stand in the buckets before each: sums of blocks, then within blocks."""
    blocked = counts.withColumn("block", F.expr(f"bucket div {BLOCK}"))
    sums = blocked.groupBy("block").agg(F.sum("n").alias("held"))
    # one row for every thousand buckets: some four hundred by the default limit of tasks
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("block", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return blocked.join(sums, "block").select(
        "bucket", "n", (F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("before"))


def sharded(
    records: DataFrame,
    shards: int,
    size: Column,
    seed: int = SEED,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """All columns of the records, ``shard`` (int, from 0) and ``slot`` (long, from 0 without gaps).

    Shards are equal stretches of the random order, so that their counts differ by one at most; with
    fewer records than shards some stay empty.  Values may be null, nothing is dropped or merged, and
    columns named ``shard`` or ``slot`` give way to the new ones.  An empty table gives an empty one.
    """
    rows, n = shuffled(records, size, seed, bucket_bytes)
    placed = rows.withColumn("shard", F.expr(f"int(position * {shards} div {max(n, 1)})"))
    first = F.expr(f"(bigint(shard) * {n} + {shards - 1}) div {shards}")
    placed = placed.withColumn("slot", F.col("position") - first)
    kept = [F.col("row")[c].alias(c) for c in records.columns if c not in ("shard", "slot")]
    return placed.select(*kept, "shard", "slot")


def write_shards(rows: DataFrame, path: str) -> None:
    """Write sharded rows as Parquet, a folder for each shard; within a file rows follow ``slot``.
    A bucket's rows lie in one shard or a few that follow each other, so files stay few."""
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
