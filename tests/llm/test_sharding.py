"""The two-pass shuffle: whole records, even shards, gapless slots, random order, hot keys."""

import collections
import zlib

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tests.llm import plain
from wayside.llm import sharding
from wayside.llm.queries import QUERIES, SHARDS

SF = "/root/testdata/sf0.001"


def size():
    return F.coalesce(F.octet_length("text"), F.lit(0)) + 8


def even(rows, shards):
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(shards)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_query(spark):
    table = pq.read_table(f"{SF}/documents.parquet")
    rows = QUERIES["op11_sharding"](spark, SF).collect()
    even(rows, SHARDS)
    want = {d: (t or "").encode() for d, t in zip(*(table[c].to_pylist() for c in ("doc_id", "text")))}
    assert sorted(r.doc_id for r in rows) == sorted(want)
    for r in rows:
        data = want[r.doc_id]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (
            len(data) + 8, zlib.crc32(data), "rows", None)


def test_awkward_rows_and_small_buckets(spark):
    docs = plain.awkward(spark).withColumn("bucket", F.lit(1)).withColumn("slot", F.lit("old"))
    rows = sharding.sharded(docs, 5, size(), bucket_bytes=500).collect()
    even(rows, 5)
    count = collections.Counter((r.doc_id, r.text, r.bucket, r.n_bytes) for r in rows)
    assert count == collections.Counter((d, t, 1, 7) for d, t in plain.AWKWARD)
    none = sharding.sharded(plain.empty(spark), 5, size())
    assert none.columns == [*plain.empty(spark).columns, "shard", "slot"] and none.count() == 0


def test_same_seed_same_order_and_equal_rows_spread(spark):
    docs = spark.range(4_000, numPartitions=4).select(
        F.lit(7).alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy").otherwise(
            F.concat(F.lit("text "), "id")).alias("text"))
    order = lambda seed: [r.row.text for r in sharding.shuffled(
        docs, size(), seed, bucket_bytes=4_000)[0].orderBy("position").collect()]
    first = order(1)
    assert first == order(1) and first != order(2)
    # where the odd ones of a run of neighbours land says nothing about where they came from
    place = {t: i for i, t in enumerate(first) if t != "copy"}
    came = sorted(place, key=lambda t: int(t.split()[1]))
    ranks = np.array([place[t] for t in came])
    assert abs(np.corrcoef(np.arange(len(ranks)), ranks)[0, 1]) < 0.08
    copies = [i for i, t in enumerate(first) if t == "copy"]
    per_tenth = np.bincount(np.array(copies) * 10 // len(first), minlength=10)
    assert per_tenth.min() > 90 and per_tenth.max() < 180


def test_no_python_workers_and_no_shuffle_in_the_second_pass(spark):
    placed = sharding.sharded(spark.read.parquet(f"{SF}/documents.parquet"), 4, size(), bucket_bytes=50_000)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange hashpartitioning" not in plan


def test_written_shards(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sharding.write_shards(sharding.sharded(docs, 6, size(), bucket_bytes=40_000), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    even(back.collect(), 6)
    assert back.select("doc_id", "text").exceptAll(docs.select("doc_id", "text")).count() == 0
    for path in (tmp_path / "out").rglob("*.parquet"):
        slots = pq.ParquetFile(path).read(["slot"])["slot"].to_pylist()
        assert slots == sorted(slots)
