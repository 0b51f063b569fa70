"""Near duplicates by SpotSigs: a join of signature sets by Jaccard likeness, partitioned by length.

Lengths fall into partitions whose ends grow by the factor 1 / least, so that two sets alike enough
are in one partition or in neighbours: a set stands in its own partition, and as a guest in the one
before if shorter sets there can be like it.  Signatures are ordered from rare to frequent; alike
sets of a partition share one of the first n - ceil(least * n) + 1 of each, which are the buckets.
Where up to SMALL sets meet in a bucket, all pairs of allowed sizes are compared.  In a crowded one
all are compared with LEADERS of its sets first; only buckets in which more than one class is left
after that are compared in full, in pairs of bounded blocks, and there only sets of different classes.
So no link between classes is lost, and a large group of near copies costs a comparison or a few a
set.  Equal sets are one from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wayside.llm.common import drop_written, giving_back, written
from wayside.llm.components import components
from wayside.llm.spotsigs import likeness, with_spot_signatures

LEAST = 0.8
SMALL, LEADERS, BLOCK = 16, 4, 512
#: Counters that order signatures by frequency; signatures share one by their low bits.
COUNTERS = 1 << 17
#: Stands for a null doc_id, so that a class takes its name from another document.
NO_ID = (1 << 63) - 1
NODE = "struct<id: long, h: long>"


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = LEAST
) -> DataFrame:
    """``doc_id``, ``n_signatures`` and ``component_id``, the smallest doc_id that links reach, for
    every row: sets are linked at a likeness of ``least`` or more.

    Null texts are empty; empty texts are one class.  A null doc_id gets its class's id, null if
    the class has no other.  Repeated rows are returned as often as they come.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    coded = with_spot_signatures(rows, "text", keep=["doc_id"]).withColumn("_digest", digest())
    found = classes(rows, least=least).select(
        F.col("digest").alias("_digest"), F.col("component_id").alias("_class")).distinct()
    return coded.join(found, "_digest", "left").select(
        "doc_id", "n_signatures", F.coalesce("_class", "doc_id").alias("component_id"))


def digest() -> Column:
    return F.unhex(F.md5(F.col("fingerprint").cast("binary")))


def classes(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = LEAST
) -> DataFrame:
    """``doc_id``, ``digest`` of the fingerprint and ``component_id``, once each, for the documents
    whose fingerprint several rows have or a link joins to another."""
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    coded = with_spot_signatures(rows, "text", keep=["doc_id"]).select(
        "doc_id", digest().alias("digest"), F.unbase64("fingerprint").alias("set"), F.col("n_signatures").alias("n"))
    # texts are read once: the sets leave the disk as soon as equal ones are one
    coded = written(coded.withColumn("id", F.coalesce("doc_id", F.lit(NO_ID))), "spot-rows")
    holders = written(coded.select("doc_id", "digest").distinct(), "spot-holders")
    one = coded.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("rows"),
                                      F.first("n").alias("n"), F.first("set").alias("set"))
    one = written(one.select("digest", F.struct("id", F.xxhash64("digest").alias("h")).alias("node"),
                             "rows", "n", "set"), "spot-sets")
    drop_written(coded)
    met = written(_met(one, least), "spot-buckets")
    near = written(_compared(one, _pairs(met, least), least), "spot-links")
    before = components(near)
    first = written(before, "spot-classes")
    rest = written(_crowds(one, met, first, least), "spot-links")
    label = components(near.unionByName(rest)).withColumnRenamed("component", "root")
    named = F.coalesce(F.col("root.id"), F.col("node.id"))
    found = one.select("node", "rows", "digest").join(label, "node", "left").where(
        "rows > 1 or root is not null").select("digest", F.when(named != NO_ID, named).alias("component_id"))
    found = written(holders.join(found, "digest").select("doc_id", "digest", "component_id"), "spot-found")
    for used in (one, holders, met, near, before, first, rest, label):
        drop_written(used)
    return found


def length_bounds(least: float) -> np.ndarray:
    """The least length of each partition."""
    bounds = [1]
    while bounds[-1] < 1 << 31:
        bounds.append(max(bounds[-1] + 1, math.ceil(bounds[-1] / least - 1e-9)))
    return np.array(bounds, np.int64)


def bucket_keys(found: np.ndarray, counts: np.ndarray, bounds: np.ndarray, least: float) -> np.ndarray:
    """Partition, signature and (lowest bit) whether the set is a guest there; none of an empty set."""
    n = len(found)
    if not n:
        return np.empty(0, np.int64)
    rarest = np.lexsort((found, counts[found % np.uint32(COUNTERS)]))
    prefix = found[rarest[: n - math.ceil(least * n - 1e-9) + 1]].astype(np.int64) << 1
    k = int(np.searchsorted(bounds, n, side="right")) - 1
    own = prefix | k << 33
    if k and least * n <= bounds[k] - 1 + 1e-9:
        return np.concatenate([own, prefix | (k - 1) << 33 | 1])
    return own


def _met(one: DataFrame, least: float) -> DataFrame:
    """The sets in each bucket that two or more reach, with the number of its ``members``."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for s in batch.column(0):
                total += np.bincount(_signatures(s) % np.uint32(COUNTERS), minlength=COUNTERS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["c", "n"])

    sums = one.select("set").mapInArrow(giving_back(counted), "c int, n long").groupBy("c").agg(F.sum("n").alias("n"))
    counts = np.zeros(COUNTERS, np.int64)
    for row in sums.collect():  # COUNTERS rows at most
        counts[row.c] = row.n
    shared, bounds = one.sparkSession.sparkContext.broadcast(counts), length_bounds(least)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [bucket_keys(_signatures(s), shared.value, bounds, least) for s in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(made, pa.list_(pa.int64()))],
                                             names=["node", "n", "keys"])

    rows = one.where("n > 0").select("node", "n", "set").mapInArrow(
        giving_back(keyed), f"node {NODE}, n int, keys array<long>")
    held = rows.select("node", "n", F.explode("keys").alias("key")).select(
        F.shiftright("key", 1).alias("bucket"), (F.col("key") % 2 == 1).alias("guest"), "node", "n")
    sizes = held.groupBy("bucket").agg(F.count("*").alias("members"), F.min("guest").alias("guests"))
    return held.join(sizes.where("members > 1 and not guests").drop("guests"), "bucket")


def _pairs(met: DataFrame, least: float) -> DataFrame:
    """Pairs of nodes, once each, of small buckets, and of crowded ones with their leaders."""
    me = F.struct("node", "n", "guest")
    few = met.where(F.col("members") <= SMALL).select("bucket", me.alias("a"))
    pairs = few.join(few.withColumnRenamed("a", "b"), "bucket").where("a.node < b.node")
    crowd = met.where(F.col("members") > SMALL)
    first = [F.min(F.when(~F.col("guest"), F.struct(F.xxhash64("node", F.lit(k)).alias("order"), me.alias("a"))))["a"]
             for k in range(LEADERS)]
    leaders = crowd.groupBy("bucket").agg(F.array_distinct(F.array(*first)).alias("leaders"))
    led = crowd.select("bucket", me.alias("b")).join(leaders, "bucket").select("b", F.explode("leaders").alias("a"))
    both = pairs.select("a", "b").unionByName(led.where("a.node <> b.node").select("a", "b"))
    small, large = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    return both.where(~(F.col("a.guest") & F.col("b.guest")) & (small >= least * large - 1e-9)).select(
        F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()


def _compared(one: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """The pairs whose sets have the likeness."""
    pairs = written(pairs, "spot-pairs")
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = written(one.select("node", "set").join(asked, "node", "left_semi"), "spot-asked")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = [likeness(_signatures(a), _signatures(b), least) >= least - 1e-12
                     for a, b in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return both.select("a", "b", "set_a", "set_b").mapInArrow(giving_back(close), f"a {NODE}, b {NODE}")


def _crowds(one: DataFrame, met: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """Links between classes within crowded buckets, by pairs of blocks of BLOCK sets on average."""
    crowd = met.where(F.col("members") > SMALL).join(found, "node", "left").withColumn(
        "class", F.coalesce("component", "node"))
    mixed = crowd.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high"))
    mixed = mixed.where("low <> high").select("bucket")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    placed = crowd.join(mixed, "bucket", "left_semi").select(
        "bucket", "guest", "node", F.xxhash64("class").alias("class"),
        F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"), blocks.alias("blocks"))
    placed = placed.join(one.select("node", "set"), "node")
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "block", "guest", "node", "class", "set")
    return dealt.groupBy("bucket", "i", "j").applyInArrow(
        lambda members: block_links(members, least), f"a {NODE}, b {NODE}")


def block_links(members: pa.Table, least: float, kind: str = "<u4") -> pa.Table:
    """Links between the sets of two blocks, or within one: enough to join what links join."""
    members = members.combine_chunks()
    sets = [np.frombuffer(s.as_py(), kind) for s in members.column("set")]
    size = np.array([len(s) for s in sets], np.int64)
    guest = members.column("guest").to_numpy(zero_copy_only=False).astype(bool)
    block = members.column("block").to_numpy()
    parent = np.unique(members.column("class").to_numpy(), return_inverse=True)[1].tolist()
    owner = np.repeat(np.arange(len(sets)), size)
    shared = np.zeros((len(sets), len(sets)), np.float32)
    codes, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    some = times[codes] > 1  # what one set has no two share
    codes, owner = np.cumsum(times > 1)[codes[some]] - 1, owner[some]
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]
    for start in range(0, int((times > 1).sum()), 4096):
        lo, hi = np.searchsorted(codes, [start, start + 4096])
        held = np.zeros((len(sets), 4096), np.float32)
        held[owner[lo:hi], codes[lo:hi] - start] = 1
        shared += held @ held.T
    alike = shared >= (least - 1e-7) * (size[:, None] + size - shared)
    alike &= ~(guest[:, None] & guest)
    if members.column("i")[0].as_py() != members.column("j")[0].as_py():
        alike &= block[:, None] != block
    kept: tuple[list, list] = ([], [])
    roots = list(range(len(sets)))

    def root(x: int) -> int:
        while roots[x] != x:
            roots[x] = x = roots[roots[x]]
        return x

    for a, b in np.argwhere(np.triu(alike, 1)).tolist():
        one, other = root(parent[a]), root(parent[b])
        if one != other and likeness(sets[a], sets[b], least) >= least - 1e-12:
            roots[one] = other
            kept[0].append(a)
            kept[1].append(b)
    nodes = members.column("node")
    return pa.table({"a": nodes.take(pa.array(kept[0], pa.int64())),
                     "b": nodes.take(pa.array(kept[1], pa.int64()))})


def _signatures(value: pa.BinaryScalar) -> np.ndarray:
    return np.frombuffer(value.as_py(), "<u4")
