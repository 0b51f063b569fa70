"""Exact top-k search by inner product over vectors sorted by length.

All vectors are rotated so that the first coordinates carry most of the squares (the right
singular vectors of the table).  A query meets the candidates block by block, longest vectors
first.  A block, and then a vector, is passed over when a bound by Cauchy and Schwarz, of the whole
vectors or of the coordinates that a partial sum has left out, stays below the query's k-th score.
Scores themselves are integers, computed from the vectors as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from wayside.llm.common import written

#: Candidates of a block, queries of a block, candidates that give the first bounds.
BLOCK, QUERIES, HEAD = 2_048, 512, 2_048
#: Blocks that one call holds at most.
CALL_BLOCKS = 4
#: Share of the squares that the partial sum's coordinates carry at least.
SHARE = 0.7
#: Integers beyond this could overflow a score.
LARGEST = 1 << 26


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id`` and ``v``, floor(64 x) of every component; rows with a null id, a null vector or a
    null, NaN or infinite component are left out.  Rows of one vec_id count once, by the smallest
    vector; shorter vectors are filled with zeros later."""
    scaled = F.transform(embedding, lambda x: F.floor(x.cast("double") * 64).cast("long"))
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x)
                    & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return (
        vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & fine)
        .select(F.col(vec_id).cast("long").alias("vec_id"), scaled.alias("v"))
        .groupBy("vec_id").agg(F.min("v").alias("v"))
    )


def top_k(
    vectors: DataFrame, is_query: str, k: int = 20, block: int = BLOCK, queries: int = QUERIES
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: of every row of ``vectors`` (from
    ``quantised``) that the SQL condition ``is_query`` picks, the k highest inner products with all
    other rows; ties go to the smaller vec_id.  Fewer candidates than k: all.  No rows: none.
    """
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") ** 2))
    rows = written(vectors.withColumn("length", length), "vectors")
    width = rows.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    d, largest = int(width[0] or 0), int(width[1] or 0)
    schema = "query_id long, rank int, vec_id long, score long"
    if d == 0:
        return vectors.sparkSession.createDataFrame([], schema)
    if largest > LARGEST:
        raise ValueError(f"a component of {largest} could overflow the scores")
    search = _Search(d, k, *_rotation(rows, d))
    n_queries = rows.where(is_query).count()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, -(-n_queries // max(64, min(queries, -(-n_queries // parts)))))
    # the longest vectors: bounded, and real candidates, so their k-th score bounds every query's
    head = rows.orderBy(F.desc("length"), "vec_id").limit(HEAD).collect()
    search.head = (np.array([r.vec_id for r in head]), search.matrix([r.v for r in head]))
    asked = rows.where(is_query).withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))
    asked = written(asked.select("g", "vec_id", "v").mapInArrow(
        search.bound, "g int, vec_id long, v array<long>, least double, kth long"), "queries")
    packed = rows.repartitionByRange("length").sortWithinPartitions(F.desc("length"), "vec_id")
    packed = packed.withColumn("part", F.spark_partition_id()).select("vec_id", "length", "v", "part")
    # c: neighbouring blocks, as many as one call holds
    packed = written(packed.mapInArrow(
        search.pack(block), "c long, longest double, ids binary, vs binary"), "blocks")
    # a block goes to the groups in which some query's bound its longest vector can reach
    bounds = asked.groupBy("g").agg(F.min(F.col("least")).alias("reach"))
    spread = packed.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    pairs = spread.join(bounds, "g").where("longest >= reach").select(
        "g", "c", "longest", "ids", "vs")
    calls = pairs.select(F.col("g").alias("g"), F.col("c").alias("c")).distinct()
    sent = asked.join(calls, "g").select("g", "c", "vec_id", "v", "kth")
    found = sent.groupBy("g", "c").cogroup(pairs.groupBy("g", "c")).applyInArrow(
        lambda asked, blocks: search.run(asked, blocks), schema)
    # the k best of each call, then of all calls
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found


def _rotation(rows: DataFrame, d: int) -> tuple[np.ndarray, int]:
    """Right singular vectors, largest first, from the sums of products (d by d); and the number of
    coordinates that carry SHARE of the squares."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            x = _dense(batch.column(0), d).astype(float)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(d * d, dtype=np.int32)), pa.array(total.ravel())], names=["i", "s"])

    sums = rows.select("v").mapInArrow(products, "i int, s double").groupBy("i").agg(F.sum("s").alias("s"))
    gram = np.zeros(d * d)
    for row in sums.collect():
        gram[row.i] = row.s
    values, axes = np.linalg.eigh(gram.reshape(d, d))
    values, axes = np.maximum(values[::-1], 0), axes[:, ::-1]
    share = np.cumsum(values) / max(values.sum(), 1e-300)
    return axes, int(min(d, 1 + np.searchsorted(share, SHARE)))


def _dense(column: pa.Array, d: int) -> np.ndarray:
    """Lists of longs as rows of d numbers, zeros after a list's end."""
    size = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten())
    if len(size) and (size == d).all():
        return flat.reshape(-1, d)
    out = np.zeros((len(size), d), np.int64)
    out[np.arange(d) < size[:, None]] = flat
    return out


class _Search:
    def __init__(self, d: int, k: int, axes: np.ndarray, kept: int):
        self.d, self.k, self.axes, self.kept = d, k, axes, kept
        self.head: tuple[np.ndarray, np.ndarray] | None = None

    def matrix(self, rows: list) -> np.ndarray:
        out = np.zeros((len(rows), self.d), np.int64)
        for i, row in enumerate(rows):
            out[i, : len(row)] = row
        return out

    def bound(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The length that a candidate needs at least to reach the query's k-th score in the head, and
        that score."""
        ids, vectors = self.head
        for batch in batches:
            q, own = _dense(batch.column(2), self.d), batch.column(1).to_numpy(zero_copy_only=False)
            least = np.full(len(q), -np.inf)
            known = np.full(len(q), np.iinfo(np.int64).min)
            for i in range(len(q)):
                scores = (vectors @ q[i])[ids != own[i]]
                length = np.sqrt(float((q[i].astype(float) ** 2).sum()))
                if len(scores) >= self.k and length:
                    kth = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
                    known[i] = kth
                    least[i] = kth / length * (1 - 1e-9) if kth > 0 else -np.inf
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(least),
                 pa.array(known)], names=["g", "vec_id", "v", "least", "kth"])

    def pack(self, block: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n, done = [], 0, 0
            for batch in batches:
                held.append(batch)
                n += batch.num_rows
                if n >= block:
                    made = self._blocks(held, block, done)
                    done += made.num_rows
                    yield made
                    held, n = [], 0
            if held and n:
                yield self._blocks(held, block, done)

        return run

    def _blocks(self, held: list[pa.RecordBatch], block: int, done: int) -> pa.RecordBatch:
        """Blocks, numbered by their Spark partition and, ``done`` of them before, their place."""
        table = pa.Table.from_batches(held).combine_chunks()
        ids = table.column(0).to_numpy()
        length = table.column(1).to_numpy()
        v = _dense(table.column(2).combine_chunks() if table.num_rows else table.column(2), self.d)
        cuts = range(0, len(ids), block)
        part = table.column(3)[0].as_py() << 32
        return pa.RecordBatch.from_arrays(
            [pa.array([part + (done + i) // CALL_BLOCKS for i in range(len(cuts))], pa.int64()),
             pa.array([float(length[c]) for c in cuts], pa.float64()),
             pa.array([ids[c : c + block].astype("<i8").tobytes() for c in cuts], pa.binary()),
             pa.array([v[c : c + block].astype("<i4").tobytes() for c in cuts], pa.binary())],
            names=["c", "longest", "ids", "vs"])

    def run(self, asked: pa.Table, blocks: pa.Table) -> pa.Table:
        """The queries of a group against some blocks that reached it, longest vectors first."""
        query = asked.column("vec_id").to_numpy()
        q = _dense(pa.concat_arrays(asked.column("v").chunks) if asked.num_rows
                   else pa.array([], pa.list_(pa.int64())), self.d)
        order = np.argsort(-blocks.column("longest").to_numpy(), kind="stable") if blocks.num_rows else []
        known = asked.column("kth").to_numpy().astype(float)  # k other vectors have it: less is of no use
        best_score = np.full((len(query), self.k), np.iinfo(np.int64).min)
        best_id = np.full((len(query), self.k), np.iinfo(np.int64).max)
        rotated = q.astype(float) @ self.axes
        q_length = np.sqrt((rotated**2).sum(1))
        q_rest = np.sqrt(np.maximum((rotated[:, self.kept :] ** 2).sum(1), 0))
        ids, vs = blocks.column("ids"), blocks.column("vs")
        for b in order:
            longest = blocks.column("longest")[int(b)].as_py()
            kth = np.maximum(best_score[:, -1].astype(float), known)
            alive = np.flatnonzero(q_length * longest * (1 + 1e-9) + 1e-6 >= kth)
            if not len(alive):
                break  # all further vectors are shorter still
            name = np.frombuffer(ids[int(b)].as_py(), "<i8")
            v = np.frombuffer(vs[int(b)].as_py(), "<i4").reshape(-1, self.d)
            by_id = np.argsort(name, kind="stable")
            name, v = name[by_id], v[by_id].astype(np.int64)
            turned = v.astype(float) @ self.axes
            rest = np.sqrt(np.maximum((turned[:, self.kept :] ** 2).sum(1), 0))
            most = rotated[alive, : self.kept] @ turned[:, : self.kept].T
            most += q_rest[alive][:, None] * rest
            most += 1e-9 * q_length[alive][:, None] * longest + 1e-6
            for row, i in enumerate(alive):
                some = np.flatnonzero((most[row] >= kth[i]) & (name != query[i]))
                if len(some):
                    self._merge(best_score[i], best_id[i], v[some] @ q[i], name[some])
        filled = best_id != np.iinfo(np.int64).max
        filled |= best_score != np.iinfo(np.int64).min
        rows, ranks = np.nonzero(filled)
        return pa.table({
            "query_id": pa.array(query[rows]), "rank": pa.array((ranks + 1).astype(np.int32)),
            "vec_id": pa.array(best_id[rows, ranks]), "score": pa.array(best_score[rows, ranks])})

    def _merge(self, best_score, best_id, scores, names) -> None:
        scores, names = np.concatenate([best_score, scores]), np.concatenate([best_id, names])
        order = np.lexsort((names, ~scores))[: self.k]
        best_score[:], best_id[:] = scores[order], names[order]
