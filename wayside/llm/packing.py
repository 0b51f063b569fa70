"""Packing by minimum bin slack.

Documents are cut into whole windows and a rest.  For each further window the longest rest is
taken, and a subset-sum dynamic programme over the multiset of remaining lengths, kept as the bits
of one integer, finds the rests that fill the window closest to its capacity.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from wayside.llm.common import giving_back, slices
from wayside.llm.vocabulary import PartIds

CAPACITY = 1024
#: Ids that a task packs together; what is left of them fills windows of powers of two.
BLOCK_IDS = 4_000_000
END_ID = 0

SCHEMA = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long,"
          " offset long")


def pack(
    docs: DataFrame,
    ranks: str,
    pattern: str,
    text: str = "text",
    doc_id: str = "doc_id",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    block_ids: int = BLOCK_IDS,
    special_tokens: Mapping[str, int] | None = None,
) -> DataFrame:
    """Pieces of the documents' ids, packed into sequences of at most ``capacity`` ids.

    Each document is the ids of its whole text (null: none) and ``end_id``.  A row is a piece:
    ``start`` ids of its document come before it, ``offset`` ids of its sequence, without gaps.
    ``ids`` are little-endian 32-bit integers.  ``special_tokens`` are strings that have an id of
    their own wherever they stand in a text; without them they are text like any other.  Sequences are full, or as long as a power of two.
    A null doc_id and repeated rows are packed like any other row.  Tasks pack their own rows, in
    blocks of about ``block_ids`` ids; a longer document is a block alone.  An executor's loss
    repeats whole tasks, whose numbering starts from the task's own number.
    """
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = PartIds(ranks, pattern, special_tokens)
        end = np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 33
        block: list[tuple[int | None, bytes]] = []
        held = 0
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                names = batch.column(0).slice(start, stop - start).to_pylist()
                for name, t in zip(names, batch.column(1).slice(start, stop - start).to_pylist()):
                    ids = parts.of_text(t) + end
                    block.append((name, ids))
                    held += len(ids) // 4
                    if held >= block_ids:
                        rows, sequence = _pieces(block, capacity, sequence)
                        yield rows
                        block, held = [], 0
        if block:
            yield _pieces(block, capacity, sequence)[0]

    return source.mapInArrow(giving_back(run), SCHEMA)


def _pieces(block: list, capacity: int, sequence: int) -> tuple[pa.RecordBatch, int]:
    sizes = [len(ids) // 4 for _, ids in block]
    doc, start, length, number, offset = [], [], [], [], []
    for members in sequences(sizes, capacity):
        at = 0
        for d, s, n in members:
            doc.append(d)
            start.append(s)
            length.append(n)
            number.append(sequence)
            offset.append(at)
            at += n
        sequence += 1
    ids = [block[d][1][4 * s : 4 * (s + n)] for d, s, n in zip(doc, start, length)]
    long = pa.int64()
    columns = [
        pa.array([block[d][0] for d in doc], long), pa.array(start, long), pa.array(length, long),
        pa.array(ids, pa.binary()), pa.array([sizes[d] for d in doc], long),
        pa.array(number, long), pa.array(offset, long),
    ]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays(columns, names=names), sequence


def sequences(sizes: list[int], capacity: int) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of pieces ``(document, start, length)`` that hold every id once.  All have
    ``capacity`` ids but the last few, whose lengths are different powers of two."""
    rests: dict[int, list[tuple[int, int]]] = {}
    for d, n in enumerate(sizes):
        whole = n - n % capacity
        for s in range(0, whole, capacity):
            yield [(d, s, capacity)]
        if n > whole:
            rests.setdefault(n - whole, []).append((d, whole))
    left = sum(n * len(some) for n, some in rests.items())

    def take(n: int) -> tuple[int, int, int]:
        d, s = rests[n].pop()
        if not rests[n]:
            del rests[n]
        return d, s, n

    while left >= capacity:
        members = [take(max(rests))]
        room = capacity - members[0][2]
        counts = best_fill(rests, room)
        for n, times in counts.items():
            members.extend(take(n) for _ in range(times))
            room -= n * times
        if room:  # no subset fills the window: the longest rest is cut
            d, s, n = take(max(rests))
            members.append((d, s, room))
            rests.setdefault(n - room, []).append((d, s + room))
        left -= capacity
        yield members
    yield from _by_powers([take(n) for n in sorted(rests, reverse=True) for _ in range(len(rests[n]))])


def best_fill(rests: dict[int, list], room: int) -> dict[int, int]:
    """How many of each length fill ``room`` best: bit t of ``reach`` says that t is a sum of what
    was offered so far.  Counts are offered in powers of two; the way back finds those used."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for n in sorted((n for n in rests if n <= room), reverse=True):
        count, times = min(len(rests[n]), room // n), 1
        while count and not reach >> room & 1:
            times = min(times, count)
            steps.append((n, times, reach))
            reach |= reach << n * times & mask
            count -= times
            times *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for n, times, before in reversed(steps):
        if not before >> at & 1:
            used[n] = used.get(n, 0) + times
            at -= n * times
    return used


def _by_powers(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    total = sum(n for _, _, n in pieces)
    pieces = pieces[::-1]
    while total:
        room = 1 << total.bit_length() - 1
        total -= room
        members = []
        while room:
            d, s, n = pieces.pop()
            used = min(n, room)
            members.append((d, s, used))
            if n > used:
                pieces.append((d, s + used, n - used))
            room -= used
        yield members
