"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within a radius of four bits share a variant that differs from each in two bits
or fewer.  Every fingerprint therefore emits its 2,081 variants; fingerprints that meet at a
variant are linked, and being within two bits of it they are within four of each other.

Variants are dealt out by their cell: the parities of classes of bits.  All variants of one
fingerprint in one cell follow from the fingerprint and the cell, so that the shuffle carries one
row for each cell that a fingerprint reaches, and the cell's task makes the variants themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from wayside.llm.common import giving_back, map_texts, written
from wayside.llm.components import components

SHINGLE_WORDS, SEED, BITS = 4, 42, 64
#: Links join fingerprints at this many differing bits or fewer; variants differ in half as many.
RADIUS = 4
#: Variants that a task holds at a time, and the mean number aimed at for a cell.
HELD, PER_CELL = 4_000_000, 1_000_000


def fingerprint(text: str | None) -> int:
    """Words split at ASCII white space after lower-casing A-Z; a bit is 1 if over half of the
    shingles' XXH64 have it.  No words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    begins = (ends - size).tolist()
    last = min(SHINGLE_WORDS, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    total = np.zeros(BITS, np.int64)
    n = len(words) - last
    stops = ends[last:].tolist()
    for first in range(0, n, 50_000):
        some = range(first, min(n, first + 50_000))
        h = np.fromiter((digest(joined[begins[i] : stops[i]], SEED) for i in some), np.uint64,
                        len(some))
        bits = np.unpackbits(h.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, BITS)
        total += bits.sum(0, dtype=np.int32)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``fp``, the fingerprint of the whole text as a signed long (null text: as empty)."""

    def compute(texts: list) -> list[pa.Array]:
        return [pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))]

    return map_texts(docs, text, docs.columns if keep is None else keep,
                     [T.StructField("fp", T.LongType())], lambda: compute)


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hexadecimal digits) and ``component_id``, the smallest
    doc_id that links reach, for every row of ``docs``.

    Equal fingerprints, those of empty texts (zero) included, are one group.  A null doc_id gets
    its group's id, null if the group has no other; repeated rows are returned as often as they
    come.  Only distinct fingerprints are compared, so copies cost nothing.
    """
    coded = with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")),
                             "text", keep=["doc_id"])
    coded = written(coded, "fingerprints")
    prints = coded.groupBy("fp").agg(F.min("doc_id").alias("least"))
    groups = components(links(prints.select("fp")))
    own = prints.join(groups.withColumnRenamed("node", "fp"), "fp")
    roots = own.groupBy("component").agg(F.min("least").alias("root"))
    linked = own.join(roots, "component").select("fp", "root")
    # a written table: a frequent fingerprint's rows can then be split in the last join
    group = written(prints.join(linked, "fp", "left").select(
        "fp", F.coalesce("root", "least").alias("component_id")), "groups")
    return coded.join(group, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def links(prints: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints (longs, column ``fp``) that join exactly
    those that a chain of links joins; not every link is listed.  Nulls link to nothing."""
    prints = written(prints.where("fp is not null").distinct(), "prints")
    classes = class_count(prints.count())
    spread = _Spread(classes)
    cells = prints.mapInArrow(giving_back(spread.emit), "cell int, fp long")
    met = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(
        giving_back(spread.meet), "a long, b long")
    return met.distinct()


def class_count(n: int) -> int:
    """Classes of bits, so many that a cell has PER_CELL variants in the mean; at least 10."""
    classes = 10
    while classes < 30 and _ball(BITS) * n > PER_CELL << classes:
        classes += 2
    return classes


def _ball(bits: int) -> int:
    return 1 + bits + bits * (bits - 1) // 2


class _Spread:
    """How fingerprints reach cells: bit i belongs to class i modulo the number of classes."""

    def __init__(self, classes: int):
        self.classes = classes
        of = [[1 << b for b in range(BITS) if b % classes == c] for c in range(classes)]
        #: by the classes whose parity changes: the bits that a variant flips
        self.flips: dict[int, np.ndarray] = {
            0: np.array([0] + [x | y for c in of for x, y in combinations(c, 2)], np.uint64)
        }
        for c in range(classes):
            self.flips[1 << c] = np.array(of[c], np.uint64)
        for c, d in combinations(range(classes), 2):
            self.flips[1 << c | 1 << d] = np.array([x | y for x in of[c] for y in of[d]], np.uint64)
        self.masks = [np.uint64(sum(c)) for c in of]

    def home(self, fp: np.ndarray) -> np.ndarray:
        """The cell of the fingerprint itself."""
        cell = np.zeros(len(fp), np.int32)
        for c, mask in enumerate(self.masks):
            cell |= (np.bitwise_count(fp & mask) & 1).astype(np.int32) << c
        return cell

    def emit(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached = np.array(list(self.flips), np.int32)
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            cells = self.home(fp.view(np.uint64))[:, None] ^ reached
            for first in range(0, len(fp), 5_000):
                part = cells[first : first + 5_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.ravel()), pa.array(np.repeat(fp[first : first + 5_000], len(reached)))],
                    names=["cell", "fp"],
                )

    def meet(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        for cell, fp in _runs(batches):
            for a, b in self.collisions(cell, fp):
                forest.join(a, b)
            if len(forest.parent) > 200_000:
                yield from forest.drain()
        yield from forest.drain()

    def collisions(self, cell: int, fp: np.ndarray) -> Iterator[tuple[int, int]]:
        """Pairs of fingerprints that meet at a variant in the cell: each with the smallest there."""
        changed = np.int32(cell) ^ self.home(fp)
        kinds = [(k, fp[changed == k]) for k in np.unique(changed).tolist()]
        total = sum(len(self.flips[k]) * len(some) for k, some in kinds)
        parts = -(-total // HELD)  # a crowded cell is taken in parts, by a hash of the variant
        for part in range(parts):
            variants, owners = [], []
            for k, some in kinds:
                for first in range(0, len(some), 1 + HELD // len(self.flips[k])):
                    own = some[first : first + 1 + HELD // len(self.flips[k])]
                    made = (own[:, None] ^ self.flips[k]).ravel()
                    owner = np.repeat(own, len(self.flips[k]))
                    if parts > 1:
                        chosen = (made * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(
                            parts) == part
                        made, owner = made[chosen], owner[chosen]
                    variants.append(made)
                    owners.append(owner)
            yield from _pairs(np.concatenate(variants), np.concatenate(owners))


def _pairs(variant: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, int]]:
    ordered = np.sort(variant)
    repeated = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(repeated):
        return
    at = np.minimum(np.searchsorted(repeated, variant), len(repeated) - 1)
    among = repeated[at] == variant
    at, owner = at[among], owner[among]
    order = np.lexsort((owner, at))
    at, owner = at[order], owner[order]
    begins = np.concatenate([[True], at[1:] != at[:-1]])
    least = owner[np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))]
    pairs = np.unique(np.stack([least, owner], 1)[least != owner], axis=0)
    close = np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= RADIUS
    yield from pairs[close].tolist()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """The fingerprints of each cell, from rows that are sorted by cell."""
    held, now = [], None
    for batch in batches:
        cell = batch.column(0).to_numpy(zero_copy_only=False)
        fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]])
        for start, stop in zip(cuts[:-1], cuts[1:]):
            if stop == start:
                continue
            if held and cell[start] != now:
                yield now, np.concatenate(held)
                held = []
            now = cell[start]
            held.append(fp[start:stop])
    if held:
        yield now, np.concatenate(held)


class _Forest:
    """Union-find that gives back one edge to the root for every other node."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(up, up)
            x = up
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def drain(self) -> Iterator[pa.RecordBatch]:
        nodes = [x for x in self.parent if self.root(x) != x]
        if nodes:
            a = np.array(nodes, np.uint64).view(np.int64)
            b = np.array([self.root(x) for x in nodes], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        self.parent = {}
