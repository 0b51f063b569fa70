"""Alignment of two tokenizers by pointer jumping.

A is a byte-level BPE with ranks, B a sentencepiece model with byte fallback that puts a space
before the text; A reads the text behind a space too.  Every token points to the token of the other
tokenizer that overlaps it and reaches farthest to the right.  Following pointers in doublings,
every token arrives at the last token of its component, whose number labels a group: the tokens
between two byte offsets at which both tokenizers end a token.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from wayside.llm.common import giving_back, slices, written
from wayside.llm.vocabulary import encoding, space_led, token_bytes

#: Distinct parts of texts that a task remembers, and bytes of text that make up a unit.
MOST_PARTS, UNIT_BYTES = 60_000, 1 << 20
#: A link's key is the A id times this number plus the B id.
KEY = 1 << 24
#: Pairs of a group beyond which its ids are made distinct before they are paired.
PAIRS_AS_THEY_ARE = 64


def aligned(
    docs: DataFrame,
    ranks: str,
    pattern: str,
    model: str,
    text: str = "text",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add to every row ``n_a``, ``n_b``, ``n_groups``, ``n_links`` (long) and ``groups``, a string
    ``a1,a2|b1;a3|b2,b3`` of the ids of A and B group by group.

    Special tokens are not recognised inside texts.  Null and empty texts, and texts whose tokens of
    A or B do not join to the bytes of the text behind a space, have no tokens: zeros and ''.  Rows
    are not merged or dropped, repeated rows are aligned alike, other columns pass through and those
    of new names give way.

    Four more columns are for ``with_link_counts``: ``unit`` numbers the slice of a task that the
    row was in; ``pair`` (32-bit integers) and ``times`` (64-bit) say which of the unit's distinct id
    pairs the row links, and how often; ``pairs``, in a unit's first row only, lists the unit's pairs
    ascending with the number of its rows that hold each.
    """
    new = T.StructType.fromDDL(
        "n_a long, n_b long, n_groups long, n_links long, groups string, unit long, pair binary,"
        " times binary, pairs array<struct<pair: long, rows: long>>")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new.names]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("_text_"))
    position = len(kept)
    schema = T.StructType([*source.schema.fields[:position], *new.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = Parts(ranks, pattern, model)
        unit = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column(position)
            for start, stop in slices(texts, UNIT_BYTES):
                old = [batch.column(i).slice(start, stop - start) for i in range(position)]
                columns = _unit(parts, texts.slice(start, stop - start).to_pylist(), unit)
                unit += 1
                yield pa.RecordBatch.from_arrays([*old, *columns], names=schema.names)

    return source.mapInArrow(giving_back(run), schema)


def with_link_counts(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep``, ``n_best`` and ``count_sum`` for the rows of a written ``aligned`` table.

    An id pair's count is the number of rows that link it.  ``n_best`` counts the links of a row
    whose pair has the highest count of its A id, ties included; ``count_sum`` adds up the counts.
    Pairs are counted within units first and asked for once per unit, so that a common pair is one
    row per unit, not one per document.
    """
    asked = rows.select("unit", F.explode("pairs").alias("p")).select("unit", "p.pair", "p.rows")
    counts = asked.groupBy("pair").agg(F.sum("rows").alias("count"))
    # at most as many rows of one A id as B has ids
    of_a = Window.partitionBy(F.expr(f"pair div {KEY}"))
    counts = counts.withColumn("best", F.col("count") == F.max("count").over(of_a))
    counts = written(counts, "pair-counts")
    answered = asked.select(F.col("unit").alias("of"), "pair").join(counts, "pair")
    held = rows.select("unit", "pair", "times", *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)])
    schema = T.StructType([
        *[rows.schema[c] for c in keep],
        T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("pair")
        times, best = right["count"].to_numpy(), right["best"].to_numpy(zero_copy_only=False)
        n_best, total = [], []
        for pair, often in zip(left["pair"].to_pylist(), left["times"].to_pylist()):
            at, n = np.frombuffer(pair, np.int32), np.frombuffer(often, np.int64)
            n_best.append(int(n[best[at]].sum()))
            total.append(int((n * times[at]).sum()))
        own = [left[f"_{i}"] for i in range(len(keep))]
        return pa.Table.from_arrays([*own, pa.array(n_best, pa.int64()), pa.array(total, pa.int64())],
                                    names=schema.names)

    return held.groupBy("unit").cogroup(answered.groupBy("of")).applyInArrow(count, schema)


@lru_cache(maxsize=1)
def piece_bytes(model: str) -> tuple[sentencepiece.SentencePieceProcessor, list[bytes]]:
    """The model of B and the bytes of each of its pieces; control and unknown pieces have none."""
    loaded = sentencepiece.SentencePieceProcessor(model_file=model)
    table = []
    for i in range(loaded.get_piece_size()):
        piece = loaded.id_to_piece(i)
        if loaded.is_byte(i):
            table.append(bytes([int(piece[3:5], 16)]))
        elif loaded.is_control(i) or loaded.is_unknown(i):
            table.append(b"")
        else:
            table.append(piece.replace("▁", " ").encode())
    return loaded, table


class Parts:
    """Texts cut where neither tokenizer's tokens reach across, each distinct part aligned once.

    A space after something else than white space begins a token in both: the pattern of A says so,
    and no piece of B has a space but at its beginning.  So groups do not reach across either.
    """

    def __init__(self, ranks: str, pattern: str, model: str):
        self.a = encoding(ranks, pattern).encode_ordinary
        self.a_bytes = token_bytes(ranks)
        self.b, self.b_bytes = piece_bytes(model)
        if any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(len(self.b_bytes))):
            raise ValueError("pieces of the model reach across spaces")
        self.blank = self.b.piece_to_id("▁")
        self.length_a = np.zeros(max(self.a_bytes) + 1, np.int64)
        self.length_a[list(self.a_bytes)] = [len(b) for b in self.a_bytes.values()]
        self.length_b = np.array([len(b) for b in self.b_bytes])
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.groups: list[bytes] = []
        #: By part: tokens of A, of B, groups, links, whether tokens join to the part, pairs' end.
        self.figures = [array("q") for _ in range(5)]
        self.end = array("q", [0])
        self.pairs, self.times = array("q"), array("q")

    def of(self, texts: list[list[str]]) -> np.ndarray:
        """Numbers of the parts of all texts, one after another; new parts are aligned."""
        index, known = self.index, len(self.index)
        numbers = np.fromiter(
            (index.setdefault(p, len(index)) for parts in texts for p in parts),
            np.int64, sum(map(len, texts)))
        if len(index) > known:
            self._align(list(index)[known:])
        return numbers

    def _align(self, parts: list[str]) -> None:
        a = [self.a(" " + p) for p in parts]
        b = [ids if p else [self.blank] for p, ids in zip(parts, self.b.encode(parts, num_threads=1))]
        whole = [(" " + p).encode("utf-8", "surrogatepass") for p in parts]
        good = [b"".join(map(self.a_bytes.__getitem__, x)) == w == b"".join(map(self.b_bytes.__getitem__, y))
                for x, y, w in zip(a, b, whole)]
        a, b = ([x if g else [] for x, g in zip(some, good)] for some in (a, b))
        n_a, n_b = (np.fromiter(map(len, some), np.int64, len(some)) for some in (a, b))
        ids_a, ids_b = (np.fromiter((i for x in some for i in x), np.int64, n.sum())
                        for some, n in ((a, n_a), (b, n_b)))
        end_a, end_b = np.cumsum(self.length_a[ids_a]), np.cumsum(self.length_b[ids_b])
        last_a, last_b = group_ends(end_a, end_b)
        in_a, in_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        part = np.repeat(np.arange(len(parts)), n_a)[last_a]  # of each group
        groups = np.bincount(part, minlength=len(parts))
        links = np.bincount(part, in_a * in_b, len(parts)).astype(np.int64)
        for kept, values in zip(self.figures, (n_a, n_b, groups, links, np.array(good, np.int64))):
            kept.frombytes(values.astype(np.int64).tobytes())
        text_a, text_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        stop_a, stop_b = (last_a + 1).tolist(), (last_b + 1).tolist()
        shown = [",".join(text_a[i:j]) + "|" + ",".join(text_b[k:m]) for i, j, k, m in zip(
            [0, *stop_a], stop_a, [0, *stop_b], stop_b)]
        at = 0
        for n in groups.tolist():
            self.groups.append(";".join(shown[at : at + n]).encode())
            at += n
        key, times, owner = _pairs(ids_a, ids_b, last_a, last_b, part)
        self.end.frombytes((self.end[-1] + np.cumsum(np.bincount(owner, minlength=len(parts)))).tobytes())
        self.pairs.frombytes(key.tobytes())
        self.times.frombytes(times.tobytes())


def group_ends(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each group the number of its last token in A and in B.

    ``end_a`` and ``end_b`` are the byte offsets, ascending, at which tokens end; both end alike.
    Tokens of B are numbered after those of A.  A token points to the token of the other tokenizer
    that holds its last byte, if that one ends later; of two that end together A's points to B's,
    which is the terminal of its component.
    """
    n = len(end_a)
    on_b, on_a = np.searchsorted(end_b, end_a), np.searchsorted(end_a, end_b)
    own = n + np.arange(len(end_b))
    later = end_a[on_a] > end_b if n else np.zeros(0, bool)
    to = np.concatenate([n + on_b, np.where(later, on_a, own)])
    while True:
        after = to[to]
        if (after == to).all():
            break
        to = after
    terminal = np.unique(to[n:])
    return np.searchsorted(end_a, end_b[terminal - n]), terminal - n


def _pairs(
    ids_a: np.ndarray, ids_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, part: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of linked ids by part: keys, how often, and parts ascending."""
    first_a, first_b = np.concatenate([[0], last_a[:-1] + 1]), np.concatenate([[0], last_b[:-1] + 1])
    in_a, in_b = last_a + 1 - first_a, last_b + 1 - first_b
    few = in_a * in_b <= PAIRS_AS_THEY_ARE
    count = (in_a * in_b)[few]
    group = np.repeat(np.flatnonzero(few), count)
    at = np.arange(len(group)) - np.repeat(np.cumsum(count) - count, count)
    keys = [ids_a[first_a[group] + at // in_b[group]] * KEY + ids_b[first_b[group] + at % in_b[group]]]
    owners, often = [part[group]], [np.ones(len(group), np.int64)]
    for g in np.flatnonzero(~few).tolist():  # each A id of the group with each of its B ids
        a, times_a = np.unique(ids_a[first_a[g] : last_a[g] + 1], return_counts=True)
        b, times_b = np.unique(ids_b[first_b[g] : last_b[g] + 1], return_counts=True)
        keys.append((a[:, None] * KEY + b).ravel())
        often.append((times_a[:, None] * times_b).ravel())
        owners.append(np.full(len(keys[-1]), part[g]))
    return _summed(np.concatenate(keys), np.concatenate(often), np.concatenate(owners))


def _summed(key: np.ndarray, times: np.ndarray, owner: np.ndarray):
    """Equal keys of an owner added up; ascending by owner, then key."""
    order = np.lexsort((key, owner))
    key, times, owner = key[order], times[order], owner[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    if len(key):
        times = np.add.reduceat(times, np.flatnonzero(first))
    return key[first], times, owner[first]


def _unit(parts: Parts, texts: list, unit: int) -> list[pa.Array]:
    if len(parts.index) > MOST_PARTS:
        parts.clear()
    cut = [space_led(t) if t else [] for t in texts]
    numbers = parts.of(cut)
    n = len(texts)
    doc = np.repeat(np.arange(n), np.fromiter(map(len, cut), np.int64, n))
    figures = [np.frombuffer(f, np.int64) for f in parts.figures]
    bad = np.zeros(n, bool)
    bad[doc[figures[4][numbers] == 0]] = True
    totals = [np.bincount(doc, f[numbers], n).astype(np.int64) * ~bad for f in figures[:4]]
    begin = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]).tolist()
    listed, shown = numbers.tolist(), parts.groups
    groups = [b"" if skip else b";".join([shown[k] for k in listed[i:j]])
              for i, j, skip in zip(begin, begin[1:], bad.tolist())]
    # distinct parts of each text, then the distinct pairs of these
    good = ~bad[doc]
    part, often, of = _summed(numbers[good], np.ones(int(good.sum()), np.int64), doc[good])
    end, keys, times = (np.frombuffer(x, np.int64) for x in (parts.end, parts.pairs, parts.times))
    size = end[part + 1] - end[part]
    where = np.repeat(end[part] - np.cumsum(size) + size, size) + np.arange(size.sum())
    distinct, pair = np.unique(keys[where], return_inverse=True)
    pair, often, of = _summed(pair, times[where] * np.repeat(often, size), np.repeat(of, size))
    held = np.bincount(pair, minlength=len(distinct))
    cuts = np.searchsorted(of, np.arange(n + 1)).tolist()
    pair = pair.astype(np.int32)
    listing = pa.ListArray.from_arrays(
        pa.array([0] + [len(distinct)] * n, pa.int32()),
        pa.StructArray.from_arrays([pa.array(distinct, pa.int64()), pa.array(held, pa.int64())],
                                   names=["pair", "rows"]))
    return [
        *[pa.array(t, pa.int64()) for t in totals],
        pa.array([g.decode() for g in groups], pa.string()),
        pa.array(np.full(n, unit), pa.int64()),
        pa.array([pair[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary()),
        pa.array([often[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary()),
        listing,
    ]
