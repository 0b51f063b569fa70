"""Removal of long repeats with run-length compressed Burrows-Wheeler indexes.

A byte goes if a 100-byte string covers it that also starts earlier, in a smaller doc_id or before
it in the same document.  Repeats are found in these steps:

1. Anchors.  Of every 100-byte window the 24-byte string with the smallest hash is an anchor.  Equal
   windows have equal anchors at the same place, so that only texts around equal anchors have to
   meet.  An anchor's context is what the windows around it can cover.
2. Equal contexts.  Where anchor and context both occur before, the whole context is a repeat.  This
   settles the inside of repeats; what stays are the first occurrences of different contexts of
   one anchor, at the edges of repeats.
3. Index.  These contexts are dealt out by their anchor.  Each task builds run-length compressed
   transforms of them and samples the earliest start of every string of 100 bytes that occurs more
   than once.  It then streams the contexts through the index backwards and marks where a match of
   100 bytes has an earlier start.
4. The marks of a document are merged and cut out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from wayside.llm.common import giving_back, slices, written

#: Bytes of a repeat, bytes of an anchor.
LENGTH, ANCHOR = 100, 24
#: Bytes of context that one index holds, about.
INDEX_BYTES = 1 << 19
#: Different contexts of an anchor from which they are dealt out by what the windows share.
FREQUENT = 4_096
#: Neighbouring window starts that are dealt out together then.
STEP = 8

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_FIRST = -(1 << 63)


def remove_repeats(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    length: int = LENGTH,
    frequent: int = FREQUENT,
    keep: list[str] | None = None,
    as_text: bool = False,
) -> DataFrame:
    """The columns ``keep`` (all but the text), and ``n_bytes``, ``kept`` (the remaining bytes;
    ``as_text`` as a string, without cut characters), ``spans`` (start and end of every maximal
    removed run).

    Texts are UTF-8 bytes, null ones empty; shorter ones than ``length`` lose nothing.  A null
    doc_id is smaller than any other.  Rows that repeat a doc_id with other text are documents in
    the order of a hash of their text; rows that repeat both are one document, and lose the same.
    Nothing depends on how often a string repeats: copies in a task are settled there, and frequent
    anchors are dealt out by more of their context.
    """
    taken = {"n_bytes", "kept", "spans"}
    kept = [c for c in (docs.columns if keep is None else keep) if c not in taken and c != text]
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(_FIRST))
    tie = F.xxhash64(F.coalesce(F.col(text), F.lit(""))).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    source = docs.select(key.alias("doc"), F.col(text).alias("text"), tie.alias("tie"),
                         F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    finder = _Finder(length, frequent)
    anchors = source.select("doc", "tie", "text").mapInArrow(
        giving_back(finder.anchors), "h long, c long, doc long, at long, reach int")
    met = anchors.repartition(F.coalesce("h", "c")).sortWithinPartitions("h", "c", "doc", "at").mapInArrow(
        giving_back(finder.equal_contexts), "h long, doc long, at long, reach int, often boolean")
    met = written(met, "contexts")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # both joins below read the same exchange: texts move once
    document = ["doc", "tie"]
    placed = source.repartition(parts, *document)
    own = F.shiftright("at", 32).cast("int").alias("tie")
    wanted = met.where("h is not null").groupBy("doc", own).agg(
        F.collect_list(F.struct("h", "at", "reach", "often")).alias("wanted"))
    contexts = placed.join(wanted, document).select("doc", "tie", "text", "row", "wanted").mapInArrow(
        giving_back(finder.contexts), "g long, doc long, at long, reach int, context binary")
    found = contexts.repartition("g").sortWithinPartitions("g").mapInArrow(
        giving_back(finder.index), "doc long, at long, reach int")
    marks = met.where("h is null").select("doc", "at", "reach").unionByName(found)
    marks = marks.groupBy("doc", own).agg(F.collect_list(F.struct("at", "reach")).alias("marks"))
    joined = placed.join(marks, document, "left").select("row", "tie", "text", "marks")
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    kind = T.StringType() if as_text else T.BinaryType()
    removed = joined.mapInArrow(giving_back(lambda batches: _cut_out(batches, as_text)), T.StructType([
        source.schema["row"], T.StructField("n_bytes", T.LongType()),
        T.StructField("kept", kind), T.StructField("spans", T.ArrayType(span))]))
    return removed.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "n_bytes", "kept", "spans")


def _at(tie: int, start: np.ndarray) -> np.ndarray:
    """Order of places within a doc_id: the text's tie, then the byte."""
    return (np.int64(tie) << np.int64(32)) + start


class _Finder:
    def __init__(self, length: int, frequent: int):
        self.length, self.frequent = length, frequent
        self.size = min(ANCHOR, length)
        #: windows that can have an anchor begin so many bytes before it at most
        self.before = length - self.size

    # ------------------------------------------------------------------ anchors

    def places(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Anchors of a text of ``length`` bytes or more, and their hashes."""
        n, size = len(text), self.size
        padded = np.frombuffer(text + b"\0" * 8, np.uint8)
        words = np.ascontiguousarray(
            np.lib.stride_tricks.as_strided(padded, (n, 8), (1, 1))).view("<u8").ravel()
        m = n - size + 1
        h = np.zeros(m, np.uint64)
        offsets = [*range(0, size - 7, 8)] or [0]
        if offsets[-1] + 8 < size:
            offsets.append(size - 8)
        for at in offsets:
            h = _mixed(h * _B + words[at : at + m])
        width = self.before + 1
        least = _slide(h, width, np.minimum)
        edge = np.zeros(width - 1, np.uint64)
        most = _slide(np.concatenate([edge, least, edge]), width, np.maximum)
        found = np.flatnonzero(h == most)
        return found, h[found]

    def anchors(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first of equal contexts in a slice of documents; the rest become marks (no hash)."""
        for batch in batches:
            for start, stop in slices(batch.column(2)):
                rows = [c.to_pylist() for c in batch.slice(start, stop - start).columns]
                parts = [self._of_document(*row) for row in zip(*rows)]
                parts = [p for p in parts if p is not None]
                if parts:
                    yield from self._firsts(*(np.concatenate(x) for x in zip(*parts)))

    def _of_document(self, doc, tie, text):
        data = (text or "").encode("utf-8", "surrogatepass")
        if len(data) < self.length:
            return None
        place, h = self.places(data)
        left = np.minimum(place, self.before)
        right = np.minimum(len(data) - place, self.length)
        use = left + right >= self.length
        place, h, left, right = place[use], h[use], left[use], right[use]
        digest = xxhash.xxh3_64_intdigest
        c = np.fromiter((digest(data[a:b]) for a, b in zip((place - left).tolist(),
                                                           (place + right).tolist())),
                        np.uint64, len(place))
        # a context's extent is part of what has to be equal
        c = _mixed(c + (left * 256 + right).astype(np.uint64))
        return (h.view(np.int64), c.view(np.int64), np.full(len(place), doc, np.int64),
                _at(tie, place), (left << 16 | right).astype(np.int32))

    def _firsts(self, h, c, doc, at, reach) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((at, doc, c, h))
        h, c, doc, at, reach = h[order], c[order], doc[order], at[order], reach[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        names = ["h", "c", "doc", "at", "reach"]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[first]) for x in (h, c, doc, at, reach)], names=names)
        again = ~first
        if again.any():
            doc, start, size = _merged(doc[again], at[again] - (reach[again] >> 16),
                                       (reach[again] >> 16) + (reach[again] & 0xFFFF))
            none = pa.nulls(len(doc), pa.int64())
            # h null: a mark; its hash column is filled so that marks spread over all tasks
            yield pa.RecordBatch.from_arrays(
                [none, pa.array(doc * 31 + start), pa.array(doc), pa.array(start), pa.array(size)],
                names=names)

    # ----------------------------------------------------------- equal contexts

    def equal_contexts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Marks repeated contexts; of an anchor with several contexts the first of each is wanted.
        Rows come sorted by anchor, context and place."""
        last: tuple | None = None  # anchor and context of the row before
        now, group, waiting, often = None, [], 0, False  # of the anchor at hand
        for batch in batches:
            null = np.asarray(batch.column(0).is_null())
            if null.any():
                rows = batch.filter(pa.array(null))
                yield self._marks(*(c.to_numpy(zero_copy_only=False) for c in rows.columns[2:]))
                batch = batch.filter(pa.array(~null))
            if not batch.num_rows:
                continue
            h, c, doc, at, reach = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            head = np.ones(len(h), bool)
            head[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            head[0] = (h[0], c[0]) != last
            last = (h[-1], c[-1])
            again = ~head
            if again.any():
                left = reach[again] >> 16
                yield self._marks(doc[again], at[again] - left, left + (reach[again] & 0xFFFF))
            heads = np.stack([h, doc, at, reach.astype(np.int64)], 1)[head]
            cuts = [0, *(np.flatnonzero(np.diff(heads[:, 0])) + 1).tolist(), len(heads)]
            out = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if heads[a, 0] != now:
                    if waiting > 1 or often:
                        out.extend(group)
                    now, group, waiting, often = heads[a, 0], [], 0, False
                group.append((heads[a:b], often))
                waiting += b - a
                if waiting > self.frequent and not often:
                    often = True
                    group = [(rows, True) for rows, _ in group]
                if often:
                    out.extend(group)
                    group = []
            if out:
                yield self._wanted(out)
        if group and waiting > 1:
            yield self._wanted(group)

    @staticmethod
    def _marks(doc, at, size) -> pa.RecordBatch:
        n = len(doc)
        return pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.int64()), pa.array(doc), pa.array(at),
             pa.array(np.asarray(size).astype(np.int32)), pa.nulls(n, pa.bool_())],
            names=["h", "doc", "at", "reach", "often"])

    @staticmethod
    def _wanted(found: list[tuple[np.ndarray, bool]]) -> pa.RecordBatch:
        rows = np.concatenate([r for r, _ in found])
        often = np.repeat([o for _, o in found], [len(r) for r, _ in found])
        return pa.RecordBatch.from_arrays(
            [pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2]),
             pa.array(rows[:, 3].astype(np.int32)), pa.array(often)],
            names=["h", "doc", "at", "reach", "often"])

    # ---------------------------------------------------------------- contexts

    def contexts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cuts the wanted contexts from the texts.  Those of frequent anchors are dealt out by the
        bytes that STEP neighbouring windows share; of equal ones a task sends the first."""
        for batch in batches:
            for start, stop in slices(batch.column(2), 2 << 20):
                out: list[tuple] = []
                shared: dict[tuple, tuple] = {}
                marks: list[tuple] = []
                columns = batch.slice(start, stop - start).columns
                for doc, tie, text, wanted in zip(
                        *(columns[i].to_pylist() for i in (0, 1, 2, 4))):
                    data = (text or "").encode("utf-8", "surrogatepass")
                    for w in wanted:
                        if w["at"] >> 32 != tie:
                            continue
                        place = w["at"] & 0xFFFFFFFF
                        a, b = place - (w["reach"] >> 16), place + (w["reach"] & 0xFFFF)
                        if w["often"]:
                            self._by_core(data, doc, tie, w["h"], place, a, b, shared, marks)
                        else:
                            out.append((w["h"], doc, (tie << 32) + a, b - a, data[a:b]))
                out.extend((g, doc, at, len(s), s) for (g, s), (doc, at) in shared.items())
                out.extend((at * 31 + doc & 0xFFFF, doc, at, n, None) for doc, at, n in marks)
                for first in range(0, len(out), 20_000):
                    g, doc, at, n, context = zip(*out[first : first + 20_000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(g, pa.int64()), pa.array(doc, pa.int64()), pa.array(at, pa.int64()),
                         pa.array(n, pa.int32()), pa.array(context, pa.binary())],
                        names=["g", "doc", "at", "reach", "context"])

    def _by_core(self, data, doc, tie, h, place, a, b, shared, marks) -> None:
        for last in range(place, place - self.before - STEP, -STEP):  # of STEP window starts
            low, high = max(a, last - STEP + 1), min(b, last + self.length)
            if last < a or high - low < self.length:
                continue
            piece = data[low:high]
            core = data[last : last - STEP + 1 + self.length]  # in every window of these starts
            g = xxhash.xxh3_64_intdigest(core, h & 0xFFFFFFFFFFFFFFFF)
            g -= (g >> 63) << 64
            here, seen = (doc, (tie << 32) + low), shared.get((g, piece))
            if seen is None:
                shared[g, piece] = here
            elif here != seen:
                shared[g, piece] = min(here, seen)
                later = max(here, seen)
                marks.append((*later, len(piece)))

    # ------------------------------------------------------------------- index

    def index(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Marks from indexes over whole groups of contexts, about INDEX_BYTES at a time."""
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            mark = np.asarray(batch.column(4).is_null())
            if mark.any():
                rows = batch.filter(pa.array(mark))
                yield pa.RecordBatch.from_arrays(rows.columns[1:4], names=["doc", "at", "reach"])
                batch = batch.filter(pa.array(~mark))
            for g, doc, at, n, context in zip(*(c.to_pylist() for c in batch.columns)):
                if g != last and size >= INDEX_BYTES:
                    yield self._indexed(held)
                    held, size = [], 0
                last = g
                held.append((doc, at, context))
                size += n
        if held:
            yield self._indexed(held)

    def _indexed(self, held: list[tuple]) -> pa.RecordBatch:
        doc = np.array([x[0] for x in held], np.int64)
        at = np.array([x[1] for x in held], np.int64)
        texts = [x[2] for x in held]
        document = _dense(doc, at >> 32)
        start = (document << 33) + (at & 0xFFFFFFFF)
        context, offset = RunLengthIndex(texts, start, self.length).earlier_matches()
        found = np.unique(start[context] + offset)
        back = np.full(document.max() + 1, -1)
        back[document] = np.arange(len(document))
        row = back[found >> 33]
        where = (at[row] >> 32 << 32) + (found & ((1 << 33) - 1))
        doc, where, size = _merged(doc[row], where, np.full(len(row), self.length))
        return pa.RecordBatch.from_arrays(
            [pa.array(doc), pa.array(where), pa.array(size)], names=["doc", "at", "reach"])


class RunLengthIndex:
    """A run-compressed Burrows-Wheeler transform of contexts, each ended by a separator.

    It keeps the runs (first row, symbol, rows of the symbol before), the row of every context's
    last window, and for each string of ``length`` bytes that occurs more than once its rows and
    its earliest start: the sample that decides here, in place of one at every run's end.  The
    suffix array is dropped after building.
    """

    def __init__(self, texts: list[bytes], start: np.ndarray, length: int):
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.size, self.start, self.length = size, start, length
        self.ends = np.cumsum(size + 1) - 1
        symbols = np.zeros(int(self.ends[-1]) + 1, np.int64)
        flat = np.frombuffer(b"".join(texts), np.uint8)
        inside = np.ones(len(symbols), bool)
        inside[self.ends] = False
        symbols[inside] = flat.astype(np.int64) + 1
        rows, part = _suffixes(symbols, length)
        before = symbols[rows - 1]
        change = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        self.run_row, self.run_symbol = change, before[change]
        run_size = np.diff(np.append(change, len(rows)))
        # rows of the same symbol in the runs before, after all rows of smaller symbols
        order = np.argsort(self.run_symbol, kind="stable")
        cumulative = np.cumsum(run_size[order]) - run_size[order]
        self.target = np.empty(len(change), np.int64)
        self.target[order] = cumulative
        row_of = np.empty(len(rows), np.int64)
        row_of[rows] = np.arange(len(rows))
        self.last_row = row_of[self.ends - length]
        self._repeated(rows, part)

    def _repeated(self, rows: np.ndarray, part: tuple[np.ndarray, int]) -> None:
        """Rows of the strings of ``length`` bytes that occur more than once."""
        rank, shift = part
        n = len(rows)
        context = np.repeat(np.arange(len(self.size)), self.size + 1)[rows]
        whole = rows + self.length <= self.ends[context]
        second = rank[np.minimum(rows + shift, n - 1)]
        same = np.zeros(n, bool)
        same[1:] = ((rank[rows[1:]] == rank[rows[:-1]]) & (second[1:] == second[:-1])
                    & whole[1:] & whole[:-1])
        first = np.flatnonzero(~same)
        count = np.diff(np.append(first, n))
        key = self.start[context] + rows - (self.ends[context] - self.size[context])
        least = np.minimum.reduceat(key, first)
        several = count > 1
        self.class_row, self.class_end = first[several], (first + count)[several]
        self.class_start = least[several]

    def earlier_matches(self) -> tuple[np.ndarray, np.ndarray]:
        """Contexts and offsets at which a string of ``length`` bytes begins that begins earlier
        elsewhere.  All contexts are streamed backwards from their last windows, a byte a step."""
        order = np.argsort(-self.size, kind="stable")
        size, row = self.size[order], self.last_row[order]
        start = self.start[order]
        found_context, found_offset = [], []
        if not len(self.class_row):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        for step in range(self.length, int(size[0]) + 1):
            n = int(np.searchsorted(-size, -step, side="right"))
            if step > self.length:
                run = np.searchsorted(self.run_row, row[:n], side="right") - 1
                row[:n] = self.target[run] + row[:n] - self.run_row[run]
            at = np.searchsorted(self.class_row, row[:n], side="right") - 1
            offset = size[:n] - step
            hit = (at >= 0) & (row[:n] < self.class_end[at]) & (
                start[:n] + offset > self.class_start[at])
            which = np.flatnonzero(hit)
            found_context.append(order[which])
            found_offset.append(offset[which])
        if not found_context:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(found_context), np.concatenate(found_offset)


def _suffixes(symbols: np.ndarray, length: int) -> tuple[np.ndarray, tuple[np.ndarray, int]]:
    """Suffixes in order, by doubling; and ranks by a part of ``length`` together with the shift to
    the second part, so that both ranks tell strings of ``length`` apart.

    The rank of a suffix is the first row of those that are equal so far; only rows that share
    theirs are sorted again."""
    n = len(symbols)
    key = np.zeros(n, np.int64)
    for k in range(7):
        key[: n - k] += symbols[k:] << np.int64(9 * (6 - k))
    rows = np.argsort(key)
    key = key[rows]
    open_rows = np.arange(n)
    rank = np.empty(n, np.int64)
    width, part = 7, None
    while True:
        new = np.ones(len(open_rows), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.maximum.accumulate(np.where(new, open_rows, 0))
        rank[rows[open_rows]] = first
        shared = ~new
        shared[:-1] |= shared[1:]  # the first of equal rows is open too
        open_rows = open_rows[shared]
        if part is None and 2 * width >= length:
            part = (rank.copy(), length - width)
        if not len(open_rows):
            if part is None:  # all told apart by less than half of ``length``
                part = (rank, 0)
            return rows, part
        at = rows[open_rows]
        after = at + width
        key = (rank[at] << np.int64(32)) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(key)
        rows[open_rows], key = at[order], key[order]
        width *= 2


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    return x ^ (x >> np.uint64(29))


def _slide(values: np.ndarray, width: int, reduce) -> np.ndarray:
    """Minimum or maximum of every ``width`` neighbours."""
    done = 1
    while 2 * done <= width:
        values = reduce(values[:-done], values[done:])
        done *= 2
    return reduce(values[: -(width - done)], values[width - done :]) if done < width else values


def _dense(*columns: np.ndarray) -> np.ndarray:
    """Numbers of the distinct rows, in their order."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _merged(doc: np.ndarray, at: np.ndarray, size: np.ndarray):
    """Overlapping or touching spans of a document as one."""
    if not len(doc):
        return doc, at, np.asarray(size).astype(np.int32)
    order = np.lexsort((at, doc))
    doc, at, end = doc[order], at[order], at[order] + size[order]
    number = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]) | (at[1:] >> 32 != at[:-1] >> 32)]))
    byte = number.astype(np.int64) << 33
    reached = np.maximum.accumulate(byte + (end & 0xFFFFFFFF))
    new = np.ones(len(doc), bool)
    new[1:] = byte[1:] + (at[1:] & 0xFFFFFFFF) > reached[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    stop = reached[last] - byte[last]
    return doc[first], at[first], (stop - (at[first] & 0xFFFFFFFF)).astype(np.int32)


def _cut_out(batches: Iterator[pa.RecordBatch], as_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, stop in slices(batch.column(2)):
            part = batch.slice(start, stop - start)
            n_bytes, kept, spans = [], [], []
            for tie, text, marks in zip(*(c.to_pylist() for c in part.columns[1:])):
                data = (text or "").encode("utf-8", "surrogatepass")
                own = [m for m in marks or () if m["at"] >> 32 == tie]
                at = np.array([m["at"] & 0xFFFFFFFF for m in own], np.int64)
                size = np.array([m["reach"] for m in own], np.int64)
                _, at, size = _merged(np.zeros(len(at), np.int64), at, size)
                runs = list(zip(at.tolist(), (at + size).tolist()))
                pieces, done = [], 0
                for a, b in runs:
                    pieces.append(data[done:a])
                    done = b
                pieces.append(data[done:])
                n_bytes.append(len(data))
                rest = b"".join(pieces)
                kept.append(rest.decode("utf-8", "ignore") if as_text else rest)
                spans.append([{"start": a, "end": b} for a, b in runs])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n_bytes, pa.int64()), pa.array(kept, pa.string() if as_text else pa.binary()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=["row", "n_bytes", "kept", "spans"])
