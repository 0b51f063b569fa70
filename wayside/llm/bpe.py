"""Byte-level BPE encoding by a global shuffle of distinct words, and decoding by the token table.

A word is a match of the vocabulary's pattern.  A batch of documents keeps its text as word
numbers, in order, which are the positions; its distinct words, each once however often it occurs,
are dealt out by the word and encoded where all batches' copies meet, each distinct word once.
Their ids go back to the batch, which puts its documents together again.

Numbers, words and ids travel as compressed blocks: per batch one block of positions, and per batch
and share of the words one block of words there and one of ids back.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from wayside.llm.common import map_texts, slices, written_by
from wayside.llm.vocabulary import encoding, space_led, token_bytes

#: Bytes of text in a batch (a longer text is a batch alone).
BATCH_BYTES = 12 << 20
#: Shares of the words for each shuffle partition, so that partitions come out even.
SHARES = 3


def encode(
    docs: DataFrame, ranks: str, pattern: str, text: str = "text", doc_id: str = "doc_id",
    decoded: bool = False,
) -> DataFrame:
    """``doc_id`` and ``ids`` (little-endian unsigned 32-bit integers) of every row's whole text;
    with ``decoded`` also the bytes that ``decode`` gives for the ids, made in the same task.

    Null and empty texts have no ids.  A null doc_id passes through and repeated rows are encoded
    as often as they come.  Words may be as long as their text.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("batch", T.LongType()), T.StructField("share", T.IntegerType()),
        T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("block", T.BinaryType()),
    ])
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = source.mapInArrow(partial(_split, pattern=pattern, shares=SHARES * parts), schema)
    split = written_by(split, "words", "batch", parts)  # positions need no shuffle later
    words = split.where("share is not null").select("batch", "share", "block")
    ids = words.repartition("share").sortWithinPartitions("share").mapInArrow(
        partial(_encoded, ranks=ranks, pattern=pattern), "batch long, block binary")
    home = split.where("share is null").select("batch", "doc_ids", "block")
    fields = [T.StructField("doc_id", kind), T.StructField("ids", T.BinaryType())]
    if decoded:
        fields.append(T.StructField("decoded", T.BinaryType()))
    return home.groupBy("batch").cogroup(ids.groupBy("batch")).applyInArrow(
        lambda home, words: _assemble(home, words, ranks if decoded else None), T.StructType(fields))


def _split(batches: Iterator[pa.RecordBatch], pattern: str, shares: int) -> Iterator[pa.RecordBatch]:
    matches = regex.compile(_white_space_property(pattern)).findall
    number = TaskContext.get().partitionId() << 33
    for batch in batches:
        for start, stop in slices(batch.column(1), BATCH_BYTES):
            coded, words = _numbered(batch.column(1).slice(start, stop - start).to_pylist(), matches)
            block = _packed(np.fromiter(map(len, coded), np.int64, len(coded)),
                            np.concatenate(coded))
            ids = batch.column(0).slice(start, stop - start)
            yield _rows(number, [None], pa.ListArray.from_arrays([0, len(ids)], ids), [block])
            share = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % shares
                                 for w in words), np.int64, len(words))
            order = np.argsort(share, kind="stable")
            cuts = np.flatnonzero(np.diff(share[order], prepend=-1)).tolist()
            blocks = []
            for first, last in zip(cuts, [*cuts[1:], len(order)]):
                own = order[first:last]
                data = [words[i].encode("utf-8", "surrogatepass") for i in own.tolist()]
                blocks.append(_packed(np.diff(own, prepend=0), np.fromiter(map(len, data), np.int64),
                                      b"".join(data)))
            if blocks:
                yield _rows(number, share[order[cuts]].tolist(),
                            pa.nulls(len(blocks), pa.list_(ids.type)), blocks)
            number += 1


def _rows(batch: int, shares: list, doc_ids: pa.Array, blocks: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(blocks), batch, np.int64)), pa.array(shares, pa.int32()), doc_ids,
         pa.array(blocks, pa.binary())],
        names=["batch", "share", "doc_ids", "block"])


def _encoded(batches: Iterator[pa.RecordBatch], ranks: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """The ids of every block's words.  Blocks come sorted by share; a share's words are encoded
    once and remembered until the next share."""
    single = encoding(ranks, pattern)._encode_single_piece
    known: dict[bytes, np.ndarray] = {}
    now = None
    for batch in batches:
        numbers, shares, blocks = (c.to_pylist() for c in batch.columns)
        out = []
        for share, block in zip(shares, blocks):
            if share != now:
                now, known = share, {}
            steps, size, data = _unpacked(block, 2)
            ends = np.cumsum(size).tolist()
            found, start = [], 0
            for end in ends:
                word = data[start:end]
                start = end
                if (ids := known.get(word)) is None:
                    ids = known[word] = single(word)
                found.append(ids)
            out.append(_packed(steps, np.fromiter(map(len, found), np.int64, len(found)),
                               np.fromiter((i for ids in found for i in ids), np.int64)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(numbers, pa.int64()), pa.array(out, pa.binary())], names=["batch", "block"])


def _white_space_property(pattern: str) -> str:
    r"""``\s`` and ``\S`` as the Unicode property, which the vocabulary's library takes for them."""
    return pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


def _numbered(texts: list, matches) -> tuple[list[np.ndarray], list[str]]:
    """Every text as word numbers, and the words; the most frequent word has number 0."""
    parts: list[str] = []
    led, bare = _Numbers(parts, " "), _Numbers(parts, "")
    coded = []
    for text in texts:
        first, *rest = space_led(text or "")
        sequence = np.empty(1 + len(rest), np.int32)
        sequence[0] = bare[first]
        sequence[1:] = np.fromiter(map(led.__getitem__, rest), np.int32, len(rest))
        coded.append(sequence)
    found = _Counter()
    size, flat = np.empty(len(parts), np.int64), []
    for i, part in enumerate(parts):
        inside = list(map(found.__getitem__, matches(part)))
        size[i] = len(inside)
        flat.extend(inside)
    flat = np.array(flat, np.int32)
    begin = np.cumsum(size) - size
    part_times = np.bincount(np.concatenate(coded), minlength=len(parts))
    times = np.bincount(flat, np.repeat(part_times, size), len(found))
    order = np.argsort(-times, kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    flat = rank[flat] if len(flat) else flat
    names = list(found)
    return [_ragged(flat, begin[c], size[c]) for c in coded], [names[i] for i in order.tolist()]


class _Numbers(dict):
    def __init__(self, parts: list[str], lead: str):
        super().__init__()
        self.parts, self.lead = parts, lead

    def __missing__(self, part: str) -> int:
        self[part] = number = len(self.parts)
        self.parts.append(self.lead + part)
        return number


class _Counter(dict):
    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def _ragged(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` one after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(begin - (ends - size), size) + np.arange(total)]


def _packed(*columns) -> bytes:
    """Columns of numbers below 2**32, and bytes as the last one if any, compressed.  Of numbers
    all lowest bytes come first, then the second, third and highest ones."""
    numbers = [c for c in columns if not isinstance(c, bytes)]
    head = np.array([len(c) for c in numbers], "<i8").tobytes()
    planes = [c.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for c in numbers]
    return zstandard.compress(b"".join([head, *planes, *columns[len(numbers):]]), 3)


def _unpacked(block: bytes, numbers: int) -> list:
    """So many columns of numbers, then the bytes that follow."""
    data = zstandard.decompress(block)
    columns, at = [], 8 * numbers
    for n in np.frombuffer(data, "<i8", numbers).tolist():
        planes = np.frombuffer(data, np.uint8, 4 * n, at).reshape(4, n)
        columns.append(np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64))
        at += 4 * n
    return [*columns, data[at:]]


def _assemble(home: pa.Table, words: pa.Table, ranks: str | None) -> pa.Table:
    numbers, ids = [], []
    for block in words.column("block").to_pylist():
        steps, size, flat, _ = _unpacked(block, 3)
        numbers.extend(np.cumsum(steps).tolist())
        data, ends = flat.astype("<u4").tobytes(), np.cumsum(4 * size)
        ids.extend(data[a:b] for a, b in zip((ends - 4 * size).tolist(), ends.tolist()))
    of = [b""] * len(ids)
    for number, word in zip(numbers, ids):
        of[number] = word
    names, out = [], []
    for doc_ids, block in zip(home.column("doc_ids").chunks, home.column("block").to_pylist()):
        size, flat, _ = _unpacked(block, 2)
        names.append(doc_ids.flatten())
        start = 0
        for end in np.cumsum(size).tolist():
            out.append(b"".join([of[i] for i in flat[start:end].tolist()]))
            start = end
    columns = {"doc_id": pa.chunked_array(names, home.schema.field("doc_ids").type.value_type),
               "ids": pa.chunked_array([pa.array(out, pa.binary())])}
    if ranks is not None:
        table = token_bytes(ranks)
        columns["decoded"] = pa.chunked_array(
            [pa.array([_decoded(row, table) for row in out], pa.binary())])
    return pa.table(columns)


def _decoded(ids: bytes, table: dict[int, bytes]) -> bytes:
    return b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decode(
    encoded: DataFrame, ranks: str, ids: str = "ids", keep: list[str] | None = None
) -> DataFrame:
    """Add ``decoded``, the bytes of the ids: every task joins them with the token-byte table, whose
    size the vocabulary bounds.  Null ids decode to nothing; an unknown id is an error."""

    def make():
        table = token_bytes(ranks)

        def compute(rows: list) -> list[pa.Array]:
            return [pa.array([_decoded(r or b"", table) for r in rows], pa.binary())]

        return compute

    return map_texts(encoded, ids, encoded.columns if keep is None else keep,
                     [T.StructField("decoded", T.BinaryType())], make)
