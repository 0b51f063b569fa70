"""Edit-aware token counts.

A document keeps a segment tree over leaves of text: every node has the characters and tokens
below it.  Leaves begin where no token can reach across.  An edit re-encodes the leaves that it
touches and one more on either side as context, and updates the sums above them.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from wayside.llm.common import map_texts
from wayside.llm.vocabulary import PartIds

#: Characters of a leaf, about.
LEAF = 96

_safe_space = re.compile(r"(?<=\S) ")


class Tree:
    """Sums over the leaves' characters and tokens; node i has children 2i and 2i + 1."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.chars, self.tokens = chars, tokens
        self.leaves = len(chars) // 2

    @classmethod
    def over(cls, sizes: list[int], counts: list[int]) -> Tree:
        leaves = 1 << max(0, len(sizes) - 1).bit_length()
        tree = cls([0] * (2 * leaves), [0] * (2 * leaves))
        tree.chars[leaves : leaves + len(sizes)] = sizes
        tree.tokens[leaves : leaves + len(counts)] = counts
        for i in range(leaves - 1, 0, -1):
            tree._sum(i)
        return tree

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf of the character at ``place`` (the last one with text, beyond the end) and the
        characters before it."""
        i, before = 1, 0
        place = min(place, max(0, self.chars[1] - 1))
        while i < self.leaves:
            i *= 2
            if place - before >= self.chars[i]:
                before += self.chars[i]
                i += 1
        return i - self.leaves, before

    def put(self, leaf: int, sizes: list[int], counts: list[int]) -> None:
        first, last = leaf + self.leaves, leaf + self.leaves + len(sizes) - 1
        self.chars[first : last + 1] = sizes
        self.tokens[first : last + 1] = counts
        while first > 1:
            first, last = first // 2, last // 2
            for i in range(first, last + 1):
                self._sum(i)


def cut(text: str, leaf: int = LEAF) -> list[str]:
    """Leaves of at least ``leaf`` characters that begin at safe places; joined they are the text."""
    places = [m.start() for m in _safe_space.finditer(text)]
    out, start = [], 0
    while len(text) - start > leaf:
        k = bisect_left(places, start + leaf)
        if k == len(places):
            break
        out.append(text[start : places[k]])
        start = places[k]
    return [*out, text[start:]]


def build(text: str, ids: PartIds) -> Tree:
    leaves = cut(text)
    return Tree.over([len(x) for x in leaves], [len(ids.of_text(x)) // 4 for x in leaves])


def edit(text: str, tree: Tree, start: int, length: int, new: str, ids: PartIds) -> tuple[str, Tree, int]:
    """The edited text, its tree, and the characters that were encoded again."""
    start = min(max(0, start), len(text))
    stop = min(len(text), start + max(0, length))
    first, before = tree.leaf_at(start)
    last, last_before = tree.leaf_at(stop)
    touched = first
    while first and not tree.chars[tree.leaves + first - 1]:
        first -= 1
    first = max(0, first - 1)  # the leaf before gives the context to the left
    before -= sum(tree.chars[tree.leaves + first : tree.leaves + touched])
    end = last_before + tree.chars[tree.leaves + last]
    while last + 1 < tree.leaves and not tree.chars[tree.leaves + last + 1]:
        last += 1
    if last + 1 < tree.leaves:
        last += 1
        end += tree.chars[tree.leaves + last]
    region = text[before:start] + new + text[stop:end]
    text = text[:start] + new + text[stop:]
    room, parts = last - first + 1, cut(region)
    if len(parts) > 4 * room:  # a large insertion: the tree is built anew
        return text, build(text, ids), len(text)
    if len(parts) > room:
        parts = [*parts[: room - 1], "".join(parts[room - 1 :])]
    sizes = [len(p) for p in parts] + [0] * (room - len(parts))
    counts = [len(ids.of_text(p)) // 4 for p in parts] + [0] * (room - len(parts))
    tree.put(first, sizes, counts)
    return text, tree, len(region)


def with_token_trees(
    docs: DataFrame, ranks: str, pattern: str, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Add ``chars`` and ``tokens``, the tree of every whole text (null: as empty).  Item 1 of
    ``tokens`` (0-based) is the number of tokens."""

    def make():
        ids = PartIds(ranks, pattern)

        def compute(texts: list) -> list[pa.Array]:
            trees = [build(t or "", ids) for t in texts]
            return [pa.array([t.chars for t in trees], pa.list_(pa.int32())),
                    pa.array([t.tokens for t in trees], pa.list_(pa.int32()))]

        return compute

    fields = [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("chars", "tokens")]
    return map_texts(docs, text, docs.columns if keep is None else keep, fields, make)




def recount(
    docs: DataFrame, ranks: str, pattern: str, text: str = "text", edits: str = "edits",
    keep: list[str] | None = None,
) -> DataFrame:
    """Apply each row's ``edits``, an array of ``(start, length, new)``, one after the other to a
    text with its tree (columns ``chars`` and ``tokens``).

    Adds ``edited`` (the text), the updated ``chars`` and ``tokens``, and ``reencoded``, the
    characters that were encoded again.  Places outside the text are moved to its ends; null edits,
    null texts and null fields count as empty, 0 and ''.
    """
    kept = [c for c in (docs.columns if keep is None else keep)
            if c not in ("edited", "chars", "tokens", "reencoded")]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias("_t_"),
                         F.col("chars").alias("_c_"), F.col("tokens").alias("_n_"),
                         F.col(edits).alias("_e_"))
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([
        *source.schema.fields[: len(kept)], T.StructField("edited", T.StringType()),
        T.StructField("chars", ints), T.StructField("tokens", ints),
        T.StructField("reencoded", T.LongType())])
    names = schema.names

    def run(batches):
        ids = PartIds(ranks, pattern)
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                texts, chars, tokens, wanted = (c.to_pylist() for c in part.columns[len(kept):])
                again = []
                for i, t in enumerate(texts):
                    now, done = t or "", 0
                    tree = Tree(chars[i], tokens[i]) if chars[i] else build(now, ids)
                    for e in wanted[i] or ():
                        if e is not None:
                            now, tree, n = edit(now, tree, e["start"] or 0, e["length"] or 0,
                                                e["new"] or "", ids)
                            done += n
                    texts[i], chars[i], tokens[i] = now, tree.chars, tree.tokens
                    again.append(done)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(kept)], pa.array(texts, pa.string()),
                     pa.array(chars, pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.int32())),
                     pa.array(again, pa.int64())], names=names)

    return source.mapInArrow(run, schema)
