"""Document fingerprints by SpotSigs.

A signature is an anchor (a very common word) with the chain of content words that follow it; a
fingerprint is the set of a text's signatures.  Sets are compared by Jaccard likeness, which the
ratio of their sizes bounds, so that a search partitions sets by length.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from wayside.llm.common import giving_back, map_texts, slices, unzipped, zipped

#: Content words of a chain.
CHAIN = 2

# Common words of English, German, French and Spanish.
ANCHORS = frozenset(
    "a an and are as at be by for from in is it not of on or that the this to was with "
    "auf das dem den der des die ein eine es für im ist mit nicht sich und von zu "
    "au ce dans de des du en est et il la le les par pour que qui un une "
    "con del el las los no para por se su y".split()
)

_word = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Numbers words and keeps what signatures need of them."""

    def __init__(self):
        super().__init__()
        self.hashes: list[int] = []
        self.common: list[bool] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self.hashes)
        self.hashes.append(zlib.crc32(word.encode("utf-8", "surrogatepass")))
        self.common.append(word in ANCHORS)
        return number


def signature_sets(texts: list) -> list[np.ndarray]:
    """Sorted 32-bit signatures of every text (null: as empty).

    A text without a complete chain makes every word an anchor; one with fewer words than a chain
    has, the whole text is its one signature; an empty text has none.
    """
    number = _Words()
    coded = [np.fromiter(map(number.__getitem__, _word.findall((t or "").lower())), np.int64)
             for t in texts]
    hashes, common = np.array(number.hashes, np.uint64), np.array(number.common, bool)
    out = []
    for text, words in zip(texts, coded):
        found = np.empty(0, np.uint32)
        if len(words) > CHAIN:
            anchor = common[words]
            content = np.flatnonzero(~anchor)
            found = _chains(hashes[words], np.flatnonzero(anchor), content)
            if not len(found):
                everywhere = np.arange(len(words))
                found = _chains(hashes[words], everywhere, everywhere)
        elif text:
            found = np.array([zlib.crc32(text.encode("utf-8", "surrogatepass"))], np.uint32)
        out.append(found)
    return out


def _chains(hashes: np.ndarray, anchors: np.ndarray, content: np.ndarray) -> np.ndarray:
    first = np.searchsorted(content, anchors, side="right")
    whole = first + CHAIN <= len(content)
    mixed, first = hashes[anchors[whole]], first[whole]
    for k in range(CHAIN):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX + hashes[content[first + k]]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX
    return np.unique((mixed >> np.uint64(32)).astype(np.uint32))


def as_text(signatures: np.ndarray) -> str:
    return base64.b64encode(signatures.astype("<u4").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard likeness of two sorted sets; 0 without comparing them if their sizes allow less than
    ``least``.  Two empty sets are alike."""
    if not len(a) and not len(b):
        return 1.0
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if not small or small < least * large:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def with_spot_signatures(
    docs: DataFrame, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Add ``fingerprint`` (the sorted 32-bit signatures in base 64) and ``n_signatures``.  Equal
    texts have equal fingerprints; rows and other columns stay as they are."""

    def compute(texts: list) -> list[pa.Array]:
        sets = signature_sets(texts)
        return [pa.array([as_text(s) for s in sets], pa.string()),
                pa.array([len(s) for s in sets], pa.int32())]

    fields = [T.StructField("fingerprint", T.StringType()),
              T.StructField("n_signatures", T.IntegerType())]
    return map_texts(docs, text, docs.columns if keep is None else keep, fields, lambda: compute)


def edited_halves(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", classes: DataFrame | None = None
) -> DataFrame:
    """Every text's fingerprint beside that of its edited text and of the next document's text.

    The edited text has its last floor(n/2) code points replaced by the first as many, or all, of
    the next document in ascending doc_id; the last document's next is the first.  A null doc_id
    counts as the smallest and a repeated one is ordered by text; null texts are empty.

    Rows are dealt out by ranges of doc_id and sorted within; only the first row of each range is
    also sent to the range before it, so that texts move once, zipped.  With ``classes``, a table of
    ``doc_id``, ``digest`` of the fingerprint and ``component_id``, rows also get their ``component_id``
    (their doc_id without one): each class goes to its document's range and stands before its rows.
    """
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), key.alias("key"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = 4 * parts  # several for each task, so that tasks come out even
    cuts = rows.select("key").approxQuantile(
        "key", [i / ranges for i in range(1, ranges)], max(1e-5, 0.1 / ranges))
    cuts = np.unique(np.array([int(c) for c in cuts], np.int64))

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, keys.to_numpy(), side="right").astype(np.int32))

    firsts = sorted((r.part, r.key) for r in rows.select("key", place("key").alias("part"))
                    .groupBy("part").agg(F.min("key").alias("key")).collect())
    used = np.array([part for part, _ in firsts], np.int32)
    first = np.array([k for _, k in firsts], np.int64)

    @F.pandas_udf("array<int>")
    def places(keys: pd.Series) -> pd.Series:
        k = keys.to_numpy()
        part = np.searchsorted(cuts, k, side="right")
        at = np.minimum(np.searchsorted(used, part), max(0, len(used) - 1))
        begins = first[at] == k
        before = used[at - 1]
        return pd.Series([[2 * p, 2 * b + 1] if again else [2 * p]
                          for p, b, again in zip(part.tolist(), before.tolist(), begins.tolist())])

    dealt = rows.withColumn("zip", zipped("text")).withColumn("place", F.explode(places("key"))).select(
        F.shiftright("place", 1).alias("part"), (F.col("place") % 2).alias("tail"), "key",
        F.lit(1).alias("kind"), "doc_id", "zip", F.lit(None).cast("binary").alias("digest"),
        F.lit(None).cast("long").alias("component"))
    if classes is not None:
        own = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
        dealt = dealt.unionByName(classes.select(
            place(own).alias("part"), F.lit(0).alias("tail"), own.alias("key"), F.lit(0).alias("kind"),
            F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("zip"),
            "digest", F.col("component_id").alias("component")))
    dealt = dealt.repartition(parts, "part").withColumn("text", unzipped("zip"))
    dealt = dealt.sortWithinPartitions("part", "tail", "key", "kind", "text")
    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string,"
              " edited_fingerprint string, near_edited double, near_next double, component_id long")
    done = dealt.select("part", "tail", "doc_id", "text", "key", "kind", "digest", "component").mapInArrow(
        giving_back(_with_next), schema)
    return done if classes is not None else done.drop("component_id")


def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs every row with the one after it; a range's rows end with one row of the next range."""
    last = key = None
    found: dict = {}
    for batch in batches:
        for start, stop in slices(batch.column(3)):
            cut = batch.slice(start, stop - start)
            pairs = []
            for part, tail, doc_id, text, at, kind, digest, component in zip(*(c.to_pylist() for c in cut.columns)):
                if (part, at) != key:
                    key, found = (part, at), {}
                if not kind:
                    found[digest] = component
                    continue
                if last is not None and part == last[0]:
                    pairs.append((*last[1:], text))
                last = None if tail else (part, doc_id, found, text)
            if pairs:
                yield _compared(pairs)


def _compared(pairs: list[tuple]) -> pa.RecordBatch:
    texts = [t for _, _, t, _ in pairs]
    after = [t for _, _, _, t in pairs]
    edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, after)]
    own, changed = signature_sets(texts), signature_sets(edited)
    chained = [i for i in range(len(pairs) - 1) if after[i] is texts[i + 1]]
    following: list = [None] * len(pairs)
    for i in chained:
        following[i] = own[i + 1]
    rest = [i for i, s in enumerate(following) if s is None]
    for i, s in zip(rest, signature_sets([after[i] for i in rest])):
        following[i] = s
    prints = [as_text(s) for s in own]
    labels = [found.get(hashlib.md5(p.encode()).digest(), d) if found else d
              for p, (d, found, _, _) in zip(prints, pairs)]
    columns = [
        pa.array([d for d, _, _, _ in pairs], pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
        pa.array(prints, pa.string()),
        pa.array([as_text(s) for s in changed], pa.string()),
        pa.array([likeness(a, b) for a, b in zip(own, changed)], pa.float64()),
        pa.array([likeness(a, b) for a, b in zip(own, following)], pa.float64()),
        pa.array([d if c is None else c for c, (d, _, _, _) in zip(labels, pairs)], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
        "near_next", "component_id"])
