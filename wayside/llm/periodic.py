"""Periodic runs of words by block convolution.

A run is a stretch of words with smallest period q and at least max(24, 3 q) words that no
neighbouring word extends.  At each dyadic scale L the words are cut into blocks of L.  A run whose
period lies in [L, 2 L) holds a whole block together with its copy q words later, so the sum of
squared differences between block and window is zero at distance q.  These sums are a convolution,
taken for all distances at once by a number-theoretic transform.  Each zero is then extended to
both sides, word by word.  Periods below 16 are found with blocks of eight words.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from wayside.llm.common import map_texts

LEAST_WORDS, LEAST_TIMES = 24, 3
#: Words of the smallest block.
FIRST_BLOCK = 8
#: 15 * 2**27 + 1, with a generator of its multiplicative group.
PRIME, GENERATOR = 2013265921, 31
#: Numbers that one transform works on at a time (one block alone may need more).
MOST_NUMBERS = 1 << 20

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("runs", T.ArrayType(RUN)),
    T.StructField("collapsed", T.StringType()),
]


def with_runs(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Add ``n_words``, ``runs`` (``start``, ``length``, ``period`` in words, ascending by start,
    then period) and ``collapsed``, the words joined by one space of which every run keeps only its
    first period.

    Words are what ASCII white space separates.  Null, empty and blank texts have no words, no runs
    and an empty ``collapsed``.  A text is searched whole, however long, in the task that holds its
    row.  Rows are not merged or dropped: repeated rows give repeated results.  Other columns pass
    through; those of the new names give way.
    """
    return map_texts(docs, text, docs.columns if keep is None else keep, FIELDS, lambda: _described)


def _described(texts: list) -> list[pa.Array]:
    words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    count = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(count + 1) - count - 1  # one separator after each text
    codes = _codes(words, count, begin)
    found = find_runs(codes, int(count.max(initial=0)))
    owner = np.searchsorted(begin, found[:, 0], side="right") - 1
    runs: list[list[dict]] = [[] for _ in texts]
    gone = np.zeros(len(codes) + 1, np.int64)
    for d, (start, end, period) in zip(owner.tolist(), found.tolist()):
        runs[d].append({"start": start - int(begin[d]), "length": end - start, "period": period})
        gone[start + period] += 1
        gone[end] -= 1
    gone = np.cumsum(gone) > 0
    collapsed = []
    for d, own in enumerate(words):
        if runs[d]:
            drop = gone[begin[d] : begin[d] + count[d]].tolist()
            own = [w for w, dropped in zip(own, drop) if not dropped]
        collapsed.append(b" ".join(own).decode("utf-8", "surrogatepass"))
    return [
        pa.array(count, pa.int64()),
        pa.array(runs, pa.list_(pa.struct([(n, pa.int64()) for n in RUN.names]))),
        pa.array(collapsed, pa.string()),
    ]


def _codes(words: list[list[bytes]], count: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A number for every word, equal words alike, and one of its own for every separator."""
    flat = pa.chunked_array([pa.array([w for own in words for w in own], pa.large_binary())])
    coded = flat.combine_chunks().dictionary_encode()
    numbers = np.empty(int(count.sum()) + len(words), np.int64)
    place = np.ones(len(numbers), bool)
    place[begin + count] = False
    numbers[place] = coded.indices.to_numpy(zero_copy_only=False)
    numbers[begin + count] = len(coded.dictionary) + np.arange(len(words))
    return numbers


def find_runs(codes: np.ndarray, longest: int) -> np.ndarray:
    """Rows ``(start, end, period)`` of all runs, ascending.  ``longest`` bounds a run's length."""
    n = len(codes)
    found: dict[tuple[int, int], int] = {}
    if longest < LEAST_WORDS:
        return np.empty((0, 3), np.int64)
    padded = np.concatenate([codes, codes.max() + 1 + np.arange(longest + FIRST_BLOCK * 4)])
    recurs = _recurrence(codes)
    size = FIRST_BLOCK
    while LEAST_TIMES * size <= longest or size == FIRST_BLOCK:
        least, most = (1, 2 * size - 1) if size == FIRST_BLOCK else (size, 2 * size - 1)
        known = _reach(found)
        blocks = _possible(recurs, size)
        # Inside a run of a shorter period every match at this scale is a multiple of that period.
        blocks = blocks[_end_of(known, blocks * size) < (blocks + LEAST_TIMES) * size]
        at, distance = _matches(padded, blocks, size, least, most)
        new = _end_of(known, at) < at + size + distance
        at, distance = at[new], distance[new]
        order = np.lexsort((at, distance))
        at, distance = at[order], distance[order]
        # Neighbouring blocks that match at one distance are in one stretch.
        chained = np.zeros(len(at), bool)
        chained[1:] = (distance[1:] == distance[:-1]) & (at[1:] == at[:-1] + size)
        for start, d in zip(at[~chained].tolist(), distance[~chained].tolist()):
            low = start - _equal_before(codes, start, start + d)
            high = start + size + d + _equal_after(codes, start + size, start + size + d)
            if high - low >= max(LEAST_WORDS, LEAST_TIMES * d):
                found[low, high] = min(d, found.get((low, high), d))
        size *= 2
    rows = sorted((low, high, d) for (low, high), d in found.items())
    rows.sort(key=lambda r: (r[0], r[2]))
    return np.array(rows, np.int64).reshape(-1, 3)


def _recurrence(codes: np.ndarray) -> np.ndarray:
    """How far on the eight words from each place occur again; a large number if they do not.
    Strings are compared by hash, so that a distance may be too small, never too large."""
    n = len(codes) - FIRST_BLOCK + 1
    far = np.full(len(codes), np.iinfo(np.int64).max, np.int64)
    if n <= 0:
        return far
    with np.errstate(over="ignore"):
        hashed = np.zeros(n, np.uint64)
        mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
        mixed ^= mixed >> np.uint64(29)
        for k in range(FIRST_BLOCK):
            hashed = hashed * np.uint64(0xD1342543DE82EF95) + mixed[k : k + n]
    order = np.argsort(hashed, kind="stable")
    same = hashed[order[1:]] == hashed[order[:-1]]
    far[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return far


def _possible(recurs: np.ndarray, size: int) -> np.ndarray:
    """Blocks all of whose strings of eight words occur again within reach of the window."""
    count = len(recurs) // size
    inside = recurs[: count * size].reshape(count, size)[:, : size - FIRST_BLOCK + 1]
    return np.flatnonzero(inside.max(axis=1) < 2 * size) if count else np.empty(0, np.int64)


def _reach(found: dict[tuple[int, int], int]) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs, ascending, and the farthest end of a run that starts no later."""
    spans = np.array(sorted(found), np.int64).reshape(-1, 2)
    return spans[:, 0], np.maximum.accumulate(spans[:, 1])


def _end_of(known: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> np.ndarray:
    """The farthest end of a known run that starts at a place or before; -1 if there is none."""
    starts, ends = known
    return np.concatenate([[-1], ends])[np.searchsorted(starts, at, side="right")]


def _matches(
    padded: np.ndarray, blocks: np.ndarray, size: int, least: int, most: int
) -> tuple[np.ndarray, np.ndarray]:
    """Block starts and distances from ``least`` to ``most`` at which the same words stand again.

    The sums are exact modulo the prime; a sum that only the prime divides is told from zero by
    comparing the words.
    """
    width = most - least + size  # words of the window
    length = 1 << (width - 1).bit_length()
    at, distance = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    step = max(1, MOST_NUMBERS // length)
    p = np.uint64(PRIME)
    for first in range(0, len(blocks), step):
        start = blocks[first : first + step] * size
        block = padded[start[:, None] + np.arange(size)].astype(np.uint64)
        window = padded[start[:, None] + least + np.arange(width)].astype(np.uint64)
        turned = np.zeros((len(start), length), np.uint64)
        turned[:, 0] = block[:, 0]
        turned[:, length - size + 1 :] = block[:, :0:-1]
        filled = np.zeros((len(start), length), np.uint64)
        filled[:, :width] = window
        crossed = inverse(forward(turned) * forward(filled) % p)[:, : most - least + 1]
        squares = np.cumsum(window * window % p, axis=1)
        squares = np.concatenate([np.zeros((len(start), 1), np.uint64), squares], axis=1)
        own = (block * block % p).sum(axis=1)
        sums = own[:, None] + squares[:, size:] - squares[:, : most - least + 1]
        row, d = np.nonzero(sums % p == crossed * np.uint64(2) % p)
        for some in np.array_split(np.arange(len(row)), 1 + len(row) * size // MOST_NUMBERS):
            here, by = start[row[some]], d[some] + least
            there = (here + by)[:, None] + np.arange(size)
            equal = (block[row[some]] == padded[there].astype(np.uint64)).all(axis=1)
            at.append(here[equal])
            distance.append(by[equal])
    return np.concatenate(at), np.concatenate(distance)


def _powers(base: int, count: int) -> np.ndarray:
    """1, base, base**2, … modulo the prime."""
    out = np.ones(1, np.uint64)
    while len(out) < count:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), PRIME)) % np.uint64(PRIME)])
    return out[:count]


def forward(rows: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of every row, in bit-reversed order.  Rows have a power of two."""
    p, (count, length) = np.uint64(PRIME), rows.shape
    half = length // 2
    while half:
        pairs = rows.reshape(count, -1, 2, half)
        root = _powers(pow(GENERATOR, (PRIME - 1) // (2 * half), PRIME), half)
        a, b = pairs[:, :, 0], pairs[:, :, 1]
        rows = np.stack([(a + b) % p, (a + p - b) * root % p], axis=2)
        half //= 2
    return rows.reshape(count, length)


def inverse(rows: np.ndarray) -> np.ndarray:
    """The rows that ``forward`` gave these transforms."""
    p, (count, length) = np.uint64(PRIME), rows.shape
    half = 1
    while half < length:
        pairs = rows.reshape(count, -1, 2, half)
        root = _powers(pow(GENERATOR, PRIME - 1 - (PRIME - 1) // (2 * half), PRIME), half)
        a, b = pairs[:, :, 0], pairs[:, :, 1] * root % p
        rows = np.stack([(a + b) % p, (a + p - b) % p], axis=2)
        half *= 2
    return rows.reshape(count, length) * np.uint64(pow(length, -1, PRIME)) % p


def _equal_after(codes: np.ndarray, a: int, b: int) -> int:
    """How many words from ``a`` on equal those from ``b`` on, ``a`` < ``b``."""
    done, step = 0, 32
    while b + done < len(codes):
        y = codes[b + done : b + done + step]
        unequal = np.flatnonzero(codes[a + done : a + done + len(y)] != y)
        if len(unequal):
            return done + int(unequal[0])
        done += len(y)
        step *= 2
    return done


def _equal_before(codes: np.ndarray, a: int, b: int) -> int:
    """How many words just before ``a`` equal those before ``b``, ``a`` < ``b``."""
    done, step = 0, 32
    while a - done > 0:
        take = min(step, a - done)
        x = codes[a - done - take : a - done]
        unequal = np.flatnonzero(x != codes[b - done - take : b - done])
        if len(unequal):
            return done + take - 1 - int(unequal[-1])
        done += take
        step *= 2
    return done
