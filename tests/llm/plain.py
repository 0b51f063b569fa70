"""Plain versions of the operators, and small tables with awkward rows."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import xxhash

LONG_WORD = "q" * 3_000
AWKWARD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "The  quick\t\tbrown   fox jumps  "),
    (6, "can't we'll  it's 12345 ½ ² éàü ñ 汉字 😀 <|endoftext|> x y \x1cz"),
    (7, LONG_WORD), (8, "word " * 4_000), (9, "word " * 4_000 + "end"), (10, "word " * 4_000),
    (10, "word " * 4_000), (None, "no id but text with several words in it"), (11, "a" * 700),
    (12, "ÄÖÜ äöü ÀÉ Straße"), (13, "9" * 120 + " " + "9" * 120),
]


def awkward(spark):
    """The rows, with columns whose names operators use themselves."""
    rows = [(d, t, "x", 0.5, 1, [1], "y", 7) for d, t in AWKWARD]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, score double, row int, ids array<int>,"
        " lang_pred string, n_bytes int")


def empty(spark):
    return spark.createDataFrame(
        [], "doc_id long, text string, lang string, source string, n_chars long")


def fingerprint(text):
    data = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42)
         for i in range(max(1, len(words) - 3))]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def groups(prints, radius=4):
    """Smallest id reachable by links, of fingerprints by id."""
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    value = np.array([prints[i] for i in ids], np.uint64)
    for k, i in enumerate(ids):
        for m in np.flatnonzero(np.bitwise_count(value[k + 1 :] ^ value[k]) <= radius):
            a, b = root(i), root(ids[k + 1 + m])
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def repeats(texts, length=100):
    """For (order, text) pairs: kept bytes and removed runs, by a set of all strings."""
    seen, out = {}, []
    for i, (_, text) in enumerate(texts):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - length + 1):
            if seen.setdefault(data[at : at + length], (i, at)) != (i, at):
                gone[at : at + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(data), int(gone.sum()), runs,
                    np.frombuffer(data, np.uint8)[~gone].tobytes()))
    return out


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()
