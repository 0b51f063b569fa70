"""Runs by block convolution against a comparison of every period."""

import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq

from tests.llm import plain
from wayside.llm import periodic
from wayside.llm.queries import QUERIES, with_planted_runs

SF = "/root/testdata/sf0.001"


def brute(words):
    """(start, length, period) of all runs: every period, every place."""
    number = {}
    w = np.array([number.setdefault(x, len(number)) for x in words], np.int64)
    best = {}
    for q in range(1, len(w) // 3 + 1):
        step = np.diff(np.concatenate([[0], (w[:-q] == w[q:]).astype(int), [0]]))
        for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()):
            if b - a + q >= max(24, 3 * q):
                best.setdefault((a, b + q), q)
    return sorted(((a, b - a, q) for (a, b), q in best.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def test_chance_sequences():
    chance = random.Random(1)
    for _ in range(400):
        w = []
        for _ in range(chance.randrange(1, 8)):
            if chance.random() < 0.5:
                w += [chance.randrange(50) for _ in range(chance.randrange(40))]
            else:
                unit = [chance.randrange(chance.choice([1, 2, 3]))
                        for _ in range(chance.randrange(1, chance.choice([4, 20, 90])))]
                w += (unit * 12)[: chance.randrange(1, 8 * len(unit) + 20)]
        found = periodic.find_runs(np.array(w, np.int64), len(w)).tolist() if w else []
        assert [(a, b - a, q) for a, b, q in found] == brute(w)


def test_transform_is_a_convolution():
    chance = np.random.default_rng(2)
    a, b = chance.integers(0, periodic.PRIME, (2, 3, 16)).astype(np.uint64)
    got = periodic.inverse(periodic.forward(a) * periodic.forward(b) % np.uint64(periodic.PRIME))
    for r in range(3):
        for k in range(16):
            want = sum(int(a[r, i]) * int(b[r, (k - i) % 16]) for i in range(16)) % periodic.PRIME
            assert got[r, k] == want


def test_query(spark):
    table = pq.read_table(f"{SF}/documents.parquet")
    found = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert len(found) == len(table)
    planted = 0
    for d, text in zip(table["doc_id"].to_pylist(), table["text"].to_pylist()):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        h, n = zlib.crc32(str(d).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += n - a >= 24
        runs, x = brute(w), found[d]
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        assert (x.n_runs, x.start, x.length, x.period) == (len(runs), *best)
        assert x.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert x.runs_sha256 == plain.sha("".join("%d,%d,%d\n" % r for r in runs))
        assert x.collapsed_sha256 == plain.sha(collapsed(w, runs))
    assert planted > 5


def test_awkward_rows(spark):
    docs = plain.awkward(spark).withColumnRenamed("row", "runs")
    rows = periodic.with_runs(docs).collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in rows))) == sorted(map(repr, plain.AWKWARD))
    for r in rows:
        w = (r.text or "").encode().split()
        runs = [(x.start, x.length, x.period) for x in r.runs]
        assert runs == brute(w) and r.n_words == len(w)
        assert r.collapsed.encode() == collapsed(w, runs)
    assert sum(len(r.runs) for r in rows) == 4
    assert periodic.with_runs(plain.empty(spark)).count() == 0


def test_long_text_and_large_periods():
    chance = random.Random(4)
    unit = [f"w{chance.randrange(3_000)}" for _ in range(7_001)]
    words = ["x"] * 10 + unit * 3 + unit[:17] + ["y"] + ["a", "b"] * 4_000 + unit[:6_000]
    described = periodic._described([" ".join(words), "one " * 23, "one " * 24])
    runs = [[(r["start"], r["length"], r["period"]) for r in own] for own in described[1].to_pylist()]
    assert runs == [[(10, 3 * 7_001 + 17, 7_001), (10 + 3 * 7_001 + 18, 8_000, 2)], [], [(0, 24, 1)]]


def test_planted_runs_of_awkward_texts(spark):
    """Ids that plant a run, with every awkward text; and ids that do not."""
    ids = [d for d in range(400) if zlib.crc32(str(d).encode()) % 10 == 0]
    texts = [t for _, t in plain.AWKWARD] + ["a b c " * 9]
    rows = [(d, t) for d, t in zip(ids, texts)] + [(None, "a b"), (1, ""), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = with_planted_runs(docs)
    assert found.columns == docs.columns
    got = {r.doc_id: r.text for r in found.collect()}
    assert len(got) == len(rows) and got[None] == "a b" and got[1] == "" and got[2] is None
    for d, t in rows[: len(texts)]:
        w = (t or "").encode().split()
        g, n = zlib.crc32(str(d).encode()) // 10, len(w)
        if not n:
            assert got[d] == t
            continue
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert got[d].encode() == b" ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(n))
