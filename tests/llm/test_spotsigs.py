"""SpotSigs fingerprints and the length-partitioned join against plain versions."""

import base64
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from tests.llm import plain
from wayside.llm import spot_join, spotsigs
from wayside.llm.queries import QUERIES
from wayside.llm.spotsigs import ANCHORS, CHAIN

SF = "/root/testdata/sf0.001"


def signatures(text):
    """Signatures by plain loops: an anchor and the next two content words."""
    words = re.findall(r"\w+", (text or "").lower())
    if len(words) <= CHAIN:
        return {zlib.crc32(text.encode())} if text else set()

    def chains(anchor, content):
        found = set()
        for i, w in enumerate(words):
            chain = [v for v in words[i + 1 :] if content(v)][:CHAIN] if anchor(w) else []
            if len(chain) == CHAIN:
                mixed = zlib.crc32(w.encode())
                for v in chain:
                    mixed = ((mixed ^ mixed >> 29) * 0x9E3779B97F4A7C15 + zlib.crc32(v.encode())) % 2**64
                found.add((mixed ^ mixed >> 32) * 0x9E3779B97F4A7C15 % 2**64 >> 32)
        return found

    return chains(ANCHORS.__contains__, lambda v: v not in ANCHORS) or chains(lambda w: True, lambda v: True)


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def roots(sets, least=0.8):
    """The smallest id that links reach."""
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if jaccard(sets[a], sets[b]) >= least - 1e-12:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {d: top(d) for d in ids}


def test_query_against_plain_version(spark):
    table = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    texts = {r["doc_id"]: r["text"] or "" for r in table}
    found = {r.doc_id: r for r in QUERIES["op9_spotsigs"](spark, SF).collect()}
    assert found.keys() == texts.keys()
    order = sorted(texts)
    sets = {d: signatures(t) for d, t in texts.items()}
    expected = roots(sets)
    assert 1 < len(set(expected.values())) < len(order)
    for d, after in zip(order, order[1:] + order[:1]):
        text, half = texts[d], len(texts[d]) // 2
        changed = signatures(text[: len(text) - half] + texts[after][:half])
        x = found[d]
        assert set(np.frombuffer(base64.b64decode(x.fingerprint), "<u4").tolist()) == sets[d]
        assert set(np.frombuffer(base64.b64decode(x.edited_fingerprint), "<u4").tolist()) == changed
        assert x.near_edited == pytest.approx(jaccard(sets[d], changed))
        assert x.near_next == pytest.approx(jaccard(sets[d], sets[after]))
        assert x.component_id == expected[d]


def page(chance, n):
    return [f"the {chance.choice('abcdefgh')}{chance.randrange(10**6)} w{chance.randrange(10**6)}" for _ in range(n)]


@pytest.mark.parametrize("small, leaders, block", [(16, 4, 512), (2, 1, 8)])
def test_crowds_lose_no_link(spark, monkeypatch, small, leaders, block):
    """Pages with 70 % boilerplate are no links; pairs among them at 0.8 to 0.9, a large group of near
    copies and chains of slowly growing texts are."""
    monkeypatch.setattr(spot_join, "SMALL", small)
    monkeypatch.setattr(spot_join, "LEADERS", leaders)
    monkeypatch.setattr(spot_join, "BLOCK", block)
    chance = random.Random(7)
    common, texts = page(chance, 70), []
    for _ in range(60):
        own = page(chance, chance.randrange(22, 40))
        texts.append(common + own)
        if chance.random() < 0.5:
            texts.append(common + own[: -chance.randrange(2, 8)] + page(chance, chance.randrange(2, 12)))
    group = page(chance, 60)
    for _ in range(60):
        copy = list(group)
        copy[chance.randrange(60)] = page(chance, 1)[0]
        texts.append(copy)
    grown = page(chance, 10)
    for _ in range(15):
        grown = grown + page(chance, 1 + len(grown) // 6)
        texts.append(grown)
    chance.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    expected = roots({d: signatures(t) for d, t in rows})
    found = spot_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == expected
    assert 60 <= len(set(expected.values())) < len(rows) - 70


def test_pairs_of_blocks_alone_find_all_links(spark, monkeypatch):
    """With every bucket crowded and no comparison before, all links come from the pairs of blocks."""
    chance = random.Random(3)
    common = page(chance, 80)
    texts = [common + page(chance, 30) for _ in range(40)]
    texts += [t[:-6] + page(chance, 6) for t in texts] + [["lone"] + page(chance, 5)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    pairs = spot_join._pairs
    monkeypatch.setattr(spot_join, "SMALL", 1)
    monkeypatch.setattr(spot_join, "BLOCK", 8)
    monkeypatch.setattr(spot_join, "_pairs", lambda met, least: pairs(met, least).limit(0))
    found = spot_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = roots({d: signatures(t) for d, t in rows})
    assert {r.doc_id: r.component_id for r in found} == expected
    assert len(set(expected.values())) == 41


def test_every_alike_pair_shares_a_bucket():
    chance = np.random.default_rng(5)
    bounds, counts = spot_join.length_bounds(0.8), chance.integers(0, 5, spot_join.COUNTERS)
    for _ in range(300):
        n = int(chance.integers(1, 80))
        a = np.unique(chance.integers(0, 1 << 32, n, np.uint32))
        b = np.unique(np.concatenate([a[chance.random(len(a)) < 0.93],
                                      chance.integers(0, 1 << 32, int(chance.integers(0, 4)), np.uint32)]))
        keys = [spot_join.bucket_keys(s, counts, bounds, 0.8) for s in (a, b)]
        places = [{k >> 1: k & 1 for k in some.tolist()} for some in keys]
        met = [k for k in places[0].keys() & places[1].keys() if not (places[0][k] and places[1][k])]
        if len(b) and jaccard(set(a.tolist()), set(b.tolist())) >= 0.8:
            assert met


def test_awkward_rows(spark):
    docs = plain.awkward(spark)
    found = spot_join.near_duplicates(docs).collect()
    assert len(found) == len(plain.AWKWARD)
    classes = {}
    for r in found:
        classes.setdefault(r.doc_id, set()).add(r.component_id)
    assert classes[1] == classes[2] == {1}          # null and empty
    assert classes[8] == classes[10] == {8}         # copies; a repeated doc_id
    assert classes[None] == {None} and classes[6] == {6}
    assert spot_join.near_duplicates(plain.empty(spark)).count() == 0
    twice = spark.createDataFrame([(None, "same words here again"), (5, "same words here again")],
                                  "doc_id long, text string")
    assert {r.component_id for r in spot_join.near_duplicates(twice).collect()} == {5}
    with pytest.raises(ValueError):
        spot_join.classes(docs, least=0)


def test_odd_column_names(spark):
    docs = spark.createDataFrame([(1, "a b c d", 0), (2, "a b c d", 1)], "`the.id` long, `a.text` string, `_class` int")
    found = spot_join.near_duplicates(docs, "a.text", "the.id").collect()
    assert [(r.doc_id, r.component_id) for r in sorted(found)] == [(1, 1), (2, 1)]


def test_classes_go_to_the_rows(spark, setting):
    """However many classes there are, rows with their fingerprints are shuffled once, zipped."""
    setting("spark.sql.autoBroadcastJoinThreshold", -1)
    copy = " ".join(f"the word{i} of" for i in range(60))
    rows = [(i, copy if i % 3 == 0 else f"the text{i} of its own number{i} and the rest{i} of it all{i}")
            for i in range(60)] + [(None, copy), (7, copy), (7, ""), (9, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    done = spotsigs.edited_halves(docs, classes=spot_join.classes(docs))
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    expected = spot_join.near_duplicates(docs).groupBy("doc_id", "component_id").count()
    got = done.groupBy("doc_id", "component_id").count()
    key = lambda rows: sorted(map(str, rows.collect()))
    assert key(got) == key(expected) and done.count() == len(rows)
