"""The registered queries on a whole small table, against SQL or plain versions."""

import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tests.llm import plain
from tests.oracle import compare, connect
from wayside.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    table = pq.read_table(f"{SF}/documents.parquet")
    return dict(sorted(zip(table["doc_id"].to_pylist(), (t or "" for t in table["text"].to_pylist()))))


@pytest.fixture(scope="module")
def ids(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {d: tokenizer.encode(t, add_special_tokens=False).ids for d, t in texts.items()}


@pytest.fixture(scope="module")
def result(spark):
    made = {}

    def get(name):
        if name not in made:
            made[name] = QUERIES[name](spark, SF).toPandas()
        return made[name]

    return get


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_sql(spark, name):
    entry = SimpleNamespace(run=QUERIES[name], sql=ORACLE_SQL[name])
    rows, problems = compare(spark, connect(SF), entry, SF)
    assert not problems, "\n".join(problems)
    assert rows


def test_simhash(texts, result):
    prints = {d: plain.fingerprint(t) for d, t in texts.items()}
    root = plain.groups(prints)
    found = result("op3_simhash")
    assert len(found) == len(texts)
    for x in found.itertuples():
        assert x.fingerprint == f"{prints[x.doc_id]:016x}"
        assert x.component_id == root[x.doc_id]


def test_bpe(texts, ids, result):
    found = result("op4_byte_bpe")
    assert sorted(found.doc_id) == list(texts)
    for x in found.itertuples():
        assert x.n_tokens == len(ids[x.doc_id])
        assert x.ids_sha256 == plain.sha(np.array(ids[x.doc_id], "<u4").tobytes())
        assert x.decoded_sha256 == plain.sha(texts[x.doc_id])


def test_packing(ids, result):
    found = result("op8_packing")
    ends = dict.fromkeys(ids, 0)
    for x in found.sort_values(["doc_id", "start"]).itertuples():
        own = ids[x.doc_id] + [0]
        assert x.start == ends[x.doc_id] and x.doc_tokens == len(own)
        ends[x.doc_id] += x.length
        piece = np.array(own[x.start : x.start + x.length], "<u4").tobytes()
        assert x.ids_crc32 == zlib.crc32(piece)
    assert ends == {d: len(i) + 1 for d, i in ids.items()}
    ordered = found.sort_values(["sequence_id", "offset"])
    running = ordered.groupby("sequence_id").length.cumsum() - ordered.length
    assert (running == ordered.offset).all()
    full = ordered.groupby("sequence_id").length.sum()
    assert full.max() <= 1024
    short = full[full < 1024]
    assert all(n & (n - 1) == 0 for n in short)
    assert len(short) < 11


def test_spotsigs(texts, result):
    found = result("op9_spotsigs").set_index("doc_id")
    order = list(texts)
    for k, d in enumerate(order):
        text, after = texts[d], texts[order[(k + 1) % len(order)]]
        half = len(text) // 2
        x = found.loc[d]
        assert x.n_chars == len(text)
        assert x.edited_sha256 == plain.sha(text[: len(text) - half] + after[:half])
    assert (found.near_edited >= found.near_next).mean() > 0.95
    assert found.near_next.mean() < 0.05 < 0.25 < found.near_edited.mean()


def test_suffix_dedup(texts, result):
    found = result("op10_suffix_dedup").set_index("doc_id")
    for d, (n, gone, runs, kept) in zip(texts, plain.repeats(texts.items())):
        x = found.loc[d]
        assert (x.n_bytes, x.n_removed, x.n_spans) == (n, gone, runs)
        assert x.kept_sha256 == plain.sha(kept)


def test_token_counts(texts, result):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    source = dict(zip(*(pq.read_table(f"{SF}/documents.parquet")[c].to_pylist()
                        for c in ("doc_id", "source"))))
    found = result("op6_token_counts").set_index("doc_id")
    count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    for d, text in texts.items():
        at = len(text) // 3
        edited = text[:at] + text[:12] + text[at + 20 :]
        at = min(2 * len(text) // 3, len(edited))
        edited = edited[:at] + " " + source[d] + edited[at:]
        x = found.loc[d]
        assert x.n_tokens == count(text) and x.edited_tokens == count(edited)
        assert x.edited_sha256 == plain.sha(edited)
    long = found[found.edited_chars > 10_000]
    assert (long.reencoded < 0.25 * long.edited_chars).all()


def test_language_and_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    held = {d: zlib.crc32(str(d).encode()) % 5 == 0 for d in docs.doc_id}
    lang = QUERIES["op7_language_id"](spark, sf).toPandas().merge(docs, on="doc_id")
    assert len(lang) == len(docs) and (lang.held_out == lang.doc_id.map(held)).all()
    assert (lang[lang.held_out].lang == lang[lang.held_out].lang_pred).mean() > 0.97
    assert lang.score.between(0, 1).all()
    toxic = QUERIES["op5_toxicity"](spark, sf).toPandas()
    assert len(toxic) == len(docs) and ((toxic.score >= 0.5) == (toxic.predicted == 1)).all()
    both = toxic.merge(labels, on="doc_id")
    both = both[both.held_out]
    assert (both.predicted == both.toxic).mean() > 0.9
