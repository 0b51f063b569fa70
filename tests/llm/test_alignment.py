"""Two tokenizers' alignment against their libraries on whole texts and a plain walk over offsets."""

import collections

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import sentencepiece
import pytest
from tokenizers import Tokenizer

from tests.llm import plain
from wayside.llm import alignment
from wayside.llm.common import importable, written
from wayside.llm.queries import PATTERN, PIECES, QUERIES, RANKS

SF = "/root/testdata/sf0.001"
FIGURES = ("n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    # the printable stand-ins of byte-level BPE
    stand = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [x for x in range(256) if x not in stand]
    byte = {chr(x): x for x in stand} | {chr(256 + i): x for i, x in enumerate(other)}
    of_a = lambda i: bytes(byte[c] for c in a.id_to_token(i))
    of_b = lambda i: (bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i)
                      else b.id_to_piece(i).replace("▁", " ").encode())
    return a, b, of_a, of_b


def walk(texts, libraries):
    """The seven figures for every text, by running along both sequences."""
    a, b, of_a, of_b = libraries
    every = []
    for text in texts:
        groups = []
        if text:
            x = [(i, of_a(i)) for i in a.encode(" " + text, add_special_tokens=False).ids]
            y = [(i, of_b(i)) for i in b.encode(text)]
            if b"".join(t for _, t in x) == b"".join(t for _, t in y) == (" " + text).encode():
                at_x = at_y = 0
                group = [[], []]
                x, y = x[::-1], y[::-1]
                while x or y:
                    if at_x <= at_y:
                        i, t = x.pop()
                        at_x += len(t)
                        group[0].append(i)
                    else:
                        i, t = y.pop()
                        at_y += len(t)
                        group[1].append(i)
                    if at_x == at_y:
                        groups.append(group)
                        group = [[], []]
        every.append(groups)
    links = [collections.Counter((i, j) for g in groups for i in g[0] for j in g[1]) for groups in every]
    count = collections.Counter(pair for own in links for pair in own)
    highest = collections.Counter()
    for (i, _), n in count.items():
        highest[i] = max(highest[i], n)
    for groups, own in zip(every, links):
        shown = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        yield (sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups),
               own.total(), shown,
               sum(n for (i, j), n in own.items() if count[i, j] == highest[i]),
               sum(n * count[p] for p, n in own.items()))


def test_query(spark, libraries):
    table = pq.read_table(f"{SF}/documents.parquet")
    ids, texts = table["doc_id"].to_pylist(), table["text"].to_pylist()
    found = {r.doc_id: r for r in QUERIES["op13_alignment"](spark, SF).collect()}
    assert len(found) == len(ids)
    for d, want in zip(ids, walk(texts, libraries)):
        r = found[d]
        digest = plain.sha(want[4]) if want[4] else ""
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) == (
            *want[:4], digest, *want[5:])


def test_awkward_rows(spark, libraries):
    importable(spark)
    more = [(20, "a▁b"), (21, " lead"), (22, "trail "), (23, "  "), (24, "<s> <unk> </s> <0x0A>"),
            (25, "汉字" * 300), (26, "aaaa" * 700), (27, "12345678901234567890" * 40),
            (28, "é ﬁ ½ ｆｕｌｌ"), (29, "x\n\n  y\t z \x00 \x7f")]
    docs = plain.awkward(spark).unionByName(
        spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    docs = docs.withColumnRenamed("row", "groups").withColumnRenamed("score", "unit")
    rows = written(alignment.aligned(docs, RANKS, PATTERN, PIECES), "test").cache()
    assert "lang" in rows.columns and rows.columns.count("groups") == 1
    counted = alignment.with_link_counts(rows, ["doc_id", "text", *FIGURES[:5]]).collect()
    texts = [t for _, t in [*plain.AWKWARD, *more]]
    want = collections.Counter((d, t, *w) for (d, t), w in zip(
        [*plain.AWKWARD, *more], walk(texts, libraries)))
    assert collections.Counter((r.doc_id, r.text, *(r[f] for f in FIGURES)) for r in counted) == want
    none = alignment.aligned(plain.empty(spark), RANKS, PATTERN, PIECES)
    assert alignment.with_link_counts(written(none, "test"), ["doc_id"]).count() == 0


def test_pointer_jumping():
    chance = np.random.default_rng(3)
    for _ in range(300):
        end = int(chance.integers(1, 60))
        cut = lambda: np.append(np.flatnonzero(chance.random(end - 1) < chance.random()) + 1, end)
        a, b = cut(), cut()
        last_a, last_b = alignment.group_ends(a, b)
        both = np.intersect1d(a, b)
        assert (a[last_a] == both).all() and (b[last_b] == both).all()


def test_pairs_of_large_groups():
    ids_a, ids_b = np.array([1, 1, 2] * 20), np.array([5, 6] * 15)
    keys, times, owner = alignment._pairs(
        ids_a, ids_b, np.array([59]), np.array([29]), np.array([0]))
    assert dict(zip(keys.tolist(), times.tolist())) == {
        a * alignment.KEY + b: n for a, b, n in ((1, 5, 600), (1, 6, 600), (2, 5, 300), (2, 6, 300))}
    assert owner.tolist() == [0] * 4


def test_texts_that_begin_with_spaces(libraries):
    """The space before the text and the text's own first spaces may be one token of B."""
    texts = [" 汉字", "  汉字", " é x", " \u3000\u3000e ", " \n'eé", " ));&нан", " ", "   ", " \x00x", " lead er",
             " ½ x", "\t 汉", "x  汉", "  \n 汉 "]
    columns = alignment._unit(alignment.Parts(RANKS, PATTERN, PIECES), texts, 0)
    found = [tuple(c[i].as_py() for c in columns[:5]) for i in range(len(texts))]
    assert found == [w[:5] for w in walk(texts, libraries)]
