"""The corpus pipeline, stage by stage, against plain versions."""

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from tests.llm import plain
from tests.llm.test_near_copies import firsts
from wayside.llm import langid, stages
from wayside.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.written(stage(spark, docs, SF), name)
        before = {r.doc_id: r for r in docs.collect()}
        rows = after.collect()
        if name != "packing":
            assert after.columns == columns
        if name == "language_id":
            assert len(rows) == len(before)
        elif name == "toxicity":
            toxic = {r.doc_id for r in QUERIES["op5_toxicity"](spark, SF).collect() if r.predicted}
            assert toxic and {r.doc_id for r in rows} == set(before) - toxic
        elif name == "near_dedup":
            assert {r.doc_id for r in rows} == firsts({d: r.text for d, r in before.items()})
            assert len(rows) < len(before)
            assert all(r == before[r.doc_id] for r in rows)
        elif name == "long_repeats":
            texts = sorted((d, r.text) for d, r in before.items())
            left = {d: kept.decode("utf-8", "ignore")
                    for (d, _), (_, _, _, kept) in zip(texts, plain.repeats(texts))}
            assert {r.doc_id: r.text for r in rows} == {d: t for d, t in left.items() if t}
            assert all(r.n_chars == len(r.text) for r in rows)
        else:
            assert {r.doc_id for r in rows} == set(before)
        docs = after


def test_stages_take_awkward_and_empty_tables(spark):
    for name, stage in corpus_pipeline.STAGES:
        docs = plain.awkward(spark)
        after = stage(spark, docs, SF)
        rows = after.collect()
        if name == "language_id":
            kept = {r.doc_id for r in rows}
            assert not kept & {1, 2, 3, 13}
        if name == "near_dedup":
            ids = [r.doc_id for r in rows]
            assert ids.count(10) == 0 and ids.count(8) == 1 and ids.count(None) == 1
        if name != "packing":
            assert after.columns == docs.columns
        assert stage(spark, plain.empty(spark), SF).count() == 0


def test_names_and_repeated_ids(spark):
    """Columns named as operators name theirs, and doc_ids with two texts."""
    long = " ".join(f"word{i} of the text" for i in range(60))
    rows = [(1, long), (2, long + " end"), (2, "a text of its own that nobody else has written"),
            (2, "a text of its own that nobody else has written"), (3, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("lang", "_p", "_s", "_b", "lang_pred", "score", "predicted", "phrase_bits", "row",
              "node", "h", "a.b"):
        docs = docs.withColumn(c, F.lit(c))
    kept = stages.near_dedup(spark, docs, SF)
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [
        (1, long), (2, rows[2][1]), (3, "")]
    for stage in (stages.language_id, stages.toxicity_filter, stages.near_dedup):
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        assert all(r[c] == c for r in after.collect() for c in docs.columns[2:])


def test_learned_languages_of_large_alphabets_stay(spark):
    """Three scripts of thousands of characters each: texts of all are known again and kept, texts
    of none of them go."""
    chance = np.random.default_rng(4)
    first = {"ja": 0x3041, "ko": 0xAC00, "zh": 0x4E00, "en": 0x61}
    size = {"ja": 1_800, "ko": 2_000, "zh": 2_500, "en": 26}
    # words of two to four characters, some of which are far more frequent than others
    lexicon = {k: ["".join(chr(first[k] + c) for c in chance.integers(0, size[k], chance.integers(2, 5)))
                   for _ in range(1_500)] for k in first}

    def text(k):
        picks = np.minimum(chance.zipf(1.3, 150) - 1, 1_499)
        return (" " if k == "en" else "").join(lexicon[k][i] for i in picks)

    rows = [(i, text(k), k) for i, k in enumerate(np.repeat(list(first), 90).tolist())]
    other = [(1_000 + i, "".join(chr(0x1200 + c) for c in chance.integers(0, 300, 400)), None) for i in range(20)]
    docs = spark.createDataFrame(rows + other, "doc_id long, text string, lang string")
    kept = stages.language_id(spark, docs, SF).collect()
    assert {r.doc_id for r in kept} == {r[0] for r in rows}
    found = langid.with_language(docs, langid.fit_languages(docs)).where("lang is not null")
    assert found.where("lang_pred <> lang").count() == 0


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert set(rows.columns) >= {"doc_id", "sequence_id", "ids"} and rows.count() > 100
