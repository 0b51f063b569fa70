"""The toxicity model learns from every labelled row that is not held out, and from whole texts."""

import random

import numpy as np
from pyspark.sql import functions as F

from wayside.llm import toxicity
from wayside.llm.common import held_out


def test_rows_of_any_hash_and_long_texts_are_learned(spark):
    """A fifth of the toxic rows, those with the largest hashes, have a toxic word of their own, and
    so have those of more than 12,000 characters."""
    chance = random.Random(3)
    ids = spark.range(7_500).select("id", F.xxhash64("id").alias("h"), held_out("id").alias("held"))
    ids = [(r.id, r.held) for r in ids.orderBy("h").collect()]
    rows, labels, asked = [], [], {}
    for k, (i, held) in enumerate(ids):
        bad = i % 2
        word = "gorf" if k > 0.8 * len(ids) else "vile"
        n = 40
        if i % 50 < 2:
            word, n = "blag", 2_200
        words = [f"plain{chance.randrange(300)}" for _ in range(n)]
        if bad:
            words.insert(chance.randrange(len(words)), word)
        rows.append((i, " ".join(words), "en"))
        labels.append((i, bad))
        if held:
            asked[i] = (bad, word)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(9)
    model = toxicity.fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    told = {r.doc_id: r.predicted for r in toxicity.with_toxicity(docs, model, keep=["doc_id"]).collect()}
    for word in ("vile", "gorf", "blag"):
        right = [told[i] == bad for i, (bad, w) in asked.items() if w == word]
        assert len(right) > 20 and np.mean(right) > 0.97


def test_the_model_does_not_follow_from_partitions(spark):
    chance = random.Random(5)
    rows = [(i, " ".join([f"w{chance.randrange(90)}" for _ in range(20)] + ["vile"] * (i % 3 == 0)), "en")
            for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _, _ in rows], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, other = (toxicity.fit_toxicity(docs.repartition(n), labels.repartition(n)) for n in (1, 11))
    assert np.array_equal(one.table, other.table) and one.thresholds == other.thresholds
    assert np.array_equal(one.weight, other.weight) and one.offset == other.offset


def test_slopes_are_the_derivatives_of_the_loss():
    chance = np.random.default_rng(2)
    table = np.column_stack([np.arange(1, 41), chance.integers(50, 90, (40, 4))])
    table[::3, 2:] = toxicity.BUCKETS
    words = [chance.integers(0, 40, n) for n in (1, 2, 9, 30)]
    y, scale = np.array([1, 0, 1, 0]), np.array([0.7, 1.3, 0.7, 1.3])
    params = toxicity._started(np.ones((2, toxicity.BUCKETS + 1)), np.array([3, 3]), 4)
    for p in params[1:]:
        p += chance.normal(0, 0.2, p.shape)
    params[-3] += 0.5

    def loss():
        model = toxicity._tabled(params)
        # the model's own table has 32 bits, too coarse here
        wide = np.hstack([params[0] @ f[j * 8 : j * 8 + 8] for f, w in zip(params[1:4], toxicity.WIDTHS) for j in range(w)])
        value, _ = toxicity.raw_values(model, toxicity._summed(wide, table), words)
        return float((scale * (np.logaddexp(0, value) - y * value)).sum())

    rows, slopes, grads = toxicity._slopes(params, [table[w] for w in words], y, scale)
    for k, grad in enumerate(grads, 1):
        for at in list(np.ndindex(grad.shape))[:: max(1, grad.size // 7)]:
            old = params[k][at]
            params[k][at] = old + 1e-5
            up = loss()
            params[k][at] = old - 1e-5
            down = loss()
            params[k][at] = old
            assert abs((up - down) / 2e-5 - grad[at]) < 1e-4
    for r, slope in list(zip(rows, slopes))[::5]:
        for c in range(8):
            old = params[0][r, c]
            params[0][r, c] = old + 1e-5
            up = loss()
            params[0][r, c] = old - 1e-5
            down = loss()
            params[0][r, c] = old
            assert abs((up - down) / 2e-5 - slope[c]) < 1e-4
