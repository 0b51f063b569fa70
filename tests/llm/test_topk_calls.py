"""No call of the search holds more than a few blocks."""

import random

import pytest
from pyspark import cloudpickle

from wayside.llm import topk


@pytest.fixture
def by_value():
    """Workers get the module as it is here, changes included."""
    cloudpickle.register_pickle_by_value(topk)
    yield
    cloudpickle.unregister_pickle_by_value(topk)


def test_calls_hold_few_blocks(spark, monkeypatch, by_value):
    run = topk._Search.run

    def bounded(self, asked, blocks):
        assert blocks.num_rows <= 4, f"{blocks.num_rows} blocks in one call"
        return run(self, asked, blocks)

    monkeypatch.setattr(topk._Search, "run", bounded)
    chance = random.Random(8)
    rows = [(i, [chance.uniform(-1, 1) for _ in range(8)]) for i in range(900)]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).coalesce(1)
    ints = {r.vec_id: list(r.v) for r in vectors.collect()}
    found = {}
    for r in topk.top_k(vectors, "vec_id % 20 = 0", 7, block=16).collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert sorted(found) == [i for i in sorted(ints) if i % 20 == 0]
    for q, got in found.items():
        scores = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)
        assert [got[k + 1] for k in range(7)] == [(i, -s) for s, i in scores[:7]]
