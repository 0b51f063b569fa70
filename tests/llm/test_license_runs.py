"""Licence notices that are wrapped over lines or stand in a line with other words."""

import collections
import random
import textwrap

import regex
from pyspark.sql import functions as F

from wayside.llm import licenses


def test_wrapped_and_inline_notices(spark):
    chatter = "some other words that only fill the line and say nothing of interest at all here "
    rows, expected = [], {}
    for i, (name, text) in enumerate(licenses.TEMPLATES):
        wrapped = "\n".join(f"# {x}" for x in textwrap.wrap(text, 40))
        rows += [(10 * i, f"{chatter}\n{wrapped}\n{chatter * 30}"), (10 * i + 1, chatter + text + " " + chatter),
                 (10 * i + 2, f"{chatter}{text} {text}\n\n{chatter}")]
        expected |= {(10 * i, name): (1.0, 1), (10 * i + 1, name): (1.0, 1), (10 * i + 2, name): (1.0, 2)}
    rows += [(900, (chatter + "permission is granted under the terms of ") * 200), (901, "of the " * 5_000),
             (902, "x\n" + licenses.TEMPLATES[0][1] + "\n" + chatter + licenses.TEMPLATES[0][1] + " " + chatter)]
    rows += rows[:1]
    expected[902, "Apache-2.0"] = (1.0, 2)
    expected[41, "MIT"] = (0.843137255, 1)  # the line itself counts
    expected[101, "BSD-2-Clause"], expected[111, "BSD-3-Clause"] = (0.811764706, 1), (0.862068966, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = licenses.scan_licenses(docs)
    assert {(r.doc_id, r.license): (r.dice, r.passages) for r in found.collect()} == expected
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_close_relatives_are_told_apart(spark):
    """Licences whose texts differ by a clause or a word, wrapped, inline and as lines of their own."""
    whole = {}
    for name, text in licenses.TEMPLATES:
        whole[name] = max(whole.get(name, ""), text, key=len)
    chatter = "nothing in these words before and behind the notice belongs to any licence at all "
    rows, expected = [], {}
    for i, name in enumerate(("BSD", "BSD-2-Clause", "BSD-3-Clause", "GPL-3.0", "LGPL-3.0", "AGPL-3.0",
                              "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "ISC", "MIT")):
        wrapped = "\n".join(textwrap.wrap(whole[name], 60))
        for k, text in enumerate((f"{chatter}\n{wrapped}\n{chatter * 9}", chatter + whole[name] + " " + chatter,
                                  f"{chatter}\n{whole[name]}\n{chatter}")):
            rows.append((10 * i + k, text))
            expected[10 * i + k] = {name}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {}
    for r in licenses.scan_licenses(docs).collect():
        found.setdefault(r.doc_id, set()).add(r.license)
    assert found == expected


def test_texts_are_told_by_words_without_loss(spark):
    """No passage at the limit is lost: templates with as many words replaced as the likeness allows."""
    chance = random.Random(8)
    for name, text in licenses.TEMPLATES:
        covers, missing = licenses.telling_words(text, licenses.LEAST)
        words = text.lower().split()
        assert sum(covers.values()) > missing
        # a text without any of the words is passed over, the template itself is not
        assert not any(w in "und nicht ganz so viel" for w in covers if len(w) > 4)
    rows = []
    for k in range(300):
        name, text = chance.choice(licenses.TEMPLATES)
        words = text.split()
        for _ in range(chance.randrange(1 + len(words) // 5)):
            words[chance.randrange(len(words))] = chance.choice(["other", "x", ""])
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = docs.select("*", F.explode(F.array(F.lower("text"))).alias("lower")).where(
        licenses._may_hold("lower", licenses.TEMPLATES, licenses.LEAST))
    told = {r.doc_id for r in held.collect()}
    pairs = lambda t: collections.Counter(zip(w := regex.sub(r"[^\p{L}\p{N}]+", " ", t.lower()).split(), w[1:]))
    for k, text in rows:
        mine = pairs(text)
        best = max(2 * (mine & pairs(t)).total() / (mine.total() + pairs(t).total())
                   for _, t in licenses.TEMPLATES)
        assert best < licenses.LEAST or k in told
    assert 30 < len(told)
