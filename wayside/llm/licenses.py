"""License scan: passages of normalised text against licence templates, by the Dice coefficient of
their word bigrams.  DataFrame functions only."""

from __future__ import annotations

import math

import regex
from pyspark.sql import Column, DataFrame, functions as F

from wayside.llm.common import written

#: Likeness from which a passage counts as the template.
LEAST = 0.8

# Notices and short licence texts, as their authors publish them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use"
     " this file except in compliance with the License. You may obtain a copy of the License at"
     " http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
     " software and associated documentation files (the \"Software\"), to deal in the Software"
     " without restriction, including without limitation the rights to use, copy, modify, merge,"
     " publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to"
     " whom the Software is furnished to do so, subject to the following conditions: The above"
     " copyright notice and this permission notice shall be included in all copies or substantial"
     " portions of the Software."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the"
     " terms of the GNU General Public License as published by the Free Software Foundation, either"
     " version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0"
     " International License."),
    # the sentence alone does not say which of the two it is
    ("BSD", "Redistribution and use in source and binary forms, with or without"
     " modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without"
     " modification, are permitted provided that the following conditions are met: 1. Redistributions"
     " of source code must retain the above copyright notice, this list of conditions and the"
     " following disclaimer. 2. Redistributions in binary form must reproduce the above copyright"
     " notice, this list of conditions and the following disclaimer in the documentation and/or other"
     " materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without"
     " modification, are permitted provided that the following conditions are met: 1. Redistributions"
     " of source code must retain the above copyright notice, this list of conditions and the"
     " following disclaimer. 2. Redistributions in binary form must reproduce the above copyright"
     " notice, this list of conditions and the following disclaimer in the documentation and/or other"
     " materials provided with the distribution. 3. Neither the name of the copyright holder nor the"
     " names of its contributors may be used to endorse or promote products derived from this"
     " software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or"
     " without fee is hereby granted, provided that the above copyright notice and this permission"
     " notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
     " If a copy of the MPL was not distributed with this file, You can obtain one at"
     " http://mozilla.org/MPL/2.0/."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the"
     " terms of the GNU Lesser General Public License as published by the Free Software Foundation,"
     " either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the"
     " terms of the GNU Affero General Public License as published by the Free Software Foundation,"
     " either version 3 of the License, or (at your option) any later version."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or"
     " neighboring rights to this work."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International"
     " License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0"
     " International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is"
     " free to copy, modify, publish, use, compile, sell, or distribute this software, either in"
     " source code form or as a compiled binary, for any purpose, commercial or non-commercial, and"
     " by any means."),
)
#: Words of a template that are looked for first: at least so many, and as many as cover its bigrams.
TELLING_WORDS = 8


def telling_words(text: str, least: float) -> tuple[dict[str, int], int]:
    """Words of a template, longest first, with the number of its bigrams that each covers, and how
    many bigrams a passage of likeness ``least`` can lack.

    A passage with n bigrams, c of them shared with a template of t, has c <= n and
    2 c >= least (n + t), so c >= least t / (2 - least).  A text without a word has none of the
    bigrams that hold it."""
    words = regex.sub(r"[^\p{L}\p{N}]+", " ", text.lower()).split()
    open_pairs = list(zip(words, words[1:]))
    missing = len(open_pairs) - math.ceil(len(open_pairs) * least / (2 - least) - 1e-9)
    covers: dict[str, int] = {}
    for word in sorted(set(words), key=lambda w: (-len(w), w)):
        if len(covers) >= TELLING_WORDS and sum(covers.values()) > 1.5 * missing:
            break
        if held := sum(word in pair for pair in open_pairs):
            covers[word] = held
            open_pairs = [pair for pair in open_pairs if word not in pair]
    return covers, missing


def _may_hold(lower: str, templates, least: float) -> Column:
    """False for a text that lacks too many words of every template to hold a passage like it."""
    found = F.lit(False)
    for _, text in templates:
        covers, missing = telling_words(text, least)
        lacking = sum((F.when(F.contains(lower, F.lit(w)), 0).otherwise(n) for w, n in covers.items()),
                      F.lit(0))
        found = found | (lacking <= missing)
    return found


def _words(text: Column) -> Column:
    """Lower-cased words of a passage: runs of letters and digits."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    """Word pairs in order, repeats included; of one word none."""
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - 1)),
        lambda i: F.concat(F.element_at(words, i), F.lit(" "), F.element_at(words, i + 1)),
    )


def template_table(spark, templates=TEMPLATES) -> DataFrame:
    """``template`` (its number), ``license``, ``size`` (bigrams), one row per distinct ``bigram``
    with its ``times``.  Templates of one word are left out."""
    rows = spark.createDataFrame(
        [(i, name, text) for i, (name, text) in enumerate(templates)],
        "template int, license string, text string")
    words = rows.withColumn("words", _words(F.col("text"))).where(F.size("words") > 1)
    spread = words.select("template", "license", (F.size("words") - 1).alias("size"),
                          F.explode(_bigrams(F.col("words"))).alias("bigram"))
    return spread.groupBy("template", "license", "size", "bigram").agg(
        F.count("*").cast("int").alias("times"))


def scan_licenses(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    templates=TEMPLATES,
    least: float = LEAST,
) -> DataFrame:
    """``doc_id``, ``license``, ``dice`` (the best passage's, at least ``least``) and ``passages``
    (how many reach it), one row per document and licence found.

    Passages are the lines of a text, if it has several the whole text, and runs of consecutive
    words that neither a line nor the whole text that counts has taken: a notice that is wrapped over
    lines, or stands in a line with other words.  Two sizes s and t allow a coefficient of
    2 min(s, t) / (s + t) at most, so lines whose size no template allows are dropped before their
    bigrams are made, and templates are compared only within their bounds; runs begin and end with a
    bigram of the template.
    A passage counts for the licence it is most like (ties: the first by name), and of runs that
    overlap, whatever their licences, the one that shares most.  Texts that lack too many words of
    every template to hold any such passage are told first, by substring search.
    Bigrams count as often as they occur.  Null and empty texts and passages of one word find
    nothing; rows that repeat a doc_id are scanned as one document; a null doc_id is one.
    The templates are parameters of the call: their table is broadcast.
    """
    table = template_table(docs.sparkSession, templates)
    sizes = [r.size for r in table.select("size").distinct().collect()]
    ratio = least / (2 - least)
    allowed = F.lit(False)
    for size in sizes:
        allowed = allowed | F.col("n").between(size * ratio - 1e-9, size / ratio + 1e-9)
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("text is not null")
    # the generator keeps the lower-cased text from being made anew for every word
    lowered = source.select("doc_id", "text", F.explode(F.array(F.lower("text"))).alias("lower"))
    source = written(lowered.where(_may_hold("lower", templates, least)).select("doc_id", "text"), "licence-texts")
    lines = F.split("text", "\n", -1)
    whole = F.when(F.size(lines) > 1, F.array(F.col("text"))).otherwise(F.array().cast("array<string>"))
    passages = source.select("doc_id", F.xxhash64("text").alias("h"),
                             F.posexplode(F.concat(whole, lines)).alias("place", "passage"))
    sized = passages.select("doc_id", "h", "place", _words(F.col("passage")).alias("words"))
    sized = sized.withColumn("n", F.size("words") - 1).where((F.col("n") > 0) & allowed)
    spread = sized.select("doc_id", "h", "place", "n",
                          F.posexplode(_bigrams(F.col("words"))).alias("at", "bigram"))
    # only what the templates share is shuffled; a bigram of a repeated row counts once
    shared = (
        spread.join(F.broadcast(table), "bigram")
        .where(F.least("n", "size") * 2 >= least * (F.col("n") + F.col("size")) - 1e-9)
        .dropDuplicates(["doc_id", "h", "place", "at", "template"])
        .groupBy("doc_id", "h", "place", "n", "template", "license", "size", "bigram", "times")
        .agg(F.count("*").alias("found"))
        .groupBy("doc_id", "h", "place", "n", "template", "license", "size")
        .agg(F.sum(F.least("found", "times")).alias("common"))
    )
    scored = shared.withColumn("dice", 2 * F.col("common") / (F.col("n") + F.col("size")))
    best = F.min_by(F.struct("license", "template", "dice", "common"),
                    F.struct(-F.col("dice"), F.col("license"), -F.col("size")))
    taken = scored.where(F.col("dice") >= least - 1e-12).groupBy("doc_id", "h", "place").agg(
        best.alias("best")).select("doc_id", "h", "place", "best.*")
    # lines count from 0 in what follows; the whole text, if it has several, is line -1
    several = source.select(F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_h"),
                            F.contains("text", F.lit("\n")).cast("int").alias("several")).distinct()
    taken = taken.join(several, taken["doc_id"].eqNullSafe(F.col("_d")) & (taken["h"] == F.col("_h"))).select(
        "_d", "_h", (F.col("place") - F.col("several")).alias("_line"), "license", F.col("template").alias("_t"),
        "dice", "common")
    taken = written(taken, "licence-lines")
    whole = taken.where("_line < 0").select(
        F.col("_d").alias("doc_id"), "license", "dice", F.lit(1).cast("long").alias("passages"))
    runs = _runs(source, table, taken, least)
    return whole.unionByName(runs).groupBy("doc_id", "license").agg(
        F.round(F.max("dice"), 9).alias("dice"), F.sum("passages").alias("passages"))


def _runs(source: DataFrame, table: DataFrame, taken: DataFrame, least: float) -> DataFrame:
    """``doc_id``, ``license``, ``dice`` and ``passages`` of the lines that are ``taken`` and of the
    runs of words in each text.  Of those that overlap the one that shares most counts, a line before
    a run; a text that counts as a whole has no runs.

    A bigram at a place adds to what a run from ``start`` shares with a template if, ``times``
    occurrences before it, the same bigram lies before ``start``; so the shared bigrams of every run
    are counted by going on from its start, without a table of its own.  A run has no borders of its
    own, and would otherwise end before words that differ: it has at least the template's size.
    """
    lines = F.transform(F.split("text", "\n", -1), lambda line, i: F.transform(
        _words(line), lambda w: F.struct(w.alias("w"), i.alias("line"))))
    words = source.select("doc_id", F.xxhash64("text").alias("h"), F.flatten(lines).alias("words"))
    bigrams = F.transform(
        F.sequence(F.lit(1), F.size("words") - 1),
        lambda i: F.struct(
            F.concat(F.element_at("words", i)["w"], F.lit(" "), F.element_at("words", i + 1)["w"])
            .alias("bigram"), F.element_at("words", i)["line"].alias("line")))
    spread = words.where(F.size("words") > 1).select("doc_id", "h", F.posexplode(bigrams).alias("at", "b"))
    met = spread.select("doc_id", "h", "at", F.col("b.line").alias("line"), F.col("b.bigram").alias("bigram"))
    met = met.join(F.broadcast(table), "bigram").dropDuplicates(["doc_id", "h", "at", "template"])
    met = written(met, "licence-bigrams")
    same = met["doc_id"].eqNullSafe(F.col("_d")) & (met["h"] == F.col("_h"))
    on_line = taken.where("_line >= 0").join(
        met.select("doc_id", "h", "line", "template", "at"),
        same & (met["line"] == F.col("_line")) & (met["template"] == F.col("_t")))
    on_line = on_line.groupBy("doc_id", "h", "line", "license", "dice", "common").agg(
        F.min("at").alias("first"), F.max("at").alias("last"))
    on_line = on_line.select("doc_id", "h", F.struct(
        "first", "last", "dice", (F.col("common") * 2.0).alias("shared"), F.lit(True).alias("line"),
        "license", F.col("dice").alias("most")).alias("run"))
    met = met.join(taken.where("_line < 0"), same, "left_anti")
    key = ["doc_id", "h", "template", "license", "size"]
    alike = met.groupBy(*key, "times", "bigram").agg(F.sort_array(F.collect_list("at")).alias("ats"))
    each = alike.select(*key, F.explode(F.transform(
        "ats", lambda at, i: F.struct(
            at.alias("at"),
            F.when(i >= F.col("times"), F.get("ats", i - F.col("times"))).otherwise(-1).alias("before"))
    )).alias("x"))
    found = each.groupBy(*key).agg(F.sort_array(F.collect_list("x")).alias("xs"))
    size = F.col("size")
    ratio = least / (2 - least)
    need, longest = F.ceil(size * least - 1e-9).cast("int"), F.floor(size / ratio + 1e-9).cast("int")

    def best(x, i):
        """Of the runs that start at the i-th shared bigram the best: its dice and last place."""
        state = F.struct(F.lit(0).alias("common"), F.lit(0.0).alias("dice"), x["at"].alias("last"))

        def further(s, y):
            inside = y["at"] - x["at"] < longest
            common = s["common"] + (inside & (y["before"] < x["at"])).cast("int")
            dice = F.when(inside, 2.0 * common / (size + F.greatest(size, y["at"] - x["at"] + 1))).otherwise(0.0)
            better = dice > s["dice"] + 1e-12
            return F.struct(common.alias("common"), F.when(better, dice).otherwise(s["dice"]).alias("dice"),
                            F.when(better, y["at"]).otherwise(s["last"]).alias("last"))

        end = F.aggregate(F.slice("xs", i + 1, longest), state, further)
        # only where so many shared bigrams follow near enough
        far = F.get("xs", i + need - 1)["at"]
        return F.when(far - x["at"] < longest, F.struct(
            x["at"].alias("first"), end["last"].alias("last"), end["dice"].alias("dice"),
            # twice the shared bigrams: dice times both sizes
            F.round(end["dice"] * (size + F.greatest(size, end["last"] - x["at"] + 1))).alias("shared")))

    runs = found.where(F.size("xs") >= need).select(
        "doc_id", "h", "license", F.explode(F.transform("xs", best)).alias("run"))
    runs = runs.where(F.col("run.dice") >= least - 1e-12).select("doc_id", "h", F.struct(
        "run.*", F.lit(False).alias("line"), "license", F.col("run.dice").alias("most")).alias("run"))
    runs = runs.unionByName(on_line).groupBy("doc_id", "h").agg(F.sort_array(F.collect_list("run")).alias("runs"))

    def choose(kept, r):
        last = F.get(kept, F.size(kept) - 1)
        apart = (F.size(kept) == 0) | (r["first"] > last["last"])
        rank = lambda x: F.struct(x["shared"], x["line"], x["dice"])
        better = (rank(r) > rank(last)) | ((rank(r) == rank(last)) & (r["license"] < last["license"]))
        # the best dice of overlapping runs of one licence, whichever of them counts
        winner = F.when(better, r).otherwise(last)
        alike = (r["license"] == last["license"]) & ~winner["line"]
        most = F.when(alike, F.greatest(r["most"], last["most"]))
        winner = winner.withField("most", F.coalesce(most, winner["most"]))
        return F.when(apart, F.concat(kept, F.array(r))).otherwise(
            F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(winner)))

    chosen = F.aggregate("runs", F.slice("runs", 1, 0), choose)
    return runs.select("doc_id", F.explode(chosen).alias("run")).groupBy("doc_id", "run.license").agg(
        F.max("run.most").alias("dice"), F.count("*").alias("passages"))
