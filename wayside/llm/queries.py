"""The registered queries of this package and the SQL that checks them, where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers

from wayside.llm import (
    alignment, bpe, langid, licenses, packing, periodic, sharding, simhash, spot_join, spotsigs,
    suffix_dedup, tokencount, topk, toxicity, vocabulary,
)
from wayside.llm.common import held_out, importable, written

#: Vocabulary of the queries; the operators take any.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SHARDS = 24

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(run):
    @wraps(run)
    def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
        importable(spark)
        return run(spark, sf_dir)

    QUERIES[run.__name__] = reachable
    return reachable


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_license_scan(spark, sf_dir):
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


@query
def op2_topk_search(spark, sf_dir):
    vectors = topk.quantised(_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, "vec_id % 20 = 0", 20)


@query
def op3_simhash(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


@query
def op4_byte_bpe(spark, sf_dir):
    encoded = bpe.encode(_table(spark, sf_dir, "documents"), RANKS, PATTERN, decoded=True)
    return encoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op5_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.with_toxicity(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query
def op6_token_counts(spark, sf_dir):
    """Every document is counted, then edited twice: a third of the way in, its first twelve
    characters take the place of twenty; at two thirds, its source is put in."""
    docs = _table(spark, sf_dir, "documents")
    n = F.length("text")
    edit = lambda start, length, new: F.struct(
        start.cast("int").alias("start"), F.lit(length).alias("length"), new.alias("new"))
    edited = docs.withColumn("edits", F.array(
        edit(F.floor(n / 3), 20, F.substring("text", 1, 12)),
        edit(F.floor(2 * n / 3), 0, F.concat(F.lit(" "), F.col("source")))))
    trees = tokencount.with_token_trees(edited, RANKS, PATTERN, keep=["doc_id", "text", "edits"])
    counted = trees.withColumn("n_tokens", F.get("tokens", F.lit(1)).cast("long"))
    again = tokencount.recount(counted, RANKS, PATTERN, keep=["doc_id", "n_tokens"])
    return again.select("doc_id", "n_tokens", F.get("tokens", F.lit(1)).cast("long").alias("edited_tokens"),
                        F.length("edited").cast("long").alias("edited_chars"),
                        F.sha2("edited", 256).alias("edited_sha256"), "reencoded")


@query
def op7_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    found = langid.with_language(docs, langid.fit_languages(docs), keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query
def op8_packing(spark, sf_dir):
    packed = packing.pack(_table(spark, sf_dir, "documents"), RANKS, PATTERN,
                          special_tokens=vocabulary.added_tokens(TOKENIZER))
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op9_spotsigs(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return spotsigs.edited_halves(docs, classes=spot_join.classes(docs))


@query
def op10_suffix_dedup(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    left = suffix_dedup.remove_repeats(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return left.select("doc_id", "n_bytes", removed.alias("n_removed"),
                       F.size("spans").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_sharding(spark, sf_dir):
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    placed = sharding.sharded(_table(spark, sf_dir, "documents"), SHARDS, size)
    return placed.select(
        "doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op12_periodic_runs(spark, sf_dir):
    found = periodic.with_runs(with_planted_runs(_table(spark, sf_dir, "documents")),
                               keep=["doc_id"])
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    # length / period of the one is greater than that of the other; of equal ones the first stays
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, r: F.when(
        r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length",
        "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The words of a tenth of the documents, by a hash of doc_id, repeat with some period from some
    word on; the other texts, and those without a word or doc_id, stay as they are."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    planted = docs.select("*", h.alias("_h"), F.when(h % 10 == 0, words).alias("_w"))
    planted = planted.selectExpr("*", "size(_w) as _n", "_h div 10 as _g")
    planted = planted.withColumn("_a", F.expr("int(_g % nullif(_n, 0))"))
    planted = planted.withColumn("_p", F.expr("int(1 + (_n - _a) div (3 + _g % 8))"))
    repeated = F.expr("array_join(transform(_w, (w, i) -> if(i < _a, w, _w[_a + (i - _a) % _p])), ' ')")
    return planted.select(
        *[F.when(F.col("_n") > 0, repeated).otherwise(F.col("text")).alias(c) if c == "text" else c
          for c in docs.columns])


@query
def op13_alignment(spark, sf_dir):
    rows = alignment.aligned(_table(spark, sf_dir, "documents"), RANKS, PATTERN, PIECES, keep=["doc_id"])
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    rows = written(rows.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    return alignment.with_link_counts(
        rows, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])


#: The scan of op1 as SQL: lines and whole texts, bigrams with their counts, Dice within bounds.
ORACLE_SQL["op1_license_scan"] = """
with templates(template, license, text) as (values {templates}),
passages as (
 select distinct doc_id, md5(text) as h, unnest(range(len(p))) as place, unnest(p) as passage
 from (select doc_id, text, case when contains(text, chr(10))
         then list_concat([text], string_split(text, chr(10))) else [text] end as p
       from documents where text is not null)),
coded as (
 select doc_id, h, place, 0 as template, '' as license, passage as text from passages
 union all select null, null, null, template, license, text from templates),
listed as (
 select *, list_filter(string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')),
                                    ' '), lambda w: w <> '') as w from coded),
grams as (
 select doc_id, h, place, template, license, len(w) - 1 as n, w[i] || ' ' || w[i + 1] as bigram
 from (select *, unnest(range(1, len(w))) as i from listed where len(w) between 2 and 400)),
counted as (
 select doc_id, h, place, template, license, n, bigram, count(*) as times
 from grams group by all),
shared as (
 select d.doc_id, d.h, d.place, t.license, t.template,
        2.0 * sum(least(d.times, t.times)) / (any_value(d.n) + any_value(t.n)) as dice
 from counted d join counted t on d.bigram = t.bigram and d.h is not null and t.h is null
 group by all),
best as (
 select doc_id, h, place, license, dice from shared where dice >= {least} - 1e-12
 qualify row_number() over (partition by doc_id, h, place order by dice desc, license) = 1)
select doc_id, license, round(cast(max(dice) as double), 9) as dice, count(*) as passages
from best group by doc_id, license
""".format(
    least=licenses.LEAST,
    templates=", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''"))
                        for i, (name, text) in enumerate(licenses.TEMPLATES)),
)

ORACLE_SQL["op2_topk_search"] = """
with v as (
 select vec_id, min(q) as q from (
  select vec_id, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 64) as bigint)) as q
  from embeddings where vec_id is not null and embedding is not null
   and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)
 group by vec_id),
scored as (
 select a.vec_id as query_id, b.vec_id,
        cast(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) as bigint) as score
 from v a join v b on a.vec_id <> b.vec_id and a.vec_id % 20 = 0),
ranked as (
 select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank
 from scored)
select query_id, rank, vec_id, score from ranked where rank <= 20
"""
