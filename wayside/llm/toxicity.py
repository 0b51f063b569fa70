"""Toxicity: a convolutional text classifier on hashed word embeddings, trained in numpy within Spark
tasks on all labelled texts.

A word's embedding is the sum of those of its hash and of the hashes of its beginnings, so that
inflected forms share what is learned.  Filters of several widths slide over the text, their maxima
over the whole text feed a logistic unit, and the threshold is calibrated for each language, which
the model tells from the text's own words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from wayside.llm.common import drop_written, give_back, giving_back, held_out, map_texts, slices, unzip, written, written_by, zipped

#: Model size: buckets of words, embedding size, filter widths, filters of each width.
BUCKETS, EMBEDDING, WIDTHS, FILTERS = 1 << 16, 8, (1, 2, 3), 6
#: Beginnings of a word, in characters, that have an embedding of their own.
BEGINNINGS = (4, 5, 6, 7)
#: Rows and bytes of text of a training shard, on average, and files that hold the shards.
SHARD_ROWS, SHARD_BYTES, MOST_FILES = 2_000, 8 << 20, 256
#: Labelled ids, of 16 bytes each, that are broadcast at most.
FEW_LABELS = 1 << 20
SHARD_ROW = "shard int, order long, label int, lang string, words binary"
EPOCHS, RATE, BATCH = 3, 0.02, 32
#: Bytes of text whose words are scored together.
SCORED_BYTES = 2 << 20
#: A language with fewer training rows of either label takes the common threshold.
LEAST_PER_LANGUAGE = 8
#: What calling a clean text toxic costs against missing a toxic one.
CAUTION = 2.0
#: Steps of the log odds that thresholds are told apart by, and the largest log odds.
FINE, MOST = 256, 128.0

_word = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class ToxicityModel:
    """``table``: for every bucket, what it adds to each filter at each place of the window, then
    the log weight of each language.  Empty without training rows of both labels."""

    table: np.ndarray | None = None
    bias: np.ndarray | None = None
    weight: np.ndarray | None = None
    offset: float = 0.0
    languages: tuple[str, ...] = ()
    thresholds: tuple[float, ...] = ()


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    lang: str = "lang",
    doc_id: str = "doc_id",
    toxic: str = "toxic",
    seed: int = 7,
) -> ToxicityModel:
    """Train on all labelled rows that are not held out, whole texts.

    Rows are dealt into shards by a hash of id and text.  In every pass each shard goes on from the
    common parameters, and the changes that shards made to a parameter are averaged over those that
    changed it, in whole numbers, so that their order does not matter.  Only counts and parameters
    of the model's size reach the driver.  Null labels and texts are left out; repeated label rows
    count once.
    """
    known = labels.select(F.col(doc_id).alias("id"), F.col(toxic).cast("int").alias("label"))
    known = written(known.where(F.col("label").isin(0, 1) & ~held_out("id")).distinct(), "labels")
    # few labels go to the texts; otherwise both are shuffled
    met = F.broadcast(known) if known.count() <= FEW_LABELS else known
    rows = docs.where(F.col(text).isNotNull()).select(
        F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where(~held_out("id"))
    size = rows.select("id", F.octet_length("text").alias("bytes")).join(met, "id").groupBy("label").agg(
        F.count("*").alias("rows"), F.sum("bytes").alias("bytes")).collect()
    if len(size) < 2:
        drop_written(known)
        return ToxicityModel()
    shards = max(2, -(-sum(r.rows for r in size) // SHARD_ROWS), -(-sum(r.bytes for r in size) // SHARD_BYTES))
    files = min(shards, MOST_FILES)
    rows = rows.select("id", F.xxhash64("id", "text").alias("order"), zipped("text").alias("text"), "lang")
    rows = rows.join(met, "id").withColumn("shard", F.pmod("order", F.lit(shards)).cast("int"))
    rows = rows.select("shard", "order", "label", "lang", "text").repartition(files, "shard")
    rows = written_by(rows.mapInArrow(giving_back(_worded_rows), SHARD_ROW), "labelled", "shard", files)
    drop_written(known)
    languages = tuple(sorted(r.lang for r in rows.where("lang is not null").select("lang").distinct().collect()))
    seen, texts, spoken = _counted(rows, languages)
    # a model of each half of the shards, then one of all
    seen, texts = [*seen, seen.sum(0)], [*texts, texts.sum(0)]
    models = {m: _started(seen[m], texts[m], seed) for m in range(3) if texts[m].min() > 0}
    for epoch in range(EPOCHS):
        models = _pass(rows, models, texts, (seed, epoch))
    thresholds = _calibrated(rows, [models.get(m, models[2]) for m in (0, 1)], languages)
    drop_written(rows)
    return replace(_tabled(models[2], spoken, languages), thresholds=thresholds)


def _worded_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the buckets of its words in place of each zipped text."""
    for batch in batches:
        for start, stop in slices(batch.column(4), SCORED_BYTES):
            part = batch.slice(start, stop - start)
            table, words = _worded([unzip(t).decode("utf-8", "replace") for t in part.column(4).to_pylist()])
            # a missing beginning (BUCKETS) is told from bucket 0 by the word's number of beginnings
            held = (table < BUCKETS).sum(1)
            packed = np.column_stack([held, np.where(table < BUCKETS, table, 0)]).astype("<u2")
            codec = pa.Codec("zstd")
            sent = [len(w).to_bytes(8, "little") + codec.compress(packed[w].tobytes(), asbytes=True) for w in words]
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(sent, pa.binary())],
                                             names=["shard", "order", "label", "lang", "words"])


def _unpacked_words(value: bytes) -> np.ndarray:
    """A row of buckets per word."""
    wide = 2 + len(BEGINNINGS)
    n = int.from_bytes(value[:8], "little")
    flat = pa.Codec("zstd").decompress(value[8:], 2 * n * wide, asbytes=True)
    rows = np.frombuffer(flat, "<u2").reshape(n, wide).astype(np.int32)
    return np.where(np.arange(wide - 1) < rows[:, :1], rows[:, 1:], BUCKETS)


def _worded(texts: list) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bucket rows of the distinct words, and each text's words as places there."""
    number = _Vocabulary()
    words = [np.fromiter(map(number.__getitem__, _word.findall((t or "").lower())), np.int64)
             for t in texts]
    return _bucket_rows(list(number)), words


def _counted(rows: DataFrame, languages: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each half and label the texts that hold a bucket and the number of texts; how often the
    words of each bucket come in each language."""
    width, number = BUCKETS + 1, {x: k for k, x in enumerate(languages)}
    kinds = 4 + len(languages)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, texts = np.zeros((kinds, width), np.int64), np.zeros(4, np.int64)
        for batch in batches:
            for s, y, x, words in zip(*(c.to_pylist() for c in batch.columns)):
                w, kind = _unpacked_words(words), 2 * (s % 2) + y
                texts[kind] += 1
                total[kind, np.unique(w)] += 1
                if x is not None:
                    np.add.at(total[4 + number[x]], w[:, 0], 1)
        flat = np.concatenate([total.ravel(), texts])
        used = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(flat[used])], names=["key", "n"])

    sums = rows.select("shard", "label", "lang", "words").mapInArrow(giving_back(counted), "key long, n long")
    sums = sums.groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    flat = np.zeros(kinds * width + 4, np.int64)
    flat[sums["key"].to_numpy()] = sums["n"].to_numpy()
    total = flat[:-4].reshape(kinds, width)
    return total[:4].reshape(2, 2, width), flat[-4:].reshape(2, 2), total[4:].T


def _started(seen: np.ndarray, texts: np.ndarray, seed: int) -> list[np.ndarray]:
    """The first parameters: embedding, filters of each width, their bias, weights, offset.  The
    embedding begins with the smoothed log odds of a bucket's presence in toxic and clean texts."""
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.1, (BUCKETS + 1, EMBEDDING))
    share = (seen + 1) / (texts[:, None] + 2)
    embedding[:, 0] = np.log(share[1] / share[0])
    embedding[BUCKETS] = 0  # stands for no beginning
    filters = [rng.normal(0, 0.1, (w * EMBEDDING, FILTERS)) for w in WIDTHS]
    for f in filters:  # the first filter of each width starts as the sum of the odds
        f[::EMBEDDING, 0] = 1.0
    weight = rng.normal(0, 0.1, len(WIDTHS) * FILTERS)
    weight[::FILTERS] = 1.0 / len(WIDTHS)
    return [embedding, *filters, np.zeros(weight.size), weight, np.array([-2.0])]


def _packed(params: list[np.ndarray]) -> np.ndarray:
    """All parameters in rows of the embedding's width, the embedding first."""
    dense = np.concatenate([p.ravel() for p in params[1:]])
    return np.vstack([params[0], np.pad(dense, (0, -len(dense) % EMBEDDING)).reshape(-1, EMBEDDING)])


def _unpacked(packed: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    dense, params, at = packed[len(like[0]) :].ravel(), [packed[: len(like[0])]], 0
    for p in like[1:]:
        params.append(dense[at : at + p.size].reshape(p.shape))
        at += p.size
    return params


def _pass(rows: DataFrame, models: dict, texts: list, seed: tuple) -> dict:
    """One pass over all shards: a half's model learns from its shards, that of all from each."""
    packed = {m: _packed(p) for m, p in models.items()}
    like = [np.empty(p.shape) for p in models[2]]
    height, scale = len(packed[2]), 2.0**32
    balance = {m: 0.5 * texts[m].sum() / texts[m] for m in models}
    shared = rows.sparkSession.sparkContext.broadcast({m: p.astype(np.float32) for m, p in packed.items()})

    def learned(group: pa.Table) -> pa.Table:
        shard = group["shard"][0].as_py()
        held = sorted(zip(*(group[c].to_pylist() for c in ("order", "label", "words"))))
        y, words = np.array([label for _, label, _ in held]), [_unpacked_words(w) for _, _, w in held]
        keys, moved = [np.empty(0, np.int64)], [np.empty((0, EMBEDDING), np.int64)]
        for m in (shard % 2, 2):
            if m not in shared.value:
                continue
            before = shared.value[m]
            params = _unpacked(before.copy(), like)
            touched = _trained(params, words, y, balance[m][y], (*seed, shard))
            at = np.concatenate([np.flatnonzero(touched), np.arange(BUCKETS + 1, height)])
            keys.append(m * height + at)
            moved.append(np.rint((_packed(params)[at].astype(float) - before[at]) * scale).astype(np.int64))
        moved = np.concatenate(moved)
        give_back()
        return pa.table([pa.array(np.concatenate(keys)), *map(pa.array, moved.T)],
                        names=["key", *[f"d{k}" for k in range(EMBEDDING)]])

    columns = [f"d{k}" for k in range(EMBEDDING)]
    sums = rows.select("shard", "order", "label", "words").groupBy("shard").applyInArrow(
        learned, ", ".join(["key long", *[f"{c} long" for c in columns]]))
    sums = sums.groupBy("key").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in columns]).toArrow()
    model, at = np.divmod(sums["key"].to_numpy(), height)
    moved = np.stack([sums[c].to_numpy() for c in columns], 1) / scale / sums["n"].to_numpy()[:, None]
    for m in models:
        packed[m][at[model == m]] += moved[model == m]
    shared.unpersist()
    return {m: _unpacked(packed[m], like) for m in models}


def _trained(params, words, y, scale, seed) -> np.ndarray:
    """Learn from each text once, in batches, in place; which embedding rows were touched."""
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    touched = np.zeros(BUCKETS + 1, bool)
    some = np.array([i for i, w in enumerate(words) if len(w)], np.int64)
    order = np.random.default_rng(seed).permutation(some)
    for step, first in enumerate(range(0, len(order), BATCH), 1):
        batch = order[first : first + BATCH]
        rows, slopes, grads = _slopes(params, [words[i] for i in batch], y[batch], scale[batch])
        touched[rows] = True
        _descend(params, moments, grads, rows, slopes, step)
    return touched


def _bucket_rows(words: list[str]) -> np.ndarray:
    """A row per word: the bucket of the word, then those of its proper beginnings."""
    rows = []
    for word in words:
        rows.append(zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS)
        size = len(word)
        for k in BEGINNINGS:
            rows.append(zlib.crc32(b"^" + word[:k].encode("utf-8", "surrogatepass")) % BUCKETS
                        if size > k else BUCKETS)
    return np.array(rows, np.int64).reshape(-1, 1 + len(BEGINNINGS))


def _pooled(params, words):
    """Of texts that all have words: each filter's highest value, the places where its window begins
    there, all words' buckets, their vectors, and the place of each text's last word.  A text shorter
    than a window is filled up with its last word."""
    embedding, *filters = params[: 1 + len(WIDTHS)]
    size = np.array([len(w) for w in words])
    first = np.cumsum(size) - size
    own = np.concatenate(words)
    vectors = _summed(embedding, own)
    n = len(own)
    numbers, last = np.arange(n), first + size - 1
    place, ends, long = numbers - np.repeat(first, size), np.repeat(last, size), np.repeat(size, size)
    pooled, used = np.empty((len(words), len(WIDTHS) * FILTERS), vectors.dtype), []
    for k, width in enumerate(WIDTHS):
        out = vectors @ filters[k][:EMBEDDING]
        for j in range(1, width):
            at = np.minimum(numbers + j, ends)
            out += (vectors @ filters[k][j * EMBEDDING : (j + 1) * EMBEDDING])[at]
        out[(place + width > long) & (place > 0)] = -np.inf
        top = np.maximum.reduceat(out, first)
        where = np.where(out == np.repeat(top, size, axis=0), numbers[:, None], n)
        used.append(np.minimum.reduceat(where, first))
        pooled[:, k * FILTERS : (k + 1) * FILTERS] = top
    return pooled + params[1 + len(WIDTHS)], used, own, vectors, last


def _slopes(params, words, y, scale):
    """Touched embedding rows, their gradients, and those of the other parameters, summed over
    texts that all have words."""
    filters, weight, offset = params[1 : 1 + len(WIDTHS)], params[-2], params[-1]
    pooled, used, own, vectors, last = _pooled(params, words)
    active = np.maximum(pooled, 0)
    error = scale * (1 / (1 + np.exp(-np.clip(active @ weight + offset[0], -500, 500))) - y)
    down = error[:, None] * weight * (pooled > 0)
    grads, rows, slopes = [], [], []
    for k, width in enumerate(WIDTHS):
        part, grad = down[:, k * FILTERS : (k + 1) * FILTERS], np.empty_like(filters[k])
        for j in range(width):
            at = np.minimum(used[k] + j, last[:, None])
            cut = slice(j * EMBEDDING, (j + 1) * EMBEDDING)
            grad[cut] = np.einsum("bce,bc->ec", vectors[at], part)
            live = part != 0
            slope = (part[:, :, None] * filters[k][cut].T)[live]
            rows.append(own[at[live]].ravel())
            slopes.append(np.repeat(slope, own.shape[1], axis=0))
        grads.append(grad)
    grads += [down.sum(0), active.T @ error, np.array([error.sum()])]
    rows, slopes = np.concatenate(rows), np.concatenate(slopes)
    slopes, rows = slopes[rows < BUCKETS], rows[rows < BUCKETS]
    order = np.argsort(rows, kind="stable")
    rows, begins = np.unique(rows[order], return_index=True)
    total = np.add.reduceat(slopes[order], begins) if len(rows) else np.empty((0, EMBEDDING))
    return rows, total, grads


def _descend(params, moments, grads, rows, slopes, step):
    """Adam; of the embedding only the touched rows."""
    for k, gradient in enumerate([slopes, *grads]):
        at = rows if k == 0 else slice(None)
        gradient = gradient / BATCH
        m, v = moments[k]
        m[at] = 0.9 * m[at] + 0.1 * gradient
        v[at] = 0.999 * v[at] + 0.001 * gradient**2
        params[k][at] -= RATE * (m[at] / (1 - 0.9**step)) / (
            np.sqrt(v[at] / (1 - 0.999**step)) + 1e-8
        )


def _calibrated(rows: DataFrame, models: list, languages: tuple) -> tuple[float, ...]:
    """The threshold of each language, then the common one, from all rows, each judged by the model
    of the half that it is not in.  Log odds are counted in steps of 1 / FINE, at most MOST apart
    from 0."""
    shared = rows.sparkSession.sparkContext.broadcast(models)
    number = {x: k for k, x in enumerate(languages)}

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(3), SCORED_BYTES):
                part = batch.slice(start, stop - start)
                half, words = part.column(0).to_numpy() % 2, [_unpacked_words(w) for w in part.column(3).to_pylist()]
                value, some = np.full(len(words), -np.inf), np.array([len(w) > 0 for w in words])
                for k in (0, 1):
                    params, own = shared.value[1 - k], np.flatnonzero(some & (half == k))
                    for a, b in _portions([len(words[i]) for i in own], 200_000):
                        pooled = _pooled(params, [words[i] for i in own[a:b]])[0]
                        value[own[a:b]] = np.maximum(pooled, 0) @ params[-2] + params[-1]
                step = np.rint(np.clip(value, -MOST, MOST) * FINE).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number.get(x, -1) for x in part.column(2).to_pylist()], pa.int32()),
                     part.column(1), pa.array(step)], names=["lang", "label", "step"])

    judged_rows = rows.select("shard", "label", "lang", "words").mapInArrow(
        giving_back(judged), "lang int, label int, step int")
    found = judged_rows.groupBy("lang", "step").agg(
        F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")).toArrow()
    lang, step, toxic, clean = (found[c].to_numpy() for c in ("lang", "step", "toxic", "clean"))
    shared.unpersist()

    def cut(own: np.ndarray) -> float:
        steps, at = np.unique(step[own], return_inverse=True)
        return _threshold(steps / FINE, np.bincount(at, toxic[own]), np.bincount(at, clean[own]))

    common, thresholds = cut(np.ones(len(lang), bool)), []
    for k in range(len(languages)):
        own = lang == k
        enough = min(toxic[own].sum(), clean[own].sum()) >= LEAST_PER_LANGUAGE
        thresholds.append(cut(own) if enough else common)
    return (*thresholds, common)


def _tabled(params: list, spoken: np.ndarray | None = None, languages: tuple = ()) -> ToxicityModel:
    embedding, *filters = params[: 1 + len(WIDTHS)]
    bias, weight, offset = params[1 + len(WIDTHS) :]
    table = [embedding @ f[j * EMBEDDING : (j + 1) * EMBEDDING]
             for f, width in zip(filters, WIDTHS) for j in range(width)]
    if languages:
        odds = np.log((spoken + 1.0) / (spoken + 1.0).sum(0))
        table.append(odds - odds.mean(1, keepdims=True))
    return ToxicityModel(np.hstack(table).astype(np.float32), bias, weight, float(offset[0]), languages)


def _threshold(value: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """The best cut between ascending values, where a clean text called toxic counts as CAUTION
    times a missed one; in the middle of the gap it falls into."""
    above = np.concatenate([[toxic.sum()], toxic.sum() - np.cumsum(toxic)]) / max(1, toxic.sum())
    below = np.concatenate([[0], np.cumsum(clean)]) / max(1, clean.sum())
    edges = np.concatenate([[value[0] - 1], value, [value[-1] + 1]])
    middle = (edges[:-1] + edges[1:]) / 2
    gain = above + CAUTION * below
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float(middle[best[np.argmax(np.diff(edges)[best])]])


def _summed(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For every word the sum of its buckets' rows, one bucket column at a time."""
    total = table[rows[:, 0]]
    for k in range(1, rows.shape[1]):
        total += table[rows[:, k]]
    return total


def raw_values(
    model: ToxicityModel, table: np.ndarray, words: list[np.ndarray]
) -> tuple[np.ndarray, np.ndarray]:
    """Log odds before calibration and the language's place; texts without words get -inf, -1.
    ``table`` has a row per word of the vocabulary, to which ``words`` point."""
    value, language = np.full(len(words), -np.inf), np.full(len(words), -1)
    some = [i for i, w in enumerate(words) if len(w)]
    if not some:
        return value, language
    size = np.array([len(words[i]) for i in some])
    first = np.cumsum(size) - size
    flat = np.concatenate([words[i] for i in some])
    place = np.arange(len(flat)) - np.repeat(first, size)
    last = np.repeat(first + size - 1, size)
    pooled, column = np.empty((len(some), model.bias.size)), 0
    for k, width in enumerate(WIDTHS):
        out = table[flat, column : column + FILTERS]
        for j in range(1, width):
            at = np.minimum(np.arange(len(flat)) + j, last)
            out = out + table[flat[at], column + j * FILTERS : column + (j + 1) * FILTERS]
        # windows that would run over the text's end count only if the text is shorter than one
        over = (place + width > np.repeat(size, size)) & (place > 0)
        out[over] = -np.inf
        pooled[:, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(out, first)
        column += width * FILTERS
    value[some] = np.maximum(pooled + model.bias, 0) @ model.weight + model.offset
    if model.languages:
        votes = np.add.reduceat(table[flat, column:], first)
        language[some] = votes.argmax(1)
    return value, language


def with_toxicity(
    docs: DataFrame, model: ToxicityModel, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Add ``score`` (0 to 1; 0.5 is the text language's threshold) and ``predicted``.

    Only the text decides.  Null and empty texts, texts without words, and every text under an
    empty model score 0.  Rows are neither dropped nor merged; other columns pass through.
    """
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return map_texts(docs, text, docs.columns if keep is None else keep, fields,
                     lambda: _scorer(model), limit=SCORED_BYTES)


class _Vocabulary(dict):
    """Numbers words as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def _scorer(model: ToxicityModel):
    def score(texts: list) -> list[pa.Array]:
        out = np.zeros(len(texts))
        if model.table is not None:
            buckets, words = _worded(texts)
            table = _summed(model.table, buckets)
            threshold = np.array(model.thresholds)
            for first, stop in _portions([len(w) for w in words], 200_000):
                value, language = raw_values(model, table, words[first:stop])
                z = np.clip(value - threshold[language], -500, 500)
                out[first:stop] = np.where(np.isneginf(value), 0.0, 1 / (1 + np.exp(-z)))
        return [pa.array(out), pa.array((out >= 0.5).astype(np.int32))]

    return score


def _portions(sizes: list[int], limit: int):
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if sizes:
        yield start, len(sizes)
