"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text stands for each language.  A text is parsed into phrases, each
the longest match of what follows in the language's sample; the language that needs the fewest
phrases, normalised by the sample's size and the text's length, wins.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F, types as T

from wayside.llm.common import held_out, map_texts

#: The sample of a language: so many passages of so many characters (a documented bound).
PASSAGES, PASSAGE_CHARS = 64, 256
#: Symbols with a column of their own in an automaton's table: the most frequent characters of all
#: samples.  The transitions of all others are looked up in a sorted list.
SYMBOLS = 64
#: Characters that are parsed in one go.  A phrase ends at a piece's end, in every language alike.
PIECE = 1024
UNKNOWN = "und"

_letter = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class LanguageModel:
    """Sample text by language, ascending by name, and for each language the bits per character
    beyond which a text is unlike it."""

    samples: tuple[tuple[str, str], ...]
    limits: tuple[float, ...] = ()


def fit_languages(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    doc_id: str = "doc_id",
    passages: int = PASSAGES,
    chars: int = PASSAGE_CHARS,
) -> LanguageModel:
    """Learn from rows that are not held out and have a language and a letter in their text.

    Of each language the ``passages`` rows with the smallest hash of their text give a passage of
    ``chars`` characters, at a place the hash picks; only these reach the driver.  Repeated texts
    count once per language.
    """
    order = F.xxhash64(text)
    learn = docs.select(
        F.col(lang).alias("lang"),
        order.alias("rank"),
        F.substr(
            F.col(text),
            (F.pmod(order, F.greatest(F.lit(1), F.length(text) - chars)) + 1).cast("int"),
            F.lit(chars),
        ).alias("passage"),
        F.col(text).rlike(r"\p{L}").alias("has_letter"),
        held_out(doc_id).alias("held"),
    ).where("not held and lang is not null and has_letter")
    window = Window.partitionBy("lang").orderBy("rank", "passage")
    rows = (
        learn.withColumn("n", F.dense_rank().over(window))
        .where(F.col("n") <= passages)
        .select("lang", "passage", "n")
        .distinct()
        .collect()
    )
    samples: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r.lang, r.n)):
        samples.setdefault(row.lang, []).append(row.passage)
    return learned(samples)


def learned(samples: dict[str, list[str]]) -> LanguageModel:
    """The model of passages by language.

    A language's limit lies half way between the entropy of its own text, that of every second
    passage parsed by the others, and that of text which matches nothing, a phrase for every
    character.  A language with a single passage takes the latter alone."""
    limits = []
    for name in sorted(samples):
        passages = samples[name]
        most = float(np.log2(len("\n".join(passages)) + 1))
        own = most
        if len(passages) > 1:
            half = LanguageModel(((name, "\n".join(passages[::2])),))
            own = float(cross_entropies(half, ["\n".join(passages[1::2])])[0, 0])
        limits.append((own + most) / 2 if len(passages) > 1 else most)
    return LanguageModel(tuple((k, "\n".join(v)) for k, v in sorted(samples.items())), tuple(limits))


def with_language(
    docs: DataFrame,
    model: LanguageModel,
    text: str = "text",
    keep: list[str] | None = None,
    bits: bool = False,
) -> DataFrame:
    """Add ``lang_pred`` and ``score``; with ``bits`` also ``phrase_bits``, the winner's bits per
    character, and ``unlike``, whether these are beyond its limit.

    The score is the runner-up's share of the two best entropies: 0.5 for a tie, towards 1 for a
    clear winner, 1 if only one language was learned.  A tie goes to the first name.  Null texts,
    texts without a letter and an empty model give ``und`` and score 0 (bits null, unlike true).  Rows are not
    changed, dropped or merged; other columns pass through.
    """
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    if bits:
        fields += [T.StructField("phrase_bits", T.DoubleType()), T.StructField("unlike", T.BooleanType())]
    return map_texts(docs, text, docs.columns if keep is None else keep, fields,
                     lambda: _identifier(model, bits))


def _identifier(model: LanguageModel, bits: bool):
    names = [name for name, _ in model.samples]

    def identify(texts: list) -> list[pa.Array]:
        lang, score, per_char = [UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts)
        unlike = [True] * len(texts)
        rows = [i for i, t in enumerate(texts) if t and _letter.search(t)] if names else []
        if rows:
            entropy = cross_entropies(model, [texts[i] for i in rows])
            order = np.argsort(entropy, axis=1, kind="stable")
            best = np.take_along_axis(entropy, order, 1)
            for k, i in enumerate(rows):
                lang[i] = names[order[k, 0]]
                score[i] = float(best[k, 1] / (best[k, 0] + best[k, 1])) if len(names) > 1 else 1.0
                per_char[i] = float(best[k, 0])
                unlike[i] = bool(model.limits) and per_char[i] > model.limits[order[k, 0]]
        columns = [pa.array(lang, pa.string()), pa.array(score, pa.float64())]
        return [*columns, pa.array(per_char, pa.float64()), pa.array(unlike, pa.bool_())] if bits else columns

    return identify


def cross_entropies(model: LanguageModel, texts: list[str]) -> np.ndarray:
    """Bits per character, a row per text and a column per language of the model."""
    symbol_of, automata = _automata(model)
    coded = [symbol_of[np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
             for t in texts]
    length = np.array([len(c) for c in coded])
    pieces = -(-length // PIECE)
    owner = np.repeat(np.arange(len(texts)), pieces)
    flat = np.concatenate(coded)
    start = np.repeat(np.cumsum(length) - length, pieces)
    start = start + PIECE * (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    size = np.minimum(PIECE, np.repeat(np.cumsum(length), pieces) - start)
    order = np.argsort(-size, kind="stable")
    start, size, owner = start[order], size[order], owner[order]
    active = len(size) - np.searchsorted(size[::-1], np.arange(PIECE), side="right")
    out = np.zeros((len(texts), len(automata)))
    for k, (automaton, sample_bits) in enumerate(automata):
        phrases = _phrases(automaton, flat, start, active)
        out[:, k] = np.bincount(owner, phrases, len(texts)) * sample_bits / length
    return out


@dataclass(frozen=True)
class Automaton:
    """``table`` holds, for state and frequent symbol, the next state times SYMBOLS; its last column
    is empty.  ``keys`` are state times ``alphabet`` plus symbol of all other transitions, ascending,
    ``targets`` their next states times SYMBOLS.  0, the root's number, means no match."""

    table: np.ndarray
    keys: np.ndarray
    targets: np.ndarray
    alphabet: int

    def step(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        after = self.table[at + np.minimum(symbol, SYMBOLS - 1)]
        rare = np.flatnonzero((symbol >= SYMBOLS - 1) & (symbol < self.alphabet)) if len(self.keys) else ()
        if len(rare):
            wanted = (at[rare] // SYMBOLS).astype(np.int64) * self.alphabet + symbol[rare]
            place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            after[rare] = np.where(self.keys[place] == wanted, self.targets[place], 0)
        return after


def _phrases(automaton: Automaton, flat: np.ndarray, start: np.ndarray, active: np.ndarray):
    """Phrases of every piece: all pieces advance by one symbol at a time."""
    state = np.zeros(len(start), np.int32)
    count = np.zeros(len(start), np.int64)
    for step, n in enumerate(active):
        if n == 0:
            break
        symbol = flat[start[:n] + step]
        at = state[:n]
        after = automaton.step(at, symbol)
        begins = (after == 0) | (at == 0)
        count[:n] += begins
        ended = np.flatnonzero((after == 0) & (at != 0))
        if len(ended):
            after[ended] = automaton.step(np.zeros(len(ended), np.int32), symbol[ended])
        state[:n] = after
    return count


@lru_cache(maxsize=1)
def _automata(model: LanguageModel):
    """The symbol of every code point, and for each language its table and log2 of its size.  A
    worker builds them once, from samples of bounded size."""
    samples = [np.frombuffer(s.lower().encode("utf-32-le", "surrogatepass"), "<u4")
               for _, s in model.samples]
    found, times = np.unique(np.concatenate(samples), return_counts=True)
    symbol_of = np.full(0x110000, len(found), np.int32)
    symbol_of[found[np.lexsort((found, -times))]] = np.arange(len(found))
    return symbol_of, [(_table(symbol_of[s].tolist(), len(found)), np.log2(len(s) + 1)) for s in samples]


def _table(symbols: list[int], alphabet: int) -> Automaton:
    """The suffix automaton of a sequence of symbols below ``alphabet``."""
    goto, link, length, last = [{}], [-1], [0], 0
    for s in symbols:
        here = len(goto)
        goto.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        last = here
        while p >= 0 and s not in goto[p]:
            goto[p][s] = here
            p = link[p]
        if p < 0:
            continue
        q = goto[p][s]
        if length[p] + 1 == length[q]:
            link[here] = q
            continue
        copy = len(goto)
        goto.append(dict(goto[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        while p >= 0 and goto[p].get(s) == q:
            goto[p][s] = copy
            p = link[p]
        link[q] = link[here] = copy
    table = np.zeros((len(goto), SYMBOLS), np.int32)
    rare = []
    for state, edges in enumerate(goto):
        for s, target in edges.items():
            if s < SYMBOLS - 1:
                table[state, s] = target * SYMBOLS
            else:
                rare.append((state * alphabet + s, target * SYMBOLS))
    rare.sort()
    return Automaton(table.ravel(), np.array([k for k, _ in rare], np.int64),
                     np.array([t for _, t in rare], np.int32), alphabet)
