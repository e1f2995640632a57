"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled text knows all its substrings. A text is parsed
greedily against it: each phrase is the longest match, and the next begins at the character that did not fit. The
number of phrases times log2 of the sample's length over the text's length estimates the cross entropy; the language
that needs least wins, ties going to the first name.

Texts are parsed whole. Their characters run in lanes of ``LANE`` so that one vector step moves all texts of a batch;
a lane's end ends a phrase, for every language alike. The automata are bounded by the sample (``docs`` texts of
``chars`` characters per language) and travel with the job; nothing else is collected.

Null texts and texts without a letter are ``und`` with score 0, and so is everything if nothing was labelled. Rows
without a language or text are not learned from. Repeated rows are judged alike.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

LANE = 256
_LETTERS = re.compile(r"[^\W\d_]+")
_BATCH = 1 << 22


@dataclass(frozen=True)
class Automaton:
    """Transitions as one table: twice the next state, plus one where a phrase ends; rows are states."""

    name: str
    size: int
    symbols: int
    table: np.ndarray


def normalise(text: str) -> str:
    """Lower case, every run of other characters than letters one space."""
    return " ".join(_LETTERS.findall(text.lower()))


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the automaton of all substrings; state 0 is the empty one."""
    nxt: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return nxt


def automaton(name: str, text: str, classes: dict[str, int]) -> Automaton:
    """Dense table over ``classes`` (symbol 0 is any other character, the last one is padding that changes nothing)."""
    nxt, symbols = suffix_automaton(text), len(classes) + 2
    restart = np.ones(symbols, dtype=np.int32)
    for c, to in nxt[0].items():
        restart[classes[c]] = 2 * to + 1
    table = np.tile(restart, (len(nxt), 1))
    for state, moves in enumerate(nxt):
        for c, to in moves.items():
            table[state, classes[c]] = 2 * to
    table[:, symbols - 1] = 2 * np.arange(len(nxt))
    return Automaton(name, len(text), symbols, table.reshape(-1))


def sample(labelled: DataFrame, text: str, lang: str, docs: int, chars: int) -> DataFrame:
    """``lang`` and ``text``: at most ``docs`` texts per language, those of least hash, ``chars`` characters of each."""
    usable = labelled.filter(F.col(lang).isNotNull() & F.col(text).rlike("\\p{L}"))
    cut = usable.select(F.col(lang).cast("string").alias("lang"), F.substring(text, 1, chars).alias("text"), F.md5(text).alias("order"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("order", "text"))
    return cut.distinct().withColumn("n", first).filter(F.col("n") <= docs).select("lang", "text", "order")


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", docs: int = 48, chars: int = 500) -> tuple[list[Automaton], str]:
    """One automaton per language of the labelled rows, sorted by name, and the alphabet they share."""
    parts: dict[str, list[tuple[str, str]]] = {}
    for row in sample(labelled, text, lang, docs, chars).collect():
        parts.setdefault(row.lang, []).append((row.order, normalise(row.text)))
    joined = {name: " ".join(t for _, t in sorted(texts)) for name, texts in sorted(parts.items())}
    joined = {name: t for name, t in joined.items() if t}
    alphabet = "".join(sorted(set().union(*joined.values())))
    classes = {c: k for k, c in enumerate(alphabet, 1)}
    return [automaton(name, t, classes) for name, t in joined.items()], alphabet


def _lanes(texts: list[str], classes: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols in columns of ``LANE`` and the text of each column."""
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    counts = np.array([-(-len(c) // LANE) for c in codes], dtype=np.int64)
    grid = np.full((int(counts.sum()), LANE), pad, dtype=np.int32)
    flat, at = grid.reshape(-1), 0
    for c, n in zip(codes, counts):
        flat[at : at + len(c)] = classes[np.minimum(c, len(classes) - 1)]
        at += int(n) * LANE
    return np.ascontiguousarray(grid.T), np.repeat(np.arange(len(texts)), counts)


def phrases(texts: list[str], automata: list[Automaton], alphabet: str) -> np.ndarray:
    """Phrases of each normalised text (rows) for each automaton (columns)."""
    classes = np.zeros(max([0, *map(ord, alphabet)]) + 2, dtype=np.int32)
    for k, c in enumerate(alphabet, 1):
        classes[ord(c)] = k
    out = np.zeros((len(texts), len(automata)))
    grid, owner = _lanes(texts, classes, len(alphabet) + 1)
    for k, a in enumerate(automata):
        state = np.zeros(grid.shape[1], dtype=np.int32)
        ended = np.ones(grid.shape[1], dtype=np.int32)  # the phrase that the lane's end closes
        for row in grid:
            move = a.table[state * a.symbols + row]
            ended += move & 1
            state = move >> 1
        out[:, k] = np.bincount(owner, weights=ended, minlength=len(texts))
    return out


def judge(texts: list[str], automata: list[Automaton], alphabet: str) -> list[tuple[str, float]]:
    """Language and score of each text: one less the best language's entropy over the next one's."""
    answers: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
    lettered = [k for k, t in enumerate(texts) if any(map(str.isalpha, t))] if automata else []
    weights = np.array([log2(a.size + 1) for a in automata])
    at = 0
    while at < len(lettered):
        block, chars = [], 0
        while at < len(lettered) and (not block or chars + len(texts[lettered[at]]) <= _BATCH):
            block.append(lettered[at])
            chars += len(texts[lettered[at]])
            at += 1
        cost = phrases([normalise(texts[k]) for k in block], automata, alphabet) * weights
        for row, k in zip(cost, block):
            order = np.argsort(row, kind="stable")
            score = 1.0 if len(row) == 1 else 1.0 - row[order[0]] / row[order[1]]
            answers[k] = (automata[order[0]].name, float(score))
    return answers


def predict(docs: DataFrame, automata: list[Automaton], alphabet: str, text: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with a struct ``into`` of ``lang_pred`` and ``score``; only the text is read."""
    shared = docs.sparkSession.sparkContext.broadcast((automata, alphabet))

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(judge(list(texts), *shared.value), columns=["lang_pred", "score"])

    return docs.withColumn(into, of(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def held_out(id_: Column) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text, remainder 2 by 4."""
    return F.coalesce(F.crc32(id_.cast("string")) % 4 == 2, F.lit(False))
