"""Benchmark decontamination: BM25 over the test items, block-max WAND, question and answer overlap.

The test items are the indexed documents, every passage of every training text is a query. A passage's score for an item
is BM25 over its distinct words, divided by the item's score for itself, so one threshold fits items of any length. The
index holds, per word, its greatest weight in each block of items; a block whose greatest weights cannot reach the
threshold is skipped, and of the others every item is scored. All items at or above the threshold are then verified: the
shares of the question's and of the answer's word shingles that the passage holds must both reach ``overlap``. The
answer is an item's last sentence or line, the question what comes before it.

Passages are ``2 * longest`` words and overlap by half, so an item of up to ``longest`` words lies whole in one. The
index is broadcast in parts of at most ``part_items`` items; more items make more passes, joined per text without moving
texts. Null or empty texts have no passage; items without words match nothing; equal items are all reported. Blocks are
dense rows of weights, not lists of postings with a pivot: a passage adds up the rows of its words for the blocks that are open.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from riskloom.session import stage

_WORD = re.compile(r"\w+")
_END = re.compile(r"(?<=[.!?])\s+|\n")


@dataclass(frozen=True)
class Item:
    """A test item: its id and the shingles of question and answer."""

    id: int | None
    question: frozenset[tuple[str, ...]]
    answer: frozenset[tuple[str, ...]]


@dataclass(frozen=True)
class Index:
    """Words to rows; ``weights`` row by item, ``tops`` row by block of items; the last row is for unknown words."""

    words: dict[str, int]
    weights: np.ndarray
    tops: np.ndarray
    items: tuple[Item, ...]
    block: int
    passage: int


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingles(words: list[str], size: int) -> frozenset[tuple[str, ...]]:
    """Runs of ``size`` words; fewer words are one run of their own."""
    if not words:
        return frozenset()
    return frozenset(zip(*(words[k:] for k in range(size)))) if len(words) >= size else frozenset([tuple(words)])


def parts(text: str) -> tuple[str, str]:
    """Question and answer; an item of one sentence is both."""
    sentences = [s for s in _END.split(text) if _WORD.search(s)]
    if len(sentences) < 2:
        return text, text
    return " ".join(sentences[:-1]), sentences[-1]


@dataclass(frozen=True)
class Statistics:
    """Of all items: how many have words, their mean length, and in how many each word is."""

    n: int
    length: float
    held: dict[str, int]


def build_index(
    items: list[tuple[int | None, str]], passage: int, size: int = 5, block: int = 16, k1: float = 1.2, b: float = 0.75,
    whole: Statistics | None = None,
) -> Index:
    """Index of the items that have words; ``whole`` has the statistics of all items where these are a part."""
    split = [(i, t, tokens(t)) for i, t in items if t and _WORD.search(t)]
    words: dict[str, int] = {}
    for _, _, ws in split:
        for w in ws:
            words.setdefault(w, len(words))
    n = len(split)
    counts = np.zeros((len(words) + 1, n), dtype=np.float64)
    for k, (_, _, ws) in enumerate(split):
        for w in ws:
            counts[words[w], k] += 1
    lengths = counts.sum(axis=0)
    held = (counts > 0).sum(axis=1, keepdims=True)
    total, mean = n, lengths.mean() if n else 1.0
    if whole is not None:
        held[:-1, 0] = [whole.held[w] for w in words]
        total, mean = whole.n, whole.length
    idf = np.log(1 + (total - held + 0.5) / (held + 0.5))
    scaled = k1 * (1 - b + b * lengths / max(mean, 1.0))
    weights = idf * counts * (k1 + 1) / (counts + scaled) if n else counts
    weights = (weights / weights.sum(axis=0)).astype(np.float32) if n else weights.astype(np.float32)
    tops = np.stack([weights[:, k : k + block].max(axis=1) for k in range(0, n, block)], axis=1) if n else weights[:, :0]
    made = tuple(Item(i, shingles(tokens(parts(t)[0]), size), shingles(tokens(parts(t)[1]), size)) for i, t, _ in split)
    return Index(words, weights, np.ascontiguousarray(tops), made, block, passage)


def retrieve(words: list[str], index: Index, threshold: float) -> Iterator[tuple[int, int, list[int]]]:
    """Passages (start, end) with the items that score at or above the threshold."""
    unknown = len(index.words)
    get = index.words.get
    ids = np.array([get(w, unknown) for w in words], dtype=np.int64)
    ceiling = np.concatenate([[0.0], np.cumsum(index.tops.max(axis=1)[ids])])
    step = index.passage // 2
    slack = threshold - 1e-5
    for start in range(0, max(len(words) - step, 1), step):
        end = min(start + index.passage, len(words))
        if ceiling[end] - ceiling[start] < slack:
            continue
        rows = np.unique(ids[start:end])
        open_blocks = np.flatnonzero(index.tops[rows].sum(axis=0) >= slack)
        found: list[int] = []
        for block in open_blocks:
            low = int(block) * index.block
            scores = index.weights[rows, low : low + index.block].sum(axis=0)
            found += [low + int(k) for k in np.flatnonzero(scores >= slack)]
        if found:
            yield start, end, found


def inspect(text: str, index: Index, threshold: float, overlap: float, size: int = 5) -> tuple[int, int, list[int]]:
    """Passages, retrieved passage-item pairs, and the verified item ids in order."""
    words = tokens(text)
    if not words or not index.items:
        return 0, 0, []
    step = index.passage // 2
    retrieved, verified = 0, set()
    for start, end, found in retrieve(words, index, threshold):
        retrieved += len(found)
        by_size: dict[int, frozenset] = {}
        for k in found:
            item = index.items[k]
            if item.id not in verified and all(
                sum(s in _of(by_size, words, start, end, len(s)) for s in part) >= overlap * len(part)
                for part in (item.question, item.answer)
            ):
                verified.add(item.id)
    return len(range(0, max(len(words) - step, 1), step)), retrieved, sorted(verified, key=lambda i: (i is None, i or 0))


def _of(by_size: dict[int, frozenset], words: list[str], start: int, end: int, size: int) -> frozenset:
    if size not in by_size:
        by_size[size] = frozenset(zip(*(words[start + k : end] for k in range(size))))
    return by_size[size]


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    into: str = "leak",
    threshold: float = 0.7,
    overlap: float = 0.8,
    size: int = 5,
    part_items: int = 500,
) -> DataFrame:
    """``docs`` with a struct ``into``: ``n_passages``, ``n_retrieved`` and ``items``, the ids verified in the text.

    Items without an id are searched as well and reported as null. Word frequencies, item count and mean length are taken
    over all items, so an item's score does not depend on the part it is in. A column that is named ``into`` is replaced.
    """
    spark = docs.sparkSession
    # Items come to the driver a part at a time, with the frequencies of their own words.
    pairs = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).cast("string").alias("text")).distinct()
    pairs = stage(pairs.withColumn("words", F.pandas_udf(_tokened, "array<string>")(F.coalesce("text", F.lit("")))).filter(F.size("words") > 0), "items")
    seen = pairs.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.size("words")).alias("length"), F.coalesce(F.max(F.size("words")), F.lit(0)).alias("longest")
    ).first()
    each = pairs.select("id", "text", F.explode(F.array_distinct("words")).alias("word"))
    held = each.groupBy("word").agg(F.count(F.lit(1)).alias("held"))
    counted = each.join(held, "word").groupBy("id", "text").agg(F.collect_list(F.struct("word", "held")).alias("words"))
    n_parts = max(1, -(-seen.n // part_items))
    passage = max(128, 2 * seen.longest)
    counted = stage(counted.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(n_parts))), "counted-items")
    columns = []
    for k in range(n_parts):
        rows = sorted(counted.filter(F.col("part") == k).collect(), key=lambda r: (r.id is None, r.id or 0, r.text))
        whole = Statistics(seen.n, seen.length or 1.0, {w.word: w.held for r in rows for w in r.words})
        index = build_index([(r.id, r.text) for r in rows], passage, size, whole=whole)
        columns.append(_judge(spark, index, threshold, overlap, size)(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    if len(columns) == 1:
        return docs.withColumn(into, columns[0])
    found = F.array(*columns)
    return docs.withColumn(into, F.struct(
        F.array_max(F.transform(found, lambda x: x["n_passages"])).alias("n_passages"),
        F.aggregate(found, F.lit(0).cast("long"), lambda t, x: t + x["n_retrieved"]).alias("n_retrieved"),
        F.array_sort(F.array_distinct(F.flatten(F.transform(found, lambda x: x["items"])))).alias("items"),
    ))


def _tokened(texts: pd.Series) -> pd.Series:
    return texts.map(tokens)


def _judge(spark, index: Index, threshold: float, overlap: float, size: int):
    shared = spark.sparkContext.broadcast(index)

    @F.pandas_udf("struct<n_passages:bigint,n_retrieved:bigint,items:array<bigint>>")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = [inspect(t, shared.value, threshold, overlap, size) for t in texts]
        return pd.DataFrame(rows, columns=["n_passages", "n_retrieved", "items"])

    return of


def decontaminate(docs: DataFrame, benchmark: DataFrame, into: str = "leak", **options) -> DataFrame:
    """``docs`` without those that hold an item."""
    judged = contaminated(docs, benchmark, into=into, **options)
    return judged.filter(F.size(F.col(into)["items"]) == 0).drop(into)
