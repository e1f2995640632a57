"""SimHash near-duplicates by deletion-variant signatures.

A text's fingerprint has a bit set where more than half of its word shingles' 64-bit hashes have it. Two fingerprints
with at most ``distance`` differing bits, cut into one segment per two of those bits, agree in some segment but for one
bit at most. So each distinct fingerprint is indexed under every segment as it is and under every segment with one bit
wildcarded; equality joins meet each pair that could be near, and the bit distance is verified there. A wildcard key
only joins fingerprints that differ in its bit, so a pair meets once per segment, and no segment value that is equal is
met 32 times.

Copies of a fingerprint are one row before anything is joined, and joins give verified links only. Hot keys are split
by adaptive skew joins. Components are found by contraction (``components``). Null and empty texts have fingerprint
zero, linked like any other; repeated rows and rows with null ids keep their place in the result.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from riskloom.session import stage

from .common import fresh
from .components import components

SEED = 42
BITS = 64
_WORD = re.compile("[^\x20\x09-\x0d]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_BLOCK = 1 << 15


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    """Fingerprint of one text as a signed 64-bit number; the counts are taken over blocks of hashes."""
    words = _WORD.findall((text or "").translate(_LOWER))
    if not words:
        return 0
    runs = zip(*(words[k:] for k in range(shingle))) if len(words) >= shingle else [words]
    hashes = np.fromiter((xxhash.xxh64_intdigest(" ".join(r), SEED) for r in runs), dtype=np.uint64)
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), _BLOCK):
        bits = np.unpackbits(hashes[at : at + _BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    value = sum(1 << int(k) for k in np.flatnonzero(2 * counts > len(hashes)))
    return value - (1 << BITS) if value >> (BITS - 1) else value


def fingerprint(docs: DataFrame, text: str = "text", into: str = "fingerprint", shingle: int = 3) -> DataFrame:
    """``docs`` with the ``long`` fingerprint of each whole text."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint_of(t, shingle)).astype("int64")

    return docs.withColumn(into, of(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def signatures(prints: DataFrame, distance: int = 3) -> DataFrame:
    """``key``, ``side`` and ``f``: every segment of every fingerprint as it is (``side`` null) and per wildcarded bit.

    The key packs the segment's number, the wildcard's place and the other bits; ``side`` is the bit at the wildcard.
    """
    segments = (distance + 1) // 2
    edges = [BITS * k // segments for k in range(segments + 1)]
    entries = []
    for number, (low, high) in enumerate(zip(edges, edges[1:])):
        part = F.shiftrightunsigned(F.col("f"), low).bitwiseAND(F.lit((1 << (high - low)) - 1 if high - low < 64 else -1).cast("long"))
        entries.append(F.struct(F.lit(number * 128 + 127).alias("at"), part.alias("rest"), F.lit(None).cast("int").alias("side")))
        for bit in range(high - low):
            one = F.lit(1 << bit if bit < 63 else -(1 << 63)).cast("long")
            side = F.when(part.bitwiseAND(one) != 0, 1).otherwise(0)
            entries.append(F.struct(F.lit(number * 128 + bit).alias("at"), part.bitwiseAND(F.bitwise_not(one)).alias("rest"), side.alias("side")))
    return prints.select("f", F.inline(F.array(*entries)))


def links(prints: DataFrame, distance: int = 3) -> DataFrame:
    """``a`` and ``b``: pairs of distinct fingerprints with at most ``distance`` differing bits (a pair may repeat)."""
    if distance <= 0:
        return prints.select(F.col("f").alias("a"), F.col("f").alias("b")).limit(0)
    index = signatures(prints, distance)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    left = index.select("at", "rest", "side", F.col("f").alias("a"))
    right = index.select("at", "rest", F.col("side").alias("other"), F.col("f").alias("b"))
    ordered = (F.col("side").isNull() & (F.col("a") < F.col("b"))) | ((F.col("side") == 0) & (F.col("other") == 1))
    same = [left[c] == right[c] for c in ("at", "rest")]
    # Spark takes the keys of all segments for as large as the fingerprints, and would broadcast them.
    return left.join(right.hint("merge"), [*same, ordered & near]).select("a", "b")


def _classes(prints: DataFrame, distance: int) -> DataFrame:
    """``f`` and ``least`` (the least id of each fingerprint) with the ``root`` of the fingerprint's component."""
    found = components(links(prints, distance)).withColumnRenamed("node", "f")
    return prints.join(found, "f", "left").withColumn("root", F.coalesce("root", "f"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 3
) -> DataFrame:
    """The ids with ``fingerprint`` (16 hex digits) and ``component_id``, the least id reachable over links."""
    ided = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    printed = stage(fingerprint(ided, "text", "f", shingle).select("id", "f"), "fingerprints")
    prints = stage(printed.groupBy("f").agg(F.min("id").alias("least")), "prints")
    linked = stage(_classes(prints, distance), "classes")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = linked.select("f", "root").join(least, "root").select("f", "component_id")
    return printed.join(classes, "f").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_per_class(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 3
) -> DataFrame:
    """``docs`` less all but one document of each class: the one of least id (null ids come last).

    Repeated rows of that id and fingerprint are one document, and the one of least content hash stays.
    """
    key = fresh(docs, "_key")
    printed = stage(
        fingerprint(docs, text, "f", shingle).select(F.col(id_col).alias("id"), "f", F.xxhash64(text).alias("t")), "fingerprints"
    )
    rank = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("f"), F.col("t"))
    prints = stage(printed.groupBy("f").agg(F.min(rank).alias("least")), "prints")
    name = lambda i, t: F.concat_ws(":", F.coalesce(F.col(i).cast("string"), F.lit("")), F.hex(t))
    winners = _classes(prints, distance).groupBy("root").agg(F.min("least").alias("w")).select("w.id", "w.t")
    kept = winners.select(name("id", F.col("t")).alias(key))
    mine = docs.withColumn(key, name(id_col, F.xxhash64(text)))
    # The join leaves equal keys in one task, sorted, so dropping repeated rows moves nothing more.
    return mine.join(kept, key, "left_semi").dropDuplicates([key]).drop(key)
