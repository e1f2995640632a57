"""Removal of byte strings that occur elsewhere, by a sampled suffix cover.

A byte goes if a ``length``-byte string covers it that also starts at another place, in the same text or another one.
Sorting every suffix would move each byte many times over, so only a cover of the suffixes is named and sorted, and the
rest follow from it. As with a difference cover, any two equal strings have a sampled place at the same distance from
their starts; here the sample is chosen by content (the least hash of ``WINDOW`` neighbouring grams), so equal strings
sample alike and about one place in a hundred is enough.

1. Every start of a string belongs to the sampled place that its first grams choose; starts of one place are a run.
2. A place is named by the bytes that all strings of its run share (the core). A core that occurs once ends its run.
3. A run is named by all bytes that its strings touch. A run that occurs twice is removed whole, wherever it is.
4. What is left are runs whose core occurs elsewhere in another setting: at the ends of copies and around edits. Only
   their strings (and one run of each name with the same core) are hashed one by one, sorted and compared to neighbours.

Names are 64-bit hashes; two places count as equal on 128 bits (core and run, or core and string).

Texts are UTF-8 bytes, null is empty. Nothing crosses documents. Rows that share id and text are copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from riskloom.session import drop_staged, stage

LENGTH = 400
WINDOW = 200
GRAM = 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, kept per worker for the longest text so far."""
    if len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _prefixes(data: np.ndarray) -> np.ndarray:
    up, _ = _powers(len(data) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])


def _hashes(prefixes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes at each place."""
    _, down = _powers(len(prefixes))
    return (prefixes[size:] - prefixes[:-size]) * down[: len(prefixes) - size]


def runs(data: bytes, length: int = LENGTH, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``place``, first and last start of each run, and the prefix hashes of the text."""
    raw = np.frombuffer(data, dtype=np.uint8)
    prefixes = _prefixes(raw)
    starts = len(raw) - length + 1
    if starts <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, prefixes
    h = _hashes(prefixes, GRAM)[: starts + window - 1].copy()
    h ^= h >> np.uint64(31)
    h *= _MIX
    h ^= h >> np.uint64(29)
    bits = np.uint64(len(h).bit_length())
    ranked = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)
    padded = np.full(-(-len(ranked) // window) * window, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(ranked)] = ranked
    blocks = padded.reshape(-1, window)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(behind[:starts], ahead[window - 1 : window - 1 + starts])
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:] - 1, [starts - 1]])
    return place[first], first, last, prefixes


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bytes(text) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def sampled(docs: DataFrame, length: int, window: int) -> DataFrame:
    """``id``, ``t``, ``first``, ``last``, ``core`` and ``run`` of every run of every text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data = _bytes(batch["text"][row].as_py())
                place, first, last, _ = runs(data, length, window)
                if not len(place):
                    continue
                core = [_signed(xxhash.xxh3_64_intdigest(data[p : p + length - window + 1])) for p in place.tolist()]
                run = [
                    _signed(xxhash.xxh3_64_intdigest(data[a : b + length], seed=p - a))
                    for p, a, b in zip(place.tolist(), first.tolist(), last.tolist())
                ]
                n = len(core)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch["id"][row].as_py()] * n, pa.int64()), pa.array([batch["t"][row].as_py()] * n, pa.int64()),
                        pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(core, pa.int64()), pa.array(run, pa.int64()),
                    ],
                    names=["id", "t", "first", "last", "core", "run"],
                )

    return docs.mapInArrow(of, "id long, t long, first int, last int, core long, run long")


def _strings(docs: DataFrame, length: int) -> DataFrame:
    """One row per string of the wanted runs (``id``, ``t``, ``own``, ``core``, ``start``, ``s`` its hash)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data = np.frombuffer(_bytes(batch["text"][row].as_py()), dtype=np.uint8)
                hashed = _hashes(_prefixes(data), length).view(np.int64)
                wanted = batch["wanted"][row].as_py()
                sizes = [w["last"] - w["first"] + 1 for w in wanted]
                start = np.concatenate([np.arange(w["first"], w["last"] + 1, dtype=np.int32) for w in wanted])
                total = len(start)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch["id"][row].as_py()] * total, pa.int64()), pa.array([batch["t"][row].as_py()] * total, pa.int64()),
                        pa.array(np.repeat([w["own"] for w in wanted], sizes), pa.bool_()),
                        pa.array(np.repeat(np.array([w["core"] for w in wanted], dtype=np.int64), sizes)),
                        pa.array(start), pa.array(hashed[start]),
                    ],
                    names=["id", "t", "own", "core", "start", "s"],
                )

    return docs.mapInArrow(of, "id long, t long, own boolean, core long, start int, s long")


def repeated_starts(docs: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """``id``, ``t`` and ``spans`` (first and last start) of the strings that occur elsewhere; ``docs`` has id, t, text."""
    places = stage(sampled(docs, length, window), "places")
    held = places.groupBy("core").agg(F.count(F.lit(1)).alias("held"), F.min("run").alias("low"), F.max("run").alias("high"))
    cores = held.filter("held > 1").select("core", (F.col("low") != F.col("high")).alias("mixed"))
    live = stage(places.join(cores, "core").select("id", "t", "first", "last", "core", "run", "mixed"), "live")
    drop_staged(docs.sparkSession, places)
    twice = live.groupBy("core", "run").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("id", "t", "first")).alias("one"))
    marked = stage(live.join(twice, ["core", "run"]), "marked")
    drop_staged(docs.sparkSession, live)
    whole = marked.filter("copies > 1").select("id", "t", F.struct("first", "last").alias("span"))

    # Strings of the runs left, and of one run of each name that shares a core with another name.
    lone = (F.col("id").eqNullSafe(F.col("one.id"))) & (F.col("t") == F.col("one.t")) & (F.col("first") == F.col("one.first"))
    wanted = marked.filter(F.col("mixed") & lone).dropDuplicates(["core", "run"])
    listed = wanted.groupBy("id", "t").agg(
        F.collect_list(F.struct("first", "last", "core", (F.col("copies") == 1).alias("own"))).alias("wanted")
    )
    joined = docs.join(listed, docs["id"].eqNullSafe(listed["id"]) & (docs["t"] == listed["t"]))
    # Hashed once for the counts and once for the strings looked up, so that no table of them is written and the two
    # shuffles are not on disk together.
    each = _strings(joined.select(docs["id"], docs["t"], "text", "wanted"), length)
    met = stage(each.groupBy("core", "s").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("core", "s"), "met")
    single = each.filter("own").join(met, ["core", "s"]).select("id", "t", F.struct(F.col("start").alias("first"), F.col("start").alias("last")).alias("span"))
    return whole.union(single).groupBy("id", "t").agg(F.collect_list("span").alias("spans"))


def covered(spans: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes under strings that start in the spans."""
    out: list[tuple[int, int]] = []
    for first, end in sorted((s["first"], s["last"] + length) for s in spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((first, end))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """Per document: the id, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (the remaining bytes)."""
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("t"), F.col(text).cast("string").alias("text"))
    starts = repeated_starts(named, length, window)
    joined = named.join(starts, named["id"].eqNullSafe(starts["id"]) & (named["t"] == starts["t"]), "left")

    @F.pandas_udf("struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept:binary>")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for text_, held in zip(texts, spans):
            data, out = _bytes(text_), covered(list(held) if held is not None else [], length)
            edges = [0, *[e for pair in out for e in pair], len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
            rows.append((len(data), len(data) - len(kept), len(out), kept))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    return joined.select(named["id"].alias(id_col), cut("text", "spans").alias("x")).select(id_col, "x.*")

