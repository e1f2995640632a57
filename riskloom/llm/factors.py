"""Removal of repeated word windows by relative Lempel-Ziv parsing against an indexed reference.

The reference of a document is all that starts earlier (smaller id, or the same document and an earlier start). A word goes
if a window of ``WINDOW`` words covers it that occurs in the reference: that is, if it lies in a factor of at least that many
words. Parsing every document against every block of documents would cost the square of the corpus, so the reference is
cut and indexed by content, and a document meets only the blocks that can hold a long factor of it:

1. Cut: every window belongs to an anchor, the gram of ``GRAM`` words with the least hash among its grams. Equal windows have
   equal anchors at the same distance. Neighbouring windows with one anchor are a fragment (20 to 34 words).
2. Index: an anchor that occurs once has no factor. The fragments of any other anchor are its reference block; equal ones
   are counted map-side and named by their first place, so copies are one entry however many there are.
3. Parse: a fragment whose name has an earlier place is matched whole and lengthens the factor at hand.
4. Factor boundaries: a fragment that is the first of its name is parsed window by window against the other fragments of
   its block, in the order of their places, so that the index holds what is earlier and nothing else. Blocks of more than
   ``BLOCK`` names are not gathered; their windows are grouped one by one with the first place of each.
5. The factors of a document are joined, and the words under them go.

Names are 64-bit hashes under a 64-bit anchor; windows count as equal on these 128 bits.

Null texts have no words. A null id comes after all others; rows of one id are one document, so equal places in them are not
earlier than each other and repeated rows give equal results. Documents shorter than the window lose nothing. Other columns
are not read. A text is parsed with some 100 bytes per word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from riskloom.session import drop_staged, stage

WINDOW = 20
GRAM = 6
#: Names in a reference block that one task goes through in order.
BLOCK = 10_000
#: Text hashed at a time.
PIECE_BYTES = 1 << 20
_WORD = re.compile("[^\x20\x09-\x0d]+")
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_HIGH = np.uint64(0xFFFFFFFF00000000)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _BASE, np.uint64)]))


_POWERS = _powers(1 << 12)


def words(text: str | None) -> list[str]:
    return _WORD.findall(text) if text else []


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring strings out of their hashes."""
    x = a * _BASE + b
    x ^= x >> np.uint64(32)
    x *= _MIX
    x ^= x >> np.uint64(29)
    return x


def grams(hashed: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words at each place, by doubling."""
    total, at, power, width = None, 0, hashed, 1
    while True:
        if size & width:
            rest = power[at:]
            total = rest if total is None else _joined(total[: len(rest)], rest)
            at += width
        if at == size or len(power) <= width:
            break
        power = _joined(power[:-width], power[width:])
        width *= 2
    n = max(0, len(hashed) - size + 1)
    return total[:n] if total is not None and at == size else np.zeros(0, np.uint64)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    return np.minimum(values[: len(values) - (width - reach)], values[width - reach :]) if width > reach else values


def fragments(hashed: np.ndarray, counts: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Every fragment of the texts whose words' hashes stand one after the other, ``counts`` words each.

    The text's row, ``first`` window, number of windows and place of the anchor in the text, ``core`` and ``run``.
    """
    rows = np.repeat(np.arange(len(counts)), counts)
    if len(hashed) < window or not (whole_text := rows[: len(rows) - window + 1] == rows[window - 1 :]).any():
        return (np.zeros(0, np.int64),) * 6
    small = grams(hashed, gram)
    ranked = (_joined(small, small) & _HIGH) | np.arange(len(small), dtype=np.uint64)
    place = (_least(ranked, window - gram + 1) & ~_HIGH).astype(np.int64)
    # A window of one text starts a fragment where the anchor changes; anchors of two texts differ.
    starts = whole_text.copy()
    starts[1:] &= (place[1:] != place[:-1]) | ~whole_text[:-1]
    first = np.flatnonzero(starts)
    n = np.add.reduceat(whole_text, first, dtype=np.int64)
    at = place[first]
    whole = grams(hashed, window)
    # The first and the last window cover the fragment, so their hashes and its shape name it.
    run = _joined(_joined(whole[first], whole[first + n - 1]), (n * 64 + at - first).astype(np.uint64))
    begin = (np.cumsum(counts) - counts)[rows[first]]
    return rows[first], first - begin, n, at - begin, small[at].view(np.int64), run.view(np.int64)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of about ``PIECE_BYTES`` of text; a longer text is a piece of its own."""
    sizes = pc.binary_length(batch["text"]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    number = (np.cumsum(sizes) - sizes) // PIECE_BYTES
    edges = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(sizes)]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def _hashed_words(data: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of some bytes in which texts start at the given places."""
    letter = ~_SPACE[data]
    opens = np.ones(len(data), bool)
    opens[1:] = ~letter[:-1]
    opens[texts] = True
    starts = np.flatnonzero(letter & opens)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    kept = data[letter].astype(np.uint64) + np.uint64(1)
    first = (np.cumsum(letter) - 1)[starts]
    sizes = np.diff(np.append(first, len(kept)))
    powers = _POWERS if sizes.max() <= len(_POWERS) else _powers(int(sizes.max()))
    kept *= powers[np.arange(len(kept)) - np.repeat(first, sizes)]
    return starts, _joined(np.add.reduceat(kept, first), sizes.astype(np.uint64))


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one text after the other, and the number of words of each.

    Words are found in the bytes of the Arrow column: the six blanks are single bytes in UTF-8.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, values = texts.buffers()
    edges = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(values, np.uint8)[edges[0] : edges[-1]] if values else np.zeros(0, np.uint8)
    edges = edges - edges[0]
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = at + PIECE_BYTES
        while end < len(data) and not _SPACE[data[end]]:  # a cut goes between words
            end += 1
        end = min(end, len(data))
        inside = edges[np.searchsorted(edges, at) : np.searchsorted(edges, end)] - at
        found, hashed = _hashed_words(data[at:end], inside)
        starts.append(found + at)
        hashes.append(hashed)
        at = end
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), edges))


def _cut(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Every fragment of every document (``id``, ``t``, ``text``)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch):
                row, first, n, at, core, run = fragments(*_word_hashes(piece["text"]), window, gram)
                if len(row):
                    row, whole = pa.array(row), pa.int32()
                    columns = [piece["id"].take(row), piece["t"].take(row), pa.array(first, whole), pa.array(n, whole), pa.array(at, whole), pa.array(core), pa.array(run)]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "t", "first", "n", "at", "core", "run"])

    return docs.mapInArrow(of, "id long, t int, first int, n int, at int, core long, run long")


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """The hashed windows of the fragments listed in ``wanted``, with the fragment's place."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch):
                hashed, counts = _word_hashes(piece["text"])
                whole = grams(hashed, window).view(np.int64)
                wanted = piece["wanted"].flatten()
                row = pc.list_parent_indices(piece["wanted"])
                first, n = (wanted.field(c).to_numpy().astype(np.int64) for c in ("first", "n"))
                ends = np.cumsum(n)
                start = (np.cumsum(counts) - counts)[row.to_numpy()] + first
                windows = whole[np.repeat(start - (ends - n), n) + np.arange(ends[-1])]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(windows))
                ids = piece["id"].take(row)
                columns = [ids.is_null(), ids, wanted.field("at"), piece["t"].take(row), wanted.field("first"), wanted.field("core"), wanted.field("large"), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["none", "id", "at", "t", "first", "core", "large", "windows"])

    return docs.mapInArrow(of, "none boolean, id long, at int, t int, first int, core long, large boolean, windows array<long>")


def _parsed(blocks: DataFrame) -> DataFrame:
    """``id``, ``t`` and first and last window of the factors found in blocks that are read in the order of their places."""
    ordered = blocks.repartition("core").sortWithinPartitions("core", "none", "id", "at")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, place, index, waiting = None, None, set(), []
        for batch in batches:
            out = []
            places = zip(*(batch[c].to_pylist() for c in ("core", "none", "id", "at", "t", "first", "windows")))
            for own, none, id_, at, t, first, hashed in places:
                if own != core:
                    core, place, index, waiting = own, None, set(), []
                if (none, id_, at) != place:  # equal places are not earlier than each other
                    index.update(waiting)
                    place, waiting = (none, id_, at), []
                waiting.extend(hashed)
                start = None
                for k, h in enumerate(hashed):
                    if h in index:
                        start = k if start is None else start
                    elif start is not None:
                        out.append((id_, t, first + start, first + k - 1))
                        start = None
                if start is not None:
                    out.append((id_, t, first + start, first + len(hashed) - 1))
            if out:
                columns = zip(*out)
                types = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, types)], names=["id", "t", "first", "last"])

    return ordered.mapInArrow(of, "id long, t int, first int, last int")


def _grouped(blocks: DataFrame) -> DataFrame:
    """The same for blocks of too many names: every window with the first place it has."""
    place = F.struct("none", "id", "at")
    each = blocks.select("id", "t", "core", place.alias("place"), F.posexplode("windows").alias("k", "h"), F.col("first").alias("from"))
    least = each.groupBy("core", "h").agg(F.min("place").alias("earliest"))
    later = each.join(least, ["core", "h"]).filter("place > earliest")
    return later.select("id", "t", (F.col("from") + F.col("k")).alias("first"), (F.col("from") + F.col("k")).alias("last"))


def factors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """``id``, ``t`` and ``spans`` (first and last window start) of the factors; ``docs`` has ``id``, ``t`` and ``text``."""
    spark = docs.sparkSession
    cut = stage(_cut(docs, window, gram), "fragments")
    held = cut.groupBy("core").agg(F.count(F.lit(1)).alias("held"), F.min("run").alias("low"), F.max("run").alias("high"))
    anchors = held.filter("held > 1").select("core", (F.col("low") != F.col("high")).alias("mixed"))
    live = stage(cut.join(anchors, "core"), "live")
    drop_staged(spark, cut)
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("at").alias("at"))
    names = stage(live.groupBy("core", "run", "mixed").agg(F.min(place).alias("earliest")), "names")
    large = names.filter("mixed").groupBy("core").agg(F.count(F.lit(1)).alias("names")).filter(F.col("names") > block).select("core", F.lit(True).alias("large"))
    met = stage(live.join(names.drop("mixed"), ["core", "run"]).withColumn("later", place > F.col("earliest")).filter("later OR mixed"), "met")
    drop_staged(spark, live)
    whole = met.filter("later").select("id", "t", "first", (F.col("first") + F.col("n") - 1).alias("last"))

    wanted = met.filter("NOT later").join(large, "core", "left")
    entry = F.struct("first", "n", "at", "core", F.coalesce("large", F.lit(False)).alias("large"))
    listed = wanted.groupBy("id", "t").agg(F.collect_set(entry).alias("wanted"))
    texts = docs.join(listed, docs["id"].eqNullSafe(listed["id"]) & (docs["t"] == listed["t"]))
    texts = texts.select(docs["id"], docs["t"], "text", "wanted")
    blocks = stage(_windows(texts, window), "blocks")
    found = whole.unionByName(_parsed(blocks.filter("NOT large"))).unionByName(_grouped(blocks.filter("large")))
    spans = stage(found.groupBy("id", "t").agg(F.collect_list(F.struct("first", "last")).alias("spans")), "factors")
    drop_staged(spark, names, met, blocks)
    return spans


def covered(spans, window: int) -> list[tuple[int, int]]:
    """Maximal runs of words under windows that start in the spans (``first`` and ``last`` each)."""
    out: list[tuple[int, int]] = []
    for first, end in sorted((s["first"], s["last"] + window) for s in spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((first, end))
    return out


def remove_factors(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, block: int = BLOCK
) -> DataFrame:
    """Per document: the id, ``n_words``, ``n_removed`` and ``kept`` (the words left, joined by one space)."""
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.hash(text).alias("t"), F.col(text).cast("string").alias("text"))
    found = factors(named, window, gram, block)
    joined = named.join(found, named["id"].eqNullSafe(found["id"]) & (named["t"] == found["t"]), "left")

    @F.pandas_udf("struct<n_words:bigint,n_removed:bigint,kept:string>")
    def parted(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for text_, held in zip(texts, spans):
            all_, out = words(text_), covered(held, window) if held is not None else []
            edges = [0, *[e for pair in out for e in pair], len(all_)]
            kept = [w for a, b in zip(edges[::2], edges[1::2]) for w in all_[a:b]]
            rows.append((len(all_), len(all_) - len(kept), " ".join(kept)))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])

    return joined.select(named["id"].alias(id_col), parted("text", "spans").alias("x")).select(id_col, "x.*")
