"""Fuzzy line dedup by MinHash, on SQL functions alone.

A line's shingles are all its runs of ``SIZE`` characters, one from each character on; a line of no more characters is its
own shingle. Equal lines are one row before anything else. The signature has ``bands`` permutations of the
shingles' 64-bit hashes and the ``rows`` least hashes under each; lines that agree in all rows of a band are candidates.
Similarity is the exact Jaccard coefficient of the sets of hashes.

A bucket is not expanded into all pairs. Its most frequent line is the pivot and is compared with every member. Members
found in one component need no more; two members of different components are compared unless an exact bound parts them:
their sizes, the triangle inequality of the Jaccard distance over their distances to the pivot, or the parities of their
sets, whose 2,048 bits leave little but links and pairs just short of one. So every link between components of one bucket
is found.
Components are closed by contraction (``components``); of each, the first line (least document id, then place) stays.

Lines without a word always stay and are never compared. Null and empty texts have no lines to drop. Documents that share
id and text are one document here: each keeps what the first keeps. Null ids come after all others.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.session import drop_staged, stage

from .common import SPACES, fresh, let, text_or_empty
from .components import components

SIZE = 5
#: Ids of candidate lines that are broadcast to pick their texts; more are joined by shuffle.
BROADCAST_IDS = 500_000
#: Words of 64 bits in the parity of a set of shingles, a power of two.
PARITY_WORDS = 32


def _shingle_hashes(line: Column, size: int) -> Column:
    """Hashes of the runs of ``size`` characters; white space of any kind counts as a space.

    Four bytes a character, so that a run is cut out of a line without a walk over the characters before it. ``translate``
    looks each character up, so that only lines with other white space than spaces go through it.
    """
    odd = reduce(or_, [F.contains(line, F.lit(c)) for c in SPACES[1:]])
    flat = F.when(odd, F.translate(line, SPACES[1:], " " * (len(SPACES) - 1))).otherwise(line)

    def runs(wide: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(wide) - (4 * size - 1), F.lit(1)), F.lit(4))
        return F.transform(starts, lambda at: F.xxhash64(F.substring(wide, at, F.lit(4 * size))))

    return let(F.encode(flat, "UTF-32"), runs)


def _document(id_: Column, text_hash: Column) -> Column:
    return F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("")), F.hex(text_hash))


def document(id_col: str, text: str) -> Column:
    return _document(F.col(id_col), F.xxhash64(text))


def _lines_of(text: Column) -> Column:
    return F.split(text_or_empty(text), "\n", -1)


def n_lines(text: str) -> Column:
    """Lines with a word."""
    return F.size(F.filter(_lines_of(F.col(text)), _has_word)).cast("long")


def _has_word(line: Column) -> Column:
    return line.rlike(f"[^{SPACES}]")


def _name(line: Column) -> list[Column]:
    """128 bits of a line, in two columns."""
    return [F.xxhash64(line).alias("h"), F.xxhash64(F.lit(1), line).alias("g")]


def _hashes(line: Column, size: int) -> Column:
    """The set of a line's shingles, as sorted 64-bit hashes."""
    return F.array_distinct(F.sort_array(_shingle_hashes(line, size)))


def _band_keys(lines: DataFrame, bands: int, rows: int) -> DataFrame:
    """``lines`` with ``keys`` in place of their sorted ``set``: band k holds the ``rows`` least hashes under its permutation.

    The permutation subtracts the band's offset modulo 2 ** 64, so its least hashes are those that follow the offset in
    order, around the end. One sort serves all bands; a set smaller than ``rows`` goes around more than once.
    """
    offsets = [(k << 64) // bands - (1 << 63) for k in range(bands)]
    placed = F.sort_array(F.concat("set", F.array(*[F.lit(o).cast("long") for o in offsets])))
    around = F.when(F.size("set") >= rows, F.concat("set", F.slice("set", 1, rows))).otherwise(F.concat(*["set"] * (rows + 1)))
    other = [c for c in lines.columns if c != "set"]
    ready = lines.select(*other, F.size("set").alias("size"), placed.alias("placed"), around.alias("around"))
    # The place of an offset less the offsets before it is the number of hashes below it.
    below = [F.array_position("placed", F.lit(o).cast("long")).cast("int") - k for k, o in enumerate(offsets)]
    keys = [F.xxhash64(F.lit(k), F.slice("around", start, rows)) for k, start in enumerate(below)]
    return ready.select(*other, "size", F.array(*keys).alias("keys"))


def distinct_lines(docs: DataFrame, text: str, bands: int, rows: int, size: int) -> DataFrame:
    """Distinct lines: ``id``, ``h`` and ``g`` (128 bits of the text), ``n`` occurrences, ``size`` in shingles, ``keys`` of the bands, ``line``.

    One exchange: lines are counted before it, and their shingles are hashed where they arrive.
    """
    each = docs.select(F.explode(_lines_of(F.col(text))).alias("line")).filter(_has_word(F.col("line")))
    counted = each.groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    signed = _band_keys(counted.select("line", "n", _hashes(F.col("line"), size).alias("set")), bands, rows)
    return signed.select(F.monotonically_increasing_id().alias("id"), *_name(F.col("line")), "n", "size", "keys", "line")


def _parities(lines: DataFrame, size: int) -> DataFrame:
    """``id`` and ``PARITY_WORDS`` words of 64 bits: whether an odd number of the hashes fall on the bit.

    Sets that differ in d hashes differ in at most d bits, and in few less than d while d is far below the number of bits.
    """
    # The sets are a column first: ``explode`` of a longer expression is not compiled with what follows it.
    sets = lines.select("id", F.array_distinct(_shingle_hashes(F.col("line"), size)).alias("set"))
    each = sets.select("id", F.explode("set").alias("x"))
    word = F.expr(f"CAST(shiftright(x, 6) & {PARITY_WORDS - 1} AS INT)").alias("word")
    words_ = each.groupBy("id", word).agg(F.expr("bit_xor(shiftleft(1L, CAST(x & 63 AS INT)))").alias("bits"))
    in_place = [F.coalesce(F.max(F.when(F.col("word") == k, F.col("bits"))), F.lit(0).cast("long")) for k in range(PARITY_WORDS)]
    return words_.groupBy("id").agg(*[c.alias(f"p{k}") for k, c in enumerate(in_place)])


def _similar(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """``a``, ``b`` and their Jaccard coefficient ``j``. Lines travel, not their sets, which are several times as long."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("x"), F.col("size").alias("m")), "a")
    both = both.join(texts.select(F.col("id").alias("b"), F.col("line").alias("y"), F.col("size").alias("n")), "b")
    common = F.size(F.array_intersect(_shingle_hashes(F.col("x"), size), _shingle_hashes(F.col("y"), size)))
    both = both.select("a", "b", "m", "n", common.alias("common"))
    return both.select("a", "b", (F.col("common") / (F.col("m") + F.col("n") - F.col("common"))).alias("j"))


def candidates(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of the buckets of two lines and more, and ``id``, ``line`` and ``size`` of these lines.

    A member has ``key``, ``id``, ``size``, the bucket's ``pivot`` and its ``span`` (size), and ``held`` members with it.
    """
    keyed = lines.select("id", "n", "size", F.explode("keys").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    # Stored first, so that the shuffles of the count and of the join are not on disk together.
    buckets = stage(buckets, "buckets")
    held = stage(keyed.join(buckets, "key"), "held")
    # The pivots are looked for among the few lines that share a bucket, not among all.
    pivots = held.groupBy("key").agg(F.min(F.struct(-F.col("n"), "id", "size")).alias("pivot"))
    pivots = pivots.select("key", F.col("pivot.id").alias("pivot"), F.col("pivot.size").alias("span"))
    members = stage(held.drop("n").join(pivots, "key").select("key", "id", "size", "pivot", "span", "held"), "members")
    drop_staged(lines.sparkSession, buckets, held)

    ids = stage(members.select("id").distinct(), "candidates")
    picked = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return members, stage(lines.select("id", "line", "size").join(picked, "id"), "texts")


def line_classes(members: DataFrame, texts: DataFrame, similarity: float, size: int) -> DataFrame:
    """``id`` and ``root`` of the lines that are near another line, from ``candidates``."""
    # A pivot whose size alone parts it from a member is not compared with it: such a member has no distance ``j``.
    alike = F.least("size", "span") >= similarity * F.greatest("size", "span") - 1e-9
    stars = members.filter("id != pivot").filter(alike).select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    judged = stage(_similar(stars, texts, size), "stars")
    links = judged.filter(F.col("j") >= similarity).select("a", "b")
    first = components(links)

    # Members of a bucket that the pivot left in different components, unless a bound parts them: their sizes, their
    # distances to the pivot, or the bits in which their parities differ (each takes a shingle that only one of them has).
    # Members outside the bucket's largest component meet all members; those inside it do not meet each other.
    wide = members.filter("held > 2 AND id != pivot").withColumnsRenamed({"pivot": "a", "id": "b"}).join(judged, ["a", "b"], "left")
    placed = wide.join(first.withColumnRenamed("node", "b"), "b", "left")
    placed = stage(placed.select("key", "b", "size", "j", F.coalesce("root", "b").alias("root")), "placed")
    parts = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("parts"))
    mixed = stage(placed.join(parts.filter("parts > 1").select("key", "main"), "key"), "mixed")
    bits = [f"p{k}" for k in range(PARITY_WORDS)]
    sets = _parities(texts.join(mixed.select(F.col("b").alias("id")).distinct(), "id"), size)
    mixed = stage(mixed.join(sets.withColumnRenamed("id", "b"), "b"), "parities")
    again = {"b": "a", "size": "sized", "j": "i", "root": "top"} | {p: f"q{p}" for p in bits}
    apart = mixed.filter("root != main").join(mixed.drop("main").withColumnsRenamed(again), "key")
    apart = apart.filter((F.col("root") != F.col("top")) & ((F.col("top") == F.col("main")) | (F.col("a") < F.col("b"))))
    apart = apart.filter(F.least("size", "sized") >= similarity * F.greatest("size", "sized"))
    apart = apart.filter(F.coalesce(F.abs(F.col("i") - F.col("j")), F.lit(0.0)) <= 1 - similarity + 1e-9)
    differ = reduce(add, [F.bit_count(F.col(p).bitwiseXOR(F.col(f"q{p}"))) for p in bits])
    apart = apart.filter(differ <= (F.col("size") + F.col("sized")) * ((1 - similarity) / (1 + similarity)) + 1e-9)
    apart = apart.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = stage(_similar(apart, texts, size), "more").filter(F.col("j") >= similarity).select("a", "b")
    if more.isEmpty():
        return first
    return components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))


def dropped_lines(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = 0.8, bands: int = 12, rows: int = 5, size: int = SIZE
) -> DataFrame:
    """``document`` (id and text hash) and ``drop``: the places, from 0, of lines whose class has an earlier line."""
    lines = stage(distinct_lines(docs, text, bands, rows, size), "lines")
    members, texts = candidates(lines)
    names = stage(lines.select("id", "h", "g", "n"), "names")
    drop_staged(docs.sparkSession, lines)
    classes = line_classes(members, texts, similarity, size).withColumnRenamed("node", "id")
    joined = names.join(classes, "id", "left")
    repeated = joined.filter("n > 1 OR root IS NOT NULL").select("h", "g", F.coalesce("root", "id").alias("root"))

    each = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), F.posexplode(_lines_of(F.col(text))).alias("place", "line")
    )
    each = each.filter(_has_word(F.col("line"))).select("id", "t", "place", *_name(F.col("line")))
    found = stage(each.join(repeated, ["h", "g"]).select("id", "t", "place", "root").distinct(), "occurrences")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "t", "place")
    first = found.groupBy("root").agg(F.min(order).alias("first"))
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("t") == F.col("first.t")) & (F.col("place") == F.col("first.place"))
    late = found.join(first, "root").filter(~same)
    return late.groupBy(_document(F.col("id"), F.col("t")).alias("document")).agg(F.sort_array(F.collect_list("place")).alias("drop"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length_col: str | None = None, **options) -> DataFrame:
    """``docs`` with only the first line of each class; documents that lose every line with a word go.

    ``length_col`` names a column of text lengths to keep in step.
    """
    key, kept = (fresh(docs, f"_{x}") for x in ("document", "kept"))
    drops = dropped_lines(docs, id_col, text, **options).withColumnRenamed("document", key)
    drop = fresh(docs, "drop")
    joined = docs.withColumn(key, document(id_col, text)).join(drops.withColumnRenamed("drop", drop), key, "left")
    left = lambda split: F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(drop)), lambda i: F.get(split, i)
    )
    joined = joined.withColumn(kept, F.when(F.col(drop).isNotNull(), let(_lines_of(F.col(text)), left)))
    worded = F.exists(F.col(kept), _has_word)
    whole = F.when(F.col(drop).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    new = {text: whole}
    if length_col in docs.columns:
        length = F.when(F.col(drop).isNull(), F.col(length_col)).otherwise(F.length(whole))
        new[length_col] = length.cast(docs.schema[length_col].dataType)
    columns = [new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns]
    return joined.filter(F.col(drop).isNull() | worded).select(*columns)
