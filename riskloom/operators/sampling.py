"""Repeatable splits and samples from keyed hashes: no row order, no random state."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import HASH_BITS, HASH_SPAN, key_hash
from ..session import stage
from .ordered import hash_limits, hash_thresholds

LISTED_LABELS = 100
SENT_LABELS = 100_000
SALTS = 64


def _allocate(labels: DataFrame, test_size: float) -> DataFrame:
    """``(__label, want)``: validation rows per label of ``(__label, n)``.

    The whole share is rounded up, training shares go by largest remainder. All work is on one row per label.
    """
    total = labels.agg(F.sum("n")).first()[0] or 0
    train = total - math.ceil(total * test_size)
    product = F.col("n").cast("decimal(19,0)") * F.lit(train).cast("decimal(19,0)")
    shares = labels.withColumn("product", product).withColumn("total", F.lit(max(total, 1)).cast("decimal(19,0)"))
    shares = shares.select("__label", "n", F.expr("product div total").alias("given"), F.expr("product % total").alias("rest"))
    extra = train - (shares.agg(F.sum("given")).first()[0] or 0)
    up = shares.orderBy(F.desc("rest"), F.col("__label").cast("string")).limit(extra).select(F.col("__label").alias("__up"))
    joined = shares.join(up.withColumn("one", F.lit(1)), F.col("__label").eqNullSafe(F.col("__up")), "left")
    return joined.select("__label", (F.col("n") - F.col("given") - F.coalesce("one", F.lit(0))).alias("want"))


def stratified_split(
    df: DataFrame,
    label: str = "label",
    keys: Sequence[str] = ("entity_id",),
    test_size: float = 0.2,
    seed: int = 42,
    method: str = "xxhash64",
) -> DataFrame:
    """Add ``split`` = ``train`` or ``valid`` so that each label keeps its share, to the row.

    The rows of smallest hash within a label are the validation rows. Rows of equal key stay together; with unique
    keys the counts are exact. A row is compared with the limit of its label. Up to ``LISTED_LABELS`` limits are
    constants of the plan and up to ``SENT_LABELS`` are broadcast, so no row moves; more are joined by label and salt.
    """
    hashed = key_hash(keys, seed, method)
    labels = stage(df.groupBy(F.col(label).alias("__label")).agg(F.count(F.lit(1)).alias("n")), "labels")
    limits = stage(hash_limits(df, label, hashed, HASH_BITS, stage(_allocate(labels, test_size), "wanted")), "label-limits")
    split = F.when(hashed <= F.col("__limit"), F.lit("valid")).otherwise(F.lit("train"))
    listed = limits.limit(LISTED_LABELS + 1).collect()
    if len(listed) <= LISTED_LABELS:
        limit = F.lit(-1).cast("long")
        for r in listed:
            limit = F.when(F.col(label).eqNullSafe(F.lit(r["__label"])), F.lit(r["__limit"])).otherwise(limit)
        return df.withColumn("split", F.when(hashed <= limit, F.lit("valid")).otherwise(F.lit("train")))
    same = F.col(label).eqNullSafe(F.col("__label"))
    if limits.limit(SENT_LABELS + 1).count() <= SENT_LABELS:
        return df.join(F.broadcast(limits), same, "left").select(*[df[c] for c in df.columns], split.alias("split"))
    salted = limits.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = df.join(salted, same & (F.pmod(hashed, F.lit(SALTS)) == F.col("__salt")), "left")
    return joined.select(*[df[c] for c in df.columns], split.alias("split"))


def sample_n(
    df: DataFrame, n: int, keys: Sequence[str], seed: int = 42, method: str = "xxhash64", strict: bool = False
) -> DataFrame:
    """Exactly ``n`` rows by smallest hash (all rows when there are fewer, or an error if ``strict``).

    Rows are compared with the hash of rank n. Rows that tie at that hash (copies of its key) are compared by a hash of
    their content in the same way, and equal rows are counted, to fill the sample to the row.
    """
    if strict:
        have = df.count()
        if have < n:
            raise ValueError(f"sample size {n} exceeds table size {have}")
    hashed = key_hash(keys, seed, method)
    return _first_by_hash(df, hashed, n, keys)


def _first_by_hash(df: DataFrame, hashed: Column, n: int, keys: Sequence[str]) -> DataFrame:
    """The ``n`` rows of smallest hash; of rows that tie, those of smallest content hash, and copies by their number.

    Ties are cut by counts per bucket like the hashes themselves: a key that holds a third of the rows is neither sorted
    nor brought to one task.
    """
    limit = F.lit(hash_thresholds(df, [], hashed, HASH_BITS, {(): n})[()])
    below = df.where(hashed < limit)
    need = max(0, n - below.count())
    if not need:
        return below
    ties = df.where(hashed == limit)
    content = F.shiftrightunsigned(F.xxhash64(*df.columns), 64 - HASH_BITS)
    second = F.lit(hash_thresholds(ties, [], content, HASH_BITS, {(): need})[()])
    first = ties.where(content < second)
    need = max(0, need - first.count())
    # What ties in both hashes is one row and its copies: they are counted and unfolded.
    equal = ties.where(content == second).groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__copies"))
    before = Window.orderBy(*keys, F.xxhash64(F.lit(1), *df.columns)).rowsBetween(Window.unboundedPreceding, -1)
    taken = F.least(F.col("__copies"), F.lit(need) - F.coalesce(F.sum("__copies").over(before), F.lit(0)))
    copies = equal.withColumn("__taken", taken).where("__taken > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__taken"))))
    return below.unionAll(first).unionAll(copies.select(*df.columns))


def sample_fraction(
    df: DataFrame, fraction: float, keys: Sequence[str], seed: int = 42, method: str = "xxhash64", exact: bool = False
) -> DataFrame:
    """Rows whose hash lies below ``fraction``; ``exact`` gives ``round(fraction * rows)`` of them."""
    hashed = key_hash(keys, seed, method)
    if exact:
        return _first_by_hash(df, hashed, round(fraction * df.count()), keys)
    return df.where(hashed < F.lit(int(fraction * HASH_SPAN)))


def complement_split(
    df: DataFrame, fraction: float, keys: Sequence[str], seed: int = 42, method: str = "xxhash64"
) -> tuple[DataFrame, DataFrame]:
    """A sample and the rest; if nothing is left, the rest is a second sample by the next seed."""
    hashed = key_hash(keys, seed, method)
    inside = hashed < F.lit(int(fraction * HASH_SPAN))
    reference, current = df.where(inside), df.where(~inside)
    if current.isEmpty():
        current = sample_fraction(df, 1 - fraction, keys, seed + 1, method)
    return reference, current
