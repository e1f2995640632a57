"""Order-based work over a whole table without one partition.

A running sum over a global order is done bucket by bucket. Cut points come from mergeable
quantile digests, so no bucket holds more than about its share of the rows, and equal values are
summed map-side before any shuffle, so a value held by a third of all rows is one row afterwards.
Cut points are read by the driver (a few hundred numbers) and enter the plan as constants: a
stage computed again after the loss of an executor uses the same buckets. They decide only the
balance of the work, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import stage

MAX_BUCKETS = 4096
MAX_DIGEST_GROUPS = 512
# Quantiles look into few buckets, so few are made; a wanted bucket above the limit is cut again.
QUANTILE_BUCKETS = 256
REFINED_BUCKETS = 128
SORTED_VALUES = 5_000_000
HASH_BITS_PER_ROUND = 12
SORTED_HASHES = 1_000_000


def bucket_count(df: DataFrame) -> int:
    """Two buckets per shuffle partition, within limits."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(8, min(MAX_BUCKETS, 2 * partitions))


def _clean(column: str) -> Column:
    """The value as double; NaN becomes null and -0.0 becomes 0.0, so that ties meet."""
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value + F.lit(0.0))


def cut_points(df: DataFrame, columns: Sequence[str], buckets: int | None = None) -> dict[str, list[float]]:
    """Approximate quantiles that cut each column into buckets of similar size (one job)."""
    return cut_points_and_counts(df, columns, {}, buckets)[0]


def cut_points_and_counts(
    df: DataFrame, columns: Sequence[str], counts: Mapping[str, Column], buckets: int | None = None
) -> tuple[dict[str, list[float]], dict[str, int]]:
    """Cut points, and whole-number aggregates that share their pass over the table.

    Each scan task makes one digest per column. Digests meet in groups of tasks, since all of them in
    one task would be too much for a table of many files; the quantiles of the groups, weighted by
    their rows, then give the quantiles of the table.
    """
    columns = list(columns)
    k = buckets or bucket_count(df)
    probs = F.array(*[F.lit(i / k) for i in range(1, k)])
    accuracy = F.lit(max(1000, 4 * k))
    groups = min(MAX_DIGEST_GROUPS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    digests = (
        df.withColumn("__group", F.spark_partition_id() % groups)
        .groupBy("__group")
        .agg(
            *[F.percentile_approx(_clean(c), probs, accuracy).alias(f"q{i}") for i, c in enumerate(columns)],
            *[F.count(_clean(c)).alias(f"n{i}") for i, c in enumerate(columns)],
            *[expr.alias(f"c_{name}") for name, expr in counts.items()],
        )
    )
    no_counts = [F.lit(None).cast("long").alias(f"c_{name}") for name in counts]

    def points(i: int) -> Column:
        """The finite cut points of a group, each standing for the group's rows."""
        known = F.filter(F.coalesce(F.col(f"q{i}"), F.array().cast("array<double>")), lambda v: F.abs(v) < math.inf)
        return F.transform(known, lambda v: F.struct(F.lit(i).alias("i"), v.alias("v"), F.col(f"n{i}").alias("n"), *no_counts))

    entries = [points(i) for i in range(len(columns))]
    sums = F.struct(
        F.lit(-1).alias("i"), F.lit(None).cast("double").alias("v"), F.lit(0).cast("long").alias("n"),
        *[F.col(f"c_{name}").cast("long").alias(f"c_{name}") for name in counts],
    )
    rows = (
        digests.select(F.explode(F.concat(F.array(sums), *entries)).alias("e"))
        .select("e.*")
        .groupBy("i")
        .agg(F.percentile("v", probs, F.col("n")).alias("q"), *[F.sum(f"c_{name}").alias(f"c_{name}") for name in counts])
        .collect()
    )
    found = {r["i"]: r for r in rows}
    cuts = {c: sorted(set(found[i]["q"] or [])) if i in found else [] for i, c in enumerate(columns)}
    totals = {name: (found[-1][f"c_{name}"] or 0) if -1 in found else 0 for name in counts}
    return cuts, totals


def with_buckets(df: DataFrame, cuts: Mapping[str, Sequence[float]]) -> DataFrame:
    """Add ``__value_i`` and ``__bucket_i`` per column: the index of its left-closed bucket."""
    columns = list(cuts)
    values = {f"__value_{i}": _clean(c) for i, c in enumerate(columns)}
    out = df.withColumns(values)
    # A column without values or of infinities has no cut point; any one will do.
    splits = [[-math.inf, *(cuts[c] or [0.0]), math.inf] for c in columns]
    found = Bucketizer(
        splitsArray=splits,
        inputCols=[f"__value_{i}" for i in range(len(columns))],
        outputCols=[f"__bucket_{i}" for i in range(len(columns))],
        handleInvalid="keep",
    ).transform(out)
    # Never null: a filter or join on the bucket would otherwise look it up a second time per row.
    return found.withColumns(
        {f"__bucket_{i}": F.coalesce(F.col(f"__bucket_{i}").cast("int"), F.lit(-1)) for i in range(len(columns))}
    )


def long_values(
    df: DataFrame,
    cuts: Mapping[str, Sequence[float]],
    carry: Sequence[str] = (),
    only: Mapping[str, Iterable[int]] | None = None,
    numbered: bool = False,
) -> DataFrame:
    """One row ``(feature, bucket, value, *carry)`` per usable value of the given columns.

    ``only`` names the buckets wanted per column; other values are left out before the columns are stacked.
    ``numbered`` gives a column's position instead of its name, which makes lighter keys to shuffle.
    """
    wide = with_buckets(df, cuts)
    entries = []
    for i, c in enumerate(cuts):
        bucket, value = F.col(f"__bucket_{i}"), F.col(f"__value_{i}")
        if only is not None:
            value = F.when(bucket.isin(sorted(only.get(c, ()))), value)
        entries.append(F.struct(F.lit(i if numbered else c).alias("feature"), bucket.alias("bucket"), value.alias("value")))
    return (
        wide.select(*carry, F.explode(F.array(*entries)).alias("e"))
        .select("e.feature", "e.bucket", "e.value", *carry)
        .where(F.col("value").isNotNull())
    )


def running_sums(
    df: DataFrame,
    sums: Mapping[str, Column],
    by: Sequence[str] = (),
    order: str = "value",
    descending: bool = False,
    few_keys: bool = True,
) -> DataFrame:
    """Per distinct ``order`` value (within ``by``): its sums, running sums ``run_*``, totals ``all_*``.

    ``df`` holds ``bucket``. The running sums include the row's own value. Partial sums meet in
    ``groupBy``; each bucket is then one window group, shifted by the totals of the buckets before.
    The shifts have one row per bucket and key: with ``few_keys`` (column names, say) that is bounded
    by the number of cut points and they are sent to all tasks; otherwise they are joined on the
    window's own keys, so the join adds no shuffle.
    """
    keys = [*by, "bucket"]
    names = list(sums)
    # Buckets are never null, so the join below adds no filter and both branches stay alike: they share
    # one exchange, and the table is read and shuffled once.
    counts = df.groupBy(*keys, order).agg(*[expr.alias(n) for n, expr in sums.items()])
    totals = counts.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    before = W.partitionBy(*by).orderBy(direction("bucket")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*by)
    offsets = totals.select(
        *keys,
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"off_{n}") for n in names],
        *[F.sum(n).over(whole).alias(f"all_{n}") for n in names],
    )
    inside = W.partitionBy(*keys).orderBy(direction(order)).rowsBetween(W.unboundedPreceding, 0)
    return counts.join(F.broadcast(offsets) if few_keys else offsets, keys).select(
        *keys,
        order,
        *names,
        *[(F.sum(n).over(inside) + F.col(f"off_{n}")).alias(f"run_{n}") for n in names],
        *[f"all_{n}" for n in names],
    )


def _locate(totals: Iterable, wanted: Mapping[tuple, list[tuple[int, int]]]) -> tuple[list[tuple], int]:
    """Where the wanted ranks lie: ``(feature, bucket, rank, rank inside the bucket)``, and the most rows such a bucket has.

    ``totals`` are rows ``(feature, parent, bucket, w, rows)``; ``wanted`` holds ``(rank, rank inside the
    parent)`` per ``(feature, parent)``.
    """
    by_parent: dict[tuple, list] = {}
    for row in totals:
        by_parent.setdefault((row["feature"], row["parent"]), []).append((row["bucket"], row["w"], row["rows"]))
    found, largest = [], 0
    for key, ranks in wanted.items():
        start = 0
        for bucket, size, rows in sorted(by_parent.get(key, [])):
            here = [(key[0], bucket, rank, inner - start) for rank, inner in ranks if start <= inner < start + size]
            if here:
                found += here
                largest = max(largest, rows)
            start += size
    return found, largest


def _totals(long: DataFrame) -> list:
    """Weight and rows per bucket: as many rows as there are buckets."""
    return long.groupBy("feature", "parent", "bucket").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("rows")).collect()


def _refine(counts: DataFrame) -> DataFrame:
    """Cut every bucket into finer ones, by quantiles of its distinct values; ``parent`` is the old bucket."""
    probs = F.array(*[F.lit(i / REFINED_BUCKETS) for i in range(1, REFINED_BUCKETS)])
    digests = counts.groupBy("feature", "bucket").agg(F.percentile_approx("value", probs, F.lit(1000)).alias("points"))
    # Constants again, so that a stage computed twice cuts alike: one short array per wanted bucket.
    points = counts.sparkSession.createDataFrame(
        [tuple(r) for r in digests.collect()], "feature string, bucket long, points array<double>"
    )
    step = F.size(F.filter("points", lambda p: p <= F.col("value"))).cast("long")
    return counts.join(F.broadcast(points), ["feature", "bucket"]).select(
        "feature", F.col("bucket").alias("parent"), (F.col("bucket") * REFINED_BUCKETS + step).alias("bucket"), "value", "w"
    )


def _values_at_ranks(part: DataFrame, targets: list[tuple], largest: int) -> dict[tuple, float]:
    """Values at the wanted ranks, from the rows of the buckets that hold them.

    Equal values become one row first. A bucket that is still too large for one window group is cut
    again, by its distinct values, so that every cut makes it smaller.
    """
    counts = part.groupBy("feature", "bucket", "value").agg(F.sum("w").alias("w"))
    if largest > SORTED_VALUES:
        counts = stage(counts, "rank-buckets")
        largest = counts.groupBy("feature", "bucket").count().agg(F.max("count")).first()[0]
        while largest > max(1, SORTED_VALUES):
            finer = stage(_refine(counts), "rank-buckets")
            wanted: dict[tuple, list[tuple[int, int]]] = {}
            for feature, bucket, rank, inner in targets:
                wanted.setdefault((feature, bucket), []).append((rank, inner))
            targets, largest = _locate(_totals(finer), wanted)
            pairs = finer.sparkSession.createDataFrame(sorted({t[:2] for t in targets}), "feature string, bucket long")
            counts = finer.drop("parent").join(F.broadcast(pairs), ["feature", "bucket"], "left_semi")
    inside = W.partitionBy("feature", "bucket").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    places = part.sparkSession.createDataFrame(targets, "feature string, bucket long, rank long, inner_rank long")
    found = (
        counts.withColumn("run", F.sum("w").over(inside))
        .join(F.broadcast(places), ["feature", "bucket"])
        .where((F.col("run") - F.col("w") <= F.col("inner_rank")) & (F.col("inner_rank") < F.col("run")))
        .select("feature", "rank", "value")
    )
    return {(r["feature"], r["rank"]): r["value"] for r in found.collect()}


def _thin(cuts: Sequence[float], limit: int) -> list[float]:
    """At most ``limit`` of the cut points, evenly chosen."""
    return list(cuts[:: max(1, -(-len(cuts) // limit))])


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    weight: str | None = None,
    cuts: Mapping[str, Sequence[float]] | None = None,
) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation, for any table size.

    ``weight`` names a whole-number column that says how often a row counts. Three passes over the
    named columns: digests for the cut points, bucket totals, and the buckets that hold a wanted
    rank, which are cut again while they are large. Nothing grows with the table on the driver or in
    one task. An empty column gives nulls.
    """
    columns = list(columns)
    known = {c: cuts[c] for c in columns if cuts and c in cuts}
    missing = [c for c in columns if c not in known]
    if missing:
        known.update(cut_points(df, missing, min(QUANTILE_BUCKETS, bucket_count(df))))
    known = {c: _thin(known[c], QUANTILE_BUCKETS) for c in columns}
    rows = df.withColumn("__w", F.col(weight).cast("long") if weight else F.lit(1).cast("long"))

    def stacked(only: Mapping[str, Iterable[int]] | None = None) -> DataFrame:
        long = long_values(rows, known, ["__w"], only)
        bucket = F.col("bucket").cast("long").alias("bucket")
        return long.select("feature", F.lit(0).cast("long").alias("parent"), bucket, "value", F.col("__w").alias("w"))

    totals = _totals(stacked())
    n = {c: 0 for c in columns}
    for row in totals:
        n[row["feature"]] += row["w"]
    wanted: dict[tuple, list[tuple[int, int]]] = {}
    for c in columns:
        positions = [(n[c] - 1) * p for p in probs] if n[c] else []
        ranks = {r for h in positions for r in (math.floor(h), min(math.ceil(h), n[c] - 1))}
        wanted[c, 0] = [(r, r) for r in sorted(ranks)]
    targets, largest = _locate(totals, wanted)
    found: dict[tuple, float] = {}
    if targets:
        held: dict[str, set[int]] = {}
        for feature, bucket, *_ in targets:
            held.setdefault(feature, set()).add(bucket)
        found = _values_at_ranks(stacked(held), targets, largest)
    out: dict[str, list[float | None]] = {}
    for c in columns:
        values: list[float | None] = []
        for p in probs:
            if not n[c]:
                values.append(None)
                continue
            h = (n[c] - 1) * p
            low, high = found[c, math.floor(h)], found[c, min(math.ceil(h), n[c] - 1)]
            values.append(low if low == high else low + (high - low) * (h - math.floor(h)))
        out[c] = values
    return out


def grouped_quantiles(df: DataFrame, by: Sequence[str], column: str, probs: Sequence[float]) -> DataFrame:
    """Exact linear quantiles per group as an array, for any number and size of groups.

    Cut points of the whole column bound every (group, bucket) by a bucket's share of all rows.
    """
    # A struct is never null itself, so groups with missing parts of their key are kept.
    value = df.select(F.struct(*by).alias("key"), F.col(column).cast("double").alias("value"))
    bucketed = with_buckets(value, cut_points(value, ["value"]))
    rows = bucketed.where(F.col("__value_0").isNotNull()).select(
        "key", F.col("__bucket_0").alias("bucket"), F.col("__value_0").alias("value")
    )
    run = running_sums(rows, {"n": F.count(F.lit(1))}, by=["key"], few_keys=False)
    picks = []
    for i, p in enumerate(probs):
        h = (F.col("all_n") - 1) * F.lit(float(p))
        at = lambda rank: (F.col("run_n") - F.col("n") <= rank) & (rank < F.col("run_n"))
        picks += [
            F.max(F.when(at(F.floor(h)), F.col("value"))).alias(f"low_{i}"),
            F.max(F.when(at(F.ceil(h)), F.col("value"))).alias(f"high_{i}"),
            F.max(F.when(at(F.floor(h)), h - F.floor(h))).alias(f"part_{i}"),
        ]
    found = run.groupBy("key").agg(*picks)
    return found.select(
        "key.*",
        F.array(
            *[F.col(f"low_{i}") + (F.col(f"high_{i}") - F.col(f"low_{i}")) * F.col(f"part_{i}") for i in range(len(probs))]
        ).alias("quantiles"),
    )


def _same(stratum: Sequence[str], key: tuple) -> Column:
    return reduce(lambda a, b: a & b, [F.col(s).eqNullSafe(F.lit(v)) for s, v in zip(stratum, key)], F.lit(True))


def _choose(stratum: Sequence[str], values: Mapping[tuple, int]) -> Column:
    """The constant that belongs to the row's stratum."""
    expr = F.lit(None).cast("long")
    for key, value in values.items():
        expr = F.when(_same(stratum, key), F.lit(int(value)).cast("long")).otherwise(expr)
    return expr


def hash_thresholds(
    df: DataFrame, stratum: Sequence[str], hash_value: Column, hash_bits: int, wanted: Mapping[tuple, int]
) -> dict[tuple, int]:
    """Per stratum the hash value up to which ``wanted`` rows lie, in hash order (-1 for none).

    Hashes are uniform, so the leading bits make balanced buckets and need no cut points. Each round
    counts by the next bits inside the bucket that holds the wanted rank, until that bucket is small
    enough to sort its distinct hashes; every round is a scan that combines map-side to a few
    thousand rows. The driver reads one row per stratum and round.
    """
    out = {tuple(k): -1 for k in wanted}
    rest = {tuple(k): int(n) for k, n in wanted.items() if n > 0}
    if not rest:
        return out
    hashed = df.select(*stratum, hash_value.alias("h"))
    upto = W.partitionBy(*stratum).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    inside, shift, largest = hashed, hash_bits, SORTED_HASHES + 1
    prefix: dict[tuple, int] = {}
    while shift > 0 and largest > SORTED_HASHES:
        shift = max(0, shift - HASH_BITS_PER_ROUND)
        holding = (
            inside.withColumn("bucket", F.shiftright("h", shift))
            .groupBy(*stratum, "bucket")
            .count()
            .withColumn("run", F.sum("count").over(upto))
            .withColumn("rest", _choose(stratum, rest) - (F.col("run") - F.col("count")))
            .where((F.col("rest") > 0) & (F.col("rest") <= F.col("count")))
            .select(*stratum, "bucket", "count", "rest")
            .collect()
        )
        prefix = {tuple(r)[:-3]: r["bucket"] for r in holding}
        rest = {tuple(r)[:-3]: r["rest"] for r in holding}
        largest = max((r["count"] for r in holding), default=0)
        inside = hashed.where(F.shiftright("h", shift) == _choose(stratum, prefix))
    # A stratum with fewer rows than wanted gives all of them.
    out.update({tuple(k): prefix.get(tuple(k), 1 << hash_bits) for k, n in wanted.items() if n > 0})
    if shift == 0 or not prefix:
        return out
    order = W.partitionBy(*stratum).orderBy("h").rowsBetween(W.unboundedPreceding, 0)
    cut = (
        inside.groupBy(*stratum, "h")
        .count()
        .withColumn("run", F.sum("count").over(order))
        .where(F.col("run") >= _choose(stratum, rest))
        .groupBy(*stratum)
        .agg(F.min("h").alias("h"))
        .collect()
    )
    out.update({tuple(r)[:-1]: r["h"] for r in cut if r["h"] is not None})
    return out


def hash_limits(df: DataFrame, label: str, hash_value: Column, hash_bits: int, wanted: DataFrame) -> DataFrame:
    """``hash_thresholds`` for any number of labels, which stay in tables: ``(__label, __limit)`` for ``(__label, want)``.

    A round counts by the next bits and keeps the bucket of the wanted rank per label. Rows meet a bucket by label
    and leading bits, so a label that holds a third of the rows is spread over its buckets.
    """
    hashed = df.select(F.col(label).alias("label"), hash_value.alias("h"))
    state = wanted.where("want > 0").select("__label", F.col("want").alias("rest"))
    same = F.col("label").eqNullSafe(F.col("__label"))
    rows, shift, largest = hashed, hash_bits, SORTED_HASHES + 1
    while shift > 0 and largest > SORTED_HASHES:
        shift = max(0, shift - HASH_BITS_PER_ROUND)
        upto = W.partitionBy("label").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
        counts = rows.groupBy("label", F.shiftright("h", shift).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
        placed = counts.withColumn("before", F.sum("n").over(upto) - F.col("n")).join(state.select("__label", "rest"), same)
        holding = placed.where("before < rest AND rest <= before + n")
        state = stage(holding.select("__label", F.col("bucket").alias("__bucket"), (F.col("rest") - F.col("before")).alias("rest"), "n"), "hash-buckets")
        largest = state.agg(F.max("n")).first()[0] or 0
        rows = hashed.join(state, same & (F.shiftright("h", shift) == F.col("__bucket"))).select("label", "h")
    upto = W.partitionBy("label").orderBy("h").rowsBetween(W.unboundedPreceding, 0)
    last = rows.groupBy("label", "h").count().withColumn("run", F.sum("count").over(upto))
    found = last.join(state.select("__label", "rest"), same).where("run >= rest").groupBy("__label").agg(F.min("h").alias("__limit"))
    return found.union(wanted.where("want <= 0").select("__label", F.lit(-1).cast("long")))
