"""Mixing sources to target weights by hierarchical budgets.

A budget of tokens is handed down a tree of columns (domain, language, source). Among siblings it is shared by weight;
a child that cannot use its share (its tokens times ``max_epochs``) is filled up, and what it leaves goes to its
siblings by their weights. Only what a whole group of siblings cannot use reaches the parent's siblings, since the
parent's own supply is the sum of its children's. Each leaf then takes the first tokens of its stream: epoch after
epoch, each in an order of its own drawn from the seed, the last document cut to the tokens that are left.

No leaf is sorted whole. Epochs that fit are taken as they are; in the last one, documents are counted by leading digits
of their order key, and only the one bucket that holds the cut is put in order. Node tables have one row per node.

Null tree columns are nodes of their own, named ``(none)``. Documents without words hold no tokens and are never drawn;
an empty table gives no rows. Repeated rows are drawn on their own; ties in the order are broken by tokens and text
hash. Nodes of weight zero or below get nothing, nodes without a weight get ``default``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskloom.session import stage

from .common import fresh, words

#: Leaves whose table is broadcast; a larger tree is joined by shuffle.
BROADCAST_LEAVES = 50_000


def _order_key(seed: int, epoch: Column, id_: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_.cast("string"), F.lit(""))))


def _weight(path: Column, weights: dict[tuple[str, ...], float], default: float) -> Column:
    if not weights:
        return F.lit(float(default))
    entries = [x for path_, w in weights.items() for x in (F.lit("/".join(path_)), F.lit(float(w)))]
    return F.coalesce(F.try_element_at(F.create_map(*entries), path), F.lit(float(default)))


def share_out(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """``nodes`` (columns ``supply``, ``weight``, ``given``) with the ``budget`` of each: ``given`` shared by weight.

    The common level is the greatest, over siblings in order of supply per weight, of what is left for the rest per
    weight of the rest: it rises while siblings are filled up and falls after that.
    """
    group = Window.partitionBy(*(parents or [F.lit(0)]))
    before = group.orderBy(F.col("supply") / F.col("weight"), F.col(name)).rowsBetween(Window.unboundedPreceding, -1)
    filled = F.coalesce(F.sum("supply").over(before), F.lit(0))
    weighed = F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (F.col("given") - filled) / (F.sum("weight").over(group) - weighed)
    return (
        nodes.withColumn("level", level)
        .withColumn("level", F.max("level").over(group))
        .withColumn("budget", F.least(F.col("supply").cast("double"), F.col("level") * F.col("weight")))
        .drop("level", "given")
    )


def budgets(
    leaves: DataFrame, names: list[str], weights: dict[tuple[str, ...], float], share: float, max_epochs: int, default: float = 1.0
) -> DataFrame:
    """``leaves`` (one row per leaf: the tree columns and ``tokens``) with its whole-token ``budget``."""
    weighed = leaves
    for depth in range(1, len(names) + 1):
        path = F.concat_ws("/", *names[:depth])
        weighed = weighed.withColumn(f"_w{depth}", _weight(path, weights, default))
    for depth in range(1, len(names) + 1):
        weighed = weighed.filter(F.col(f"_w{depth}") > 0)
    weighed = weighed.withColumn("supply", F.col("tokens") * max_epochs)
    root = Window.partitionBy(F.lit(0))
    asked = F.floor(F.sum("asked").over(root) * F.lit(share)).cast("double")
    total = leaves.groupBy(names[0]).agg(F.sum("tokens").alias("asked"))
    total = total.withColumn("given", asked).select(names[0], "given")
    parents: list[str] = []
    given = total
    for depth, name in enumerate(names, 1):
        nodes = weighed.groupBy(*names[:depth]).agg(F.sum("supply").alias("supply"), F.first(f"_w{depth}").alias("weight"))
        nodes = nodes.join(given, parents or [name])
        if not parents:
            nodes = nodes.withColumn("given", F.least(F.col("given"), F.sum("supply").over(root).cast("double")))
        given = share_out(nodes, parents, name).select(*names[:depth], F.col("budget").alias("given"))
        parents = names[:depth]
    return leaves.join(given, names).withColumn("budget", F.floor("given").cast("long")).drop("given")


def mix(
    docs: DataFrame,
    tree: dict[str, Column],
    weights: dict[tuple[str, ...], float],
    share: float,
    max_epochs: int = 4,
    seed: int = 7,
    default: float = 1.0,
    digits: int = 3,
    id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``docs`` drawn to ``share`` of all tokens: one row per document and epoch that draws it.

    Adds ``leaf`` (the path of the tree), ``epoch``, ``n_tokens`` (words of the text) and ``n_taken`` (all of them but
    in the last document of a leaf); ``fresh`` names where the input has these. ``digits`` leading hexadecimal digits
    of the order key make the buckets, so a bucket holds about 16 ** -digits of a leaf.
    """
    names = [fresh(docs, f"_tree{k}") for k in range(len(tree))]
    tokens, tie = fresh(docs, "_tokens"), fresh(docs, "_tie")
    placed = docs.withColumns({n: F.coalesce(c.cast("string"), F.lit("(none)")) for n, c in zip(names, tree.values())})
    placed = placed.withColumns({tokens: F.size(words(F.col(text))).cast("long"), tie: F.xxhash64(text)})
    narrow = stage(placed.select(*names, F.col(tokens).alias("tokens"), F.col(id_col).alias("id")).filter("tokens > 0"), "tokens")
    leaves = stage(narrow.groupBy(*names).agg(F.sum("tokens").alias("tokens")), "leaves")
    drawn = budgets(leaves, names, weights, share, max_epochs, default)
    drawn = stage(
        drawn.withColumn("full", F.floor(F.col("budget") / F.col("tokens")).cast("int"))
        .withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens"))
        .drop("tokens"),
        "budgets",
    )
    few = drawn.count() <= BROADCAST_LEAVES
    small = (lambda df: F.broadcast(df)) if few else (lambda df: df)

    # The bucket of each leaf's last epoch that holds the cut, and the tokens taken from it.
    bucket = F.substring(_order_key(seed, F.col("full"), F.col("id")), 1, digits).alias("bucket")
    counted = narrow.join(small(drawn.filter("rest > 0")), names).groupBy(*names, "rest", bucket).agg(F.sum("tokens").alias("held"))
    running = F.sum("held").over(Window.partitionBy(*names).orderBy("bucket"))
    cut = (
        counted.withColumn("upto", running)
        .filter("upto >= rest AND upto - held < rest")
        .select(*names, F.col("bucket").alias("cut"), (F.col("rest") - (F.col("upto") - F.col("held"))).alias("need"))
    )
    plan = stage(drawn.join(cut, names, "left").select(*names, "full", "cut", "need"), "cuts")

    out = {x: fresh(docs, x) for x in ("leaf", "epoch", "n_tokens", "n_taken")}
    full, at, need, key = (fresh(docs, f"_{x}") for x in ("full", "cut", "need", "key"))
    joined = placed.filter(F.col(tokens) > 0).join(small(plan.toDF(*names, full, at, need)), names)
    joined = joined.withColumn(key, _order_key(seed, F.col(full), F.col(id_col)))
    own = F.substring(key, 1, digits)
    epochs = F.col(full) + F.when(own < F.col(at), 1).otherwise(0)
    whole = joined.filter(epochs > 0).withColumn(out["epoch"], F.explode(F.sequence(F.lit(0), epochs - 1)))
    whole = whole.withColumn(out["n_taken"], F.col(tokens))

    edge = Window.partitionBy(*names).orderBy(key, tokens, tie).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(tokens).over(edge), F.lit(0))
    last = joined.filter(own == F.col(at)).withColumn(out["epoch"], F.col(full))
    last = last.withColumn(out["n_taken"], F.least(F.col(tokens), F.col(need) - before)).filter(F.col(out["n_taken"]) > 0)

    named = [F.concat_ws("/", *names).alias(out["leaf"]), out["epoch"], F.col(tokens).alias(out["n_tokens"]), out["n_taken"]]
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return whole.select(*columns, *named).unionByName(last.select(*columns, *named))
