"""Prefix trie of conversations by ternary search trees over range shards.

Turns are encoded by a dictionary of 64-bit ids (checked to be one-to-one on the table's turns), so a conversation is a
list of ids with the code points of each turn. Equal lists become one row with a count before anything is sorted. The
distinct lists are range-partitioned and sorted; each run of about ``SHARD_TURNS`` ids is a shard of neighbouring lists. A
shard's lists go into a ternary search tree, medians first, so that its alternatives are balanced, and one iterative
traversal adds up members, least id, children, leaves and savings from the deepest nodes to the root.

A prefix that is found in two shards is a prefix of a shard's first or last list. Those boundary nodes leave the shard with
what its inner nodes add below them, and are merged by key. Sorted by the place where they are first met, they stand in the
order of a walk through the trie, so a subtree is a run of them and its sums are differences of running totals; a walk over
the depth is not needed, however long the conversations are.

Digests of the ids that end at a node are fed in sorted order, one id at a time: a third of all conversations may end at one
node without being held together. A digest of an ordered list cannot be split, so such a node's ids pass through one task.

Rows without a conversation id belong to no conversation. Null role or text is empty; turns are ordered by turn (null
first), then role, then text; repeated turns stay. No rows give no nodes. Other columns are not read. A conversation
travels as one row of 12 bytes per turn; its texts are not held together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskloom.session import drop_staged, stage

from .common import text_or_empty

#: Turn ids in one shard's tree.
SHARD_TURNS = 1 << 19
NO_IDS = hashlib.sha256(b"").hexdigest()
_END = (1 << 62) - 1


def encoded(turns: DataFrame, seed: int = 0) -> DataFrame:
    """``turns`` (role, text, ...) with ``code`` instead of role and text, and ``chars``, the code points of the text.

    Codes are hashes under the first seed that gives no two turns the same one (compared by a second hash).
    """
    code = lambda k: F.xxhash64(F.lit(k), "role", "text")
    while True:
        other = F.xxhash64("text", "role", F.lit(~seed))
        words = turns.select(code(seed).alias("code"), other.alias("other")).groupBy("code")
        if words.agg(F.min("other").alias("low"), F.max("other").alias("high")).filter("low <> high").isEmpty():
            return turns.withColumns({"code": code(seed), "chars": F.length("text")}).drop("role", "text")
        seed += 1


def sequences(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv`` and ``seq``, its turns in order as ``code`` and ``chars``."""
    turns = conversations.select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), text_or_empty(F.col(role)).alias("role"), text_or_empty(F.col(text)).alias("text")
    ).filter("conv IS NOT NULL")
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = encoded(turns.withColumn("pos", F.row_number().over(order)))
    listed = placed.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("pos", "code", "chars"))).alias("seq"))
    return listed.select("conv", F.transform("seq", lambda x: F.struct(x["code"].alias("code"), x["chars"].alias("chars"))).alias("seq"))


def with_shared_heads(seqs: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Each conversation's first turns (crc32 of its decimal id modulo ``most``) taken from the first of its hundred."""
    h = (F.crc32(F.col("conv").cast("string")) % most).cast("int")
    own = seqs.select("conv", "seq", h.alias("h"), (F.col("conv") - F.col("conv") % every).alias("base"))
    heads = seqs.filter(F.col("conv") % every == 0).select(F.col("conv").alias("base"), F.slice("seq", 1, most - 1).alias("head"))
    rest = F.slice("seq", F.col("h") + 1, F.greatest(F.size("seq") - F.col("h"), F.lit(0)))
    head = F.slice(F.coalesce("head", F.slice("seq", 1, 0)), F.lit(1), F.col("h"))
    return own.join(heads, "base", "left").select("conv", F.concat(head, rest).alias("seq"))


class TernaryTree:
    """Prefixes of id lists. Node 0 is the empty prefix; ``low`` and ``high`` lead to smaller and larger alternatives."""

    def __init__(self) -> None:
        self.code, self.low, self.equal, self.high, self.chars, self.end = [0], [0], [0], [0], [0], [-1]

    def _new(self, code: int, chars: int) -> int:
        for column, value in ((self.code, code), (self.low, 0), (self.equal, 0), (self.high, 0), (self.chars, chars), (self.end, -1)):
            column.append(value)
        return len(self.code) - 1

    def insert(self, codes: list[int], chars: list[int], number: int) -> list[int]:
        """Put a list in; its nodes from the root to its end, which is marked with ``number``."""
        code, low, equal, high = self.code, self.low, self.equal, self.high
        at, path = 0, [0]
        for want, size in zip(codes, chars):
            node = equal[at]
            if not node:
                node = equal[at] = self._new(want, size)
            while code[node] != want:
                side = low if want < code[node] else high
                if not side[node]:
                    side[node] = self._new(want, size)
                node = side[node]
            at = node
            path.append(at)
        self.end[at] = number
        return path

    def walk(self) -> tuple[list[int], list[int], list[int]]:
        """Nodes with every node after its parent, and each node's parent and depth by number."""
        order, parent, depth = [0], [-1] * len(self.code), [0] * len(self.code)
        stack = [(self.equal[0], 0)]
        while stack:
            node, above = stack.pop()
            if not node:
                continue
            parent[node], depth[node] = above, depth[above] + 1
            order.append(node)
            stack += [(self.low[node], above), (self.high[node], above), (self.equal[node], node)]
        return order, parent, depth


def _medians(n: int) -> Iterator[int]:
    """0 to n - 1, the middle of every range before its halves."""
    stack = [(0, n)]
    while stack:
        a, b = stack.pop()
        if a < b:
            middle = (a + b) // 2
            yield middle
            stack += [(a, middle), (middle + 1, b)]


_SHARD = (
    "shard long, side int, on_last boolean, depth long, key binary, above binary, above_side int, parent long, "
    "n long, least long, children long, leaves long, saved long, chars long, e1 long, e2 long"
)
_SHARD_NAMES = [field.split()[0] for field in _SHARD.split(", ")]
_SHARD_TYPES = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}


def _chained(codes: list[int]) -> list[bytes]:
    """A key for each prefix of a list, the empty one first."""
    keys = [b""]
    for code in codes:
        keys.append(xxhash.xxh3_128_digest(keys[-1] + code.to_bytes(8, "little", signed=True)))
    return keys


def shard_nodes(shard: int, lists: list[tuple[list[int], list[int]]], n: list[int], least: list[int], ends: list[tuple[int, int]]) -> list[tuple]:
    """Rows of ``_SHARD`` for one shard of sorted distinct lists (``side`` null: an inner node, which is final)."""
    tree = TernaryTree()
    paths = {}
    for k in _medians(len(lists)):
        path = tree.insert(*lists[k], k)
        if k in (0, len(lists) - 1):
            paths[k] = path
    size = len(tree.code)
    order, parent, depth = tree.walk()
    side: list[int | None] = [None] * size
    on_last, key = [False] * size, {}
    for node, name in zip(paths[len(lists) - 1], _chained(lists[-1][0])):
        side[node], on_last[node], key[node] = 1, True, name
    for node, name in zip(paths[0], _chained(lists[0][0])):
        side[node], key[node] = 0, name
    members, low = [0] * size, [_END] * size
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    for node in reversed(order):
        k = tree.end[node]
        if k >= 0:
            members[node] += n[k]
            low[node] = min(low[node], least[k])
        above, inner = parent[node], side[node] is None
        if inner:
            leaves[node] += not children[node]
            saved[node] += (members[node] - 1) * tree.chars[node]
        if above >= 0:
            members[above] += members[node]
            low[above] = min(low[above], low[node])
            if inner:
                children[above] += 1
                leaves[above] += leaves[node]
                saved[above] += saved[node]
    out = []
    for node in order:
        above, end = parent[node], ends[tree.end[node]] if tree.end[node] >= 0 else (None, None)
        inner = side[node] is None
        outer = inner and side[above] is not None
        out.append((
            shard, side[node], on_last[node], depth[node], key.get(node), key.get(above) if not inner else None,
            side[above] if outer else None, low[above] if inner and not outer else None,
            members[node], low[node], children[node], leaves[node], saved[node], tree.chars[node], *end,
        ))
    return out


def _sharded(distinct: DataFrame, shard_turns: int) -> DataFrame:
    """Nodes of every shard of the staged distinct lists (``seq``, ``n``, ``least``, ``e1``, ``e2``)."""
    ids = distinct.agg(F.sum(F.size("seq") + 1)).first()[0] or 0
    shuffle = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = distinct.repartitionByRange(max(1, shuffle, -(-ids // shard_turns)), "seq").sortWithinPartitions("seq")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        held, size, number = [], 0, 0

        def rows() -> pa.RecordBatch:
            lists, n, least, ends = zip(*held)
            columns = zip(*shard_nodes(first + number, list(lists), list(n), list(least), list(ends)))
            types = [_SHARD_TYPES[field.split()[1]] for field in _SHARD.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=_SHARD_NAMES)

        for batch in batches:
            seqs = batch["seq"]
            places = seqs.offsets.to_numpy() - seqs.offsets[0].as_py()
            flat = seqs.flatten()
            codes, chars = (flat.field(f).to_pylist() for f in ("code", "chars"))
            n, least, e1, e2 = (batch[c].to_pylist() for c in ("n", "least", "e1", "e2"))
            for k in range(batch.num_rows):
                a, b = places[k], places[k + 1]
                held.append(((codes[a:b], chars[a:b]), n[k], least[k], (e1[k], e2[k])))
                size += b - a + 1
                if size >= shard_turns:
                    yield rows()
                    held, size, number = [], 0, number + 1
        if held:
            yield rows()

    return ranged.mapInArrow(of, _SHARD)


def _merged(borders: DataFrame) -> DataFrame:
    """Boundary nodes with the sums of all shards: ``key``, ``above``, ``depth``, members, children, leaves and savings."""
    own = borders.groupBy("key").agg(
        F.first("above").alias("above"), F.first("depth").alias("depth"), F.first("chars").alias("chars"),
        *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")], F.min("least").alias("least"),
        F.max("e1").alias("e1"), F.max("e2").alias("e2"),
        F.min(F.struct("shard", "side")).alias("met"), F.max(F.struct("shard", "on_last")).alias("left"),
    )
    own = stage(own, "borders")
    below = own.filter("above IS NOT NULL").groupBy(F.col("above").alias("key")).agg(F.count(F.lit(1)).alias("outer"))
    own = own.join(below, "key", "left").withColumn("children", F.col("children") + F.coalesce("outer", F.lit(0)))
    own = own.withColumns({
        "leaves": F.col("leaves") + (F.col("children") == 0).cast("long"), "saved": F.col("saved") + (F.col("n") - 1) * F.col("chars")
    })
    own = stage(own.drop("outer"), "borders")

    # Running totals in walking order; marks at the end of each shard's two sides say where subtrees end.
    sides = F.explode(F.array(F.lit(0), F.lit(1)))
    zero = F.lit(0).cast("long")
    marks = borders.select("shard").distinct().select(
        F.lit(None).cast("binary").alias("key"), "shard", sides.alias("side"), F.lit(_END).alias("depth"), zero.alias("leaves"), zero.alias("saved")
    )
    places = own.select("key", "met.shard", "met.side", "depth", "leaves", "saved").union(marks)
    places = places.withColumn("task", F.shiftrightunsigned("shard", 32))
    walk = Window.partitionBy("task").orderBy("shard", "side", "depth")
    run = stage(places.withColumns({f"to_{c}": F.sum(c).over(walk) for c in ("leaves", "saved")}), "walk")
    # One row per range partition, so this window's single task holds no more rows than the shuffle had partitions.
    tasks = run.groupBy("task").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("task", *[F.coalesce(F.sum(c).over(before), zero).alias(f"before_{c}") for c in ("leaves", "saved")])
    run = run.join(tasks, "task").select(
        "key", "shard", "side", "leaves", "saved", *[(F.col(f"to_{c}") + F.col(f"before_{c}")).alias(f"to_{c}") for c in ("leaves", "saved")]
    )
    start = run.filter("key IS NOT NULL").select("key", *[(F.col(f"to_{c}") - F.col(c)).alias(f"from_{c}") for c in ("leaves", "saved")])
    ends = run.filter("key IS NULL").select("shard", "side", "to_leaves", "to_saved")
    closed = own.join(start, "key").withColumns({"shard": F.col("left.shard"), "side": F.col("left.on_last").cast("int")}).join(ends, ["shard", "side"])
    sums = {c: F.col(f"to_{c}") - F.col(f"from_{c}") for c in ("leaves", "saved")}
    return closed.withColumns(sums).select("key", "above", "depth", "n", "least", "children", "leaves", "saved", "e1", "e2")


def _digests(members: DataFrame) -> DataFrame:
    """``e1``, ``e2`` and ``ends_sha256`` of the sorted ids ``conv`` of each key, fed one by one."""
    sorted_ = members.repartition("e1", "e2").sortWithinPartitions("e1", "e2", "conv")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None

        def row(keys, digests) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(digests, pa.string())],
                names=["e1", "e2", "ends_sha256"],
            )

        for batch in batches:
            e1, e2, conv = (batch[c].to_numpy() for c in ("e1", "e2", "conv"))
            edges = np.flatnonzero((e1[1:] != e1[:-1]) | (e2[1:] != e2[:-1])) + 1
            done, digests = [], []
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(conv)]):
                ids, mine = ",".join(map(str, conv[a:b].tolist())), (int(e1[a]), int(e2[a]))
                if mine == key:
                    digest.update(f",{ids}".encode())
                    continue
                if key is not None:
                    done.append(key)
                    digests.append(digest.hexdigest())
                key, digest = mine, hashlib.sha256(ids.encode())
            if done:
                yield row(done, digests)
        if key is not None:
            yield row([key], [digest.hexdigest()])

    return sorted_.mapInArrow(of, "e1 long, e2 long, ends_sha256 string")


def prefix_trie(seqs: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per distinct prefix of the lists in ``seqs`` (``conv``, ``seq`` as ``sequences`` gives them).

    ``conv_id`` (least member), ``depth``, ``parent_conv_id`` (null for the empty prefix), ``n_convs``, ``n_children``,
    ``n_leaves`` and ``saved_tokens`` (over the subtree), ``ends_sha256`` (of the members that end there).
    """
    spark = seqs.sparkSession
    e1, e2 = F.xxhash64("seq"), F.xxhash64(F.lit(1), "seq")
    keyed = stage(seqs.select("conv", "seq", e1.alias("e1"), e2.alias("e2")), "sequences")
    distinct = stage(keyed.groupBy("seq", "e1", "e2").agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("least")), "distinct")
    nodes = stage(_sharded(distinct, shard_turns), "nodes")
    borders = nodes.filter("side IS NOT NULL")
    merged = stage(_merged(borders), "merged")

    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "e1", "e2"]
    tail = ["n", "children", "leaves", "saved", "e1", "e2"]
    above = merged.select(F.col("key").alias("above"), F.col("least").alias("parent"))
    outer = merged.join(above, "above", "left").select("least", "depth", "parent", *tail).toDF(*names)
    # An inner node's parent is inner (known) or on a side of its own shard.
    met = borders.select("shard", F.col("side").alias("above_side"), "depth", "key").join(merged.select("key", "least"), "key")
    met = met.select("shard", "above_side", (F.col("depth") + 1).alias("depth"), F.col("least").alias("parent"))
    inner = nodes.filter("side IS NULL")
    known = inner.filter("above_side IS NULL").select("least", "depth", "parent", *tail).toDF(*names)
    found = inner.filter("above_side IS NOT NULL").drop("parent").join(met, ["shard", "above_side", "depth"])
    every = stage(outer.unionByName(known).unionByName(found.select("least", "depth", "parent", *tail).toDF(*names)), "trie")
    drop_staged(spark, nodes, merged, distinct)
    ended = every.filter("e1 IS NOT NULL").join(_digests(keyed.select("e1", "e2", "conv")), ["e1", "e2"])
    open_ = every.filter("e1 IS NULL").withColumn("ends_sha256", F.lit(NO_IDS))
    return ended.unionByName(open_).drop("e1", "e2")
