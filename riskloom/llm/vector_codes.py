"""Compression of vectors to codes of a few bytes, by anchors-hierarchy metric trees over their parts.

Vectors become whole numbers, are cut into equal parts, and each part position gets a codebook by rounds of nearest-entry
assignment and averaging. The vectors of a block (a bounded run of rows in one task) are put into one metric tree per
part, once: anchors take the points nearest to them, the points of an anchor are cut again in the same way, and above
the anchors the two balls that fit into the smallest ball are merged until one is left (middle-out). Every ball has its
pivot, radius, count and component sums.

A round walks the trees with the list of entries that may still be nearest to some point of a ball. Children inherit
what is left of it; an entry goes when another one is nearer to every point of the ball (``|p-j|^2 - |p-i|^2 > 2 r |i-j|``
for pivot ``p``), and a ball with one entry left is wholly owned: its cached count and sums are added and its points are not
looked at. Points of leaves are compared with the entries left there. Only clear cases are pruned, ties are settled at the
points by exact whole numbers, so the result equals that of comparing each point with each entry.

Blocks are staged once. A round moves one row per task, part, entry and component, summed map-side; the driver holds the
codebooks alone (parts x entries x components, a parameter's size). Hot vectors are a ball of radius zero.

Rows whose vector is null or holds null, NaN or infinite components go. Repeated rows all stay; a null id comes after all
others when the first entries are chosen (ties of an id by the vector), and null labels are one label. Fewer rows than
entries give smaller codebooks, no rows give none. Other columns are not read. Vectors of unequal length, of a length that
the parts do not divide, or so large that a squared distance leaves 64 bits raise ``ValueError``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from riskloom.session import drop_staged, stage

#: Whole numbers per unit of a component.
STEPS = 1024
#: Vectors in one tree, and points in a leaf at most (more only where they are all equal).
BLOCK = 4096
LEAF = 16
#: Labels up to which their sums are broadcast; beyond it they are joined by label and salt.
BROADCAST_LABELS = 100_000
SALTS = 32


class _Ball:
    """A node while a tree is built: its points, pivot, squared radius, sums and the two balls below it."""

    __slots__ = ("rows", "pivot", "radius2", "sums", "below")

    def __init__(self, points: np.ndarray, rows: np.ndarray, below: tuple = ()):
        own = points[rows]
        self.rows, self.below = rows, below
        self.sums = own.sum(axis=0)
        self.pivot = np.floor_divide(self.sums, len(rows))
        self.radius2 = ((own - self.pivot) ** 2).sum(axis=1).max()


def _distances(points: np.ndarray, rows: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    return np.sqrt(((points[rows] - pivot) ** 2).sum(axis=1).astype(np.float64))


def _anchors(points: np.ndarray, rows: np.ndarray, wanted: int) -> list[np.ndarray]:
    """The rows that each of up to ``wanted`` anchors owns; a point belongs to its nearest anchor."""
    far = _distances(points, rows, points[rows[0]])
    order = np.argsort(-far, kind="stable")
    owned = [(rows[0], rows[order], far[order])]
    while len(owned) < wanted:
        widest = max(range(len(owned)), key=lambda k: owned[k][2][0])
        if owned[widest][2][0] == 0:
            break
        pivot = owned[widest][1][0]
        taken, at, after = [], [], []
        for anchor, mine, far in owned:
            apart = math.sqrt(float(((points[anchor] - points[pivot]) ** 2).sum()))
            # A point nearer to its anchor than half the way to the new one cannot be stolen; lists descend.
            open_ = int(np.searchsorted(-far, -apart / 2, side="left"))
            if not open_:
                after.append((anchor, mine, far))
                continue
            new = _distances(points, mine[:open_], points[pivot])
            steal = new < far[:open_]
            taken.append(mine[:open_][steal])
            at.append(new[steal])
            stay = np.concatenate([~steal, np.ones(len(mine) - open_, bool)])
            after.append((anchor, mine[stay], far[stay]))
        rows_, far_ = np.concatenate(taken), np.concatenate(at)
        order = np.argsort(-far_, kind="stable")
        owned = [x for x in after if len(x[1])] + [(pivot, rows_[order], far_[order])]
    return [mine for _, mine, _ in owned]


def _merged(points: np.ndarray, balls: list[_Ball]) -> _Ball:
    """One ball over all: the pair with the smallest common ball is merged first."""
    n = len(balls)
    alive = np.ones(n, bool)
    pivots = np.array([b.pivot for b in balls], dtype=np.float64)
    reach = np.sqrt(np.array([float(b.radius2) for b in balls]))

    def common(k: int) -> np.ndarray:
        radius = (np.sqrt(((pivots - pivots[k]) ** 2).sum(axis=1)) + reach + reach[k]) / 2
        radius = np.maximum(radius, np.maximum(reach, reach[k]))
        radius[~alive] = np.inf
        radius[k] = np.inf
        return radius

    table = np.array([common(k) for k in range(n)])
    for _ in range(n - 1):
        a, b = divmod(int(table.argmin()), n)
        balls[a] = _Ball(points, np.concatenate([balls[a].rows, balls[b].rows]), (balls[a], balls[b]))
        alive[b] = False
        pivots[a], reach[a] = balls[a].pivot, math.sqrt(float(balls[a].radius2))
        table[b, :] = table[:, b] = np.inf
        table[a, :] = table[:, a] = common(a)
    return balls[int(np.flatnonzero(alive)[0])]


def _grown(points: np.ndarray, rows: np.ndarray) -> _Ball:
    ball = _Ball(points, rows)
    if len(rows) <= LEAF or ball.radius2 == 0:
        return ball
    owned = _anchors(points, rows, math.isqrt(len(rows) - 1) + 1)
    if len(owned) == 1:
        return ball
    return _merged(points, [_grown(points, mine) for mine in owned])


def tree(points: np.ndarray) -> dict[str, np.ndarray]:
    """The nodes of the tree over ``points`` in walking order, and the order in which leaves hold the points.

    ``first`` and ``last`` bound a node's points in that order; ``skip`` is the next node after its subtree, and a leaf's
    ``skip`` is its own number plus one.
    """
    root = _grown(points, np.arange(len(points)))
    nodes, leaves, stack, firsts, at = [], [], [root], [], 0
    while stack:
        ball = stack.pop()
        nodes.append(ball)
        firsts.append(at)
        if ball.below:
            stack.extend(reversed(ball.below))
        else:
            leaves.append(ball.rows)
            at += len(ball.rows)
    skip = np.empty(len(nodes), np.int32)
    sizes = {}
    for k in range(len(nodes) - 1, -1, -1):
        sizes[id(nodes[k])] = 1 + sum(sizes[id(b)] for b in nodes[k].below)
        skip[k] = k + sizes[id(nodes[k])]
    first = np.array(firsts, np.int32)
    return {
        "order": np.concatenate(leaves).astype(np.int32),
        "first": first,
        "last": first + np.array([len(b.rows) for b in nodes], np.int32),
        "skip": skip,
        "pivot": np.array([b.pivot for b in nodes]),
        "radius": np.sqrt(np.array([float(b.radius2) for b in nodes])),
        "sums": np.array([b.sums for b in nodes]),
    }


def walk(nodes: dict[str, np.ndarray], points: np.ndarray, entries: np.ndarray) -> Iterator[tuple]:
    """``(node, owner)`` of wholly owned balls (``owner`` an entry) and ``(node, owners)`` of leaves (an entry per point).

    ``points`` are in leaf order.
    """
    square = (entries**2).sum(axis=1)
    gaps = np.sqrt(np.maximum((square[:, None] - 2 * (entries @ entries.T) + square[None, :]).astype(np.float64), 0))
    # Of equal entries only the first can win a tie.
    start = np.sort(np.unique(entries, axis=0, return_index=True)[1])
    stack = [(0, start)]
    while stack:
        node, held = stack.pop()
        if len(held) > 1:
            far = square[held] - 2 * (entries[held] @ nodes["pivot"][node])
            best = int(far.argmin())
            lead = (far - far[best]).astype(np.float64)
            held = held[lead * (1 - 1e-9) <= 2 * nodes["radius"][node] * gaps[held[best]][held]]
        if len(held) == 1:
            yield node, held[0]
        elif nodes["skip"][node] == node + 1:
            own = points[nodes["first"][node] : nodes["last"][node]]
            yield node, held[(square[held][None, :] - 2 * (own @ entries[held].T)).argmin(axis=1)]
        else:
            child, end = node + 1, nodes["skip"][node]
            while child < end:
                stack.append((child, held))
                child = nodes["skip"][child]


#: The lists that hold a block's trees.
_LISTS = {
    "order": T.IntegerType, "points": T.LongType, "n_nodes": T.IntegerType, "first": T.IntegerType, "last": T.IntegerType,
    "skip": T.IntegerType, "pivot": T.LongType, "radius": T.DoubleType, "sums": T.LongType,
}
_NUMPY = {T.IntegerType: np.int32, T.LongType: np.int64, T.DoubleType: np.float64}


def _list(values) -> pa.ListArray:
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _blocks(vectors: DataFrame, parts: int, width: int, number: type) -> DataFrame:
    """One row per block: ids, labels and the trees of all parts, one after the other."""
    label = T.ArrayType(vectors.schema["label"].dataType)
    fields = [("id", T.ArrayType(T.LongType())), ("label", label), *((name, T.ArrayType(kind())) for name, kind in _LISTS.items())]
    schema = T.StructType([T.StructField(name, kind) for name, kind in fields])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                n = piece.num_rows
                flat = piece["v"].flatten().to_numpy(zero_copy_only=False).reshape(n, parts, width).astype(number)
                held = {name: [] for name in _LISTS}
                for part in range(parts):
                    points = np.ascontiguousarray(flat[:, part])
                    nodes = tree(points)
                    held["points"].append(points[nodes["order"]].reshape(-1))
                    held["n_nodes"].append([len(nodes["skip"])])
                    for name in ("order", "first", "last", "skip", "radius"):
                        held[name].append(nodes[name])
                    held["pivot"].append(nodes["pivot"].reshape(-1))
                    held["sums"].append(nodes["sums"].reshape(-1))
                lists = [_list(np.concatenate(held[name]).astype(_NUMPY[kind])) for name, kind in _LISTS.items()]
                yield pa.RecordBatch.from_arrays([_list(piece["id"]), _list(piece["label"]), *lists], names=schema.names)

    return vectors.mapInArrow(of, schema)


def _trees(row: dict, parts: int, width: int, number: type) -> Iterator[tuple[int, dict, np.ndarray]]:
    """Part number, nodes and points of a staged block."""
    n, at = len(row["order"]) // parts, 0
    for part, count in enumerate(row["n_nodes"]):
        pick = slice(at, at + int(count))
        nodes = {name: row[name][pick] for name in ("first", "last", "skip", "radius")}
        nodes |= {name: row[name].reshape(-1, width)[pick].astype(number) for name in ("pivot", "sums")}
        nodes["order"] = row["order"][part * n : (part + 1) * n]
        yield part, nodes, row["points"].reshape(parts, n, width)[part].astype(number)
        at += int(count)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, dict]]:
    for k in range(batch.num_rows):
        yield k, {name: batch[name][k].values.to_numpy(zero_copy_only=False) for name in _LISTS}


def _totals(blocks: DataFrame, books: np.ndarray, number: type) -> DataFrame:
    """``part``, ``entry``, ``place``, ``total`` and ``n``: component sums of the parts that each entry owns."""
    parts, entries, width = books.shape

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for _, row in _rows(batch):
                for part, nodes, points in _trees(row, parts, width, number):
                    sized = nodes["last"] - nodes["first"]
                    for node, owner in walk(nodes, points, books[part].astype(number)):
                        if isinstance(owner, np.ndarray):
                            own = points[nodes["first"][node] : nodes["last"][node]]
                            np.add.at(sums[part], owner, own.astype(np.int64))
                            np.add.at(counts[part], owner, 1)
                        else:
                            sums[part, owner] += nodes["sums"][node].astype(np.int64)
                            counts[part, owner] += sized[node]
        part, entry = np.nonzero(counts)
        if len(part):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(part, width), pa.int32()), pa.array(np.repeat(entry, width), pa.int32()),
                    pa.array(np.tile(np.arange(width), len(part)), pa.int32()), pa.array(sums[part, entry].reshape(-1)),
                    pa.array(np.repeat(counts[part, entry], width)),
                ],
                names=["part", "entry", "place", "total", "n"],
            )

    found = blocks.mapInArrow(of, "part int, entry int, place int, total long, n long")
    return found.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))


def _coded(blocks: DataFrame, books: np.ndarray, number: type) -> DataFrame:
    """``id``, ``label``, ``code`` and ``error`` of every vector."""
    parts, entries, width = books.shape
    digits = max(2, len(f"{entries - 1:x}"))
    label = blocks.schema["label"].dataType.elementType
    fields = [("id", T.LongType()), ("label", label), ("code", T.StringType()), ("error", T.LongType())]
    schema = T.StructType([T.StructField(name, kind) for name, kind in fields])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([f"{k:0{digits}x}" for k in range(entries)], dtype=object)
        for batch in batches:
            for k, row in _rows(batch):
                n = len(row["order"]) // parts
                codes, error = np.empty((parts, n), np.int64), np.zeros(n, np.int64)
                for part, nodes, points in _trees(row, parts, width, number):
                    book = books[part].astype(number)
                    own = np.empty(n, np.int64)
                    for node, owner in walk(nodes, points, book):
                        own[nodes["first"][node] : nodes["last"][node]] = owner
                    codes[part, nodes["order"]] = own
                    error[nodes["order"]] += ((points - book[own]) ** 2).sum(axis=1).astype(np.int64)
                code = names[codes[0]]
                for part in range(1, parts):
                    code = code + names[codes[part]]
                yield pa.RecordBatch.from_arrays([batch["id"][k].values, batch["label"][k].values, pa.array(code, pa.string()), pa.array(error)], names=schema.names)

    return blocks.mapInArrow(of, schema)


def _finite(vector: str):
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.col(vector).isNotNull() & F.forall(vector, good)


def _number(most: float, width: int) -> type:
    """Doubles while every squared distance is a whole number they hold exactly, else 64-bit integers."""
    square = 4 * max(width, 1) * (most + 1) ** 2
    if square < 2.0**53:
        return np.float64
    if square < 2.0**62:
        return np.int64
    raise ValueError("components too large: a squared distance would not fit 64 bits")


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = 4, entries: int = 256, rounds: int = 4,
) -> tuple[DataFrame, np.ndarray]:
    """Rows ``(id, label, code, error)`` and the final codebooks (parts x entries x components)."""
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("label"))
    kept = kept.filter(_finite("v")).withColumn("v", F.transform("v", lambda x: F.floor(x * STEPS)))
    seen = kept.agg(
        F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high"),
        F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))).alias("most"),
    ).first()
    size = seen.low or 0
    if seen.low != seen.high or size % parts:
        raise ValueError(f"vectors must have one length that {parts} parts divide, found {seen.low} to {seen.high}")
    width = size // parts
    number = _number(seen.most or 0.0, width)
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = np.array([r.v for r in first], dtype=np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    blocks = stage(_blocks(kept, parts, width, number), "blocks")
    for _ in range(rounds if len(first) and width else 0):
        for r in _totals(blocks, books, number).collect():
            books[r.part, r.entry, r.place] = int(r.total) // r.n
    coded = stage(_coded(blocks, books, number), "codes")
    drop_staged(vectors.sparkSession, blocks)
    return coded, books


def books_sha256(books: np.ndarray) -> str:
    """SHA-256 of the entries' components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the sum of ``error`` over equal labels; null labels are one."""
    sums = stage(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")
    if sums.count() <= BROADCAST_LABELS:
        each = F.broadcast(sums.withColumnRenamed("label", "_label"))
        return coded.join(each, coded["label"].eqNullSafe(F.col("_label"))).drop("_label")
    salted = sums.select(F.col("label").alias("_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    mine = coded.withColumn("_mine", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
    met = mine.join(salted, mine["label"].eqNullSafe(F.col("_label")) & (F.col("_mine") == F.col("_salt")))
    return met.drop("_label", "_salt", "_mine")
