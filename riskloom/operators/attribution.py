"""Additive attributions of a prediction to its features."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import staged_path
from .models import FEATURES, input_names, trees_of

TOP_FEATURES = 20
# Rows, and values of row by leaf by feature, that are worked on at a time.
PATH_ROWS = 256
PATH_CELLS = 1 << 19


def linear_attribution(df: DataFrame, weights: Mapping[str, float], keep: Sequence[str] = ("entity_id",)) -> DataFrame:
    """``w_i * (x_i - mean_i)`` per feature as columns: exact for a linear model of independent features."""
    means = df.agg(F.struct(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(weights)]).alias("m")).scalar()
    return df.select(
        *keep, *[(F.lit(float(w)) * (F.col(c) - means.getField(f"m_{i}"))).alias(c) for i, (c, w) in enumerate(weights.items())]
    )


def mean_abs_attribution(df: DataFrame, features: Sequence[str], top: int | None = TOP_FEATURES) -> DataFrame:
    """Mean absolute attribution per feature, largest first ``(feature, mean_abs_shap)``."""
    row = df.agg(*[F.avg(F.abs(F.col(f))).alias(f"a_{i}") for i, f in enumerate(features)])
    entries = [F.struct(F.lit(f).alias("feature"), F.col(f"a_{i}").alias("mean_abs_shap")) for i, f in enumerate(features)]
    ranked = row.select(F.explode(F.array(*entries)).alias("r")).select("r.*").orderBy(F.desc("mean_abs_shap"), "feature")
    return ranked.limit(top) if top else ranked


def _tree_nodes(model: PipelineModel) -> list[dict]:
    """Nodes of all trees, one dict per tree from node id to node.

    They are read from the model's own saved table; their number is set by rounds and depth.
    """
    trees = trees_of(model)
    spark = SparkSession.active()
    path = staged_path(spark, "trees")
    trees.write().save(path)
    nodes: list[dict] = [{} for _ in range(trees.getNumTrees)]
    for row in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect():
        nodes[row["treeID"]][row["id"]] = row
    return nodes


@dataclass
class Paths:
    """Leaves that test equally many features, as arrays of leaf by tested feature.

    A row meets a test if its value lies above ``low`` and at most at ``high``, and for a nominal feature if its code is
    allowed by row ``listed`` of ``allowed`` (-1: no such test). ``keep`` is the share of training rows that meet it.
    """

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    keep: np.ndarray
    listed: np.ndarray
    value: np.ndarray
    allowed: np.ndarray

    def met(self, x: np.ndarray, part: slice) -> np.ndarray:
        """Row by leaf by feature: whether the test is met."""
        values = x[:, self.feature[part]]
        # A comparison with NaN is false, and the trees send such a value to the right.
        met = ~(values <= self.low[part]) | np.isneginf(self.low[part])
        met &= (values <= self.high[part]) | np.isposinf(self.high[part])
        listed = self.listed[part]
        if (listed >= 0).any():
            codes = np.nan_to_num(values, nan=-1.0).clip(-1, self.allowed.shape[1] - 1).astype(np.int64)
            met &= self.allowed[listed, codes] | (listed < 0)
        return met

    def add(self, x: np.ndarray, out: np.ndarray) -> None:
        """Add the Shapley values of all leaves for a batch of rows.

        A coalition is worth the leaf's value times 1 or 0 per known feature and its kept share per unknown one. Averaged over
        orders of the features that is an integral over [0, 1] of a product of one linear factor per other feature: a
        polynomial, which a Gauss rule of half as many points sums exactly. The products leave out one factor each by
        running products from both sides, so the work per leaf and row is the square of its features.
        """
        leaves, m = self.feature.shape
        nodes, shares = np.polynomial.legendre.leggauss((m + 1) // 2)
        nodes, shares = (nodes + 1) / 2, shares / 2
        step = max(1, PATH_CELLS // max(1, len(x) * m))
        for at in range(0, leaves, step):
            part = slice(at, at + step)
            met, keep = self.met(x, part).astype(np.float64), self.keep[part]
            total = np.zeros_like(met)
            for t, share in zip(nodes, shares):
                factor = keep * (1 - t) + met * t
                before = np.ones_like(factor)
                np.cumprod(factor[:, :, :-1], axis=2, out=before[:, :, 1:])
                after = np.ones_like(factor)
                after[:, :, :-1] = np.cumprod(factor[:, :, :0:-1], axis=2)[:, :, ::-1]
                total += share * before * after
            total *= self.value[part, None] * (met - keep)
            # Equal features are summed side by side.
            flat = self.feature[part].reshape(-1)
            order = np.argsort(flat, kind="stable")
            named, first = np.unique(flat[order], return_index=True)
            out[:, named] += np.add.reduceat(total.reshape(len(x), -1)[:, order], first, axis=1)


def packed_paths(leaves: Sequence[tuple[float, list]]) -> list[Paths]:
    """Leaves ``(value, tests)`` by their number of features; tests are ``(feature, kept share, (kind, limit))``.

    Several tests of one feature are one: their bounds and lists are intersected, their shares multiplied.
    """
    size = 1 + max((int(max(limit)) for _, tests in leaves for _, _, (kind, limit) in tests if kind in ("in", "out") and len(limit)), default=0)
    groups: dict[int, list] = {}
    for value, tests in leaves:
        games: dict[int, list] = {}
        for f, share, (kind, limit) in tests:
            game = games.setdefault(f, [1.0, -np.inf, np.inf, None])
            game[0] *= share
            if kind == "le":
                game[2] = min(game[2], limit)
            elif kind == "gt":
                game[1] = max(game[1], limit)
            else:
                # The last place stands for codes that no list names.
                own = np.full(size + 1, kind == "out")
                own[np.asarray(limit, dtype=np.int64)] = kind == "in"
                game[3] = own if game[3] is None else game[3] & own
        if games:
            groups.setdefault(len(games), []).append((value, games))
    out = []
    for m, held in groups.items():
        lists = [game[3] for _, games in held for game in games.values() if game[3] is not None]
        numbers = iter(range(len(lists)))
        listed = [[next(numbers) if game[3] is not None else -1 for game in games.values()] for _, games in held]
        column = lambda k: np.array([[game[k] for game in games.values()] for _, games in held], dtype=np.float64)
        out.append(Paths(
            np.array([list(games) for _, games in held]), column(1), column(2), column(0), np.array(listed),
            np.array([value for value, _ in held]), np.array(lists) if lists else np.ones((1, size + 1), bool),
        ))
    return out


def _leaves(nodes: list[dict], weights: Sequence[float]) -> list[tuple[float, list]]:
    """Value and tests of every leaf."""
    leaves = []
    for tree, weight in zip(nodes, weights):
        open_nodes = [(0, [])]
        while open_nodes:
            node_id, tests = open_nodes.pop()
            node = tree[node_id]
            if node["leftChild"] < 0:
                leaves.append((weight * node["prediction"], tests))
                continue
            f, split = node["split"]["featureIndex"], node["split"]
            values = list(split["leftCategoriesOrThreshold"])
            nominal = split["numCategories"] >= 0
            for side, child in (("left", node["leftChild"]), ("right", node["rightChild"])):
                share = tree[child]["rawCount"] / node["rawCount"] if node["rawCount"] else 0.0
                if nominal:
                    test = ("in" if side == "left" else "out", values)
                else:
                    test = ("le" if side == "left" else "gt", values[0])
                open_nodes.append((child, [*tests, (f, share, test)]))
    return leaves


def tree_attribution(model: PipelineModel, df: DataFrame, keep: Sequence[str] = ("entity_id",)) -> DataFrame:
    """Exact path-dependent Shapley values of the trees' margin: one column per feature and ``base``.

    The columns of a row and ``base`` add up to its margin. Rows are independent, so the work is
    spread like any projection. Each task holds the leaves as arrays, some 28 bytes per leaf and tested feature: a size set by
    rounds and depth, not by the data (7 MB for 600 rounds of depth 6).
    """
    names = input_names(model)
    trees = trees_of(model)
    leaves = _leaves(_tree_nodes(model), trees.treeWeights)
    base = float(sum(value * np.prod([share for _, share, _ in tests]) for value, tests in leaves))
    shared = df.sparkSession.sparkContext.broadcast(packed_paths(leaves))
    prepared = PipelineModel(model.stages[:-1]).transform(df)
    rows = prepared.select(*keep, vector_to_array(FEATURES).alias("__x"))
    width = len(names)

    def attribute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.asarray(batch["__x"].tolist(), dtype=np.float64).reshape(len(batch), width)
            out = np.zeros((len(batch), width))
            for at in range(0, len(x), PATH_ROWS):
                for paths in shared.value:
                    paths.add(x[at : at + PATH_ROWS], out[at : at + PATH_ROWS])
            result = batch.drop(columns="__x")
            for i, name in enumerate(names):
                result[name] = out[:, i]
            result["base"] = base
            yield result

    types = dict(rows.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + [f"`{n}` double" for n in names] + ["base double"])
    return rows.mapInPandas(attribute, schema)
