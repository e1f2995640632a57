"""Anomaly scores by a neural autoencoder, fitted by synchronous mini-batch gradient descent.

All steps are one Spark job while a batch is one task's rows and the packed table fits its memory: steps follow each other, so
that more tasks would not help them. Over larger tables a step is a job: every task adds up the gradient of its rows under the
current weights, slices of the sums meet in a second and smaller round of tasks, and the driver, which holds the weights alone,
is sent one gradient and makes the step; a batch of one task's rows needs no second round. Rows are packed once. Equal rows
are one row with a count; a pack holds the few hundred rows that share a hash, sorted, so its matrix products do not depend
on how the table was partitioned, and sums of gradients are whole numbers, so they do not depend on the order of addition.
Weights and losses are the same for any layout of the table and after any lost task (errors of rows are scored in single
precision).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalars import threshold_predict
from ..session import drop_staged, stage
from .evaluate import score_percentile
from .models import ANOMALY_PERCENTILE, scaled_row

# Layer sizes, epochs, rows of a step, step size and decay of the published model.
HIDDEN, LATENT = 128, 32
EPOCHS, BATCH_ROWS = 50, 4096
RATE, DECAY = 1e-3, 1e-5
# Steps of an epoch at most: larger tables make larger steps, as a step costs a job.
MAX_STEPS = 64
# Rows in a pack and of a task on average, and tasks that add up a slice of the gradients each.
PACK_ROWS = 256
TASK_ROWS = 16384
SUMS = 4
# Numbers that the task of a small table may hold (256 MB).
HELD_VALUES = 1 << 25
# Gradients as whole numbers: this many units per 1 of the mean gradient.
_UNITS = float(1 << 44)
_ROOM = float(1 << 61)


def layer_sizes(inputs: int, hidden: int = HIDDEN, latent: int = LATENT) -> list[tuple[int, int]]:
    return [(inputs, hidden), (hidden, latent), (latent, hidden), (hidden, inputs)]


def initial_weights(inputs: int, hidden: int = HIDDEN, latent: int = LATENT, seed: int = 42) -> list[np.ndarray]:
    """Matrices and offsets, uniform within one over the root of the layer's inputs."""
    rng = np.random.default_rng(seed)
    weights = []
    for a, b in layer_sizes(inputs, hidden, latent):
        reach = 1 / math.sqrt(a)
        weights += [rng.uniform(-reach, reach, (a, b)), rng.uniform(-reach, reach, b)]
    return weights


def _layers(rows: np.ndarray, weights: Sequence[np.ndarray]) -> list[np.ndarray]:
    """The input of every layer and the output of the last; all but the last cut off below 0."""
    held = [rows]
    for k in range(0, len(weights), 2):
        out = held[-1] @ weights[k] + weights[k + 1]
        held.append(out if k == len(weights) - 2 else np.maximum(out, 0.0))
    return held


def row_errors(rows: np.ndarray, weights: Sequence[np.ndarray]) -> np.ndarray:
    """Mean squared difference of every row and its reconstruction."""
    return ((_layers(rows, weights)[-1] - rows) ** 2).mean(axis=1)


def gradients(rows: np.ndarray, counts: np.ndarray, weights: Sequence[np.ndarray]) -> tuple[np.ndarray, float]:
    """Sums over the rows, ``counts`` times each, of the gradient of a row's error and of the error."""
    held = _layers(rows, weights)
    off = held[-1] - rows
    loss = float((counts * (off * off).mean(axis=1)).sum())
    back = off * (2.0 / rows.shape[1]) * counts[:, None]
    parts: list[np.ndarray] = []
    for k in range(len(weights) - 2, -1, -2):
        parts = [held[k // 2].T @ back, back.sum(axis=0), *parts]
        if k:
            back = (back @ weights[k].T) * (held[k // 2] > 0)
    return np.concatenate([p.reshape(-1) for p in parts]), loss


class Adam:
    """Steps of the Adam method with decay added to the gradient."""

    def __init__(self, size: int, rate: float = RATE, decay: float = DECAY):
        self.rate, self.decay, self.n = rate, decay, 0
        self.first, self.second = np.zeros(size), np.zeros(size)

    def step(self, values: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.n += 1
        gradient = gradient + self.decay * values
        self.first = 0.9 * self.first + 0.1 * gradient
        self.second = 0.999 * self.second + 0.001 * gradient**2
        first, second = self.first / (1 - 0.9**self.n), self.second / (1 - 0.999**self.n)
        return values - self.rate * first / (np.sqrt(second) + 1e-8)


def _flat(weights: Sequence[np.ndarray]) -> np.ndarray:
    return np.concatenate([w.reshape(-1) for w in weights])


def _shaped(values: np.ndarray, like: Sequence[np.ndarray]) -> list[np.ndarray]:
    edges = np.cumsum([0, *[w.size for w in like]])
    return [values[a:b].reshape(w.shape) for a, b, w in zip(edges, edges[1:], like)]


def pack(rows: DataFrame, batch_rows: int = BATCH_ROWS, max_steps: int = MAX_STEPS) -> tuple[DataFrame, list[int]]:
    """Packs ``(batch, counts, flat)`` of rows ``(x)`` and the rows of each batch; batches are folders of the staged table."""
    equal = stage(rows.groupBy("x").agg(F.count(F.lit(1)).alias("n")), "rows")
    n, distinct = equal.agg(F.sum("n"), F.count(F.lit(1))).first()
    if not n:
        raise ValueError("there are no rows of label 0 to fit on")
    steps = max(1, min(max_steps, -(-n // batch_rows)))
    cells = max(1, -(-distinct // (steps * PACK_ROWS)))
    place = F.xxhash64("x")
    dealt = equal.select(F.pmod(place, F.lit(steps)).alias("batch"), F.pmod(F.xxhash64(place), F.lit(cells)).alias("cell"), "x", "n")
    packs = dealt.groupBy("batch", "cell").agg(F.array_sort(F.collect_list(F.struct("x", "n"))).alias("rows"))
    # A batch has one file for each of its tasks.
    shares = max(1, -(-distinct // (steps * TASK_ROWS)))
    packs = packs.repartition("batch", F.pmod("cell", F.lit(shares))).select(
        "batch", F.transform("rows", lambda r: r["n"].cast("double")).alias("counts"), F.flatten(F.transform("rows", lambda r: r["x"])).alias("flat")
    )
    packs = stage(packs, "packs", by="batch")
    sizes = {r["batch"]: int(r["n"]) for r in packs.groupBy("batch").agg(F.sum(F.aggregate("counts", F.lit(0.0), lambda a, c: a + c)).alias("n")).collect()}
    drop_staged(rows.sparkSession, equal)
    return packs, [sizes.get(k, 0) for k in range(steps)]


def _means(rows: DataFrame, values: dict[str, Column], most: dict[str, float]) -> list[float]:
    """Means of the values, each at most its ``most`` in size, out of whole numbers: alike for any order of the rows."""
    parts, half = [], float(1 << 31)
    for i, (c, value) in enumerate(values.items()):
        high = F.floor(value / F.lit(most[c] or 1.0) * F.lit(half))
        low = F.floor((value / F.lit(most[c] or 1.0) * F.lit(half) - high) * F.lit(half))
        parts += [F.sum(x.cast("decimal(20,0)")).alias(f"{n}{i}") for n, x in (("h", high), ("l", low))] + [F.count(value).alias(f"n{i}")]
    sums = rows.agg(*parts).first()
    out = []
    for i, c in enumerate(values):
        units = int(sums[f"h{i}"] or 0) * (1 << 31) + int(sums[f"l{i}"] or 0)
        out.append(units / (max(sums[f"n{i}"], 1) << 62) * (most[c] or 1.0))
    return out


def stable_scale(rows: DataFrame, columns: Sequence[str]) -> tuple[list[float], list[float]]:
    """Mean and population deviation of each column (a zero deviation becomes 1), the same for any layout of the rows."""
    value = {c: F.col(c).cast("double") for c in columns}
    low, high = F.min, F.max
    ends = rows.agg(*[f(x).alias(f"{n}{i}") for i, x in enumerate(value.values()) for n, f in (("a", low), ("b", high))]).first()
    edge = lambda i: max(abs(ends[f"a{i}"] or 0.0), abs(ends[f"b{i}"] or 0.0))
    means = _means(rows, value, {c: edge(i) for i, c in enumerate(columns)})
    off = {c: (value[c] - F.lit(m)) * (value[c] - F.lit(m)) for c, m in zip(columns, means)}
    square = _means(rows, off, {c: (edge(i) + abs(m)) ** 2 for i, (c, m) in enumerate(zip(columns, means))})
    return means, [math.sqrt(v) or 1.0 for v in square]


_SLICE = "slot int, total array<bigint>"
_SENT = "slot int, total binary"


def sent(total: np.ndarray) -> bytes:
    """Whole numbers without loss, those of small size in few bytes: signs come last and bytes of one place lie together."""
    planes = ((total << 1) ^ (total >> 63)).view(np.uint8).reshape(-1, 8).T
    return pa.compress(np.ascontiguousarray(planes), codec="zstd", asbytes=True)


def received(data: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, size * 8, codec="zstd"), np.uint8).reshape(8, size)
    folded = np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1)
    return (folded >> np.uint64(1)).view(np.int64) ^ -(folded & np.uint64(1)).view(np.int64)


def _sent_batch(totals: dict[int, np.ndarray]) -> pa.RecordBatch:
    data = [sent(total) for total in totals.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(data, pa.binary())], names=["slot", "total"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, slot in enumerate(batch["slot"].to_pylist()):
            own = batch["total"][k].values.to_numpy()
            totals[slot] = totals[slot] + own if slot in totals else own.copy()
    yield _sent_batch(totals)


def _pack_units(rows: np.ndarray, counts: np.ndarray, weights: Sequence[np.ndarray], size: int) -> np.ndarray:
    """A pack's share of the mean gradient and mean error of ``size`` rows, in whole units."""
    gradient, error = gradients(rows, counts, weights)
    units = np.append(gradient, error) * (_UNITS / size)
    if not np.isfinite(units).all() or np.abs(units).max() > _ROOM / max(size, 1):
        raise OverflowError("a gradient is too large; scale the columns or lower the rate")
    return np.rint(units).astype(np.int64)


def batch_gradient(packs: DataFrame, size: int, weights: Sequence[np.ndarray]) -> tuple[np.ndarray, float]:
    """Mean gradient and mean error of the packs' ``size`` rows."""
    inputs = weights[0].shape[0]
    shares = max(1, -(-size // TASK_ROWS))
    # The error comes after the gradient.
    ends = np.linspace(0, sum(w.size for w in weights) + 1, (1 if shares == 1 else SUMS) + 1).astype(int).tolist()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for k in range(batch.num_rows):
                counts, flat = (batch[c][k].values.to_numpy() for c in ("counts", "flat"))
                units = _pack_units(flat.reshape(-1, inputs), counts, weights, size)
                total = units if total is None else total + units
        if total is None:
            return
        if shares == 1:
            yield _sent_batch({0: total})
            return
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(total))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(ends) - 1), pa.int32()), lists], names=["slot", "total"])

    sums = packs.select("counts", "flat").coalesce(shares)
    if shares == 1:
        sums = sums.mapInArrow(of, _SENT)
    else:
        sums = sums.mapInArrow(of, _SLICE).repartition(SUMS, "slot").mapInArrow(_added, _SENT)
    table = sums.toArrow()
    totals = dict(zip(table["slot"].to_pylist(), table["total"].to_pylist()))
    total = np.concatenate([received(totals[k], b - a) for k, (a, b) in enumerate(zip(ends, ends[1:]))]) / _UNITS
    return total[:-1], float(total[-1])


def fits_task(packs: DataFrame, sizes: Sequence[int], inputs: int) -> bool:
    """Whether one task makes every step anyway and can hold all packs."""
    return max(sizes) <= TASK_ROWS and packs.agg(F.sum(F.size("counts"))).first()[0] * inputs <= HELD_VALUES


def _fit_held(
    packs: DataFrame, sizes: Sequence[int], orders: Sequence[Sequence[int]], weights: Sequence[np.ndarray], rate: float, decay: float
) -> tuple[np.ndarray, list[float]]:
    """Values and losses after all steps, by one task that holds the packs."""
    inputs = weights[0].shape[0]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                counts, flat = (batch[c][k].values.to_numpy() for c in ("counts", "flat"))
                held.setdefault(batch["batch"][k].as_py(), []).append((flat.reshape(-1, inputs), counts))
        values, losses = _flat(weights), []
        adam = Adam(len(values), rate, decay)
        for order in orders:
            seen = []
            for k in order:
                now, total = _shaped(values, weights), np.zeros(len(values) + 1, np.int64)
                for rows, counts in held[k]:
                    total += _pack_units(rows, counts, now, sizes[k])
                mean = total / _UNITS
                values = adam.step(values, mean[:-1])
                seen.append(float(mean[-1]))
            losses.append(float(np.mean(seen)))
        columns = [pa.array([v], pa.list_(pa.float64())) for v in (values.tolist(), losses)]
        yield pa.RecordBatch.from_arrays(columns, names=["fitted", "losses"])

    fitted = packs.coalesce(1).mapInArrow(of, "fitted array<double>, losses array<double>").toArrow()
    return np.array(fitted["fitted"][0].as_py()), fitted["losses"][0].as_py()


@dataclass
class Autoencoder:
    """Weights between standardised columns and their reconstruction, with the loss of every epoch."""

    columns: list[str]
    means: list[float]
    scales: list[float]
    weights: list[np.ndarray]
    threshold: float
    losses: list[float] = field(default_factory=list)

    def errors(self, df: DataFrame, keep: Sequence[str] = ("entity_id", "label")) -> DataFrame:
        """``(*keep, reconstruction_error)``: mean squared difference of a row and its reconstruction; a missing value is an error."""
        weights = [w.astype(np.float32) for w in self.weights]

        @F.arrow_udf("double")
        def error(rows: pa.Array) -> pa.Array:
            matrix = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
            if np.isnan(matrix).any():
                raise ValueError("a row has a missing value")
            return pa.array(row_errors(matrix.astype(np.float32), weights).astype(np.float64))

        row = scaled_row(self.columns, self.means, self.scales)
        return df.select(*keep, error(row).alias("reconstruction_error"))

    def score(self, df: DataFrame, keep: Sequence[str] = ("entity_id", "label")) -> DataFrame:
        """``(*keep, reconstruction_error, prediction)``."""
        return self.errors(df, keep).withColumn("prediction", threshold_predict("reconstruction_error", self.threshold))

    def history(self) -> DataFrame:
        """``(iteration, loss)``: the mean batch loss of every epoch."""
        rows = [(k + 1, float(v)) for k, v in enumerate(self.losses)]
        return SparkSession.active().createDataFrame(rows, "iteration int, loss double")

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        layers = [(k, list(w.shape), w.reshape(-1).tolist()) for k, w in enumerate(self.weights)]
        spark.createDataFrame(layers, "layer int, shape array<int>, weights array<double>").write.mode("overwrite").parquet(f"{path}/layers")
        self.history().write.mode("overwrite").parquet(f"{path}/history")
        settings = [(self.columns, self.means, self.scales, self.threshold)]
        kinds = "columns array<string>, means array<double>, scales array<double>, threshold double"
        spark.createDataFrame(settings, kinds).write.mode("overwrite").parquet(f"{path}/settings")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Autoencoder":
        settings = spark.read.parquet(f"{path}/settings").first()
        layers = sorted(spark.read.parquet(f"{path}/layers").collect(), key=lambda r: r["layer"])
        weights = [np.array(r["weights"]).reshape(r["shape"]) for r in layers]
        losses = [r["loss"] for r in sorted(spark.read.parquet(f"{path}/history").collect(), key=lambda r: r["iteration"])]
        return Autoencoder(list(settings["columns"]), list(settings["means"]), list(settings["scales"]), weights, settings["threshold"], losses)


def train_autoencoder(
    train: DataFrame,
    columns: Sequence[str],
    label: str = "label",
    hidden: int = HIDDEN,
    latent: int = LATENT,
    epochs: int = EPOCHS,
    batch_rows: int = BATCH_ROWS,
    rate: float = RATE,
    decay: float = DECAY,
    percentile: float = ANOMALY_PERCENTILE,
    seed: int = 42,
) -> Autoencoder:
    """Fit on the rows of label 0; the threshold is an exact percentile of their errors.

    An epoch takes every batch once, in an order drawn from the seed. A missing value is an error.
    """
    columns = list(columns)
    legit = train.where(F.col(label) == 0)
    means, scales = stable_scale(legit, columns)
    row = scaled_row(columns, means, scales)
    missing = F.exists("x", lambda v: F.isnan(v))
    rows = legit.select(row.alias("x")).select(F.when(missing, F.raise_error(F.lit("a row has a missing value"))).otherwise(F.col("x")).alias("x"))
    packs, sizes = pack(rows, batch_rows)
    weights = initial_weights(len(columns), hidden, latent, seed)
    order = np.random.default_rng(seed)
    orders = [order.permutation([k for k, n in enumerate(sizes) if n]).tolist() for _ in range(epochs)]
    if fits_task(packs, sizes, len(columns)):
        values, losses = _fit_held(packs, sizes, orders, weights, rate, decay)
    else:
        values, losses = _flat(weights), []
        adam = Adam(len(values), rate, decay)
        for batches in orders:
            seen = []
            for batch in batches:
                gradient, loss = batch_gradient(packs.where(F.col("batch") == batch), sizes[batch], _shaped(values, weights))
                values = adam.step(values, gradient)
                seen.append(loss)
            losses.append(float(np.mean(seen)))
    model = Autoencoder(columns, means, scales, _shaped(values, weights), float("inf"), losses)
    drop_staged(train.sparkSession, packs)
    errors = stage(model.errors(legit, keep=[]), "training-errors")
    model.threshold = score_percentile(errors, "reconstruction_error", [percentile])[percentile]
    return model
