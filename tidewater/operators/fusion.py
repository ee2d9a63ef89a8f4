"""A network that fuses two inputs in the middle (such as table features and a text embedding), trained on the cluster.

Each input has a hidden layer of its own; both meet in a shared one. An epoch is one pass over a stored table: tasks add
up the gradients and losses of their rows in Arrow batches, Spark adds those of the tasks number by number, and only the
weights, whose number doesn't depend on the data, pass through the driver. Rows held out give a loss of their own; training
stops once that hasn't fallen for `patience` epochs, and the best weights stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.sources.work import materialize


@dataclass
class FusionModel:
    shapes: list[tuple[int, ...]]
    weights: np.ndarray
    history: list[tuple[int, float, float]]

    def _parts(self) -> list[np.ndarray]:
        ends = np.cumsum([int(np.prod(s)) for s in self.shapes])
        return [w.reshape(s) for w, s in zip(np.split(self.weights, ends[:-1]), self.shapes, strict=True)]

    def forward(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, ...]:
        w1, b1, w2, b2, w3, b3, w4, b4 = self._parts()
        both = np.concatenate([np.maximum(one @ w1 + b1, 0), np.maximum(two @ w2 + b2, 0)], axis=1)
        shared = np.maximum(both @ w3 + b3, 0)
        return both, shared, 1 / (1 + np.exp(-np.clip(shared @ w4 + b4, -30, 30)))[:, 0]

    def gradient(self, one: np.ndarray, two: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The sum over rows of the gradient of the log loss."""
        _, _, _, _, w3, _, w4, _ = self._parts()
        both, shared, p = self.forward(one, two)
        out = (p - y)[:, None]
        d3 = (out @ w4.T) * (shared > 0)
        d12 = (d3 @ w3.T) * (both > 0)
        h = self.shapes[1][0]
        d1, d2 = d12[:, :h], d12[:, h:]
        return np.concatenate([g.ravel() for g in (one.T @ d1, d1.sum(0), two.T @ d2, d2.sum(0), both.T @ d3, d3.sum(0), shared.T @ out, out.sum(0))])

    def scored(self, df: DataFrame, keep: list[str], one: str, two: str, name: str = "score") -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = self.forward(_matrix(batch.column(len(keep))), _matrix(batch.column(len(keep) + 1)))[-1] if batch.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(p)], [*keep, name])

        kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
        return df.select(*keep, F.col(one).cast("array<double>"), F.col(two).cast("array<double>")).mapInArrow(run, f"{kinds}{name} double")

    def losses(self, spark) -> DataFrame:
        return spark.createDataFrame(self.history, "epoch int, train_loss double, held_out_loss double")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _pass(rows: DataFrame, model: FusionModel) -> np.ndarray:
    """(gradient, then loss and rows of both parts) summed over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(model.weights) + 4)
        for batch in batches:
            if batch.num_rows:
                one, two, y, held = _matrix(batch.column(0)), _matrix(batch.column(1)), batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
                p = np.clip(model.forward(one, two)[-1], 1e-12, 1 - 1e-12)
                loss = -(y * np.log(p) + (1 - y) * np.log(1 - p))
                learn = ~held
                total[:-4] += model.gradient(one[learn], two[learn], y[learn])
                total[-4:] += [loss[learn].sum(), learn.sum(), loss[held].sum(), held.sum()]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

    out = np.zeros(len(model.weights) + 4)
    for r in rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # a row for each weight
        out[r["i"]] = r["v"]
    return out


def train_fusion(df: DataFrame, one: str, two: str, label: str, held_out: str, hidden: int = 8, shared: int = 8, epochs: int = 100, rate: float = 0.02,
                 patience: int = 10, seed: int = 42) -> FusionModel:
    """Train on the rows that aren't held out (the boolean column `held_out`); `one` and `two` are arrays of numbers, each of
    one length. Rows with a null are left out. Without rows to learn from, the weights stay as they begin.
    """
    rows = df.select(F.col(one).cast("array<double>").alias("one"), F.col(two).cast("array<double>").alias("two"), F.col(label).cast("double").alias("y"), F.col(held_out).alias("held")).na.drop()
    rows = materialize(rows, "fusion_rows")
    first = rows.select(F.size("one"), F.size("two")).first()
    d1, d2 = tuple(first) if first else (1, 1)
    shapes = [(d1, hidden), (hidden,), (d2, hidden), (hidden,), (2 * hidden, shared), (shared,), (shared, 1), (1,)]
    rng = np.random.default_rng(seed)
    begin = [rng.normal(0, np.sqrt(2 / s[0]), s) if len(s) == 2 else np.full(s, 0.01) for s in shapes]
    model = FusionModel(shapes, np.concatenate([b.ravel() for b in begin]), [])
    best, kept, m, v = np.inf, model.weights, 0.0, 0.0
    for epoch in range(epochs):
        sums = _pass(rows, model)
        loss, n, held_loss, held = sums[-4:]
        model.history.append((epoch, float(loss / max(n, 1)), float(held_loss / max(held, 1))))
        watched = model.history[-1][2] if held else model.history[-1][1]
        if watched < best:
            best, kept, since = watched, model.weights, epoch
        elif epoch - since >= patience:
            break
        if not n:
            break
        step = sums[:-4] / n
        m, v = 0.9 * m + 0.1 * step, 0.999 * v + 0.001 * step * step  # Adam
        model.weights = model.weights - rate * (m / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(v / (1 - 0.999 ** (epoch + 1))) + 1e-8)
    model.weights = kept
    return model
