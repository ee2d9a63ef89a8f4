"""A linear model with a random intercept for each group: y = X b + u(group) + e, from sufficient statistics.

Rows are aggregated to sums by group, and those to sums by group size: the restricted likelihood depends on nothing else,
as all groups of one size enter it alike. So whatever the number of rows and groups, the driver sees a table with a row
for each size that occurs. There the ratio of variances is one-dimensional: REML takes the best point, and the posterior
(flat on the coefficients and on the intraclass correlation, 1/variance on the residual) is drawn from exactly, on a grid
of the correlation, without a chain. Group effects are drawn beside their groups, as Spark rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.sources.work import materialize

GRID, DRAWS, MAX_LEVELS = 400, 2000, 1000


def with_indicators(df: DataFrame, column: str, most: int = MAX_LEVELS) -> tuple[DataFrame, list[str]]:
    """0/1 columns for all levels of a category but the first; null is a level of its own. Over `most` levels are an error."""
    levels = [r[0] for r in df.select(column).distinct().orderBy(F.col(column).asc_nulls_last()).limit(most + 1).collect()]
    if len(levels) > most:
        raise ValueError(f"{column} has over {most} levels")
    names = {f"{column}_{'null' if v is None else v}": F.col(column).eqNullSafe(F.lit(v)).cast("double") for v in levels[1:]}
    return df.withColumns(names), list(names)


@dataclass
class Fit:
    """Sums of the model, by group size, and the mean that was taken off y. `terms` are the columns of X, the constant first."""

    terms: list[str]
    shift: float
    rows: int
    groups: DataFrame  # a row for each group: its name, n, and sums s (of X) and t (of y)
    size: np.ndarray
    count: np.ndarray
    ss: np.ndarray
    st: np.ndarray
    tt: np.ndarray
    xx: np.ndarray
    xy: np.ndarray
    yy: float

    def solved(self, ratio: float) -> tuple[np.ndarray, np.ndarray, float]:
        """(A, b, Q): X'MX, the coefficients and the residual sum of squares, where M^-1 is 1 + ratio * J in each group."""
        w = ratio / (1 + ratio * self.size)
        a = self.xx - np.einsum("c,cij->ij", w, self.ss)
        right = self.xy - w @ self.st
        b = np.linalg.solve(a, right)
        return a, b, float(self.yy - w @ self.tt - right @ b)

    def criterion(self, icc: float) -> float:
        """Minus twice the restricted log-likelihood, up to a constant, with the residual variance at its best."""
        ratio = icc / (1 - icc)
        a, _, q = self.solved(ratio)
        return float((self.rows - len(self.terms)) * np.log(max(q, 1e-300)) + self.count @ np.log1p(ratio * self.size) + np.linalg.slogdet(a)[1])

    def reml(self) -> dict[str, float]:
        """icc, between and residual variance and the coefficients at the maximum of the restricted likelihood."""
        low, high = 0.0, 1 - 1e-9
        for _ in range(4):  # finer and finer grids about the best point
            grid = np.linspace(low, high, 65)
            best = int(np.argmin([self.criterion(x) for x in grid]))
            low, high = grid[max(best - 1, 0)], grid[min(best + 1, 64)]
        icc = float(grid[best])
        _, b, q = self.solved(icc / (1 - icc))
        residual = q / (self.rows - len(self.terms))
        return {"icc": icc, "between_variance": residual * icc / (1 - icc), "residual_variance": residual} | self._named(b)

    def _named(self, b: np.ndarray) -> dict[str, float]:
        return {t: float(v + (self.shift if i == 0 else 0.0)) for i, (t, v) in enumerate(zip(self.terms, b, strict=True))}

    def posterior(self, draws: int = DRAWS, seed: int = 42) -> np.ndarray:
        """Draws of (icc, residual variance, coefficients), one a row."""
        rng = np.random.default_rng(seed)
        grid = np.linspace(0, 1 - 1e-6, GRID)
        for _ in range(2):  # the second grid covers where the density is
            log = -0.5 * np.array([self.criterion(x) for x in grid])
            density = np.exp(log - log.max())
            dense = np.flatnonzero(density > 1e-10)
            low, high = grid[max(dense[0] - 1, 0)], grid[min(dense[-1] + 1, GRID - 1)]
            mass = np.concatenate([[0.0], np.cumsum((density[1:] + density[:-1]) / 2)])
            known, grid = (grid, mass / mass[-1]), np.linspace(low, high, GRID)
        icc = np.interp(rng.random(draws), known[1], known[0])
        out = np.zeros((draws, 2 + len(self.terms)))
        for i, x in enumerate(icc):
            a, b, q = self.solved(x / (1 - x))
            residual = q / 2 / rng.gamma((self.rows - len(self.terms)) / 2)
            out[i] = [x, residual, *(b + np.linalg.cholesky(np.linalg.inv(a) * residual) @ rng.standard_normal(len(b)))]
        return out

    def draw_table(self, posterior: np.ndarray) -> DataFrame:
        """draw, icc, between_variance, residual_variance and a column for each term."""
        rows = [(i, float(r[0]), float(r[1] * r[0] / (1 - r[0])), float(r[1]), *self._named(r[2:]).values()) for i, r in enumerate(posterior)]
        kinds = "draw long, icc double, between_variance double, residual_variance double, " + ", ".join(f"`{t}` double" for t in self.terms)
        return self.groups.sparkSession.createDataFrame(rows, kinds)

    def group_draws(self, posterior: np.ndarray, seed: int = 42) -> DataFrame:
        """A row for each group, with its effect in each draw as an array; the noise follows from a hash of the group."""
        icc, residual, b = posterior[:, 0], posterior[:, 1], posterior[:, 2:]
        ratio = icc / (1 - icc)

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, t, keys = (batch.column(c).to_numpy() for c in ("n", "t", "__key"))
                s = batch.column("s").flatten().to_numpy().reshape(len(n), -1)
                shrink = ratio / (1 + np.outer(n, ratio))
                effect = shrink * (t[:, None] - s @ b.T)
                noise = np.stack([np.random.default_rng(int(k) & (1 << 63) - 1).standard_normal(len(ratio)) for k in keys]) if len(keys) else effect
                effect += noise * np.sqrt(residual * shrink)
                offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * len(ratio))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(effect.ravel()))], [batch.schema.names[0], "effects"])

        group = self.groups.columns[0]
        keyed = self.groups.withColumn("__key", F.xxhash64(F.lit(seed), group))
        return keyed.mapInArrow(draw, f"`{group}` {self.groups.schema[0].dataType.simpleString()}, effects array<double>")


def random_intercept(df: DataFrame, group: str, y: str, terms: Sequence[str] = ()) -> Fit:
    """The sums of y = constant + terms + an intercept for each group. Rows with a null in any of the columns are left out."""
    columns = [group, y, *terms]
    rows = df.select(*columns).na.drop()
    shift = rows.agg(F.avg(y)).first()[0] or 0.0
    xs = [F.lit(1.0), *[F.col(t).cast("double") for t in terms]]
    target = F.col(y).cast("double") - shift
    p = len(xs)
    sums = [F.count(F.lit(1)).alias("n"), F.array(*[F.sum(x) for x in xs]).alias("s"), F.sum(target).alias("t")]
    groups = materialize(rows.groupBy(group).agg(*sums), "mixed_groups")
    cell = lambda i: F.col("s")[i]
    products = [F.sum(cell(i) * cell(j)).alias(f"ss_{i}_{j}") for i in range(p) for j in range(p)] + [F.sum(cell(i) * F.col("t")).alias(f"st_{i}") for i in range(p)]
    sizes = groups.groupBy("n").agg(F.count(F.lit(1)).alias("count"), F.sum(F.col("t") * F.col("t")).alias("tt"), *products).orderBy("n").collect()  # a row for each size
    whole = rows.agg(*[F.sum(a * b).alias(f"xx_{i}_{j}") for i, a in enumerate(xs) for j, b in enumerate(xs)], *[F.sum(a * target).alias(f"xy_{i}") for i, a in enumerate(xs)], F.sum(target * target).alias("yy")).first()
    number = lambda name, *shape: np.array([[r[f"{name}{''.join(f'_{k}' for k in at)}"] for at in np.ndindex(*shape)] for r in sizes], float).reshape(len(sizes), *shape)
    return Fit(
        ["constant", *terms], shift, sum(r["n"] * r["count"] for r in sizes), groups, number("n"), number("count"), number("ss", p, p), number("st", p), number("tt"),
        np.array([[whole[f"xx_{i}_{j}"] or 0.0 for j in range(p)] for i in range(p)]), np.array([whole[f"xy_{i}"] or 0.0 for i in range(p)]), whole["yy"] or 0.0)
