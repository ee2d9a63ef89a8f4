"""Report tables: curves over steps, deltas between phases, ribbons, baselines, regressions per draw, tallies."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def loss_curve(log: DataFrame, run: Sequence[str], step: str, epoch: str, values: Sequence[str]) -> DataFrame:
    """Per run and whole epoch: the mean and maximum over steps, each step giving its first known value by epoch."""
    per_step = log.groupBy(*run, step).agg(F.min(epoch).alias("__e"), *[F.min_by(v, F.when(F.col(v).isNotNull(), F.col(epoch))).alias(v) for v in values])
    return per_step.groupBy(*run, F.floor("__e").alias("epoch")).agg(*[f.alias(f"{n}_{v}") for v in values for n, f in (("mean", F.avg(v)), ("max", F.max(v)))])


def phase_deltas(df: DataFrame, keys: Sequence[str], phase: str, before: str, after: str, metrics: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The mean of (after - before) per group of `by`, as rows (by, metric, delta); keys with both phases count."""
    wide = df.groupBy(*keys).agg(*[F.max(F.when(F.col(phase) == p, F.col(m))).alias(f"{m}_{p}") for m in metrics for p in (before, after)])
    gaps = wide.select(*keys, *[(F.col(f"{m}_{after}") - F.col(f"{m}_{before}")).alias(m) for m in metrics])
    return gaps.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics]).unpivot(list(by), list(metrics), "metric", "delta")


def with_baseline(df: DataFrame, keys: Sequence[str], method: str, baseline: str, value: str) -> DataFrame:
    """Each row beside its key's value of the baseline method, and whether it is above it."""
    base = df.filter(F.col(method) == baseline).groupBy(*keys).agg(F.max(value).alias("baseline"))
    return df.join(base, list(keys), "left").withColumn("is_better", F.col(value) > F.col("baseline"))


def significance_tally(df: DataFrame, group: Sequence[str], item: str, better: Column, p: Column, level: float = 0.05) -> DataFrame:
    """How many different items are significantly better, significantly worse, and there at all."""
    sure = p < level
    return df.groupBy(*group).agg(F.countDistinct(F.when(sure & better, F.col(item))).alias("n_better"), F.countDistinct(F.when(sure & ~better, F.col(item))).alias("n_worse"), F.countDistinct(item).alias("n"))


def fitted_ribbon(reps: DataFrame, rep: str, x: str, y: str, grid: Sequence[float], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Lines fitted in each replicate, on a grid of x: median and percentiles of their heights."""
    lines = reps.groupBy(rep).agg(F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"))
    at = lines.withColumn("x", F.explode(F.array(*[F.lit(float(g)) for g in grid]))).withColumn("height", F.col("a") + F.col("b") * F.col("x"))
    return at.groupBy("x").agg(*[F.percentile("height", F.lit(q)).alias(n) for n, q in (("low", low), ("middle", 0.5), ("high", high))])


def regress_per_draw(draws: DataFrame, draw: str, unit: str, value: str, units: DataFrame, predictors: Sequence[str]) -> DataFrame:
    """Least squares of the units' values on their predictors in each draw: draw, term, coefficient.

    A draw holds one row per unit and is solved by normal equations, whose sums are aggregated before anything is
    brought together; only the small matrix of a draw reaches Python.
    """
    terms = ["constant", *predictors]
    rows = draws.join(units.select(unit, *predictors), unit).withColumn("constant", F.lit(1.0))
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"s_{i}_{j}") for i, a in enumerate(terms) for j, b in enumerate(terms)]
    per_draw = rows.groupBy(draw).agg(*sums, *[F.sum(F.col(a) * F.col(value)).alias(f"t_{i}") for i, a in enumerate(terms)])
    k = len(terms)

    def solve(frames):
        for f in frames:
            left = f[[f"s_{i}_{j}" for i in range(k) for j in range(k)]].to_numpy(float).reshape(-1, k, k)
            found = np.einsum("nij,nj->ni", np.linalg.pinv(left), f[[f"t_{i}" for i in range(k)]].to_numpy(float))
            yield pd.DataFrame({draw: np.repeat(f[draw].to_numpy(), k), "term": terms * len(f), "coefficient": found.ravel()})

    return per_draw.mapInPandas(solve, f"{draw} {draws.schema[draw].dataType.simpleString()}, term string, coefficient double")


def posterior_summary(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*group).agg(*[F.percentile(value, F.lit(q)).alias(n) for n, q in (("median", 0.5), ("low", 0.025), ("high", 0.975))])


def prevalence_parts(share: Column, prevalence: Column, whole: Column) -> tuple[Column, Column]:
    """A subgroup's part of the whole's prevalence, and the rest, not below 0."""
    part = share * prevalence
    return part, F.greatest(whole - part, F.lit(0.0))


def set_where(df: DataFrame, match: dict[str, object], columns: Sequence[str], value) -> DataFrame:
    """Columns set to a value in the rows that match all of a tuple."""
    hit = F.lit(True)
    for c, v in match.items():
        hit = hit & F.col(c).eqNullSafe(F.lit(v))
    return df.withColumns({c: F.when(hit, F.lit(value)).otherwise(F.col(c)) for c in columns})


def columns_like(df: DataFrame, contains: Sequence[str] = (), starts: Sequence[str] = (), without: Sequence[str] = ()) -> list[str]:
    """Names that contain or start with one of the parts, and contain none of `without`."""
    picked = [c for c in df.columns if any(p in c for p in contains) or any(c.startswith(s) for s in starts)]
    return [c for c in picked if not any(w in c for w in without)]


def rename_by_rules(df: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Each column whose name holds a rule's first part has it replaced by the second; the first rule that fits counts."""
    new = {}
    for c in df.columns:
        for old, to in rules:
            if old in c:
                new[c] = c.replace(old, to)
                break
    return df.withColumnsRenamed(new)
