"""Metrics of binary predictions as grouped aggregates: no task holds a group."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.ranks import join_groups, prefix_totals

_EPSILON = 2.220446049250313e-16
#: Bins of scores per group in a bootstrap, rows whose draws are held at once, and (group, score) sums that a task holds.
BOOT_BINS, ROWS_AT_ONCE, SUMS_HELD = 64, 2000, 4096


def auc(df: DataFrame, group: list[str], label: str, score: str, weight: str | None = None) -> DataFrame:
    """ROC AUC per group, ties counting one half; null where a group has one class only. Rows with nulls are left out."""
    w = F.col(weight) if weight else F.lit(1)
    known = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    at = prefix_totals(known, group, score, {"pos": F.sum(w * F.col(label).cast("long")), "neg": F.sum(w * (1 - F.col(label).cast("long")))})
    sums = at.groupBy(*group).agg(F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return sums.select(*group, "n_pos", "n_neg", (F.col("u") / F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0))).alias("auc"))


def average_precision(df: DataFrame, group: list[str], label: str, score: str) -> DataFrame:
    """Area under the precision-recall steps, from the highest score down; equal scores are one step."""
    at = prefix_totals(df.withColumn("__down", -F.col(score)), group, "__down", {"pos": F.sum(F.col(label).cast("long")), "n": F.count(F.lit(1))})
    gain = F.col("pos") * (F.col("before_pos") + F.col("pos")) / (F.col("before_n") + F.col("n"))
    return at.groupBy(*group).agg((F.sum(gain) / F.nullif(F.sum("pos"), F.lit(0))).alias("ap"))


def log_loss(label: Column, score: Column) -> Column:
    """Mean negative log-likelihood, scores held off 0 and 1."""
    p = F.least(F.greatest(score, F.lit(_EPSILON)), F.lit(1 - _EPSILON))
    return -F.avg(label * F.log(p) + (1 - label) * F.log(1 - p))


def confusion(label: Column, predicted: Column) -> dict[str, Column]:
    """Aggregates tp, fp, fn, tn and the rates of fairness reports."""
    tp, fp, fn, tn = (F.count_if((predicted == p) & (label == y)) for p, y in ((1, 1), (1, 0), (0, 1), (0, 0)))
    return {
        "tp": tp, "fp": fp, "fn": fn, "tn": tn,
        "demographic_parity": F.avg(predicted.cast("double")), "equal_opportunity": tp / F.nullif(tp + fn, F.lit(0)),
        "false_positive_rate": fp / F.nullif(fp + tn, F.lit(0)), "predictive_parity": tp / F.nullif(tp + fp, F.lit(0)),
    }


def concordance(x: str, y: str) -> Column:
    """Concordance correlation coefficient with population moments."""
    gap = F.avg(x) - F.avg(y)
    return 2 * F.covar_pop(x, y) / F.nullif(F.var_pop(x) + F.var_pop(y) + gap * gap, F.lit(0.0))


#: Modulus and multipliers of the draws, and the cumulative Poisson(1) probabilities they are held against.
PRIME, KEY_FACTOR, REP_FACTOR, SEED_FACTOR = 2_147_483_647, 48_271, 69_621, 7_919
POISSON_STEPS = (0.367879441171, 0.735758882343, 0.919698602929, 0.981011843124, 0.996340153173, 0.999405815182, 0.999916758850, 0.999989750803)


def key_number(key: Column) -> Column:
    """A number below PRIME from a key of any type."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 13), 16, 10).cast("long") % PRIME


def draws(key: np.ndarray, rep: np.ndarray, seed: int) -> np.ndarray:
    """Poisson(1) numbers for key numbers and replicates: a hash with two squarings, so that keys keep no relation over replicates."""
    x = (key * KEY_FACTOR + (rep + 1) * REP_FACTOR + seed * SEED_FACTOR) % PRIME
    x = (x * x + key) % PRIME
    x = (x * x + rep) % PRIME
    return np.searchsorted(POISSON_STEPS, x / PRIME, side="right").astype(np.int32)


def draws_sql(rows: str, key: str, reps: int, seed: int) -> str:
    """The same draws as a table (key, rep, w) in DuckDB's SQL, from a table `rows` with the column `key`."""
    steps = " + ".join(f"(x / {PRIME}::DOUBLE >= {s})::INT" for s in POISSON_STEPS)
    first = f"SELECT {key}, k, rep, (k * {KEY_FACTOR} + (rep + 1) * {REP_FACTOR} + {seed * SEED_FACTOR}) % {PRIME} AS x FROM (SELECT DISTINCT {key}, ('0x' || substr(md5({key}::VARCHAR), 1, 13))::BIGINT % {PRIME} AS k FROM {rows}), (SELECT unnest(range(0, {reps})) AS rep)"
    second = f"SELECT {key}, k, rep, (x * x + k) % {PRIME} AS x FROM ({first})"
    return f"SELECT {key}, rep, {steps} AS w FROM (SELECT {key}, rep, (x * x + rep) % {PRIME} AS x FROM ({second}))"


def bootstrap_counts(df: DataFrame, key: str, reps: int, seed: int = 0) -> DataFrame:
    """Each row once per replicate with a Poisson(1) number of draws `w` from a hash of (key, replicate); zeros are left out.

    Rows with the same key get the same draws, so methods compared on the same patients are resampled together. Nothing
    is counted or ordered, so a replicate costs one pass and the plan is the same at any size.
    """
    rows = df.withColumn("__k", key_number(F.col(key))).withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long"))))
    rows = rows.withColumn("__x", (F.col("__k") * KEY_FACTOR + (F.col("rep") + 1) * REP_FACTOR + seed * SEED_FACTOR) % PRIME)
    rows = rows.withColumn("__x", (F.col("__x") * F.col("__x") + F.col("__k")) % PRIME)
    rows = rows.withColumn("__x", (F.col("__x") * F.col("__x") + F.col("rep")) % PRIME)
    u = F.col("__x") / PRIME
    w = reduce(add, [(u >= s).cast("int") for s in POISSON_STEPS])
    return rows.withColumn("w", w).filter("w > 0").drop("__k", "__x")


def bootstrap_sums(df: DataFrame, group: list[str], key: str, sums: dict[str, Column], reps: int, seed: int = 0) -> DataFrame:
    """(group, rep, sums) of Poisson bootstrap replicates: each sum weighed by the draws of bootstrap_counts().

    A row is not repeated for each replicate: a task's rows become one array of `reps` sums for each group and sum, by a
    matrix product with the drawn numbers, and the tasks' arrays are added up. Null terms count as 0.
    """
    rows = df.select(*group, key_number(F.col(key)).alias("k"), *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in sums.items()])
    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.select(*group).schema.fields)
    kinds, names, number = ", ".join(f"{n} array<double>" for n in sums), list(sums), np.arange(reps, dtype=np.int64)

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.iloc[lo : lo + ROWS_AT_ONCE]
                keys, place = np.unique(part["k"].to_numpy(), return_inverse=True)
                w = draws(keys[:, None], number[None, :], seed)[place].astype(np.float64)
                of = part.groupby(group, dropna=False, sort=False).ngroup().to_numpy() if group else np.zeros(len(part), np.int64)
                first = np.unique(of, return_index=True)[1]
                values = part[names].to_numpy(np.float64)
                out = part.iloc[first][group].reset_index(drop=True)
                found = [values[of == g].T @ w[of == g] for g in range(len(first))]
                yield out.assign(**{n: [f[i] for f in found] for i, n in enumerate(names)})

    def whole(_: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"rep": number, **{n: np.stack(parts[n].to_numpy()).sum(axis=0) for n in names}})
        return out.assign(**{c: parts[c].iloc[0] for c in group})[[*group, "rep", *names]]

    partial = rows.mapInPandas(drawn, f"{fields}{kinds}")
    # The batches of a task are added before anything is shuffled by group alone.
    partial = partial.groupBy(*group, F.pmod(F.spark_partition_id(), F.lit(64)).alias("__part")).agg(*[F.collect_list(n).alias(n) for n in names])
    added = [F.aggregate(F.slice(n, 2, F.greatest(F.size(n) - 1, F.lit(0))), F.col(n)[0], lambda a, b: F.zip_with(a, b, lambda x, y: x + y)).alias(n) for n in names]
    return partial.select(*group, *added).groupBy(*group).applyInPandas(whole, f"{fields}rep long, {', '.join(f'{n} double' for n in names)}")


def bootstrap_auc(df: DataFrame, group: list[str], key: str, label: str, score: str, reps: int, seed: int = 0) -> DataFrame:
    """(group, rep, auc) of Poisson bootstrap replicates; the draws are those of bootstrap_counts().

    A row is not repeated for each replicate: a task's rows become, per (group, score), two arrays with the drawn
    positives and negatives of every replicate (sent on before the task's end only where they are more than SUMS_HELD).
    These are added up within bins of scores (at quantiles, as in prefix_totals), and a group's few bins give the areas
    by running sums over whole arrays. Rows are dealt to all cores by key, so that a key's draws are made once.
    """
    known = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull()).select(*group, key_number(F.col(key)).alias("k"), F.col(label).cast("int").alias("y"), F.col(score).cast("double").alias("s"))
    cuts = known.groupBy(*group).agg(F.percentile_approx("s", [i / BOOT_BINS for i in range(1, BOOT_BINS)], 1000).alias("cuts"))
    dealt = known.repartition(df.sparkSession.sparkContext.defaultParallelism, "k")
    rows = join_groups(dealt, cuts, group).withColumn("bin", F.size(F.filter("cuts", lambda c: c < F.col("s")))).drop("cuts")
    schema = known.select(*group).schema
    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in schema.fields)
    number = np.arange(reps, dtype=np.int64)

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [*group, "bin", "s"]
        slots: dict[tuple, int] = {}
        heads: list[pd.DataFrame] = []
        held = np.zeros((2, SUMS_HELD, reps), np.int32)

        def send() -> Iterator[pd.DataFrame]:
            out = pd.concat(heads) if heads else pd.DataFrame()
            for lo in range(0, len(out), 256):
                piece = out.iloc[lo : lo + 256]
                yield piece.assign(pos=list(held[0, lo : lo + len(piece)]), neg=list(held[1, lo : lo + len(piece)]))

        for batch in batches:
            for lo in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.iloc[lo : lo + ROWS_AT_ONCE]
                keys, place = np.unique(part["k"].to_numpy(), return_inverse=True)
                w = draws(keys[:, None], number[None, :], seed)[place]
                y = part["y"].to_numpy()[:, None]
                at = part.groupby(names, dropna=False, sort=False).ngroup().to_numpy()
                order = np.argsort(at, kind="stable")
                first = np.flatnonzero(np.append(True, np.diff(at[order]) > 0))
                if len(slots) + len(first) > SUMS_HELD:
                    yield from send()
                    slots, heads, held = {}, [], np.zeros((2, SUMS_HELD, reps), np.int32)
                found, known_before = part.iloc[order[first]][names], len(slots)
                slot = np.array([slots.setdefault(t, len(slots)) for t in found.itertuples(index=False, name=None)])
                heads.append(found[slot >= known_before])
                for i, side in enumerate((y, 1 - y)):
                    held[i, slot] += np.add.reduceat((w * side)[order], first, axis=0).astype(np.int32)
        yield from send()

    def in_bin(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("s")
        scores, place = np.unique(rows["s"].to_numpy(), return_inverse=True)
        pos, neg = (np.zeros((len(scores), reps)) for _ in range(2))
        np.add.at(pos, place, np.stack(rows["pos"].to_numpy()))
        np.add.at(neg, place, np.stack(rows["neg"].to_numpy()))
        below = np.cumsum(neg, axis=0) - neg
        return rows.iloc[:1][[*group, "bin"]].assign(pos=[pos.sum(axis=0)], neg=[neg.sum(axis=0)], area=[(pos * (below + neg / 2)).sum(axis=0)])

    def whole(_: tuple, bins: pd.DataFrame) -> pd.DataFrame:
        bins = bins.sort_values("bin")
        pos, neg, area = (np.stack(bins[c].to_numpy()) for c in ("pos", "neg", "area"))
        total = (area + pos * (np.cumsum(neg, axis=0) - neg)).sum(axis=0)
        pairs = pos.sum(axis=0) * neg.sum(axis=0)
        out = pd.DataFrame({"rep": number, "auc": np.where(pairs > 0, total / np.where(pairs > 0, pairs, 1), np.nan)})
        return out.assign(**{c: bins[c].iloc[0] for c in group})[[*group, "rep", "auc"]]

    counted = rows.mapInPandas(drawn, f"{fields}bin int, s double, pos array<int>, neg array<int>")
    sums = counted.groupBy(*group, "bin").applyInPandas(in_bin, f"{fields}bin int, pos array<double>, neg array<double>, area array<double>")
    found = sums.groupBy(*group).applyInPandas(whole, f"{fields}rep long, auc double")
    return found.withColumn("auc", F.nanvl("auc", F.lit(None).cast("double")))
