"""Prefix totals and mid-ranks within groups, without sorting a whole group in one task.

Rows are first reduced to distinct (group, value) with sums. A group's values are cut into bins at approximate quantiles,
so that no outlier crowds the rest into one bin; the bins' totals are accumulated over the bins (at most BINS rows per
group), the values within a bin by a window over that bin alone. Rows with null in a group column are a group as well.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of a group, a power of two, and the accuracy of the quantiles between them.
BINS, ACCURACY = 256, 2000


def prefix_totals(df: DataFrame, group: list[str], value: str, sums: dict[str, Column], bins: int = BINS, keep_bin: str | None = None) -> DataFrame:
    """One row per (group, value): the sums, before_<name>: the same sums over all smaller values of the group, and its bin if named."""
    distinct = df.groupBy(*group, value).agg(*[c.alias(n) for n, c in sums.items()])
    cuts = distinct.groupBy(*group).agg(F.percentile_approx(value, [i / bins for i in range(1, bins)], ACCURACY).alias("__cuts"))
    steps = F.array(*[F.lit(bins >> i) for i in range(1, bins.bit_length())])
    place = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.col(value) > F.get(F.col("__cuts"), at + step - 1), at + step).otherwise(at))  # binary search
    binned = join_groups(distinct, cuts, group).withColumn("__bin", place).drop("__cuts")
    totals = binned.groupBy(*group, "__bin").agg(*[F.sum(n).alias(f"__{n}") for n in sums])
    by_bin = Window.partitionBy(*group).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, "__bin", *[F.coalesce(F.sum(f"__{n}").over(by_bin), F.lit(0)).alias(f"__before_{n}") for n in sums])
    in_bin = Window.partitionBy(*group, "__bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    within = binned.select("*", *[F.coalesce(F.sum(n).over(in_bin), F.lit(0)).alias(f"__in_{n}") for n in sums])
    out = join_groups(within, totals, [*group, "__bin"])
    place = [F.col("__bin").alias(keep_bin)] if keep_bin else []
    return out.select(*group, value, *place, *sums, *[(F.col(f"__before_{n}") + F.col(f"__in_{n}")).alias(f"before_{n}") for n in sums])


def join_groups(df: DataFrame, per_group: DataFrame, group: list[str], how: str = "inner") -> DataFrame:
    """df with the columns of a table that has a row per group; nulls match. Without group columns that is a single row."""
    if not group:
        return df.crossJoin(F.broadcast(per_group))
    names = {c: f"__of_{i}" for i, c in enumerate(group)}
    on = reduce(and_, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    return df.join(per_group.withColumnsRenamed(names), on, how).drop(*names.values())


def mid_ranks(df: DataFrame, group: list[str], value: str, rank: str = "mid_rank", bins: int = BINS, keep_bin: str | None = None) -> DataFrame:
    """The rows of df with the 1-based rank of `value` in its group, and its bin if named; equal values share the mean of their ranks."""
    ranked = prefix_totals(df.filter(F.col(value).isNotNull()), group, value, {"__n": F.count(F.lit(1))}, bins, keep_bin)
    place = [keep_bin] if keep_bin else []
    ranked = ranked.select(*group, value, *place, (F.col("before___n") + (F.col("__n") + 1) / 2).alias(rank), F.col("__n").alias("tied"))
    return join_groups(df, ranked, [*group, value])
