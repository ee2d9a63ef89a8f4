"""Rows that may count for a target by a threshold of another column, and intervals over parts of the evaluation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limit:
    """`value` must be at least the threshold, or at most, for a row to count for the target."""

    target: str
    value: str
    at_least: bool
    threshold: float

    def met(self) -> Column:
        """False where the value is null."""
        value = F.col(self.value)
        return F.coalesce(value >= self.threshold if self.at_least else value <= self.threshold, F.lit(False))

    def observed(self, missing: int) -> Column:
        """A null target isn't the mark of a missing one: it counts as observed."""
        return ~F.col(self.target).eqNullSafe(F.lit(missing))


def eligible_keys(rows: DataFrame, keys: Sequence[str], limits: Sequence[Limit], missing: int = -1) -> DataFrame:
    """(keys, target) for each target that is observed in a row and whose limit the row meets; one scan for all targets.

    A key that repeats is given once. A target with several limits takes rows that meet one of them.
    """
    names = [F.when(limit.observed(missing) & limit.met(), F.lit(limit.target)) for limit in limits]
    found = F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")
    return rows.select(*keys, F.explode(found).alias("target")).distinct()


def eligibility(rows: DataFrame, limits: Sequence[Limit], missing: int = -1) -> DataFrame:
    """For each limit the rows with an observed target, those that the limit drops, and the rest; 0 for an empty table."""
    counts = []
    for i, limit in enumerate(limits):
        seen = limit.observed(missing)
        counts += [F.count_if(seen).alias(f"seen_{i}"), F.count_if(seen & limit.met()).alias(f"kept_{i}")]
    entry = [F.struct(F.lit(x.target).alias("target"), F.lit(x.value).alias("value"), F.lit(">=" if x.at_least else "<=").alias("criterion"), F.lit(float(x.threshold)).alias("threshold"),
                      F.col(f"seen_{i}").alias("n_before"), (F.col(f"seen_{i}") - F.col(f"kept_{i}")).alias("n_dropped"), F.col(f"kept_{i}").alias("n_after")) for i, x in enumerate(limits)]
    return rows.agg(*counts).select(F.explode(F.array(*entry)).alias("e")).select("e.*")


def in_parts(rows: DataFrame, parts: Mapping[str, Column], name: str = "part") -> DataFrame:
    """A row for each part whose condition holds; rows of no part are left out, a null condition is false."""
    return rows.withColumn(name, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in parts.items()]))))


def with_differences(values: DataFrame, group: Sequence[str], part: str, value: str, parts: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(group, part, value) with rows `a_minus_b` for the pairs of parts; null where one side is missing."""
    wide = values.groupBy(*group).pivot(part, list(parts)).agg(F.max(value))
    gaps = {f"{a}_minus_{b}": F.col(a) - F.col(b) for a, b in pairs}
    return wide.select(*group, *parts, *[c.alias(n) for n, c in gaps.items()]).unpivot(list(group), [*parts, *gaps], part, value)
