"""Keyed operators: first and best rows, unions of arrays, splits by keys, replicates, masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by a total order, nulls in other columns kept."""
    ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("__rn = 1").drop("__rn")


def extreme_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], latest: bool = False) -> DataFrame:
    """The same by an aggregate that combines before the shuffle, for columns that can be ordered as they are."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    pick = F.max if latest else F.min
    best = df.groupBy(*keys).agg(pick(F.struct(*order, *rest)).alias("__b"))
    return best.select(*keys, *[F.col(f"__b.{c}").alias(c) for c in (*order, *rest)]).select(*df.columns)


def split_by_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """df with a boolean `inside`: whether its key is among the keys; one join instead of a semi and an anti join."""
    marked = keys.select(*on).distinct().withColumn("__in", F.lit(True))
    return df.join(marked, list(on), "left").withColumn("inside", F.coalesce("__in", F.lit(False))).drop("__in")


def ordered_union(a: Column, b: Column) -> Column:
    """Elements of a, then those of b that are new; nulls left out."""
    none = F.array().cast("array<string>")
    return F.array_compact(F.array_distinct(F.concat(F.coalesce(a, none), F.coalesce(b, none))))


def text_by_key(df: DataFrame, keys: Sequence[str], order: str, text: str, separator: str) -> Column:
    """Texts of a key in order, joined; an aggregate expression."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), separator)


def collapse_replicates(df: DataFrame, keys: Sequence[str], value: str, reason: str, order: str) -> DataFrame:
    """Mean and sample deviation of the numeric values of a key, with the first reason; other values are left out."""
    numeric = df.withColumn("__v", F.col(value).try_cast("double")).filter("__v is not null")
    return numeric.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_replicates"), F.avg("__v").alias("probability"), F.stddev_samp("__v").alias("std_probability"), F.min_by(reason, order).alias("reason"))


def pending(work: DataFrame, done: DataFrame, on: Sequence[str], valid: Column) -> DataFrame:
    """Work without a valid result yet."""
    return work.join(done.filter(valid).select(*on), list(on), "left_anti")


def mask_outside(df: DataFrame, keep: DataFrame, on: Sequence[str], columns: Sequence[str], mask=-1) -> DataFrame:
    """Values of rows whose key isn't to be kept become the mask."""
    return split_by_keys(df, keep, on).withColumns({c: F.when(F.col("inside"), F.col(c)).otherwise(mask) for c in columns}).drop("inside")


def top_and_other(counts: DataFrame, group: Sequence[str], name: str, n: str, k: int, other: str = "Other") -> DataFrame:
    """Per group the k most frequent names (ties by name) and the sum of the rest."""
    order = Window.partitionBy(*group).orderBy(F.col(n).desc(), F.col(name))
    ranked = counts.withColumn("__name", F.when(F.row_number().over(order) <= k, F.col(name)).otherwise(other))
    return ranked.groupBy(*group, F.col("__name").alias(name)).agg(F.sum(n).alias(n))


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df, or an error at run time where a key occurs twice."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumn("__n", n).filter(F.when(F.col("__n") > 1, F.raise_error(F.lit(f"repeated key {', '.join(keys)}")).cast("boolean")).otherwise(True)).drop("__n")


def look_up(table: DataFrame, key: str, value: object, columns: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The columns of the first row (by `order`) whose key is the value: at most one row, found by a filter that the scan can push down."""
    return table.filter(F.col(key).eqNullSafe(F.lit(value))).orderBy(*order).limit(1).select(*columns)


def columns_by_priority(columns: Sequence[str], last: Sequence[str], very_last: str) -> list[str]:
    """Names in their order, then those of `last` as they are listed there, then those that contain `very_last` (any case)."""
    late = [c for c in columns if c not in last and very_last.lower() in c.lower()]
    plain = [c for c in columns if c not in last and c not in late]
    return [*sorted(plain), *[c for c in last if c in columns], *sorted(late)]
