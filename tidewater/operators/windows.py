"""Window operators: scores within groups, interleaving, budgets, weekly rows, balanced parts."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.ranks import join_groups, prefix_totals
from tidewater.sources.work import materialize

MAX_CLASSES = 1_000_000


def with_group_stats(df: DataFrame, group: Sequence[str], stats: dict[str, Column]) -> DataFrame:
    """Aggregates of each group beside its rows. They combine before the shuffle and are joined back, so that a hot group
    is no single task, as it would be in a window. Rows with null in a group column are a group as well.
    """
    if not group:
        return df.crossJoin(F.broadcast(df.agg(*[c.alias(n) for n, c in stats.items()])))
    return join_groups(df, df.groupBy(*group).agg(*[c.alias(n) for n, c in stats.items()]), list(group))


def zscore(df: DataFrame, group: Sequence[str], value: str, out: str) -> DataFrame:
    """(value - mean) / sample deviation within the group; 0 where that is 0 or unknown."""
    stats = with_group_stats(df, group, {"__m": F.avg(value), "__s": F.stddev_samp(value)})
    return stats.withColumn(out, F.when(F.coalesce(F.col("__s"), F.lit(0.0)) == 0, 0.0).otherwise((F.col(value) - F.col("__m")) / F.nullif(F.col("__s"), F.lit(0.0)))).drop("__m", "__s")


def interleave(df: DataFrame, label: str, order: Sequence[Column], group: Sequence[str] = ()) -> DataFrame:
    """Position of each row when labels 1 and 0 alternate, 1 first, with the longer side's rest at the end."""
    rn = F.row_number().over(Window.partitionBy(*group, label).orderBy(*order))
    least = {"__ones": F.count_if(F.col(label) == 1), "__zeros": F.count_if(F.col(label) == 0)}
    ranked = with_group_stats(df.withColumn("__rn", rn), group, least).withColumn("__both", F.least("__ones", "__zeros"))
    at = F.when(F.col("__rn") <= F.col("__both"), 2 * F.col("__rn") - F.col(label)).otherwise(F.col("__both") + F.col("__rn"))
    return ranked.withColumn("position", at.cast("long")).drop("__rn", "__ones", "__zeros", "__both")


def budget_prefix(df: DataFrame, group: Sequence[str], order: str, cost: Column, budget: float, most: int | None = None) -> DataFrame:
    """The longest prefix of each group whose running cost stays below the budget; stops at the first row that doesn't fit.

    `order` is unique within a group; a null cost counts as 0. Running costs come from totals over bins, so that no group
    is sorted in one task.
    """
    sums = {"__cost": F.sum(F.coalesce(cost, F.lit(0))), "__n": F.count(F.lit(1))}
    run = prefix_totals(df, list(group), order, sums).withColumn("running_cost", F.col("before___cost") + F.col("__cost"))
    stop = run.filter(F.col("running_cost") >= budget).groupBy(*group).agg(F.min(order).alias("__stop"))
    kept = join_groups(run, stop, list(group), "left").filter(F.col("__stop").isNull() | (F.col(order) < F.col("__stop")))
    kept = kept if most is None else kept.filter(F.col("before___n") < most)
    return join_groups(df, kept.select(*group, order, "running_cost"), [*group, order])


def first_rows(df: DataFrame, group: Sequence[str], key: str, order: Sequence[Column], k: int, parts: int = 64) -> DataFrame:
    """The first k rows of each group: first within parts of the group by a hash of the key, then among those."""
    in_part = Window.partitionBy(*group, F.pmod(F.xxhash64(key), F.lit(parts))).orderBy(*order)
    few = df.withColumn("__rn", F.row_number().over(in_part)).filter(F.col("__rn") <= k)
    ranked = few.withColumn("__rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col("__rn") <= k).drop("__rn")


def factorise(df: DataFrame, value: str, order: str, out: str) -> DataFrame:
    """A dense id of each distinct value, by first appearance.

    The distinct values' places come from a count of earlier first appearances, taken from range-partitioned counts, not
    from a window over all of them.
    """
    first = df.groupBy(value).agg(F.min(order).alias("__first"))
    place = prefix_totals(first, [], "__first", {"__n": F.count(F.lit(1))}).select("__first", F.col("before___n").alias(out))
    return df.join(first.join(place, "__first").select(value, out), value)


def change_since_last(df: DataFrame, key: str, order: Sequence[str], value: str, out: str) -> DataFrame:
    return df.withColumn(out, F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(*order)))


def one_per_week(df: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """The first row of each key and ISO week."""
    best = df.groupBy(key, F.date_trunc("week", time).cast("timestamp_ntz").alias("week")).agg(F.min(F.struct(time, tie, F.struct(*df.columns).alias("__all"))).alias("__b"))
    return best.select("week", "__b.__all.*")


def contiguous_parts(df: DataFrame, order: str, n: int, out: str = "part") -> DataFrame:
    """n parts that follow each other in order, the first count % n of them longer by one; places by range-wise counts."""
    place = prefix_totals(df, [], order, {"__n": F.count(F.lit(1))}).select(order, F.col("before___n").alias("__i"))
    rows = df.join(place, order).crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("__all"))))
    size, extra = F.floor(F.col("__all") / n), F.col("__all") % n
    at = F.when(F.col("__i") < extra * (size + 1), F.floor(F.col("__i") / (size + 1))).otherwise(extra + F.floor((F.col("__i") - extra * (size + 1)) / F.greatest(size, F.lit(1))))
    return rows.withColumn(out, at.cast("int")).drop("__i", "__all")


def _level_shares(loads: list[float], weight: float, rows: int) -> list[int]:
    """Rows that each part takes until all have reached the highest level for which `rows` rows are enough."""
    filled = lambda level: [max(0, math.ceil((level - x) / weight)) for x in loads]
    low, high = 0.0, max(loads) + weight * (rows / len(loads) + 1.0)
    for _ in range(100):  # sum(filled(low)) <= rows < sum(filled(high))
        middle = (low + high) / 2
        low, high = (middle, high) if sum(filled(middle)) <= rows else (low, middle)
    return filled(low)


def greedy_shares(classes: Iterable[tuple[float, int]], n: int) -> Iterator[tuple[float, list[int]]]:
    """How many rows of each class (weight, rows), heaviest first, a greedy packing gives each of n parts.

    Greedy puts the next row into the part with the least load, the first of those that are equal. Rows of one weight are
    alike, so that a class is filled at once: all parts are raised to the highest level that the class can fill, and less
    than n rows are then placed one by one. Rows that weigh nothing change no load and all go to the same part.
    """
    loads: list[float] = [0] * n
    for weight, rows in classes:
        if weight <= 0:
            share = [0] * n
            share[min(range(n), key=loads.__getitem__)] = rows
        else:
            share = [0] * n if rows <= 8 * n else _level_shares(loads, weight, rows)
            heap = [(x + weight * k, i) for i, (x, k) in enumerate(zip(loads, share, strict=True))]
            heapq.heapify(heap)
            for _ in range(rows - sum(share)):
                load, i = heap[0]
                share[i] += 1
                heapq.heapreplace(heap, (load + weight, i))
        loads = [x + weight * k for x, k in zip(loads, share, strict=True)]
        yield weight, share


def balanced_parts(df: DataFrame, key: str, weight: str, n: int, out: str = "part", most_classes: int = MAX_CLASSES) -> DataFrame:
    """Deal rows to n parts as a greedy longest-first packing does: each row, heaviest first, to the part with the least load.

    Only counts of rows by weight reach the driver, heaviest first and one at a time; what each part gets of a class
    comes from the counts, and the rows of a class are numbered (by range-wise counts) into the parts' places. `key` is
    a number that is unique. A null weight counts as 0; more than `most_classes` different weights are an error: round
    them first.
    """
    spark, kind = df.sparkSession, df.schema[weight].dataType.simpleString()
    rows = df.withColumn("__w", F.coalesce(F.col(weight), F.lit(0).cast(kind)))
    counts = rows.groupBy("__w").agg(F.count(F.lit(1)).alias("__n"))
    shares = []
    for w, share in greedy_shares(((r["__w"], r["__n"]) for r in counts.orderBy(F.desc("__w")).toLocalIterator()), n):
        shares.append((w, list(accumulate(share))))
        if len(shares) > most_classes:
            raise ValueError(f"over {most_classes} different weights; round them first")
    ends = materialize(spark.createDataFrame(shares, f"__w {kind}, __ends array<long>"), "balanced_ends")
    place = prefix_totals(rows, ["__w"], key, {"__n": F.count(F.lit(1))}).select("__w", key, F.col("before___n").alias("__place"))
    placed = join_groups(place, ends, ["__w"]).select("__w", key, F.size(F.filter("__ends", lambda e: e <= F.col("__place"))).alias(out))
    return join_groups(rows.drop(*([out] if out in df.columns else [])), placed, ["__w", key]).drop("__w")


def share_of_max(df: DataFrame, group: Sequence[str], value: str, out: str) -> DataFrame:
    return with_group_stats(df, group, {"__top": F.max(value)}).withColumn(out, F.col(value) / F.nullif(F.col("__top"), F.lit(0))).drop("__top")
