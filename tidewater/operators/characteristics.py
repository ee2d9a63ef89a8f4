"""The table of a cohort's characteristics by split: medians, shares, and categories with the rest as "Other".

All functions take rows with a column `split` (a row once for each split that it belongs to: eligibility.in_parts) and
give (block, name, split, shown, place): `place` orders the lines of a block. Percentages have two digits, halves up.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NOTHING, OTHER = "0 (0)", "Other"
COLUMNS = ("block", "name", "split", "shown", "place")


def share_text(n: Column, whole: Column) -> Column:
    """"1,234 (5.60)"; a share of nothing is 0.00."""
    hundredths = F.coalesce(F.floor((20000 * n + whole) / F.nullif(2 * whole, F.lit(0))), F.lit(0)).cast("long")
    return F.format_string("%,d (%d.%02d)", n.cast("long"), F.floor(hundredths / 100), F.pmod(hundredths, F.lit(100)))


def medians(rows: DataFrame, block: str, values: Mapping[str, Column]) -> DataFrame:
    """Median and quartiles of each value, nulls left out; "nan" where a split has no value."""
    q = F.array(*[F.lit(x) for x in (0.5, 0.25, 0.75)])
    found = rows.groupBy("split").agg(*[F.percentile(c, q).alias(f"v{i}") for i, c in enumerate(values.values())])
    shown = [F.when(F.col(f"v{i}").isNull(), "nan").otherwise(F.format_string("%.2f (%.2f-%.2f)", *[F.col(f"v{i}")[k] for k in range(3)])) for i in range(len(values))]
    return _lines(found, block, list(values), shown)


def shares(rows: DataFrame, block: str, flags: Mapping[str, Column], missing: int | None = None) -> DataFrame:
    """Rows where a number is 1, and their percentage of all rows, or of those that aren't `missing`."""
    counts = []
    for i, c in enumerate(flags.values()):
        seen = F.lit(True) if missing is None else ~c.eqNullSafe(F.lit(missing))
        counts += [F.count_if(seen & (c == 1)).alias(f"n{i}"), F.count_if(seen).alias(f"w{i}")]
    found = rows.groupBy("split").agg(*counts)
    return _lines(found, block, list(flags), [share_text(F.col(f"n{i}"), F.col(f"w{i}")) for i in range(len(flags))])


def _lines(found: DataFrame, block: str, names: list[str], shown: list[Column]) -> DataFrame:
    lines = F.array(*[F.struct(F.lit(n).alias("name"), c.alias("shown"), F.lit(i).cast("long").alias("place")) for i, (n, c) in enumerate(zip(names, shown, strict=True))])
    return found.select("split", F.explode(lines).alias("l")).select(F.lit(block).alias("block"), "l.name", "split", "l.shown", "l.place")


def categories(rows: DataFrame, block: str, key: str, name: str, first: str, by_key: bool = False) -> DataFrame:
    """Each name's rows (its different keys, with `by_key`) and their percentage of the split's different keys.

    Names are ordered by their count in the split `first`, greatest first, then by name. A null name has no line; its
    keys belong to the whole. A null key is no key.
    """
    counts = _counted(rows, key, name, by_key)
    order = Window.orderBy(F.col("in_first").desc(), F.col("name"))  # a row for each name
    known = counts.groupBy("name").agg(F.coalesce(F.max(F.when(F.col("split") == first, F.col("n"))), F.lit(0)).alias("in_first"))
    places = known.select("name", (F.row_number().over(order) - 1).cast("long").alias("place"))
    return counts.join(_wholes(rows, key), "split").join(places, "name").select(F.lit(block).alias("block"), "name", "split", share_text(F.col("n"), F.col("whole")).alias("shown"), "place")


def _counted(rows: DataFrame, key: str, name: str, by_key: bool) -> DataFrame:
    n = F.countDistinct(key) if by_key else F.count(F.lit(1))
    return rows.filter(F.col(name).isNotNull()).groupBy("split", F.col(name).alias("name")).agg(n.alias("n"))


def _wholes(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy("split").agg(F.countDistinct(key).alias("whole"))


def top_names(rows: DataFrame, key: str, name: str, splits: Sequence[str], k: int, by_key: bool = False) -> DataFrame:
    """The k most frequent names of each of the splits, ties by name: at most k names a split."""
    ranked = _counted(rows.filter(F.col("split").isin(list(splits))), key, name, by_key)
    best = ranked.withColumn("r", F.row_number().over(Window.partitionBy("split").orderBy(F.col("n").desc(), F.col("name"))))
    return best.filter(F.col("r") <= k).select("name").distinct()


def others(rows: DataFrame, block: str, key: str, name: str, top: DataFrame) -> DataFrame:
    """The keys that have a name which isn't among `top` (null too), beside the split's different keys; last in its block."""
    marked = rows.join(F.broadcast(top.select(F.col("name").alias(name), F.lit(True).alias("__top"))), name, "left")  # a few names a split
    n = F.countDistinct(F.when(F.col("__top").isNull(), F.col(key)))
    found = marked.groupBy("split").agg(n.alias("n"), F.countDistinct(key).alias("whole"))
    return found.select(F.lit(block).alias("block"), F.lit(OTHER).alias("name"), "split", share_text(F.col("n"), F.col("whole")).alias("shown"), F.lit(2**31).cast("long").alias("place"))


def by_split(lines: Sequence[DataFrame], blocks: Sequence[str], splits: Sequence[str]) -> DataFrame:
    """One row for each line in its order (`line`, from 1), a column for each split; NOTHING where a split lacks the line."""
    rows = reduce(DataFrame.unionByName, [x.select(*COLUMNS) for x in lines])
    wide = rows.groupBy("block", "name", "place").pivot("split", list(splits)).agg(F.max("shown")).na.fill(NOTHING, list(splits))
    at = F.array_position(F.array(*[F.lit(b) for b in blocks]), F.col("block"))
    return wide.withColumn("line", F.row_number().over(Window.orderBy(at, "place", "name")).cast("long")).select("line", "block", "name", *splits)  # a row for each line shown
