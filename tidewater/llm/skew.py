"""Joins and numbering for keys that may hold a large share of all rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.sources.work import materialize

#: A key is hot when it holds over one in so many rows, or over so many rows whatever their share.
SHARES, LEAST_ROWS, MOST_ROWS = 128, 1000, 1_000_000
#: A table is broadcast up to so many bytes, as its rows are counted.
BROADCAST_BYTES = 16 << 20
#: Rows of a key that one task numbers, as a power of two.
CELL_BITS = 15


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], spread: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """`left` joined with `right`, which has one row for each value of `keys`.

    The rows of a hot key are dealt by a hash of the column `spread` to as many parts as it takes, and the key's row of
    `right` is repeated for each part. No task then gets more than MOST_ROWS rows of one key. The hot keys, at most SHARES
    or one for MOST_ROWS rows of `left`, whichever are more, are all that is sent to the driver. `counts`
    (stored; keys and a column rows) tells how many rows of `left` have each key; without it they are counted, and `left`
    should be a stored table. `how` is inner or left.
    """
    if counts is None:
        counts = materialize(left.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")), "key_counts")
    whole = counts.agg(F.sum("rows").alias("all"), F.max("rows").alias("most")).first()
    limit = max(LEAST_ROWS, min((whole["all"] or 0) // SHARES, MOST_ROWS))
    if (whole["most"] or 0) <= limit:
        return left.join(right, keys, how)
    names = {k: f"__hot_{i}" for i, k in enumerate(keys)}
    hot = counts.filter(F.col("rows") > limit).select(*[F.col(k).alias(n) for k, n in names.items()], F.ceil(F.col("rows") / limit).cast("int").alias("__parts"))
    rows = hot.collect()  # at most SHARES, or rows / MOST_ROWS
    parts = F.broadcast(left.sparkSession.createDataFrame(rows, hot.schema))
    on = [F.col(k) == F.col(n) for k, n in names.items()]
    dealt = left.join(parts, on, "left").withColumn("__part", F.coalesce(F.pmod(F.hash(spread), F.col("__parts")), F.lit(0))).drop("__parts", *names.values())
    repeated = right.join(parts, on, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__parts") - 1, F.lit(0))))).drop("__parts", *names.values())
    return dealt.join(repeated, [*keys, "__part"], how).drop("__part")


def is_small(table: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of a (stored) table, written out as text, are at most `limit` bytes."""
    return (table.agg(F.sum(F.octet_length(F.to_json(F.struct(*table.columns))))).first()[0] or 0) <= limit


def attach(left: DataFrame, right: DataFrame, key: str, spread: str, how: str = "inner") -> DataFrame:
    """`left` (stored) joined with `right`, a row for each key: by broadcast where `right` is small, else with its hot keys dealt."""
    return left.join(F.broadcast(right), key, how) if is_small(right) else join_hot(left, right, [key], spread, how)


def number_equal_rows(rows: DataFrame, keys: list[str], out: str) -> DataFrame:
    """The rows with their place (from 0) among the rows that agree in `keys`; which of them comes first is left open.

    No task sorts all rows of a key: rows are counted by runs of 2^CELL_BITS rows of the stored table, the counts of a
    key's runs are added up, and only the rows of one run are numbered together.
    """
    stored = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), "to_number").withColumn("__cell", F.shiftright("__row", CELL_BITS))
    before = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)  # a row for each run
    cells = stored.groupBy(*keys, "__cell").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    names = {k: f"__key_{i}" for i, k in enumerate([*keys, "__cell"])}
    cells = cells.select(*[F.col(k).alias(n) for k, n in names.items()], "__before")
    placed = stored.withColumn("__within", F.row_number().over(Window.partitionBy(*keys, "__cell").orderBy("__row")) - 1)
    joined = placed.join(cells, reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]))
    return joined.select(*rows.columns, (F.col("__before") + F.col("__within")).alias(out))
