"""The k-th smallest composite key of a distributed table, and the ranks of the rows up to it.

A round draws random pivot keys from the rows still in question, counts exactly how many rows lie below, at and above
each, and goes on with the rows between the two pivots that the k-th key lies between; with PIVOTS pivots about one row in
so many is left. Only the winners are sorted. The driver sees PIVOTS keys and 2 * PIVOTS + 1 counts a round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.sources.work import materialize

PIVOTS = 15


def _literal(key: tuple, kinds: list) -> Column:
    return F.struct(*[F.lit(v).cast(kind) for v, kind in zip(key, kinds, strict=True)])


def kth_key(rows: DataFrame, keys: list[str], k: int, seed: int = 7) -> tuple | None:
    """The k-th smallest (from 1) of the stored `rows` by the columns `keys`; None where there are fewer rows or k is 0.

    Keys are compared in order; a null comes before the other values of its column.
    """
    if k < 1:
        return None
    inside, key, kinds, turn = rows.select(*keys), F.struct(*keys), [rows.schema[c].dataType for c in keys], 0
    while True:
        drawn = inside.orderBy(F.rand(seed + turn)).limit(PIVOTS).collect()  # which rows are drawn changes only the work
        pivots = sorted({tuple(r) for r in drawn}, key=lambda t: tuple((v is not None, v) if v is not None else (False,) for v in t))
        if not pivots:
            return None
        place = F.lit(0)
        for p in pivots:
            mark = _literal(p, kinds)
            place = place + F.when(key > mark, 2).when(key == mark, 1).otherwise(0)
        counts = {r["place"]: r["count"] for r in inside.groupBy(place.alias("place")).count().collect()}  # at most 2 * PIVOTS + 1 rows
        at = next((i for i in range(2 * len(pivots) + 1) if sum(counts.get(j, 0) for j in range(i + 1)) >= k), None)
        if at is None:
            return None
        if at % 2:
            return pivots[at // 2]
        k -= sum(counts.get(j, 0) for j in range(at))
        low, high = at // 2 - 1, at // 2
        if low >= 0:
            inside = inside.filter(key > _literal(pivots[low], kinds))
        if high < len(pivots):
            inside = inside.filter(key < _literal(pivots[high], kinds))
        inside, turn = materialize(inside, "select_range"), turn + 1


def ranked(rows: DataFrame, keys: list[str], out: str = "rank") -> DataFrame:
    """The rows with their place (from 1) in the order of `keys`, by a range sort; no window spans more than a row a task."""
    placed = materialize(rows.orderBy(*keys).withColumn("__at", F.monotonically_increasing_id()), "sorted_rows")
    tasks = placed.groupBy(F.shiftright("__at", 33).alias("__task")).count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = F.broadcast(tasks.select("__task", before.alias("__before")))  # a row for each task of the sort
    joined = placed.withColumn("__task", F.shiftright("__at", 33)).join(tasks, "__task")
    return joined.select(*rows.columns, (F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).alias(out))


def split_at(rows: DataFrame, keys: list[str], k: int, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(the k smallest of the stored rows, the others); the keys must tell all rows apart."""
    last = kth_key(rows, keys, k, seed)
    if last is None:
        return (rows.filter(F.lit(False)), rows) if k < 1 else (rows, rows.filter(F.lit(False)))
    inside = F.struct(*keys) <= _literal(last, [rows.schema[c].dataType for c in keys])
    return rows.filter(inside), rows.filter(~inside)
