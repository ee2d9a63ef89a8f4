"""Greedy thinning of events: of each key the first, then always the next that comes long enough after the last one kept.

What is kept depends on what was kept before. Keys with few events are folded as one array of numbers. Those with more
take pointers: each event points to the first event that comes long enough after it (found by carrying times backwards
within time buckets, and over buckets by a second pass with a row for each), and the events that are reached from a key's
first one are marked by pointer doubling over stored tables: after r rounds all that lie within 2^r steps. The rounds are
the logarithm of the most events that one key keeps, whatever the number of its events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.ranks import join_groups
from tidewater.sources.work import materialize

#: A key of up to so many events is folded in one row; buckets in one gap, for the pointers of longer ones.
FOLD_EVENTS, BUCKETS_A_GAP = 10_000, 64


def thin_by_gap(df: DataFrame, key: str, time: str, tie: str, seconds: int, fold_events: int = FOLD_EVENTS) -> DataFrame:
    """Rows of a key that come at least `seconds` after the last row that was kept (greedy from the first).

    Times count in whole seconds; `tie` identifies a row and says which of those with the same time comes first. A null
    key is a key of its own. Rows without a time are never kept. With a gap of 0 or less all others are.
    """
    timed = df.filter(F.col(time).isNotNull())
    if seconds <= 0:
        return timed
    events = materialize(timed.select(F.col(key).alias("k"), F.unix_seconds(F.col(time).cast("timestamp")).alias("t"), F.col(tie).alias("id")), "thin_events")
    sizes = materialize(events.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "thin_sizes")
    long = sizes.filter(F.col("n") > fold_events)
    kept = _folded(join_groups(events, sizes.filter(F.col("n") <= fold_events), ["k"]), seconds, df.schema[tie].dataType.simpleString())
    if long.head(1):
        kept = kept.unionByName(_pointed(join_groups(events, long, ["k"]).drop("n"), seconds))
    return df.join(kept.withColumnRenamed("id", tie), tie, "left_semi")


def _folded(events: DataFrame, seconds: int, kind: str) -> DataFrame:
    lists = events.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("t", "id"))).alias("all"))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast(f"array<{kind}>").alias("ids"))
    step = lambda s, x: F.when(s["last"].isNull() | (x["t"] - s["last"] >= seconds), F.struct(x["t"].alias("last"), F.array_append(s["ids"], x["id"]).alias("ids"))).otherwise(s)
    return lists.select(F.explode(F.aggregate("all", start, step)["ids"]).alias("id"))


def successors(times: DataFrame, seconds: int) -> DataFrame:
    """(k, t, next) of the distinct times (k, t): the first time of the key at least `seconds` later, or null."""
    width = max(1, seconds // BUCKETS_A_GAP)
    bucket = lambda c: F.floor(F.col(c) / width)
    asked = times.select("k", (F.col("t") + seconds).alias("at"), F.lit(0).alias("kind"), "t").withColumn("b", bucket("at"))
    there = times.select("k", F.col("t").alias("at"), F.lit(1).alias("kind"), "t").withColumn("b", bucket("at"))
    # Backwards in time, events before questions of the same second: what has been seen last is the first that is later.
    back = Window.partitionBy("k", "b").orderBy(F.desc("at"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = asked.unionByName(there).withColumn("next", F.last(F.when(F.col("kind") == 1, F.col("at")), ignorenulls=True).over(back)).filter("kind = 0")
    firsts = there.groupBy("k", "b").agg(F.min("at").alias("first"))
    open_ = asked.select("k", "b").distinct().withColumn("first", F.lit(None).cast("long"))
    later = Window.partitionBy("k").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket of a key
    both = firsts.unionByName(open_).groupBy("k", "b").agg(F.min("first").alias("first"))
    both = both.select("k", "b", F.last("first", ignorenulls=True).over(later).alias("beyond"))
    return join_groups(near, both, ["k", "b"]).select("k", "t", F.coalesce("next", "beyond").alias("next"))


def _hop(left: DataFrame, jumps: DataFrame, on: str) -> DataFrame:
    """`left` with the column `to`: where the jump from its time `on` ends; rows without a jump are left out."""
    steps = jumps.select(F.col("k").alias("__k"), F.col("t").alias("__from"), F.col("next").alias("to"))
    return left.join(steps, F.col("k").eqNullSafe(F.col("__k")) & (F.col(on) == F.col("__from"))).drop("__k", "__from")


def _pointed(events: DataFrame, seconds: int) -> DataFrame:
    firsts = materialize(events.groupBy("k", "t").agg(F.min("id").alias("id")), "thin_times")
    jumps = materialize(successors(firsts.select("k", "t"), seconds).filter("next is not null"), "thin_jumps")
    reached = materialize(firsts.groupBy("k").agg(F.min("t").alias("t")), "thin_reached")
    while True:  # `jumps` goes 2^r steps, and `reached` holds all within 2^r - 1 steps of the first
        more = materialize(_hop(reached, jumps, "t").select("k", F.col("to").alias("t")), "thin_more")
        if not more.head(1):
            return join_groups(firsts, reached, ["k", "t"]).select("id")
        reached = materialize(reached.unionByName(more), "thin_reached")
        jumps = materialize(_hop(jumps, jumps, "next").select("k", "t", F.col("to").alias("next")), "thin_jumps")
