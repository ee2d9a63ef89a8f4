"""Look-back as-of joins: for each session the last measurement of the same entity in a time window before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICRO = 1_000_000


def asof_lookback(sessions: DataFrame, measures: DataFrame, key: str, session_time: str, measure_time: str, measure_order: str,
                  window_seconds: int, include_now: bool = False, include_start: bool = True, bucket_seconds: int | None = None) -> DataFrame:
    """Left as-of join that keeps the last measure in [t - window, t) for each session row.

    Both bounds can be opened or closed. Sessions and measures lie in one table, cut into time buckets of a key, and the
    last measure is carried forward in time within a bucket: no session is ever paired with a measure that it doesn't
    keep. What a bucket is left with at its end, one measure, is a row of the buckets after it that a window can reach
    from there (one bucket where `bucket_seconds` isn't given). A key with very many events is dealt to its buckets; for
    one with very many in a single window choose shorter buckets.

    `measure_order` breaks ties of time. All columns of `measures` come back in the struct `last`, null where nothing was
    found. Rows with a null key or time find nothing and aren't found; they don't take part in the sort. Repeated sessions
    stay as they are.
    """
    bucket = (bucket_seconds or window_seconds) * MICRO
    reach = -(-window_seconds * MICRO // bucket)
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    known = lambda time: F.col(key).isNotNull() & F.col(time).isNotNull()
    session, measure = (F.struct(*df.columns) for df in (sessions, measures))
    empty_session, empty_measure = (F.lit(None).cast(df.schema) for df in (sessions, measures))

    def rows(df: DataFrame, time: str, kind: int, order: Column, s: Column, m: Column) -> DataFrame:
        out = df.filter(known(time)).select(F.col(key).alias("__key"), at(time).alias("__t"), F.lit(kind).alias("__kind"), order.alias("__o"), s.alias("__s"), m.alias("__m"))
        return out.withColumn("__bucket", F.floor(F.col("__t") / bucket))

    before, after = (1, 0) if include_now else (0, 1)  # which comes first at the same time
    order_type = measures.schema[measure_order].dataType
    asked = rows(sessions, session_time, before, F.lit(None).cast(order_type), session, empty_measure)
    found = rows(measures, measure_time, after, F.col(measure_order), empty_session, measure)
    last = found.groupBy("__key", "__bucket").agg(F.max_by(F.struct("__t", "__kind", "__o", "__s", "__m"), F.struct("__t", "__o")).alias("__l"))
    carried = last.select("__key", "__l.*", F.explode(F.sequence(F.col("__bucket") + 1, F.col("__bucket") + reach)).alias("__bucket"))
    both = asked.unionByName(found).unionByName(carried)
    upto = Window.partitionBy("__key", "__bucket").orderBy("__t", "__kind", "__o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.last(F.when(F.col("__kind") == after, F.struct("__t", "__m")), ignorenulls=True).over(upto)
    out = both.withColumn("__seen", seen).filter(F.col("__kind") == before)
    start = F.col("__t") - window_seconds * MICRO
    early = F.col("__seen.__t") >= start if include_start else F.col("__seen.__t") > start
    out = out.select("__s.*", F.when(early, F.col("__seen.__m")).alias("last"))
    return out.unionByName(sessions.filter(~known(session_time)).withColumn("last", empty_measure))
