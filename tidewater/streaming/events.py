"""Structured Streaming variants over an event stream; the other queries over events are batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.sources.work import new_folder


def event_stream(spark: SparkSession, folder: str, name: str = "events", files_per_trigger: int = 1) -> DataFrame:
    """A table's files as a stream, with `ts` as a timestamp."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    path = f"{folder}/{name}.parquet*"  # a folder of files, or a single file
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, mode: str = "append", key: str = "query", folder: str | None = None) -> DataFrame:
    """Run a stream over what is there now into a table in the shared folder, and read that table.

    With a `folder` of the caller's its checkpoint stays there: the next call with the same folder goes on where this one
    ended, also after a failure, and each row of the input is in the table once. Without one, each call starts anew.
    """
    spark = stream.sparkSession
    path = folder.rstrip("/") if folder else new_folder(spark, "stream")
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{path}/{key}").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    else:
        write = lambda df, epoch: df.write.mode("overwrite").parquet(f"{path}/{key}")  # noqa: E731  the last batch holds the whole result
        query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/{key}")


def tumbling(stream: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    out = stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    out = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def first_of_week(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """One event per user and week (from Monday): the first to arrive; a week's state is dropped once the watermark is past it."""
    keyed = stream.withWatermark("ts", late).withColumn("w", F.window("ts", "7 days", startTime="4 days"))
    keyed = keyed.withColumn("ts", F.expr("ts + interval 0 seconds"))  # the window alone stays the event time
    return keyed.dropDuplicates(["user_id", "w"]).withColumn("week", F.col("w.start")).drop("w")


def lookback_pairs(stream: DataFrame, window: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """Purchases with each view of the same user in the window before: an interval join of two streams."""
    buy = stream.filter("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), F.col("user_id").alias("buyer"), F.col("ts").alias("bought")).withWatermark("bought", late)
    view = stream.filter("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", F.col("ts").alias("viewed")).withWatermark("viewed", late)
    near = F.expr(f"buyer = user_id AND viewed < bought AND viewed >= bought - interval {window}")
    return buy.join(view, near).select("purchase_id", "view_id")
