"""Intermediate tables in the folder that driver and executors share.

A table written here cuts lineage: a lost executor costs only the tasks that were reading, never the work behind the
table. They stay until drop_work_tables() is called. The folder is the one named by ``spark.checkpoint.dir``; only where that is unset and Spark runs in one process
(tests) a folder under /tmp is taken.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "/tmp/tidewater-work"
    return folder.rstrip("/")


_written: list[str] = []
_named: list[str] = []


def new_folder(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, which drop_work_tables() deletes with all that is written there."""
    folder = f"{work_folder(spark)}/tidewater-{uuid.uuid4().hex}"
    _written.append(folder)
    return f"{folder}/{tag}"


def drop_work_tables(spark: SparkSession) -> None:
    """Delete all work tables that this process has written; call it when no result that reads them is needed any more."""
    while _named:
        spark.sql(f"DROP TABLE IF EXISTS {_named.pop()}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    while _written:
        path = hadoop.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and return the reader of that table.

    Its size is then known, so that later joins broadcast it only below spark.sql.autoBroadcastJoinThreshold.
    """
    spark = df.sparkSession
    path = new_folder(spark, tag)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_bucketed(df: DataFrame, tag: str, keys: list[str], buckets: int) -> DataFrame:
    """Write `df` as materialize() does, bucketed and sorted by `keys`; tables with as many buckets join without a shuffle.

    Rows that an aggregate or a join by `keys` has dealt to as many partitions lie as the buckets do; others are written
    as several files a bucket. The session's catalogue knows the table under a name of its own; its files lie in the shared folder.
    """
    spark = df.sparkSession
    name = f"{tag}_{uuid.uuid4().hex}"
    _named.append(name)
    df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", new_folder(spark, tag)).format("parquet").saveAsTable(name)
    return spark.table(name)
