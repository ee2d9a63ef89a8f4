"""Reading the star-schema tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of `folder`; any store that Spark's readers know."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt to all cores where its scan has fewer partitions than they are; larger tables stay as read, without a shuffle.

    For costly work on each row: a small file holds a single row group, which is one task however many cores are free.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
