"""Sinks: partitioned tables, JSON maps, and sweeping invalid results before a rerun."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_parts(df: DataFrame, path: str, n: int, key: str, kind: str = "parquet", compression: str = "gzip") -> None:
    """n parts of about equal size, dealt by a hash of the key."""
    df.repartition(n, key).write.mode("overwrite").format(kind).option("header", True).option("escape", '"').option("compression", compression).save(path)


def write_by(df: DataFrame, path: str, columns: list[str]) -> None:
    """A folder per value of the columns; rows are brought together first, so that a task writes few files."""
    df.repartition(*columns).write.mode("overwrite").partitionBy(*columns).parquet(path)


def write_json_map(df: DataFrame, path: str, key: str, text: str) -> None:
    """Rows as JSON objects of one pair, a line each."""
    df.select(F.to_json(F.create_map(F.col(key).cast("string"), F.col(text))).alias("value")).write.mode("overwrite").text(path)


def sweep(results: DataFrame, valid: Column, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, keys to do again): a result is invalid where the condition is false or null."""
    ok = F.coalesce(valid, F.lit(False))
    return results.filter(ok), results.filter(~ok).select(*keys).distinct().join(results.filter(ok).select(*keys), keys, "left_anti")
