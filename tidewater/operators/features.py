"""Feature preparation whose result depends on counts over the table: one aggregate decides, one projection applies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = -1


def drop_rows_without_target(df: DataFrame, targets: Sequence[str], missing: int = MISSING) -> DataFrame:
    return df.filter(F.exists(F.array(*targets), lambda t: t != missing))


def drop_unused(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Without those of the columns that are 0 or null in every row."""
    if not columns:
        return df
    top = df.agg(*[F.coalesce(F.max(F.col(c) != 0), F.lit(False)).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if not top[c]])


def drop_mostly_missing(df: DataFrame, share: float = 0.8, keep: Sequence[str] = ()) -> DataFrame:
    """Without columns of which more than `share` is null."""
    found = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns]).first()
    return df.drop(*[c for c in df.columns if c not in keep and (found[c] or 0) > share])


def missing_indicators(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_is_missing": F.col(c).isNull().cast("int") for c in columns})


def fill_missing(df: DataFrame, values: dict[str, Column | float | str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), v if isinstance(v, Column) else F.lit(v)) for c, v in values.items()})


def collapse_rare(df: DataFrame, column: str, least: int, other: str = "Other") -> DataFrame:
    """Values of fewer than `least` rows become `other`; the counts are joined, so any number of values will do."""
    counts = df.groupBy(column).agg((F.count(F.lit(1)) >= least).alias("__ok"))
    return df.join(counts, df[column].eqNullSafe(counts[column]), "left").drop(counts[column]).withColumn(column, F.when(F.col("__ok"), F.col(column)).otherwise(other)).drop("__ok")


def standardise(df: DataFrame, columns: Sequence[str], fit_on: Column | None = None) -> DataFrame:
    """(x - mean) / population deviation, learned on the rows of fit_on; 0 deviation gives 0."""
    rows = df if fit_on is None else df.filter(fit_on)
    stats = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    joined = df.crossJoin(F.broadcast(stats))  # one row
    out = joined.withColumns({c: F.coalesce((F.col(c) - F.col(f"m_{c}")) / F.nullif(F.col(f"s_{c}"), F.lit(0.0)), F.lit(0.0)) for c in columns})
    return out.drop(*[f"{p}_{c}" for p in "ms" for c in columns])
