"""Rules that map values to groups, as CASE expressions or small joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_match(text: Column, rules: Sequence[tuple[str | Sequence[str], str]], exact: Mapping[str, str] | None = None, default: str | None = None) -> Column:
    """The group of the first rule with a part that occurs in the lower-cased text; the order of the rules matters.

    Then the case-sensitive table of whole values, then the default.
    """
    out, low = None, F.lower(text)
    for parts, group in rules:
        hit = F.lit(False)
        for part in [parts] if isinstance(parts, str) else parts:
            hit = hit | low.contains(part)
        out = F.when(hit, group) if out is None else out.when(hit, group)
    rest = F.lit(default) if not exact else F.coalesce(map_values(text, exact), F.lit(default))
    return rest if out is None else out.otherwise(rest)


def map_values(value: Column, table: Mapping, default=None) -> Column:
    """A dictionary lookup; null (or the default) for values outside it."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    found = F.create_map(*pairs)[value]
    return found if default is None else F.coalesce(found, F.lit(default))


def map_by_join(df: DataFrame, column: str, dim: DataFrame, key: str, value: str, out: str, default=None, broadcast_rows: int = 100_000) -> DataFrame:
    """The same for a table of values; broadcast only if it is counted to be small."""
    pairs = dim.select(F.col(key).alias("__k"), F.col(value).alias(out)).dropDuplicates(["__k"])
    pairs = F.broadcast(pairs) if pairs.limit(broadcast_rows + 1).count() <= broadcast_rows else pairs
    joined = df.join(pairs, F.col(column) == F.col("__k"), "left").drop("__k")
    return joined if default is None else joined.withColumn(out, F.coalesce(out, F.lit(default)))


def buckets(value: Column, bounds: Sequence[tuple[float, int]], default: int = 0) -> Column:
    """The label of the first bound that the value is above; null counts as 0."""
    v, out = F.coalesce(value, F.lit(0)), None
    for bound, label in bounds:
        out = F.when(v > bound, label) if out is None else out.when(v > bound, label)
    return F.lit(default) if out is None else out.otherwise(default)


def one_hot(value: Column, values: Sequence, prefix: str) -> list[Column]:
    """An integer indicator column per value."""
    return [F.coalesce((value == v).cast("int"), F.lit(0)).alias(f"{prefix}{v}") for v in values]


def target_category(target: Column, labs: Sequence[str], symptoms: Sequence[str]) -> Column:
    """lab, symptom, or else clinic."""
    return F.when(target.isin(*labs), "lab").when(target.isin(*symptoms), "symptom").otherwise("clinic")


def align_columns(df: DataFrame, wanted: Sequence[str], fill=0) -> DataFrame:
    """The wanted columns in their order; missing ones are filled, others go."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(fill).alias(c) for c in wanted])


def drop_if_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def alias_if_missing(df: DataFrame, a: str, b: str) -> DataFrame:
    """Whichever of two columns is missing becomes a copy of the other."""
    if a not in df.columns:
        return df.withColumn(a, F.col(b))
    return df if b in df.columns else df.withColumn(b, F.col(a))
