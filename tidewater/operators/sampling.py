"""Seeded sampling and splits that depend on keys only: reruns and other partitionings give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_unit(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the key and seed, by MD5 so that any engine can give it."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def take_per_class(df: DataFrame, label: str, key: str, wanted: dict[int, int], seed: int = 42) -> DataFrame:
    """`wanted` rows of each label by the order of a seeded hash.

    Each label's least hashes are found by a top-k, which combines before the shuffle; no task sorts a label.
    """
    hashed = df.withColumn("__u", hash_unit(F.col(key), seed))
    parts = [hashed.filter(F.col(label) == y).orderBy("__u", key).limit(n) for y, n in wanted.items() if n > 0]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.drop("__u")


def few_shot(df: DataFrame, label: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n examples, half of them positive (rounded to even)."""
    return take_per_class(df, label, key, {1: round(n / 2), 0: n - round(n / 2)}, seed)


def balanced(df: DataFrame, label: str, key: str, per_class: int, seed: int = 42) -> DataFrame:
    """per_class positives, or all of them, topped up with negatives to 2 * per_class; as many as there are."""
    found = df.filter(F.col(label) == 1).limit(per_class).count()
    return take_per_class(df, label, key, {1: found, 0: 2 * per_class - found}, seed)


def random_split(key: Column, shares: list[tuple[str, float]], seed: int = 42) -> Column:
    """The name of the part that a key falls into."""
    u, total, out = hash_unit(key, seed), 0.0, None
    for name, share in shares[:-1]:
        total += share
        out = F.when(u < total, name) if out is None else out.when(u < total, name)
    return F.lit(shares[-1][0]) if out is None else out.otherwise(shares[-1][0])


def temporal_split(time: Column, key: Column, cut: str, eval_share: float = 0.15, seed: int = 42) -> Column:
    """test from the cut on, else eval for a share of the keys, else train."""
    return F.when(time >= F.lit(cut).cast("timestamp_ntz"), "test").when(hash_unit(key, seed) < eval_share, "eval").otherwise("train")


def merge_parts(part: Column, into: str, *others: str) -> Column:
    """Parts of a split as one, for a model that needs no part of its own to stop at: train and eval as train."""
    return F.when(part.isin(*others), into).otherwise(part)
