"""Connected components of an undirected graph given as an edge table.

Alternating large-star and small-star steps (Kiveris et al., 2014): every step points neighbours at the smallest
neighbour, until the edges are stars around each component's smallest node. Each round is stored as a table in the
shared folder. Nothing but the round's count and checksum, and the few nodes with very many neighbours, reach the driver.
More than MAX_ROUNDS rounds (the number grows with the logarithm of a component's size) are an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.skew import join_hot
from tidewater.sources.work import materialize

MAX_ROUNDS = 60


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node that can be reached.

    Loops and repeated edges don't matter; edges with a null end are left out; no edges give no rows.
    """
    low, high = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    now = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(high.alias("u"), low.alias("v"))
    now = materialize(now.distinct(), "edges")
    mark = _fingerprint(now)
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("rows")).withColumn("m", F.least("u", "m")), "least")
        # Large star: larger neighbours of u point at u's least neighbour.
        large = join_hot(both, least.select("u", "m"), ["u"], "v", counts=least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.distinct(), "large_star")
        # Small star: u and its neighbours, all smaller now, point at the least of them.
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("rows")), "least")
        small = join_hot(large, least.select("u", "m"), ["u"], "v", counts=least).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        before, mark = mark, _fingerprint(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    # A star's centre is its own component.
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
