"""Shapley values of tree ensembles, with expectations along the paths of the trees (path-dependent TreeSHAP).

A tree is a sum over its leaves. For a row, a leaf with m different features on its path adds to each of them, which can
be written out by how many of the other features are known: so a leaf is a few array operations for a whole Arrow batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Leaf:
    """What a leaf adds (with the tree's weight), and for each feature on its path the conditions and the share of rows
    that meet them: conditions are (threshold, left?) or (set of categories, left?).
    """

    value: float
    conditions: dict[int, list[tuple[object, bool]]] = field(default_factory=dict)
    share: dict[int, float] = field(default_factory=dict)

    def meets(self, feature: int, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for bound, left in self.conditions[feature]:
            inside = np.isin(x, list(bound)) if isinstance(bound, frozenset) else x <= bound
            out &= inside if left else ~inside
        return out


def leaves(model) -> list[Leaf]:
    """The leaves of a fitted Spark ML tree ensemble (or a single tree)."""
    trees = list(zip(model.trees, model.treeWeights, strict=True)) if hasattr(model, "treeWeights") else [(model, 1.0)]
    found: list[Leaf] = []

    def walk(node, path: list[tuple[int, object, bool, float]], weight: float) -> None:
        if node.getClass().getSimpleName() == "LeafNode":
            leaf = Leaf(weight * node.prediction())
            for feature, bound, left, share in path:
                leaf.conditions.setdefault(feature, []).append((bound, left))
                leaf.share[feature] = leaf.share.get(feature, 1.0) * share
            found.append(leaf)
            return
        split, whole = node.split(), node.impurityStats().count()
        bound = split.threshold() if split.getClass().getSimpleName() == "ContinuousSplit" else frozenset(split.leftCategories())
        for child, left in ((node.leftChild(), True), (node.rightChild(), False)):
            walk(child, [*path, (split.featureIndex(), bound, left, child.impurityStats().count() / whole)], weight)

    for tree, weight in trees:
        walk(tree._java_obj.rootNode(), [], weight)
    return found


def base_value(trees: Sequence[Leaf]) -> float:
    """What the ensemble gives where nothing is known of a row."""
    return sum(leaf.value * math.prod(leaf.share.values()) for leaf in trees)


def shapley_values(trees: Sequence[Leaf], x: np.ndarray) -> np.ndarray:
    """A value for each row and feature of x; a row's values add up to its margin less base_value()."""
    out = np.zeros(x.shape)
    for leaf in trees:
        features = list(leaf.conditions)
        met = {f: leaf.meets(f, x[:, f]).astype(float) for f in features}
        m = len(features)
        for f in features:
            ways = [np.ones(len(x))]  # ways[k]: products with k of the other features known
            for g in features:
                if g != f:
                    one, part = met[g], leaf.share[g]
                    ways = [part * (ways[k] if k < len(ways) else 0.0) + (one * ways[k - 1] if k else 0.0) for k in range(len(ways) + 1)]
            weight = sum(math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) * w for k, w in enumerate(ways))
            out[:, f] += leaf.value * (met[f] - leaf.share[f]) * weight
    return out


def tree_attributions(model, df: DataFrame, keep: Sequence[str], features: str = "features") -> DataFrame:
    """The kept columns with x (the features) and attribution, arrays of one number for each feature."""
    trees = leaves(model)
    rows = df.select(*keep, vector_to_array(features).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            x = column.flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))
            found = shapley_values(trees, x)
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * x.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))], [*batch.schema.names, "attribution"])

    kinds = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, attribution array<double>")


def importance(attributions: DataFrame, names: Sequence[str]) -> DataFrame:
    """Each feature's name, mean absolute attribution and the correlation of its values with it; features that never count are left out."""
    rows = attributions.select(F.posexplode(F.arrays_zip("x", "attribution")).alias("feature", "v")).select("feature", "v.x", "v.attribution")
    per = rows.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("importance"), F.try_divide(F.covar_pop("x", "attribution"), F.stddev_pop("x") * F.stddev_pop("attribution")).alias("correlation"))
    return per.filter("importance > 0").select(F.element_at(F.array(*[F.lit(n) for n in names]), F.col("feature") + 1).alias("feature"), "importance", "correlation")
