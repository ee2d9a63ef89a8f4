"""Near-duplicate embeddings by iterative quantisation.

A rotation that balances the variance of the dimensions is learned (Gong & Lazebnik's ITQ: principal directions, then
alternating signs and the orthogonal Procrustes solution) on a bounded sample; the signs of the rotated vector are its
binary code. Codes are cut into disjoint substrings with a hash table each (multi-index hashing, Norouzi, Punjani &
Fleet). Vectors whose codes differ in no more than a table's radius of bits of its substring meet there: a bucket is
looked up together with all buckets within that radius. Those within `Model.most_apart` bits in all are compared by
their original values in double precision; those with a cosine of at least `threshold` are linked.

Number of tables and radii follow from the data: of all choices that retrieve a share `recall` of pairs made from the
sample at the threshold and closer, with noise alike in all directions and with noise like the data's own, the one with
the fewest lookups and expected candidates in the largest label. For small labels, or codes that tell nothing, that is no
table at all, which compares all vectors of a label. Vectors of each length have a model of their own.

Vectors that are equal are one class with a weight. A pair of buckets is cut into blocks, so that a task compares two
blocks at a time whatever the buckets' sizes; a pair is counted in the first table where it meets. A task returns, per
class, the number of vectors it links with, and for each the smallest class it is connected with there, not the links.

Defined cases: vectors that are null, zero, empty or hold null or non-finite components, and those with a null label,
link with nothing; vectors of different lengths don't link. A null vec_id has no identity: it links with nothing and is
kept. Repeated rows of one vec_id are vectors of their own in n_links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.arrow_groups import least_reachable, pairs_between, whole_groups
from tidewater.llm.components import connected_components
from tidewater.llm.skew import join_hot
from tidewater.sources.work import materialize

THRESHOLD, RECALL = 0.93, 0.98
#: Vectors that the rotations are learned from, in all; at least so many for each length.
SAMPLE, LEAST_SAMPLE, ROUNDS, SEED = 10_000, 200, 30, 7
CODE_BITS, MOST_RADIUS = 64, 4
BLOCK = 512
#: Pairs at the threshold that are made to choose the tables, and bits added to the greatest distance of their codes.
TRIAL_PAIRS, SPARE_BITS = 1000, 2
#: Parts of the distance at the threshold at which pairs are made.
TRIAL_PARTS = (1.0, 0.3, 0.01)
#: Pairs, and numbers of their vectors, that a task holds at once.
PAIRS_AT_ONCE, VALUES_AT_ONCE = 1 << 20, 1 << 22


def fit_itq(x: np.ndarray, bits: int, rounds: int = ROUNDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection of dims x bits) learned from the rows of x."""
    mean = x.mean(axis=0)
    centred = x - mean
    _, vectors = np.linalg.eigh(centred.T @ centred)
    main = vectors[:, ::-1][:, :bits]
    v = centred @ main
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(main.shape[1],) * 2))[0]
    for _ in range(rounds):
        b = np.where(v @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(b.T @ v)
        rotation = (left @ right).T
    return mean, main @ rotation


def neighbours(x: np.ndarray, threshold: float, noise: np.ndarray) -> np.ndarray:
    """For each unit row a unit row whose cosine with it is the threshold, in the direction of the noise."""
    u = noise - (noise * x).sum(axis=1, keepdims=True) * x
    norm = np.linalg.norm(u, axis=1, keepdims=True)
    return threshold * x + math.sqrt(1 - threshold * threshold) * u / np.where(norm > 1e-9, norm, 1)


def ball(bits: int, radius: int) -> int:
    """How many substrings of `bits` bits differ from one by at most `radius`."""
    return sum(math.comb(bits, i) for i in range(radius + 1))


def plan_tables(differ: list[np.ndarray], largest: int, recall: float = RECALL) -> list[tuple[np.ndarray, int]]:
    """(bits, radius) of each table; none to compare whole labels. `differ`: which bits differ in trial pairs (pairs x bits)."""
    best, cost = [], float(largest)
    for m in range(1, differ[0].shape[1] + 1):
        parts = np.array_split(np.arange(differ[0].shape[1]), m)
        apart = [np.stack([d[:, p].sum(axis=1) for p in parts], axis=1) for d in differ]
        for radius in range(MOST_RADIUS + 1):
            for wider in range(1, m + 1):  # the first tables look one bit further than the others
                radii = np.array([radius] * wider + [radius - 1] * (m - wider))
                if radii[-1] < 0:
                    continue
                looked = sum(ball(len(p), int(r)) for p, r in zip(parts, radii, strict=True))
                met = largest * sum(ball(len(p), int(r)) / 2.0 ** len(p) for p, r in zip(parts, radii, strict=True))
                if looked + met < cost and min((a <= radii).any(axis=1).mean() for a in apart) >= recall:
                    best, cost = list(zip(parts, radii.tolist(), strict=True)), looked + met
    return best


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Model:
    """Rotation and tables for vectors of one length."""

    def __init__(self, dims: int, sample: np.ndarray, largest: int, threshold: float, recall: float):
        rng = np.random.default_rng(SEED)
        self.dims = dims
        x = unit_rows(sample) if len(sample) else unit_rows(rng.normal(size=(LEAST_SAMPLE, dims)))
        self.mean, self.projection = fit_itq(x, min(dims, CODE_BITS))
        trial = x[rng.integers(0, len(x), TRIAL_PAIRS)]
        noises = [rng.normal(size=trial.shape), x[rng.integers(0, len(x), TRIAL_PAIRS)] - x[rng.integers(0, len(x), TRIAL_PAIRS)] + 1e-3 * rng.normal(size=trial.shape)]
        cosines = [1 - (1 - threshold) * part for part in TRIAL_PARTS]  # in a tight cluster closer pairs may have codes further apart
        differ = [self.signs(trial) != self.signs(neighbours(trial, cosine, noise)) for noise in noises for cosine in cosines]
        tables = plan_tables(differ, largest, recall)
        self.tables = tables or [(np.zeros(0, np.int64), 0)]
        self.most_apart = max(int(d.sum(axis=1).max()) for d in differ) + SPARE_BITS if tables else CODE_BITS
        self.masks = np.array([sum(1 << int(b) for b in bits) for bits, _ in self.tables], np.uint64)
        self.radii = np.array([r for _, r in self.tables])

    def signs(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.projection >= 0

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The code of each unit row as one 64-bit number."""
        bits = self.signs(x)
        return (bits.astype(np.uint64) << np.arange(bits.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def flips(self, t: int) -> list[int]:
        """What a key of table t differs by, as signed numbers, from all keys within its radius."""
        bits, radius = self.tables[t]
        return [int(np.uint64(sum(1 << int(b) for b in some)).view(np.int64)) for r in range(radius + 1) for some in combinations(bits, r)]

    def first_meeting(self, apart: np.ndarray, t: int) -> np.ndarray:
        """Which pairs (xor of their codes), all met in table t, are close enough in all and met in no earlier table."""
        near = np.bitwise_count(apart) <= self.most_apart
        for mask, radius in zip(self.masks[:t], self.radii[:t], strict=True):
            near &= np.bitwise_count(apart & mask) > radius
        return near


def _groups(table: pa.Table) -> tuple[np.ndarray, ...]:
    """start, split and end of the groups of a table that is sorted by task and side; split is start where there is one side only."""
    task, side = (np.asarray(table.column(c).combine_chunks()) for c in ("task", "side"))
    start = np.flatnonzero(np.append(True, task[1:] != task[:-1]))
    end = np.append(start[1:], len(task))
    before = np.append(0, np.cumsum(side < 2))
    return start, np.where(side[start] == 0, start, start + before[end] - before[start]), end


def _near_pairs(table: pa.Table, models: list[Model]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(model, i, j) for the pairs of rows that a task compares and whose codes are close."""
    code = np.asarray(table.column("code").combine_chunks()).view(np.uint64)
    number, t = (np.asarray(table.column(c).combine_chunks()) for c in ("model", "t"))
    start, split, end = _groups(table)
    for key in np.unique(number[start].astype(np.int64) * 1000 + t[start]):
        own = np.flatnonzero((number[start] == key // 1000) & (t[start] == key % 1000))
        for i, j in pairs_between(start[own], split[own], end[own], PAIRS_AT_ONCE):
            near = models[key // 1000].first_meeting(code[i] ^ code[j], int(key % 1000))
            yield int(key // 1000), i[near], j[near]


def _fit_models(classes: DataFrame, threshold: float, recall: float) -> list[Model]:
    sizes = classes.groupBy(F.size("v").alias("dims"), "label").count().groupBy("dims").agg(F.sum("count").alias("n"), F.max("count").alias("largest"))
    lengths = sizes.orderBy("dims").collect()  # a row per length of vectors
    each = max(LEAST_SAMPLE, SAMPLE // max(1, len(lengths)))
    shares = classes.sparkSession.createDataFrame([(r["dims"], int(min(1.0, each / r["n"]) * (1 << 30))) for r in lengths], "dims int, share long")
    drawn = classes.join(F.broadcast(shares), F.size("v") == F.col("dims")).filter(F.pmod("node", F.lit(1 << 30)) <= F.col("share"))
    found = drawn.select("dims", "node", "v").toArrow().sort_by([("dims", "ascending"), ("node", "ascending")])  # about SAMPLE rows
    dims = np.asarray(found.column("dims"))
    return [Model(r["dims"], np.asarray(found.filter(pa.array(dims == r["dims"])).column("v").combine_chunks().flatten()).reshape(-1, r["dims"]), r["largest"], threshold, recall) for r in lengths]


def _met(classes: DataFrame, models: list[Model]) -> DataFrame:
    """Blocks of buckets that meet: (task, side, model, t, node, code); side 0 is compared within itself, 1 with 2."""
    spark = classes.sparkSession

    def enter(number: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = models[number]
            for batch in batches:
                x = unit_rows(np.asarray(batch.column(2).flatten()).reshape(batch.num_rows, -1)) if batch.num_rows else np.zeros((0, model.dims))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.full(len(x), number, np.int32)), pa.array(model.codes(x).view(np.int64))], ["space", "node", "model", "code"])

        return run

    space = F.xxhash64("label", F.size("v")).alias("space")
    coded = [classes.filter(F.size("v") == m.dims).select(space, "node", "v").mapInArrow(enter(i), "space long, node long, model int, code long") for i, m in enumerate(models)]
    whole = coded[0]
    for more in coded[1:]:
        whole = whole.unionByName(more)
    tables = [(i, t, int(mask.view(np.int64))) for i, m in enumerate(models) for t, mask in enumerate(m.masks)]
    masks = F.broadcast(spark.createDataFrame(tables, "model int, t int, mask long"))  # at most CODE_BITS rows per model
    entries = materialize(whole.join(masks, "model").withColumn("key", F.col("code").bitwiseAND(F.col("mask"))).drop("mask"), "vector_entries")
    buckets = entries.groupBy("space", "model", "t", "key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n"))
    buckets = materialize(buckets, "vector_buckets")
    flips = [(i, t, f) for i, m in enumerate(models) for t in range(len(m.tables)) for f in m.flips(t)]
    flips = F.broadcast(spark.createDataFrame(flips, "model int, t int, flip long"))  # the lookups of a code
    looked = buckets.join(flips, ["model", "t"]).withColumn("k2", F.col("key").bitwiseXOR(F.col("flip"))).filter("k2 >= key and (k2 > key or n > 1)")
    others = buckets.select("space", "t", F.col("key").alias("k2"), F.col("blocks").alias("blocks_2"))
    pairs = looked.select("space", "t", F.col("key").alias("k1"), "k2", F.col("blocks").alias("blocks_1")).join(others, ["space", "t", "k2"])
    pairs = pairs.withColumn("b1", F.explode(F.sequence(F.lit(0), F.col("blocks_1") - 1))).withColumn("b2", F.explode(F.sequence(F.lit(0), F.col("blocks_2") - 1)))
    pairs = pairs.filter("k1 < k2 or b1 <= b2").withColumn("task", F.xxhash64("space", "t", "k1", "k2", "b1", "b2")).withColumn("one", F.expr("k1 = k2 and b1 = b2"))
    side = lambda number, *which: F.struct(number.alias("side"), *[F.col(c).alias(n) for c, n in zip(which, ("key", "block"), strict=True)])
    sides = F.when(F.col("one"), F.array(side(F.lit(0), "k1", "b1"))).otherwise(F.array(side(F.lit(1), "k1", "b1"), side(F.lit(2), "k2", "b2")))
    asked = pairs.select("space", "t", "task", F.explode(sides).alias("s")).select("space", "t", "task", "s.side", "s.key", "s.block")
    placed = join_hot(entries, buckets.select("space", "t", "key", "blocks"), ["space", "t", "key"], "node")
    placed = placed.withColumn("block", F.pmod(F.hash("node"), F.col("blocks")))
    met = placed.join(asked, ["space", "t", "key", "block"]).select("task", "side", "model", "t", "node", "code")  # a block has about BLOCK members
    return met.repartition("task").sortWithinPartitions("task", "side")


def near_duplicate_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """For each vector: vec_id, n_links, component_id, kept."""
    plain = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"), F.col(label).alias("label"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    able = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound, F.lit(False))
    # Adding 0.0 turns -0.0 into 0.0, so that equal vectors are equal arrays.
    able_rows = plain.filter(able).select("vec_id", "label", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))
    classes = materialize(able_rows.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight")).withColumn("node", F.xxhash64("label", "v")), "vector_classes")
    models = _fit_models(classes, threshold, recall)
    if not models:
        return plain.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    met = _met(classes, models)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in whole_groups(batches, ["task"]):
            keep = np.zeros(table.num_rows, bool)
            for _, i, j in _near_pairs(table, models):
                keep[i] = keep[j] = True
            yield from table.filter(pa.array(keep)).combine_chunks().to_batches()

    close = materialize(met.mapInArrow(near, met.schema), "vector_candidates")
    full = close.join(classes.select("node", "v", "weight"), "node").repartition("task").sortWithinPartitions("task", "side")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in whole_groups(batches, ["task"]):
            node, place = np.unique(np.asarray(table.column("node").combine_chunks()), return_inverse=True)
            weight, values = np.asarray(table.column("weight").combine_chunks()), table.column("v").combine_chunks()
            ends = np.append(0, np.cumsum(np.asarray(values.value_lengths())))
            flat, total, a, b = np.asarray(values.flatten()), np.zeros(len(node), np.int64), [], []
            for number, i, j in _near_pairs(table, models):
                dims = models[number].dims
                for lo in range(0, len(i), max(1, VALUES_AT_ONCE // dims)):
                    p, q = (side[lo : lo + max(1, VALUES_AT_ONCE // dims)] for side in (i, j))
                    used, at = np.unique(np.append(p, q), return_inverse=True)
                    x = unit_rows(flat[ends[used][:, None] + np.arange(dims)])
                    linked = np.einsum("ij,ij->i", x[at[: len(p)]], x[at[len(p) :]]) >= threshold
                    p, q = p[linked], q[linked]
                    np.add.at(total, place[p], weight[q])
                    np.add.at(total, place[q], weight[p])
                    a.append(place[p])
                    b.append(place[q])
            least = least_reachable(np.concatenate(a), np.concatenate(b), len(node)) if a else np.arange(len(node))
            some, tied = np.flatnonzero(total), np.flatnonzero(least != np.arange(len(node)))
            rows = [np.append(node[some], node[tied]), np.append(total[some], np.zeros(len(tied), np.int64)), pa.array([None] * len(some) + node[least[tied]].tolist(), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), rows[2]], ["node", "linked", "other"])

    found = materialize(full.select("task", "side", "model", "t", "node", "code", "weight", "v").mapInArrow(link, "node long, linked long, other long"), "vector_links")
    counts = found.filter("other is null").groupBy("node").agg(F.sum("linked").alias("linked"))
    groups = connected_components(found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    at = classes.select("node", "rep", "weight").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    at = materialize(at.join(counts, "node", "left"), "vector_groups")
    least = at.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = join_hot(at, least, ["component"], "node")
    of_class = materialize(of_class.select("node", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("__n"), F.col("component_id").alias("__c")), "vector_components")
    keyed = materialize(plain.select("vec_id", F.when(able, F.xxhash64("label", F.transform("v", lambda x: x + F.lit(0.0)))).alias("node")), "vector_nodes")
    out = join_hot(keyed, of_class, ["node"], "vec_id", "left")
    out = out.select("vec_id", F.coalesce("__n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("__c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
