"""Near-duplicate documents by SuperMinHash signatures.

A document's set holds its distinct shingles of `k` words (A-Z lower-cased). SuperMinHash (Ertl, 2017) gives every
element one rank per signature slot, in which the slots are visited in the element's own permutation and ranks grow
from step to step; a document stops as soon as every slot is filled, since later steps could only give larger ranks.
Signatures are cut into bands. Documents with the same set are one class, represented by their smallest id. Classes
that share a band are candidates:

1. in each bucket (band and its hash) every member is paired with the bucket's most popular member, the one whose
   buckets are largest together (an original shares more bands with its copies than these do among each other);
2. pairs are confirmed on the full sets; confirmed pairs are joined to components by union-find (star contraction);
3. in buckets that still hold more than one component, tasks compare members of different components on their full
   sets. A bucket is cut into blocks, with blocks of its own for each large component, and a task holds two blocks, but
   never two of the same component. So a few strays among very many copies cost a task for each block of the copies.
   A task gives back no more pairs than it takes to join the components that it found linked.

After that every candidate pair has been compared or lies in one component, so no link that the bands find is lost,
while the number of pairs that are written is in proportion to the documents, whatever the size of a bucket.
With the default 25 bands of 5 a pair at the threshold of 0.8 is a candidate with probability 0.99995. Joins on buckets,
classes and components deal hot keys to several tasks.

Defined cases: a document with fewer than k words has one shingle, the whole sequence; one without words or text has
none and links with nothing. A null doc_id has no identity: such rows link with nothing, get a null component and are
kept. Rows that repeat a doc_id are judged by their own text each. Elements are compared by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.arrow_groups import least_reachable, whole_groups
from tidewater.llm.components import connected_components
from tidewater.llm.skew import join_hot
from tidewater.llm.textkernel import Chunk, chunks, mix, window_hashes
from tidewater.sources.work import materialize

SHINGLE_WORDS, PERCENT = 5, 80
BANDS, BAND_ROWS = 25, 5
#: Classes in a block of a bucket, elements of their sets in it, and columns of the incidence matrix held at once.
BLOCK, BLOCK_ELEMENTS, TERMS_AT_ONCE = 512, 2_000_000, 4096
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(chunk: Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle hash) for the distinct shingles of each row, ordered by row and hash."""
    start, end, row = chunk.words()
    words = chunk.hash_spans(chunk.prefix_hash(lower=True), start, end)
    shingles, at = window_hashes(words, row, k)
    rows = row[at]
    n_words = np.bincount(row, minlength=chunk.rows)
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        first = np.searchsorted(row, short)
        whole = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            more = n_words[short] > i
            whole[more] = mix(whole[more] * np.uint64(31) + words[first[more] + i])
        shingles, rows = np.concatenate([shingles, mix(whole ^ np.uint64(k))]), np.concatenate([rows, short])
    order = np.lexsort((shingles, rows))
    shingles, rows = shingles[order], rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (rows[1:] != rows[:-1])
    return rows[new], shingles[new]


def superminhash(rows: np.ndarray, elements: np.ndarray, n_rows: int, slots: int) -> np.ndarray:
    """n_rows x slots ranks; the rank's upper 8 bits are the step, so that every rank of a step is below the next step's."""
    ranks = np.full(n_rows * slots, _EMPTY, np.uint64)
    swaps: list[np.ndarray] = []
    for step in range(slots):
        draw = mix(elements + np.uint64((0x9E3779B97F4A7C15 * (step + 1)) & 0xFFFFFFFFFFFFFFFF))
        swap = (step + mix(draw) % np.uint64(slots - step)).astype(np.int16)
        slot = swap.copy()
        for i in range(step - 1, -1, -1):  # where the value now at position `swap` stood before the earlier swaps
            slot[swaps[i] == slot] = i
        rank = (draw >> np.uint64(8)) | np.uint64(step << 56)
        np.minimum.at(ranks, rows * slots + slot, rank)
        open_rows = (ranks.reshape(n_rows, slots) == _EMPTY).any(axis=1)
        stay = open_rows[rows]
        if not stay.any():
            break
        rows, elements = rows[stay], elements[stay]
        swaps = [s[stay] for s in swaps] + [swap[stay]]
    return ranks.reshape(n_rows, slots)


def _set_marks(rows: np.ndarray, elements: np.ndarray, n_rows: int) -> list[np.ndarray]:
    """Two 64-bit sums over hashes of each row's elements: equal for equal sets."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.zeros(len(elements) + 1, np.uint64)
        np.cumsum(mix(elements ^ np.uint64(salt)), out=total[1:])
        bounds = np.searchsorted(rows, np.arange(n_rows + 1))
        out.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return out


def signatures(docs: DataFrame, k: int, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """doc_id, n_shingles, s1 and s2 (marks of the set) and a hash for each band, for docs with doc_id and text."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, s1 long, s2 long, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                rows, elements = shingle_sets(c, k)
                ranks = superminhash(rows, elements, c.rows, bands * band_rows).reshape(c.rows, bands, band_rows)
                keys = np.zeros((c.rows, bands), np.uint64)
                for i in range(band_rows):
                    keys = mix(keys + ranks[:, :, i])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, c.rows * bands + 1, bands), pa.int32()), pa.array(keys.ravel().view(np.int64)))
                marks = _set_marks(rows, elements, c.rows)
                n = np.bincount(rows, minlength=c.rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, c.rows), pa.array(n, pa.int64()), *map(pa.array, marks), lists], ["doc_id", "n_shingles", "s1", "s2", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _class_key() -> Column:
    return F.xxhash64("n_shingles", "s1", "s2")


def _full_sets(docs: DataFrame, k: int) -> DataFrame:
    """class_key and the array of the document's shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(0)):
                rows, elements = shingle_sets(c, k)
                bounds = np.searchsorted(rows, np.arange(c.rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(elements.view(np.int64)))
                marks = _set_marks(rows, elements, c.rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.diff(bounds), pa.int64()), *map(pa.array, marks), lists], ["n_shingles", "s1", "s2", "elements"])

    sets = docs.select("text").mapInArrow(run, "n_shingles long, s1 long, s2 long, elements array<long>")
    return sets.select(_class_key().alias("class_key"), "elements")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the stored pairs (c, o: class keys; o may be hot) whose full sets are alike enough, as (a, b)."""
    one, two = (sets.select(F.col("class_key").alias(c), F.col("elements").alias(f"e_{c}")) for c in ("c", "o"))
    met = join_hot(pairs, two, ["o"], "c").join(one, "c").withColumn("both", F.size(F.array_intersect("e_c", "e_o")))
    alike = met.filter(100 * F.col("both") >= percent * (F.size("e_c") + F.size("e_o") - F.col("both")))
    return materialize(alike.select(F.col("c").alias("a"), F.col("o").alias("b")), "links")


def _alike(flat: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of left, j of right) of sets that are alike enough; sets lie back to back in flat."""
    n = len(sizes)
    terms, which, times = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    shared = np.full((len(left), len(right)), np.count_nonzero(times == n), np.float32)
    wanted = (times > 1) & (times < n)
    number = np.cumsum(wanted) - 1
    keep = wanted[which]
    owner, term = owner[keep], number[which[keep]]
    order = np.argsort(term, kind="stable")
    owner, term = owner[order], term[order]
    for lo in range(0, int(wanted.sum()), TERMS_AT_ONCE):
        a, b = np.searchsorted(term, [lo, lo + TERMS_AT_ONCE])
        held = np.zeros((n, TERMS_AT_ONCE), np.float32)
        held[owner[a:b], term[a:b] - lo] = 1
        shared += held[left] @ held[right].T
    total = sizes[left][:, None] + sizes[right][None, :]
    return np.nonzero(100 * shared >= percent * (total - shared))


def _links_within(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b) classes that links join, of different components; rows: task, side, c, comp, elements, sorted by task and side."""
    for group, bounds in whole_groups(batches, ["task"]):
        side, c, comp = (np.asarray(group.column(x).combine_chunks()) for x in ("side", "c", "comp"))
        sets = group.column("elements").combine_chunks()
        flat, ends = np.asarray(sets.flatten()), np.concatenate([[0], np.cumsum(np.asarray(pa.compute.list_value_length(sets)))])
        rows: list[np.ndarray] = []
        for lo, hi in bounds:
            within = side[lo] == 0
            left, right = (np.arange(hi - lo),) * 2 if within else (np.flatnonzero(side[lo:hi] == 1), np.flatnonzero(side[lo:hi] == 2))
            if (comp[lo:hi] == comp[lo]).all() or not len(left) or not len(right):
                continue
            i, j = _alike(flat[ends[lo] : ends[hi]], np.diff(ends[lo : hi + 1]), left, right, percent)
            i, j = left[i], right[j]
            _, place = np.unique(comp[lo:hi], return_inverse=True)
            apart = place[i] != place[j]
            i, j = place[i[apart]], place[j[apart]]
            least = least_reachable(i, j, int(place.max()) + 1)
            tied = np.flatnonzero(least != np.arange(len(least)))
            some = np.zeros(len(least), np.int64)
            some[place[::-1]] = np.arange(hi - lo)[::-1]  # a member of each component
            rows.append(np.stack([c[lo:hi][some[tied]], c[lo:hi][some[least[tied]]]]))
        found = np.concatenate(rows, axis=1) if rows else np.zeros((2, 0), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])


def _compared(placed: DataFrame) -> DataFrame:
    """Tasks that compare the members (bucket, c, n, comp) of a bucket across components: (task, side, c, comp)."""
    pieces = lambda members, elements: F.greatest(F.ceil(members / BLOCK), F.ceil(elements / BLOCK_ELEMENTS)).cast("int")
    sizes = placed.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("elements"))
    sizes = materialize(sizes.withColumn("pieces", pieces(F.col("rows"), F.col("elements"))), "bucket_components")
    small = lambda x: F.when(F.col("pieces") == 1, F.col(x)).otherwise(0)
    mixed = sizes.groupBy("bucket").agg(F.greatest(pieces(F.sum(small("rows")), F.sum(small("elements"))), F.lit(1)).alias("mixed"))
    sizes = join_hot(sizes, mixed, ["bucket"], "comp")
    # A large component has blocks of its own; small ones share the bucket's mixed blocks, each component in one of them.
    blocks = sizes.select("bucket", F.explode(F.when(F.col("pieces") > 1, F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda p: F.struct(F.col("comp").alias("owner"), p.alias("piece")))).otherwise(
        F.array(F.struct(F.lit(None).cast("long").alias("owner"), F.pmod(F.hash("comp"), F.col("mixed")).alias("piece"))))).alias("b")).select("bucket", "b.owner", "b.piece").distinct()
    blocks = materialize(blocks.withColumn("block", F.xxhash64("owner", "piece")), "bucket_blocks")
    one, two = (blocks.select("bucket", F.col("block").alias(f"b{i}"), F.col("owner").alias(f"o{i}")) for i in (1, 2))
    pairs = one.join(two, "bucket").filter("b1 < b2 and coalesce(o1 <> o2, true) or b1 = b2 and o1 is null").withColumn("task", F.xxhash64("bucket", "b1", "b2"))
    side = lambda number, block: F.struct(F.lit(number).alias("side"), F.col(block).alias("block"))
    asked = pairs.select("bucket", "task", F.explode(F.when(F.expr("b1 = b2"), F.array(side(0, "b1"))).otherwise(F.array(side(1, "b1"), side(2, "b2")))).alias("s")).select("bucket", "task", "s.side", "s.block")
    members = join_hot(placed, sizes.select("bucket", "comp", "pieces", "mixed"), ["bucket", "comp"], "c", counts=sizes.select("bucket", "comp", "rows"))
    big = F.col("pieces") > 1
    block = F.xxhash64(F.when(big, F.col("comp")), F.when(big, F.pmod(F.hash("c"), F.col("pieces"))).otherwise(F.pmod(F.hash("comp"), F.col("mixed"))))
    return members.select("bucket", "c", "comp", block.alias("block")).join(asked, ["bucket", "block"]).select("task", "side", "c", "comp")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE_WORDS, percent: int = PERCENT,
                    bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """For each row of docs: doc_id, n_shingles, component_id, kept (it has its component's smallest id)."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = materialize(signatures(plain, k, bands, band_rows), "signatures")
    able = marked.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = able.groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("rows"))
    classes = materialize(classes.withColumn("class_key", _class_key()), "classes")
    entries = classes.select("class_key", F.col("n_shingles").alias("n"), F.posexplode("bands").alias("pos", "key"))
    entries = entries.select(F.col("class_key").alias("c"), "n", F.xxhash64("pos", "key").alias("bucket"))
    crowds = materialize(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "bucket_sizes")
    members = materialize(join_hot(entries, crowds.select("bucket", F.col("rows").alias("size")), ["bucket"], "c", counts=crowds), "buckets")
    # The full sets of all classes that share a bucket; the smallest id of each class stands for its texts.
    popular = materialize(members.groupBy("c").agg(F.sum("size").alias("popularity")), "popularity")
    ids = materialize(classes.join(popular, F.col("class_key") == F.col("c"), "left_semi").select(F.col("rep").alias("doc_id")).distinct(), "candidate_ids")
    sets = materialize(_full_sets(plain.join(ids, "doc_id", "left_semi"), k).dropDuplicates(["class_key"]), "candidate_sets")
    pivots = members.join(popular, "c").groupBy("bucket").agg(F.max(F.struct("popularity", "c", "n")).alias("p")).select("bucket", F.col("p.c").alias("o"), F.col("p.n").alias("m"))
    pairs = join_hot(members, pivots, ["bucket"], "c", counts=crowds)
    # Sets of too different sizes can't reach the threshold.
    pairs = pairs.filter((F.col("o") != F.col("c")) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m")))
    links = _confirmed(materialize(pairs.select("c", "o").distinct(), "pivot_pairs"), sets, percent)
    found = materialize(connected_components(links), "components")
    placed = members.select("bucket", "c", "n").join(found, F.col("c") == F.col("node"), "left").select("bucket", "c", "n", F.coalesce("component", "c").alias("comp"))
    placed = materialize(placed, "placed")
    open_ = placed.groupBy("bucket").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).filter("c1 < c2").select("bucket", F.lit(True).alias("open"))
    mixed = materialize(join_hot(placed, open_, ["bucket"], "c", counts=crowds).drop("open"), "mixed_buckets")
    dealt = _compared(mixed).join(sets.select(F.col("class_key").alias("c"), "elements"), "c").select("task", "side", "c", "comp", "elements")
    dealt = dealt.repartition("task").sortWithinPartitions("task", "side")
    more = materialize(dealt.mapInArrow(lambda batches: _links_within(batches, percent), "a long, b long").distinct(), "block_links")
    found = materialize(connected_components(links.unionByName(more)), "components")
    placed = classes.select("class_key", "rep").join(found, F.col("class_key") == F.col("node"), "left").select("class_key", "rep", F.coalesce("component", "class_key").alias("comp"))
    placed = materialize(placed, "class_places")
    least = placed.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of_class = materialize(join_hot(placed, least, ["comp"], "class_key").select("class_key", F.col("component_id").alias("__comp")), "class_components")
    keyed = marked.select("doc_id", "n_shingles", _class_key().alias("class_key"))
    out = join_hot(keyed, of_class, ["class_key"], "doc_id", "left", counts=classes.select("class_key", "rows"))
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("__comp")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of docs without those that have a smaller id in their group; of rows with the same id all are kept."""
    verdict = near_duplicates(docs, doc_id, **options)
    gone = materialize(verdict.filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct(), "near_duplicates")
    return docs.join(gone, docs[doc_id] == F.col("__gone"), "left_anti")
