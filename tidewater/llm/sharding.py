"""Sharding by extendible hashing.

A document's key is a 60-bit hash of its id, followed by 60 bits of a hash of its text, which tell equal ids apart. Rows
that agree in both, and are too many bytes for one shard, are numbered and get 60 bits of a hash of that number instead.
So the shards' sizes and members don't depend on how the table is partitioned. A shard is a prefix of the key. The directory starts with the empty prefix; a bucket that holds more than `limit` bytes splits on the next bit,
and only such buckets split, until every bucket fits. A document that is larger than the limit by itself is a shard of
its own.

The directory is found from histograms: one aggregation counts bytes by the next STEP_BITS bits for the buckets that
are still too large, and all splits within those bits follow from it. No task holds a bucket. DataFrame functions only.

Defined cases: a null text has 0 bytes; a null id counts as an empty one, and ids that are equal as text are spread by
their texts; an empty table has no shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.skew import number_equal_rows
from tidewater.sources.work import materialize

LIMIT_BYTES = 1 << 20
STEP_BITS, HALF_BITS = 12, 60
#: A directory up to this many shards is broadcast to assign documents; a larger one is joined by a shuffle.
BROADCAST_SHARDS = 200_000


def id_bits(doc_id: Column) -> Column:
    """The first 60 bits of the id's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(depth: Column) -> list[Column]:
    """The first `depth` bits of a key (hi, lo) as two numbers."""
    hi = F.expr(f"shiftright(hi, {HALF_BITS} - least(depth, {HALF_BITS}))")
    lo = F.expr(f"shiftright(lo, {HALF_BITS} - greatest(depth - {HALF_BITS}, 0))")
    return [F.when(depth > 0, hi).otherwise(F.lit(0).cast("long")).alias("p_hi"), F.when(depth > HALF_BITS, lo).otherwise(F.lit(0).cast("long")).alias("p_lo")]


def _directory(keys: DataFrame, limit: int) -> DataFrame:
    """The shards of the keys (hi, lo, bytes): depth, p_hi, p_lo, n_docs, bytes."""
    spark = keys.sparkSession
    leaves, open_, depth = [], None, 0
    while depth < 2 * HALF_BITS:
        step = STEP_BITS
        members = keys.withColumn("depth", F.lit(depth))
        members = members.select("hi", "lo", "bytes", *_prefix(F.col("depth")))
        if open_ is not None:
            members = members.join(open_, ["p_hi", "p_lo"], "left_semi")
        fine = members.drop("p_hi", "p_lo").withColumn("depth", F.lit(depth + step))
        fine = fine.groupBy(*_prefix(F.col("depth"))).agg(F.min(F.struct("hi", "lo")).alias("k"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
        fine = fine.select(F.col("k.hi").alias("hi"), F.col("k.lo").alias("lo"), "bytes", "n")
        cells = fine.withColumn("depth", F.explode(F.sequence(F.lit(depth), F.lit(depth + step))))
        cells = cells.groupBy("depth", *_prefix(F.col("depth"))).agg(F.min(F.struct("hi", "lo")).alias("k"), F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        cells = materialize(cells.select("depth", "p_hi", "p_lo", F.col("k.hi").alias("hi"), F.col("k.lo").alias("lo"), "bytes", "n"), "shard_cells")
        parents = cells.filter(F.col("bytes") > limit).select(F.col("depth").alias("up"), F.col("p_hi").alias("up_hi"), F.col("p_lo").alias("up_lo"))
        fits = cells.filter(F.col("bytes") <= limit).withColumn("d", F.col("depth")).withColumn("depth", F.greatest(F.col("depth") - 1, F.lit(0)))
        fits = fits.select(*[c for c in fits.columns if c not in ("p_hi", "p_lo")], "p_hi", "p_lo", *[c.alias(f"up_of_{i}") for i, c in enumerate(_prefix(F.col("depth")))])
        below = fits.join(parents, (F.col("depth") == F.col("up")) & (F.col("up_of_0") == F.col("up_hi")) & (F.col("up_of_1") == F.col("up_lo")), "left")
        leaf = below.filter((F.col("up").isNotNull() & (F.col("d") > depth)) | (F.col("d") == 0))
        leaves.append(leaf.select(F.col("d").alias("depth"), "p_hi", "p_lo", F.col("n").alias("n_docs"), "bytes"))
        depth += step
        open_ = cells.filter((F.col("bytes") > limit) & (F.col("depth") == depth)).select("p_hi", "p_lo")
        if not open_.head(1):
            break
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return materialize(out, "shards")


def assign_shards(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT_BYTES) -> DataFrame:
    """For each document: doc_id, bytes, depth, shard_id, shard_docs and shard_bytes.

    shard_id is "depth:prefix", or "one:" and the key for a document over the limit by itself.
    """
    spare = lambda *what: F.shiftrightunsigned(F.xxhash64(*what), 64 - HALF_BITS)
    keys = docs.select(F.col(doc_id).alias("doc_id"), id_bits(F.col(doc_id)).alias("hi"), spare(F.lit(5), F.col(text)).alias("lo"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("bytes"))
    keys = materialize(keys, "shard_keys")
    heavy = materialize(keys.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("all")).filter((F.col("n") > 1) & (F.col("all") > limit)).select("hi", "lo"), "heavy_keys")
    n_heavy = heavy.count()
    if n_heavy:  # each holds over `limit` bytes
        heavy = F.broadcast(heavy) if n_heavy <= BROADCAST_SHARDS else heavy
        numbered = number_equal_rows(keys.join(heavy, ["hi", "lo"], "left_semi"), ["hi", "lo"], "place").withColumn("lo", spare(F.lit(7), "lo", "place")).drop("place")
        keys = materialize(keys.join(heavy, ["hi", "lo"], "left_anti").unionByName(numbered), "shard_keys")
    shared = keys.filter(F.col("bytes") <= limit)
    shards = _directory(shared.select("hi", "lo", "bytes"), limit)
    depths = [r[0] for r in shards.select("depth").distinct().collect()]  # at most 120 numbers
    n = shards.count()
    shards = shards.withColumnsRenamed({"bytes": "shard_bytes", "n_docs": "shard_docs"})
    tried = shared.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in sorted(depths)]) if depths else F.array().cast("array<int>")))
    tried = tried.select("doc_id", "bytes", "depth", *_prefix(F.col("depth")))
    placed = tried.join(F.broadcast(shards) if n <= BROADCAST_SHARDS else shards, ["depth", "p_hi", "p_lo"])
    name = F.concat_ws(":", "depth", F.concat(F.lpad(F.conv("p_hi", 10, 16), 15, "0"), F.when(F.col("depth") > HALF_BITS, F.concat(F.lit("."), F.conv("p_lo", 10, 16))).otherwise("")))
    placed = placed.select("doc_id", "bytes", F.col("depth").cast("long").alias("depth"), name.alias("shard_id"), "shard_docs", "shard_bytes")
    single = keys.filter(F.col("bytes") > limit).select(
        "doc_id", "bytes", F.lit(2 * HALF_BITS).cast("long").alias("depth"), F.concat_ws(":", F.lit("one"), F.conv("hi", 10, 16), F.conv("lo", 10, 16)).alias("shard_id"),
        F.lit(1).cast("long").alias("shard_docs"), F.col("bytes").alias("shard_bytes"))
    return placed.unionByName(single)
