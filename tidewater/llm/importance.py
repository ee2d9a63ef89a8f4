"""Resampling documents towards a target distribution by importance weights over hashed word runs.

Features are all runs of 1 to `max_words` consecutive words, hashed by crc32 into `buckets`. A bucket's gain is the
logarithm, in thousandths and rounded down, of how much likelier it is in the target texts than in the documents, with one
added to each count. A document's weight is the mean gain of its features, rounded down; noise of the Gumbel distribution,
taken from a hash of its id, turns the highest scores into a draw without replacement in proportion to the weights.

Gains are an array that each task scores its texts with. Which scores are drawn is found by distributed quickselect
(`quickselect.py`), and only the drawn rows are sorted and ranked. Both counts and scores read whole texts, a chunk of
an Arrow batch at a time; counting passes are one table of `buckets` numbers a task, on at most TASKS_PER_CORE tasks a core.

Defined cases: a null text has no words; a document without features has weight 0. A null id is hashed as `seed:` and comes
last among ties; rows that agree in score, id and number of features are alike, and any of them may be drawn. Repeated
rows count as documents each. Without target texts, or without documents, all counts are 0. Other columns aren't read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.quickselect import ranked, split_at
from tidewater.llm.textkernel import LOWER, Chunk, chunks
from tidewater.sources.tables import spread
from tidewater.sources.work import materialize

MAX_WORDS, BUCKETS, MIN_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
TASKS_PER_CORE = 4
#: Bytes of a word are 0-9, A-Z, a-z and all of the characters beyond ASCII.
WORD = np.array([chr(b).isalnum() or b > 127 for b in range(128)] + [True] * 128)
#: Longer spans are hashed one by one.
SHORT_BYTES = 48


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def crc32_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """crc32 of data[start:end] for each span, carried on from `state` (crc32 of what comes before it)."""
    state = np.zeros(len(start), np.uint32) if state is None else state.copy()
    long = np.flatnonzero(end - start > SHORT_BYTES)
    for i in long:
        state[i] = zlib.crc32(data[start[i] : end[i]], int(state[i]))
    active = np.flatnonzero((end > start) & (end - start <= SHORT_BYTES))
    now, at, stop = ~state[active], start[active], end[active]
    while len(active):
        now = _CRC[(now ^ data[at]) & 0xFF] ^ (now >> 8)
        at = at + 1
        done = at == stop
        state[active[done]] = ~now[done]
        go = ~done
        active, now, at, stop = active[go], now[go], at[go], stop[go]
    return state


def features(chunk: Chunk, max_words: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, row) of every feature of a chunk, and the number of words of each row."""
    data = LOWER[chunk.data]
    start, end, row = chunk.runs(WORD[data])
    state = crc32_spans(data, start, end)
    found = [(state % buckets, row)]
    space = np.frombuffer(b" ", np.uint8)
    for k in range(1, max_words):
        state, n = state[:-1], len(start) - k
        if n <= 0:
            break
        state = crc32_spans(space, np.zeros(n, np.int64), np.ones(n, np.int64), state)
        state = crc32_spans(data, start[k:], end[k:], state)
        same = row[:n] == row[k:]
        found.append(((state % buckets)[same], row[:n][same]))
    return np.concatenate([x[0] for x in found]).astype(np.int64), np.concatenate([x[1] for x in found]), np.bincount(row, minlength=chunk.rows)


def bucket_counts(texts: DataFrame, text: str, max_words: int = MAX_WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for c in chunks(batch.column(0)):
                total += np.bincount(features(c, max_words, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = spread(texts.select(text)).coalesce(TASKS_PER_CORE * texts.sparkSession.sparkContext.defaultParallelism)
    out = np.zeros(buckets, np.int64)
    for r in rows.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most `buckets` rows
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    s_all, t_all, n = float(source.sum()), float(target.sum()), float(len(source))
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(docs: DataFrame, gains: np.ndarray, doc_id: str = "doc_id", text: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each document."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                bucket, row, n_words = features(c, max_words, len(gains))
                n = np.bincount(row, minlength=c.rows)
                total = np.zeros(c.rows, np.int64)
                np.add.at(total, row, gains[bucket])
                mean = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, c.rows), pa.array(n_words), pa.array(n), pa.array(mean)], names)

    names = ["doc_id", "n_words", "n_features", "weight"]
    kind = docs.schema[doc_id].dataType.simpleString()
    return spread(docs.select(doc_id, text)).mapInArrow(score, f"doc_id {kind}, n_words long, n_features long, weight long")


def gumbel_score(weight: Column, doc_id: Column, seed: int = SEED) -> Column:
    """weight + floor(-1000 ln(-ln((h + 0.5) / 2^32))), h the first 32 bits of the sha256 of `seed:doc_id`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return weight + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", max_words: int = MAX_WORDS,
             buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Each document's doc_id, n_features, weight, score and rank (null where not drawn).

    Of the documents with at least `min_words` words, `percent` in a hundred (rounded down) are drawn.
    """
    gains = bucket_gains(bucket_counts(docs, text, max_words, buckets), bucket_counts(target, target_text, max_words, buckets))
    rows = weighted(docs, gains, doc_id, text, max_words).withColumn("score", gumbel_score(F.col("weight"), F.col("doc_id"), seed))
    keys = ["__least", "__no_id", "doc_id", "n_features", "__row"]
    rows = rows.withColumns({"__least": -F.col("score"), "__no_id": F.col("doc_id").isNull(), "__row": F.monotonically_increasing_id()})
    rows = materialize(rows, "importance")
    fit = rows.filter(F.col("n_words") >= min_words)
    drawn, rest = split_at(fit, keys, percent * fit.count() // 100)
    out = ["doc_id", "n_features", "weight", "score"]
    others = rest.unionByName(rows.filter(F.col("n_words") < min_words)).select(*out, F.lit(None).cast("long").alias("rank"))
    return ranked(drawn, keys).select(*out, "rank").unionByName(others)
