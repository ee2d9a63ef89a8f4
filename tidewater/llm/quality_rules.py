"""Quality rules for documents, and verdicts for the hosts they come from.

Every whole text gets counts and a base verdict. Base failures are aggregated by host; a host's failure rate is shrunk
towards the corpus with a beta prior fitted to the hosts (method of moments), so that a host with few documents is
judged mostly by the corpus. A host whose shrunk rate is over `max_host_rate` loses all its documents.

Defined cases: a null text is an empty one (no words: base_failed). A document with a null host belongs to no host and
keeps its base verdict. Repeated rows count as often as they occur and each gets its row. An empty table gives an empty
result. Columns of the input other than the named ones are ignored. The counts compare words and lines by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.textkernel import SPACE, Chunk, chunks, mix, window_hashes
from tidewater.sources.work import materialize

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, REPEAT_WORDS, MAX_REPEAT_PERCENT = 20, 8, 30
#: A host goes when over this share of its documents fails, after shrinking.
MAX_HOST_RATE = 0.7
#: A table of rejected hosts up to this many rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_HOSTS = 100_000

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    flags = np.zeros(len(keys), bool)
    flags[order[1:][same]] = True
    flags[order[:-1][same]] = True
    return flags


def text_counts(chunk: Chunk) -> dict[str, np.ndarray]:
    """The counts of each row of a chunk."""
    data, rows = chunk.data, chunk.rows
    start, end, row = chunk.words()
    prefix = chunk.prefix_hash(lower=False)
    out = {
        "n_words": np.bincount(row, minlength=rows),
        "word_chars": chunk.per_row(~SPACE[data] & ((data & 0xC0) != 0x80)),
        "n_symbols": chunk.per_row(_IS_SYMBOL[data]),
    }
    hashes = chunk.hash_spans(prefix, start, end)
    windows, at = window_hashes(hashes, row, REPEAT_WORDS)
    found = at[_repeated(mix(windows + row[at].astype(np.uint64)))] if len(at) else at
    steps = np.zeros(len(row) + 1, np.int64)
    np.add.at(steps, found, 1)
    np.add.at(steps, found + REPEAT_WORDS, -1)
    out["n_repeat_words"] = np.bincount(row[np.cumsum(steps[:-1]) > 0], minlength=rows)
    # Lines start at a text's start and after each newline; those without a word don't count.
    feeds = np.flatnonzero(data == 0x0A)
    line_start = np.sort(np.concatenate([chunk.offsets[:-1][chunk.offsets[1:] > chunk.offsets[:-1]], feeds + 1]))
    line_start = np.unique(line_start[line_start < len(data)])
    line_row = chunk.row_of(line_start)
    line_end = np.minimum(chunk.offsets[line_row + 1], np.append(line_start[1:], len(data)))
    line_end = np.where((line_end > line_start) & (data[np.maximum(line_end - 1, 0)] == 0x0A), line_end - 1, line_end)
    words_before = np.searchsorted(start, line_start), np.searchsorted(start, line_end)
    solid = words_before[1] > words_before[0]
    line_row = line_row[solid]
    keys = mix(chunk.hash_spans(prefix, line_start[solid], line_end[solid]) + line_row.astype(np.uint64))
    _, first = np.unique(keys, return_index=True)
    out["n_dup_lines"] = np.bincount(line_row, minlength=rows) - np.bincount(line_row[first], minlength=rows)
    return out


def with_counts(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """`columns` of `docs` and the counts of the column `text`."""
    plain = docs.select(*columns, F.col(text).alias("__text"))
    schema = ", ".join([*(f"`{c}` {plain.schema[c].dataType.simpleString()}" for c in columns), *(f"{c} long" for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [text_counts(c) for c in chunks(batch.column(len(columns)))]
            counts = [pa.array(np.concatenate([p[c] for p in parts]) if parts else [], pa.int64()) for c in COUNTS]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *counts], [*columns, *COUNTS])

    return plain.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def host_verdicts(judged: DataFrame, host: str, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row for each non-null host of `judged`, which has a boolean base_failed: its counts, rates and verdict.

    With m = failures / documents over all hosts and H hosts, the variance of the hosts' rates beyond sampling gives
    the prior's weight k = m (1 - m) / variance - 1, held between 1 and 10,000; the shrunk rate is
    (failures + m k) / (documents + k).
    """
    hosts = judged.filter(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    return _judged_hosts(hosts, max_host_rate)


def _judged_hosts(hosts: DataFrame, max_host_rate: float) -> DataFrame:
    n, k = F.col("n_docs").cast("double"), F.col("n_failed").cast("double")
    whole = hosts.agg(F.sum(n).alias("n"), F.count(F.lit(1)).alias("h"), F.sum(k).alias("f"), F.sum(k * k / n).alias("square")).first()  # one row
    mean, weight = beta_prior(whole["n"] or 0.0, whole["h"], whole["f"] or 0.0, whole["square"] or 0.0)
    rate = (k + mean * weight) / (n + weight)
    return hosts.select("host", "n_docs", "n_failed", rate.alias("host_rate"), (rate > max_host_rate).alias("host_rejected"))


def beta_prior(n: float, hosts: int, failures: float, square: float) -> tuple[float, float]:
    """(mean, weight) of the prior from the sums over hosts: documents, hosts, failures, and failures^2 / documents."""
    if not n:
        return 0.0, 1.0
    m = failures / n
    excess = max(square / n - m * m - m * (1 - m) * (hosts - 1) / n, 1e-9)
    return m, min(max(m * (1 - m) / excess - 1, 1.0), 10000.0)


def _rejected_hosts(judged: DataFrame, host: str, max_host_rate: float) -> DataFrame:
    """The rejected hosts as a stored table, marked for broadcast if it is known to be small."""
    bad = materialize(host_verdicts(judged, host, max_host_rate).filter("host_rejected").select(F.col("host").alias("__bad")), "rejected_hosts")
    return F.broadcast(bad) if bad.count() <= BROADCAST_HOSTS else bad


def apply_quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """For each document: its id, host, counts, base_failed, host_rejected and kept."""
    keys = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text"))
    judged = materialize(with_counts(keys, ["doc_id", "host"]).withColumn("base_failed", base_failed()), "quality")
    bad = _rejected_hosts(judged, "host", max_host_rate)
    joined = judged.join(bad, F.col("host") == F.col("__bad"), "left").withColumn("host_rejected", F.col("__bad").isNotNull()).drop("__bad")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def keep_good_documents(docs: DataFrame, text: str = "text", host: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of `docs` that pass, with all their columns and nothing else.

    Texts are scanned once: rows that pass the base rules are stored, and a host's failures are its rows without them.
    """
    columns = docs.columns
    inner = docs.toDF(*[f"__c{i}" for i in range(len(columns))])
    at = {c: f"__c{i}" for i, c in enumerate(columns)}
    good = materialize(with_counts(inner, inner.columns, at[text]).filter(~base_failed()).select(*inner.columns), "base_passed")
    hosts = inner.select(F.col(at[host]).alias("__host"), F.lit(1).alias("all"), F.lit(0).alias("good")).unionByName(good.select(F.col(at[host]).alias("__host"), F.lit(0).alias("all"), F.lit(1).alias("good")))
    hosts = hosts.filter(F.col("__host").isNotNull()).groupBy(F.col("__host").alias("host")).agg(F.sum("all").alias("n_docs"), (F.sum("all") - F.sum("good")).alias("n_failed"))
    bad = materialize(_judged_hosts(hosts, max_host_rate).filter("host_rejected").select(F.col("host").alias("__bad")), "rejected_hosts")
    n = bad.count()
    kept = good.join(F.broadcast(bad) if n <= BROADCAST_HOSTS else bad, F.col(at[host]) == F.col("__bad"), "left_anti") if n else good
    return kept.toDF(*columns)
