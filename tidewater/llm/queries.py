"""The queries of this subpackage and, where SQL can say the same, their SQL for DuckDB."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import embedding_dedup, importance, language_id, license_scan, line_dedup, minhash_dedup, mixing, packing, quality_rules, sharding, token_files, toxicity, whitening
from tidewater.sources.tables import table


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    out = quality_rules.apply_quality_rules(table(spark, folder, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rejected", "kept")


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    taken, sources = mixing.mix(table(spark, folder, "documents"), "source")
    return mixing.with_targets(taken, sources).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, folder, "documents"))


def op4_itq_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(table(spark, folder, "embeddings"))


def vocabulary() -> tuple[str, str]:
    """The byte-level BPE vocabulary of 50,257 ids, as ranks, and its pattern.

    Its ids are those of byte_bpe_50k.json (compared in tests/llm); ranks are read by a library that is faster here.
    """
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def added_tokens() -> dict[str, int]:
    """The texts that byte_bpe_50k.json takes as one token each, with their ids."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), *vocabulary(), with_ids=False, added=added_tokens())


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    out = toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", "plain", "misspelled", "quoted")


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign_shards(table(spark, folder, "documents"))


def op8_superminhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, folder, "documents"), k=2)


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = line_dedup.drop_common_lines(table(spark, folder, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(table(spark, folder, "documents"))


def op11_feast_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


def op12_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_token_files(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return token_files.read_documents(token_files.write_token_files(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_mixing, op3_license_scan, op4_itq_embeddings, op5_packing, op6_toxicity, op7_sharding, op8_superminhash, op9_line_dedup, op10_language_id,
                                   op11_feast_whitening, op12_importance_resampling, op13_token_files)}


_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
_SPACES = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) >= 2),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE trim(line, {_SPACES}) <> '' GROUP BY doc_id),
counted AS (
  SELECT d.doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN dups ON d.doc_id = dups.doc_id LEFT JOIN repeats ON d.doc_id = repeats.doc_id),
judged AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM counted),
hosts AS (SELECT source AS host, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM judged WHERE source IS NOT NULL GROUP BY source),
whole AS (SELECT sum(n) AS n, count(*) AS h, sum(f) / sum(n) AS m, sum(f * f / n) AS square FROM hosts),
prior AS (SELECT m, least(greatest(m * (1 - m) / greatest(square / n - m * m - m * (1 - m) * (h - 1) / n, 1e-9) - 1, 1.0), 10000.0) AS k FROM whole),
rates AS (SELECT host, (f + m * k) / (n + k) AS rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(rate > 0.7, false) AS host_rejected,
  NOT base_failed AND NOT coalesce(rate > 0.7, false) AS kept
FROM judged LEFT JOIN rates ON source = host
"""

OP7_SQL = """
WITH d AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h, coalesce(strlen(text), 0)::BIGINT AS bytes FROM documents),
cells AS (
  SELECT depth, h >> (60 - depth) AS p, sum(bytes)::BIGINT AS bytes, count(*) AS n
  FROM (SELECT *, unnest(range(0, 49)) AS depth FROM d WHERE bytes <= 1048576) GROUP BY ALL),
leaf AS (
  SELECT c.* FROM cells c LEFT JOIN cells u ON u.depth = c.depth - 1 AND u.p = c.p >> 1
  WHERE c.bytes <= 1048576 AND (c.depth = 0 OR u.bytes > 1048576))
SELECT doc_id, d.bytes, depth::BIGINT AS depth, depth || ':' || lpad(upper(to_hex(p)), 15, '0') AS shard_id, n AS shard_docs, leaf.bytes AS shard_bytes
FROM d JOIN leaf ON d.h >> (60 - depth) = p WHERE d.bytes <= 1048576
"""

OP9_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
keyed AS (SELECT *, trim({_ASCII_LOWER.format('line')}, {_SPACES}) AS k FROM lines),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT keyed.*, common.k IS NOT NULL AS gone FROM keyed LEFT JOIN common ON keyed.k = common.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_FOLDED = _ASCII_LOWER.format("coalesce(text, '')")
_FEATURES = f"unnest(regexp_extract_all({_FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'))"
_STEP = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"

OP12_SQL = f"""
WITH RECURSIVE crc(i, k, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, {_STEP} FROM crc WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
found AS (SELECT rowid AS r, {_FEATURES} AS w FROM (SELECT row_number() OVER () AS rowid, text FROM documents)),
mine AS (SELECT w, count(*) AS n FROM found GROUP BY w),
theirs AS (SELECT w, count(*) AS n FROM (SELECT {_FEATURES} AS w FROM benchmark) GROUP BY w),
coded AS (
  SELECT w, list_concat([4294967295::BIGINT], list_transform(range(1, length(hex(encode(w))), 2), lambda i: ('0x' || substr(hex(encode(w)), i, 2))::BIGINT)) AS b
  FROM (SELECT w FROM mine UNION SELECT w FROM theirs)),
bucketed AS (SELECT w, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM coded, tab),
s AS (SELECT bucket, sum(n)::DOUBLE AS s FROM mine JOIN bucketed USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::DOUBLE AS t FROM theirs JOIN bucketed USING (w) GROUP BY bucket),
whole AS (SELECT coalesce((SELECT sum(s) FROM s), 0) AS s_all, coalesce((SELECT sum(t) FROM t), 0) AS t_all),
gains AS (
  SELECT w, floor(1000 * ln((coalesce(t, 0) + 1) * (s_all + 10000) / ((coalesce(s, 0) + 1) * (t_all + 10000))))::BIGINT AS gain
  FROM bucketed LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), whole),
summed AS (SELECT r, count(*) AS n, sum(gain) AS total FROM found JOIN gains USING (w) GROUP BY r),
scored AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(total // n - CASE WHEN total % n < 0 THEN 1 ELSE 0 END, 0)::BIGINT AS weight,
    ('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT AS h
  FROM (SELECT row_number() OVER () AS r, doc_id FROM documents) LEFT JOIN summed USING (r)),
final AS (SELECT doc_id, n_features, weight, (weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE))))::BIGINT AS score FROM scored),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM final WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END::BIGINT AS rank FROM final LEFT JOIN drawn USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1_SQL, "op7_sharding": OP7_SQL, "op9_line_dedup": OP9_SQL, "op12_importance_resampling": OP12_SQL}
