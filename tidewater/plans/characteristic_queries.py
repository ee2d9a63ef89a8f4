"""Queries of cohort characteristics by split, and of bootstraps over rows that a threshold admits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import characteristics as ch
from tidewater.operators import eligibility as el
from tidewater.operators import metrics
from tidewater.plans.catalog import query
from tidewater.plans.metric_queries import REPS, _auc_cte, _boot_cte
from tidewater.plans.predictions import PREDS_SQL, long_predictions
from tidewater.sources.tables import table
from tidewater.sources.work import materialize

#: Splits of the cohort: by date inside the domain, and by a group of nations outside of it.
SPLIT_DATE = "1997-01-01"
SPLITS = ("training", "temporal", "outside", "outside_known", "outside_new")
_INSIDE, _KNOWN = 15, 20
BLOCKS = ("size", "flag", "event", "segment", "brand")

_SPLIT_SQL = f"""
people AS (SELECT o_orderkey, o_custkey, floor(o_totalprice) AS price, (c_acctbal > 4000)::INT AS rich, c_mktsegment AS segment,
    CASE o_orderstatus WHEN 'P' THEN -1 WHEN 'F' THEN 1 ELSE 0 END AS final, CASE o_orderpriority WHEN '5-LOW' THEN -1 WHEN '1-URGENT' THEN 1 ELSE 0 END AS urgent,
    list_filter([CASE WHEN c_nationkey < {_INSIDE} AND o_orderdate <= TIMESTAMP '{SPLIT_DATE}' THEN 'training' END, CASE WHEN c_nationkey < {_INSIDE} AND o_orderdate > TIMESTAMP '{SPLIT_DATE}' THEN 'temporal' END,
      CASE WHEN c_nationkey >= {_INSIDE} THEN 'outside' END, CASE WHEN c_nationkey >= {_INSIDE} AND c_nationkey < {_KNOWN} THEN 'outside_known' END, CASE WHEN c_nationkey >= {_KNOWN} THEN 'outside_new' END], lambda x: x IS NOT NULL) AS splits
  FROM orders JOIN customer ON o_custkey = c_custkey),
s AS (SELECT * EXCLUDE (splits), unnest(splits) AS split FROM people),
drugs AS (SELECT DISTINCT split, o_custkey, p_brand AS brand FROM s JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
seg_n AS (SELECT split, segment AS name, count(*) AS n FROM s WHERE segment IS NOT NULL GROUP BY ALL),
seg_w AS (SELECT split, count(DISTINCT o_custkey) AS w FROM s GROUP BY ALL),
brand_n AS (SELECT split, brand AS name, count(DISTINCT o_custkey) AS n FROM drugs WHERE brand IS NOT NULL GROUP BY ALL),
brand_w AS (SELECT split, count(DISTINCT o_custkey) AS w FROM drugs GROUP BY ALL),
parts AS (
  SELECT split, 'flag' AS block, 'rich' AS name, count(*) FILTER (rich = 1) AS n, count(*) AS w, 0 AS place FROM s GROUP BY split
  UNION ALL SELECT split, 'event', 'final', count(*) FILTER (final = 1), count(*) FILTER (final <> -1), 0 FROM s GROUP BY split
  UNION ALL SELECT split, 'event', 'urgent', count(*) FILTER (urgent = 1), count(*) FILTER (urgent <> -1), 1 FROM s GROUP BY split
  UNION ALL SELECT split, 'segment', name, n, w, -coalesce((SELECT t.n FROM seg_n t WHERE t.name = seg_n.name AND t.split = 'training'), 0) FROM seg_n JOIN seg_w USING (split)
  UNION ALL SELECT split, 'brand', name, n, w, -coalesce((SELECT t.n FROM brand_n t WHERE t.name = brand_n.name AND t.split = 'training'), 0) FROM brand_n JOIN brand_w USING (split))"""

_SHOWN_SQL = """
cells AS (SELECT split, block, name, place, format('{:,} ({:d}.{:02d})', n::BIGINT, coalesce((20000 * n + w) // nullif(2 * w, 0), 0)::BIGINT // 100, coalesce((20000 * n + w) // nullif(2 * w, 0), 0)::BIGINT % 100) AS shown FROM parts
  UNION ALL SELECT split, 'size', 'price, median (IQR)', 0, printf('%.2f (%.2f-%.2f)', quantile_cont(price, 0.5), quantile_cont(price, 0.25), quantile_cont(price, 0.75)) FROM s GROUP BY split)"""

_WIDE_SQL = f"""
SELECT row_number() OVER (ORDER BY list_position({list(BLOCKS)}, block), place, name) AS line, block, name, {', '.join(f"coalesce(max(shown) FILTER (split = '{x}'), '0 (0)') AS {x}" for x in SPLITS)}
FROM cells GROUP BY block, name, place"""


def _cohort(spark: SparkSession, folder: str) -> DataFrame:
    """An order once for each of its splits, with what the characteristics need: joined once for all blocks of lines."""
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") > 4000).cast("int").alias("rich"), F.col("c_mktsegment").alias("segment"), "c_nationkey")
    rows = table(spark, folder, "orders").join(customers, "o_custkey")
    final = F.when(F.col("o_orderstatus") == "P", -1).when(F.col("o_orderstatus") == "F", 1).otherwise(0)
    urgent = F.when(F.col("o_orderpriority") == "5-LOW", -1).when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)
    nation, late = F.col("c_nationkey"), F.col("o_orderdate") > F.lit(SPLIT_DATE).cast("timestamp_ntz")
    parts = {"training": (nation < _INSIDE) & ~late, "temporal": (nation < _INSIDE) & late, "outside": nation >= _INSIDE, "outside_known": (nation >= _INSIDE) & (nation < _KNOWN), "outside_new": nation >= _KNOWN}
    rows = rows.select("o_orderkey", "o_custkey", F.floor("o_totalprice").alias("price"), "rich", "segment", final.alias("final"), urgent.alias("urgent"), "c_nationkey", "o_orderdate")
    return materialize(el.in_parts(rows, parts, "split").drop("c_nationkey", "o_orderdate"), "cohort")


def _bought(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    """Each split's different pairs of a customer and a brand."""
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    brands = table(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("brand"))
    pairs = rows.select("split", "o_orderkey", "o_custkey").join(lines, "o_orderkey").join(brands, "p_partkey").select("split", "o_custkey", "brand").distinct()
    return materialize(pairs, "bought")


def _plain_lines(rows: DataFrame) -> list[DataFrame]:
    return [
        ch.medians(rows, "size", {"price, median (IQR)": F.col("price")}),
        ch.shares(rows, "flag", {"rich": F.col("rich")}),
        ch.shares(rows, "event", {"final": F.col("final"), "urgent": F.col("urgent")}, missing=-1)]


@query(f"WITH {_SPLIT_SQL}, {_SHOWN_SQL} {_WIDE_SQL}")
def characteristics_table(spark: SparkSession, folder: str) -> DataFrame:
    """Five splits by size, flag, observed events, all segments and all brands; names by their count in the first split."""
    rows = _cohort(spark, folder)
    lines = [*_plain_lines(rows), ch.categories(rows, "segment", "o_custkey", "segment", SPLITS[0]), ch.categories(_bought(spark, folder, rows), "brand", "o_custkey", "brand", SPLITS[0], by_key=True)]
    return ch.by_split(lines, BLOCKS, SPLITS)


@query(f"""
WITH {_SPLIT_SQL.replace('parts AS (', 'all_parts AS (')},
top_segments AS (SELECT DISTINCT name FROM (SELECT split, name FROM seg_n WHERE split IN ('training', 'temporal', 'outside') QUALIFY row_number() OVER (PARTITION BY split ORDER BY n DESC, name) <= 3)),
top_brands AS (SELECT name FROM brand_n WHERE split = 'training' ORDER BY n DESC, name LIMIT 3),
parts AS (SELECT * FROM all_parts WHERE block NOT IN ('segment', 'brand') OR (block = 'segment' AND name IN (FROM top_segments)) OR (block = 'brand' AND name IN (FROM top_brands))
  UNION ALL SELECT split, 'segment', 'Other', count(DISTINCT o_custkey) FILTER (segment IS NULL OR segment NOT IN (FROM top_segments)), count(DISTINCT o_custkey), 2147483647 FROM s GROUP BY split
  UNION ALL SELECT split, 'brand', 'Other', count(DISTINCT o_custkey) FILTER (brand IS NULL OR brand NOT IN (FROM top_brands)), count(DISTINCT o_custkey), 2147483647 FROM drugs GROUP BY split),
{_SHOWN_SQL} {_WIDE_SQL}
""")
def characteristics_top(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the three greatest segments of three splits, the three greatest brands of the first, and the rest as Other."""
    rows = _cohort(spark, folder)
    bought = _bought(spark, folder, rows)
    segments, brands = ch.top_names(rows, "o_custkey", "segment", SPLITS[:3], 3), ch.top_names(bought, "o_custkey", "brand", SPLITS[:1], 3, by_key=True)
    lines = _plain_lines(rows)
    for block, of, top, by_key in (("segment", rows, segments, False), ("brand", bought, brands, True)):
        lines += [ch.categories(of, block, "o_custkey", block, SPLITS[0], by_key).join(F.broadcast(top), "name", "left_semi"), ch.others(of, block, "o_custkey", block, top)]
    return ch.by_split(lines, BLOCKS, SPLITS)


#: A text must have a size for its label to count.
LIMITS = (el.Limit("toxic", "n_chars", True, 500), el.Limit("quality", "n_chars", False, 4000))
PARTS, PAIRS = ("test", "later", "later_en", "later_other"), (("later", "test"), ("later_en", "later_other"))

_LIMIT_SQL = "CASE target WHEN 'toxic' THEN n_chars >= 500 ELSE n_chars <= 4000 END"


@query(f"""
WITH t AS (SELECT doc_id, n_chars, unnest(['toxic', 'quality']) AS target, unnest([toxic, quality]) AS y FROM labels JOIN documents USING (doc_id)),
c AS (SELECT target, count(*) AS n_before, count(*) FILTER ({_LIMIT_SQL}) AS n_after FROM t WHERE y IS DISTINCT FROM -1 GROUP BY target)
SELECT target, 'n_chars' AS value, CASE target WHEN 'toxic' THEN '>=' ELSE '<=' END AS criterion, CASE target WHEN 'toxic' THEN 500.0 ELSE 4000.0 END::DOUBLE AS threshold, n_before, n_before - n_after AS n_dropped, n_after FROM c
""")
def eligibility_by_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """Observed rows of each target, and how many its threshold drops."""
    return el.eligibility(_measured(spark, folder), LIMITS)


def _measured(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "n_chars", "lang"), "doc_id")


@query(f"""
WITH {PREDS_SQL},
met AS (SELECT p.*, lang FROM long_preds p JOIN documents USING (doc_id) WHERE y <> -1 AND {_LIMIT_SQL} AND split <> 'split0'),
kept AS (SELECT * EXCLUDE (lang), unnest(CASE WHEN split = 'split1' THEN ['test'] WHEN lang = 'en' THEN ['later', 'later_en'] ELSE ['later', 'later_other'] END) AS part FROM met),
{_auc_cte('a', 'kept', 'target, method, part')}, {_boot_cte('b', 'kept', 'target, method, part', 9)},
wide AS (SELECT target, method, rep, {', '.join(f"max(auc) FILTER (part = '{p}') AS {p}" for p in PARTS)} FROM (SELECT *, -1 AS rep FROM a UNION ALL SELECT target, method, part, auc, rep FROM b) GROUP BY ALL),
tall AS (SELECT target, method, rep, unnest({[*PARTS, *(f'{a}_minus_{b}' for a, b in PAIRS)]}) AS part, unnest([{', '.join([*PARTS, *(f'{a} - {b}' for a, b in PAIRS)])}]) AS auc FROM wide)
SELECT target, method, part, round(max(auc) FILTER (rep = -1), 8) AS auc, round(quantile_cont(auc, 0.025) FILTER (rep >= 0), 8) AS lo, round(quantile_cont(auc, 0.975) FILTER (rep >= 0), 8) AS hi, count(auc) FILTER (rep >= 0) AS n_reps FROM tall GROUP BY ALL
""")
def boot_by_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """Bootstrap of the evaluation parts and their differences over the rows that each target's threshold admits."""
    measured, group = _measured(spark, folder), ["target", "method"]
    rows = long_predictions(spark, folder).filter("split <> 'split0'").join(el.eligible_keys(measured, ["doc_id"], LIMITS), ["doc_id", "target"], "left_semi")
    rows = rows.join(measured.select("doc_id", "lang"), "doc_id")
    later, en = F.col("split") == "split2", F.coalesce(F.col("lang") == "en", F.lit(False))
    rows = el.in_parts(rows, {"test": F.col("split") == "split1", "later": later, "later_en": later & en, "later_other": later & ~en})
    reps = metrics.bootstrap_auc(rows, [*group, "part"], "doc_id", "y", "score", REPS, seed=9)
    reps = el.with_differences(reps, [*group, "rep"], "part", "auc", PARTS, PAIRS)
    bounds = reps.groupBy(*group, "part").agg(F.percentile("auc", F.lit(0.025)).alias("lo"), F.percentile("auc", F.lit(0.975)).alias("hi"), F.count("auc").alias("n_reps"))
    point = el.with_differences(metrics.auc(rows, [*group, "part"], "y", "score").select(*group, "part", "auc"), group, "part", "auc", PARTS, PAIRS)
    return point.join(bounds, [*group, "part"]).select(*group, "part", *[F.round(c, 8).alias(c) for c in ("auc", "lo", "hi")], "n_reps")
