"""Queries over result files, column names and short texts: path parameters, renames, intervals, dated prompts, word metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import rules, text
from tidewater.operators import prompting, reports
from tidewater.operators.textstats import word_metric_change as metric_change
from tidewater.plans.catalog import query
from tidewater.plans.predictions import PREDS_SQL, predictions
from tidewater.plans.text_queries import _SENTENCES_SQL, _UNIGRAMS_SQL, _clean_docs
from tidewater.sources import readers, sinks
from tidewater.sources.tables import table
from tidewater.sources.work import work_folder


@query(f"""
WITH {PREDS_SQL}, m AS (SELECT method, split, avg(score) AS mean, max(score) AS top FROM preds GROUP BY ALL)
SELECT split, round(any_value(mean) FILTER (method = 'nlp'), 8) AS nlp, round(any_value(mean) FILTER (method = 'tabular'), 8) AS tabular, round(any_value(top) FILTER (method = 'nlp'), 8) AS nlp_top FROM m GROUP BY split
""")
def result_file_scan(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of result files per method, split and metric; all read at once, their parameters taken from the paths, one row per split."""
    path = f"{work_folder(spark)}/tidewater-results-{uuid.uuid4().hex}"
    found = predictions(spark, folder).groupBy("method", "split").agg(F.avg("score").alias("mean"), F.max("score").alias("top"))
    tall = found.unpivot(["method", "split"], ["mean", "top"], "metric", "value").withColumn("run", F.concat_ws("_", "metric", "method", "split"))
    sinks.write_by(tall.select("run", "value"), path, ["run"])
    back = readers.read_many(spark, f"{path}/run=*", schema="value double")
    back = back.withColumns(readers.path_parameters(F.col("source_file"), {"split": -1, "method": -2})).withColumns(readers.name_parameters(F.col("source_file"), {"metric": "run=([a-z]+)_"}, -2))
    cell = lambda method, metric: F.round(F.max(F.when((F.col("method") == method) & (F.col("metric") == metric), F.col("value"))), 8)
    return back.groupBy("split").agg(cell("nlp", "mean").alias("nlp"), cell("tabular", "mean").alias("tabular"), cell("nlp", "top").alias("nlp_top"))


@query("""
SELECT o_orderkey AS order_key, o_custkey AS customer_key, o_orderdate AS order_date, o_orderdate AS seen_date, CASE WHEN o_orderstatus = 'F' THEN 'lab' WHEN o_orderstatus = 'O' THEN 'symptom' ELSE 'clinic' END AS category
FROM orders
""")
def column_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Columns picked by parts of their names, renamed by rules, a missing date copied from the other, absent columns dropped."""
    orders = rules.drop_if_present(table(spark, folder, "orders"), ["o_comment", "no_such_column"])
    picked = orders.select("o_orderstatus", *reports.columns_like(orders, contains=["key"], starts=["o_orderd"], without=["ship"]))
    named = reports.rename_by_rules(picked, [("o_orderkey", "order_key"), ("o_custkey", "customer_key"), ("o_orderdate", "order_date")])
    dated = rules.alias_if_missing(named, "order_date", "seen_date")
    return dated.select("order_key", "customer_key", "order_date", "seen_date", rules.target_category(F.col("o_orderstatus"), ["F"], ["O"]).alias("category"))


@query("""
WITH g AS (SELECT p_brand, min(p_retailprice) AS low, max(p_retailprice) AS high, count(*) AS n, (SELECT count(*) FROM part) AS whole, min(p_type) AS kind FROM part GROUP BY p_brand)
SELECT p_brand, round(low, 2) AS low, round(high, 2) AS high, n, round(100.0 * n / whole, 1) AS percent, CASE WHEN length(kind) > 18 THEN left(kind, 18) || '...' ELSE kind END AS kind FROM g
""")
def text_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Intervals, counts with shares and key=value lists written as text and read again; long labels are shortened."""
    part = table(spark, folder, "part")
    rows = part.groupBy("p_brand").agg(F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"), F.count(F.lit(1)).alias("n"), F.min("p_type").alias("kind")).crossJoin(F.broadcast(part.agg(F.count(F.lit(1)).alias("whole"))))
    shown = rows.select("p_brand", "kind", F.format_string("[%.2f,%.2f]", "low", "high").alias("span"), F.concat(F.lit("n="), "n", F.lit(",share="), F.round(100.0 * F.col("n") / F.col("whole"), 1)).alias("list"))
    low, high = text.parse_interval(F.col("span"))
    pairs = text.key_values(F.col("list"))
    return shown.select("p_brand", low.alias("low"), high.alias("high"), pairs["n"].try_cast("long").alias("n"), pairs["share"].try_cast("double").alias("percent"), text.shorten(F.col("kind")).alias("kind"))


@query("""
SELECT o_orderkey, 'Today is ' || strftime(o_orderdate, '%b %d, %Y') || '. Is order ' || o_orderkey || ' urgent?' || CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN chr(10) || chr(10) || 'Hint: ' || o_orderpriority ELSE '' END AS prompt FROM orders
""")
def dated_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts with the date put in, and a hint where there is one."""
    ask = F.concat(F.lit("Today is <DATE>. Is order "), F.col("o_orderkey").cast("string"), F.lit(" urgent?"))
    hint = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.concat(F.lit("Hint: "), "o_orderpriority"))
    return table(spark, folder, "orders").select("o_orderkey", prompting.assemble(ask, date=F.col("o_orderdate"), hint=hint).alias("prompt"))


@query(f"""
WITH {PREDS_SQL}, {_SENTENCES_SQL}, {_UNIGRAMS_SQL},
chosen AS (SELECT word, count(DISTINCT doc_id) AS n FROM unigrams WHERE NOT regexp_matches(word, '\\p{{N}}') GROUP BY word HAVING count(DISTINCT doc_id) >= 10),
p AS (SELECT doc_id, score, quality AS y FROM preds WHERE method = 'prompting'),
has AS (SELECT DISTINCT doc_id, word FROM unigrams),
d AS (SELECT c.word, c.n, p.*, h.doc_id IS NOT NULL AS inside FROM chosen c CROSS JOIN p LEFT JOIN has h ON h.word = c.word AND h.doc_id = p.doc_id),
r AS (SELECT *, rank() OVER (PARTITION BY word, inside ORDER BY score) + (count(*) OVER (PARTITION BY word, inside, score) - 1) / 2.0 AS mid FROM d),
a AS (SELECT word, inside, count(*) AS docs, sum(y)::DOUBLE AS k, sum(1 - y)::DOUBLE AS m, sum(mid) FILTER (y = 1) AS r, (count(*) FILTER (score >= 0.5 AND y = 0))::DOUBLE / nullif(count(*) FILTER (score >= 0.5), 0) AS fdr FROM r GROUP BY ALL),
v AS (SELECT word, inside, docs, CASE WHEN k * m > 0 THEN (r - k * (k + 1) / 2) / (k * m) END AS auc, fdr FROM a)
SELECT i.word, i.docs AS n_present, round(i.auc - o.auc, 8) AS change_in_auc, round(i.fdr - o.fdr, 8) AS change_in_fdr FROM v i JOIN v o ON i.word = o.word AND i.inside AND NOT o.inside WHERE o.docs >= 10
""")
def word_metric_change(spark: SparkSession, folder: str) -> DataFrame:
    """How AUC and false discovery rate differ between documents with and without a word."""
    scores = predictions(spark, folder).filter("method = 'prompting'").select("doc_id", "score", F.col("quality").alias("y"))
    return metric_change(_clean_docs(spark, folder), scores, "doc_id", "text", "y", "score", 10)
