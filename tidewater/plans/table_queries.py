"""Queries over the plain tables: recodes, filters, joins by day, ordered reports, unions, formats and lookups."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.operators import metrics, prompting, relational, windows
from tidewater.plans.catalog import query
from tidewater.plans.metric_queries import _auc_cte
from tidewater.plans.predictions import PREDS_SQL, long_predictions, predictions
from tidewater.sources.tables import table


@query("""
WITH o AS (SELECT o_orderstatus = 'F' AS late, o_orderpriority AS kind, date_trunc('month', o_orderdate) AS month, o_totalprice FROM orders)
SELECT month::TIMESTAMP AS month, count(*) AS n, least(greatest(round(avg(o_totalprice) / 500000, 8), 0.0), 1.0) AS level FROM o
WHERE (NOT late AND kind IN ('1-URGENT', '2-HIGH')) OR (late AND kind = '5-LOW') GROUP BY month
""")
def era_predicate(spark: SparkSession, folder: str) -> DataFrame:
    """One rule of kinds before a change and another after it; a level clamped to [0, 1]."""
    late = F.col("o_orderstatus") == "F"
    kept = table(spark, folder, "orders").filter((~late & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")) | (late & (F.col("o_orderpriority") == "5-LOW")))
    level = F.least(F.greatest(F.round(F.avg("o_totalprice") / 500000, 8), F.lit(0.0)), F.lit(1.0))
    return kept.groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg(F.count(F.lit(1)).alias("n"), level.alias("level"))


@query("""
SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE -1 END AS code,
  coalesce(CASE lower(CASE WHEN c_custkey % 5 = 0 THEN 'unknown' ELSE (c_acctbal > 0)::VARCHAR END) WHEN 'true' THEN 1 WHEN 'false' THEN 0 END, -1) AS flag,
  (c_nationkey % 3 = 2)::INT AS is_primary, c_acctbal > 5000 AS is_large, round_even(c_custkey / 8.0, 2)::DOUBLE AS eighth
FROM customer
""")
def recoded_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Recodes with -1 for unknown, truth values as text to nullable numbers, ordinals to flags, half-even rounding."""
    as_text = F.when(F.col("c_custkey") % 5 == 0, "unknown").otherwise((F.col("c_acctbal") > 0).cast("string"))
    return table(spark, folder, "customer").select(
        "c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", 0).when(F.col("c_mktsegment") == "MACHINERY", 1).otherwise(-1).alias("code"),
        F.coalesce(as_text.try_cast("boolean").cast("int"), F.lit(-1)).alias("flag"), (F.col("c_nationkey") % 3 == 2).cast("int").alias("is_primary"),
        (F.col("c_acctbal") > 5000).alias("is_large"), F.bround(F.col("c_custkey") / F.lit(8.0), 2).alias("eighth"))


@query("""
SELECT l_shipdate::DATE AS day, count(*) AS n_pairs, count(DISTINCT o_orderkey) AS n_orders, round(sum(l_quantity), 6) AS quantity
FROM lineitem JOIN orders ON date_trunc('day', l_shipdate) = date_trunc('day', o_orderdate) AND l_orderkey = o_orderkey GROUP BY day
""")
def same_day_join(spark: SparkSession, folder: str) -> DataFrame:
    """Lines shipped on the day their order was made."""
    lines = table(spark, folder, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    orders = table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("day"), "o_orderkey")
    return lines.join(orders, (lines["day"] == orders["day"]) & (F.col("l_orderkey") == F.col("o_orderkey"))).groupBy(lines["day"]).agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("o_orderkey").alias("n_orders"), F.round(F.sum("l_quantity"), 6).alias("quantity"))


@query("""
WITH a AS (SELECT l_suppkey, avg(year(l_shipdate)) AS year FROM lineitem GROUP BY l_suppkey)
SELECT s_suppkey, round(year - (1950 + s_suppkey % 40), 8) AS experience, s_acctbal FROM a JOIN supplier ON l_suppkey = s_suppkey
""")
def derived_dimension_join(spark: SparkSession, folder: str) -> DataFrame:
    """A measure from a fact's mean and a dimension's attribute."""
    mean = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.avg(F.year("l_shipdate")).alias("year"))
    return mean.join(table(spark, folder, "supplier"), "s_suppkey").select("s_suppkey", F.round(F.col("year") - (1950 + F.col("s_suppkey") % 40), 8).alias("experience"), "s_acctbal")


@query(f"""
WITH {PREDS_SQL}, {_auc_cte('a', 'long_preds', 'target, method, split')},
labelled AS (SELECT a.*, auc - 0.5 AS gain, CASE method WHEN 'tabular' THEN 0 WHEN 'nlp' THEN 1 WHEN 'finetune' THEN 2 ELSE 3 END AS place FROM a)
SELECT target, method, split, round(gain, 8) AS gain, row_number() OVER (ORDER BY (target <> 'toxic')::INT, place, split) AS by_category,
  CASE WHEN abs(gain) > 1e-9 THEN row_number() OVER (ORDER BY round(abs(gain), 8) DESC, target, method, split) END AS by_size FROM labelled
""")
def ordered_report(spark: SparkSession, folder: str) -> DataFrame:
    """Report rows by category order, one group after the other, and by absolute size; rows of no size have no place there."""
    scored = metrics.auc(long_predictions(spark, folder), ["target", "method", "split"], "y", "score").withColumn("gain", F.col("auc") - 0.5)
    place = reduce(lambda c, m: c.when(F.col("method") == m[1], m[0]), enumerate(["tabular", "nlp", "finetune"]), F.when(F.lit(False), -1)).otherwise(3)
    # A report has a row per target, method and split, however large the tables are.
    by_category = F.row_number().over(Window.orderBy((F.col("target") != "toxic").cast("int"), place, "split"))
    by_size = F.row_number().over(Window.orderBy(F.round(F.abs("gain"), 8).desc(), "target", "method", "split"))
    return scored.select("target", "method", "split", F.round("gain", 8).alias("gain"), by_category.cast("long").alias("by_category"), F.when(F.abs("gain") > 1e-9, by_size.cast("long")).alias("by_size"))


@query("""
SELECT 'customer' AS kind, c_custkey AS id, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_nationkey, s_acctbal, NULL FROM supplier
""")
def union_missing_columns(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    suppliers = table(spark, folder, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return customers.unionByName(suppliers, allowMissingColumns=True)


@query("""
WITH ids AS (SELECT o_custkey AS id FROM orders UNION SELECT user_id FROM events)
SELECT id, EXISTS (SELECT 1 FROM customer WHERE c_custkey = id) AS is_customer FROM ids
""")
def union_of_ids(spark: SparkSession, folder: str) -> DataFrame:
    """All ids of two tables once, and whether a third one knows them."""
    ids = table(spark, folder, "orders").select(F.col("o_custkey").alias("id")).unionByName(table(spark, folder, "events").select(F.col("user_id").alias("id"))).distinct()
    return relational.split_by_keys(ids, table(spark, folder, "customer").select(F.col("c_custkey").alias("id")), ["id"]).select("id", F.col("inside").alias("is_customer"))


@query(f"""
WITH {PREDS_SQL}, {_auc_cte('a', 'long_preds', 'target, method, split')},
d AS (SELECT a.target, a.method, a.split, a.auc - b.auc AS delta FROM a JOIN a b ON a.target = b.target AND a.split = b.split AND b.method = 'prompting' WHERE a.method <> 'prompting')
SELECT method, coalesce(target, 'overall') AS type, round(avg(delta), 8) AS mean, round(median(delta), 8) AS median, round(min(delta), 8) AS least, round(max(delta), 8) AS most, count(delta) AS n FROM d GROUP BY GROUPING SETS ((method, target), (method))
""")
def deltas_by_type(spark: SparkSession, folder: str) -> DataFrame:
    """Differences from the baseline method, per target and over all targets."""
    scored = metrics.auc(long_predictions(spark, folder), ["target", "method", "split"], "y", "score")
    base = scored.filter("method = 'prompting'").select("target", "split", F.col("auc").alias("base"))
    rows = scored.filter("method <> 'prompting'").join(base, ["target", "split"]).withColumn("delta", F.col("auc") - F.col("base"))
    rows = rows.withColumn("type", F.explode(F.array("target", F.lit("overall"))))
    stats = {"mean": F.avg("delta"), "median": F.median("delta"), "least": F.min("delta"), "most": F.max("delta")}
    return rows.groupBy("method", "type").agg(*[F.round(c, 8).alias(n) for n, c in stats.items()], F.count("delta").alias("n"))


@query("""
WITH w AS (SELECT *, coalesce((l_quantity - avg(l_quantity) OVER g) / nullif(stddev_samp(l_quantity) OVER g, 0), 0) AS zq, coalesce((l_extendedprice - avg(l_extendedprice) OVER g) / nullif(stddev_samp(l_extendedprice) OVER g, 0), 0) AS zp FROM lineitem WINDOW g AS (PARTITION BY l_suppkey))
SELECT l_suppkey, round(max(sqrt(zq * zq + zp * zp)), 6) AS farthest, round(avg(sqrt(zq * zq + zp * zp)), 6) AS mean_distance FROM w GROUP BY l_suppkey
""")
def joint_z(spark: SparkSession, folder: str) -> DataFrame:
    """Distance from the group's centre in two standardised columns."""
    rows = windows.zscore(windows.zscore(table(spark, folder, "lineitem"), ["l_suppkey"], "l_quantity", "zq"), ["l_suppkey"], "l_extendedprice", "zp")
    far = F.sqrt(F.col("zq") * F.col("zq") + F.col("zp") * F.col("zp"))
    return rows.groupBy("l_suppkey").agg(F.round(F.max(far), 6).alias("farthest"), F.round(F.avg(far), 6).alias("mean_distance"))


@query("""
WITH m AS (SELECT l_returnflag, l_linestatus, l_quantity, median(l_quantity) OVER (PARTITION BY l_linestatus) AS mid FROM lineitem)
SELECT l_linestatus, count(*) AS n, max(mid) AS mid, dense_rank() OVER (ORDER BY max(mid) DESC, l_linestatus) AS place FROM m GROUP BY l_linestatus
""")
def order_by_group_median(spark: SparkSession, folder: str) -> DataFrame:
    """Groups in the order of their medians; places are taken over the few groups."""
    mid = table(spark, folder, "lineitem").groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.median("l_quantity").alias("mid"))
    return mid.withColumn("place", F.dense_rank().over(Window.orderBy(F.col("mid").desc(), "l_linestatus")).cast("long"))


_ALIASES = {"view": "seen", "click": "used", "purchase": "bought"}


@query(f"""
WITH listed AS (SELECT user_id, '[' || string_agg('''' || event_type || '''', ', ' ORDER BY event_id) || ']' AS names FROM events GROUP BY user_id),
parsed AS (SELECT user_id, unnest(regexp_extract_all(names, '''([^'']*)''', 1)) AS name FROM listed)
SELECT user_id, coalesce(MAP {_ALIASES}[name], name) AS name, count(*) AS n FROM parsed GROUP BY ALL
""")
def alias_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Lists written as text, read again, their names resolved by a table of aliases."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: F.concat(F.lit("'"), x["event_type"], F.lit("'")))
    listed = table(spark, folder, "events").groupBy("user_id").agg(F.concat(F.lit("["), F.array_join(in_order, ", "), F.lit("]")).alias("names"))
    alias = F.create_map(*[F.lit(x) for pair in _ALIASES.items() for x in pair])
    names = F.transform(F.regexp_extract_all("names", F.lit("'([^']*)'"), F.lit(1)), lambda n: F.coalesce(F.try_element_at(alias, n), n))
    return listed.select("user_id", F.explode(names).alias("name")).groupBy("user_id", "name").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT l_discount, CASE WHEN l_discount >= 0.03 OR l_discount = 0 THEN printf('%.4f', l_discount) ELSE printf('%.1e', l_discount) END AS rate,
  rpad(printf('%.2f', l_discount), 8, ' ') || '|' || lpad(count(*)::VARCHAR, 7, ' ') AS line, count(*) || ' (' || printf('%.3f', 100.0 * count(*) / (SELECT count(*) FROM lineitem)) || ')' AS share
FROM lineitem GROUP BY l_discount
""")
def number_formats(spark: SparkSession, folder: str) -> DataFrame:
    """Small rates in scientific notation, others fixed; padded table text; counts with their share."""
    rows = table(spark, folder, "lineitem")
    counted = rows.groupBy("l_discount").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("all"))))
    rate = F.when((F.col("l_discount") >= 0.03) | (F.col("l_discount") == 0), F.format_string("%.4f", "l_discount")).otherwise(F.format_string("%.1e", "l_discount"))
    line = F.concat(F.rpad(F.format_string("%.2f", "l_discount"), 8, " "), F.lit("|"), F.lpad(F.col("n").cast("string"), 7, " "))
    return counted.select("l_discount", rate.alias("rate"), line.alias("line"), F.format_string("%d (%.3f)", "n", 100.0 * F.col("n") / F.col("all")).alias("share"))


@query("""
WITH r AS (SELECT conv_id, list(DISTINCT role) AS roles FROM conversations GROUP BY conv_id)
SELECT conv_id, list_contains(roles, 'user')::INT AS has_user, list_contains(roles, 'assistant')::INT AS has_assistant, list_contains(roles, 'system')::INT AS has_system FROM r
""")
def multi_hot_roles(spark: SparkSession, folder: str) -> DataFrame:
    roles = table(spark, folder, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))  # a few different roles
    return roles.select("conv_id", *[F.array_contains("roles", r).cast("int").alias(f"has_{r}") for r in ("user", "assistant", "system")])


@query("""
WITH w AS (SELECT toxic, unnest(regexp_extract_all(lower(text), '[\\p{L}]+')) AS word FROM documents JOIN labels USING (doc_id)),
c AS (SELECT word, count(*) FILTER (toxic = 1)::DOUBLE AS a, count(*) FILTER (toxic = 0)::DOUBLE AS b FROM w GROUP BY word HAVING count(*) FILTER (toxic = 1) > 0 AND count(*) FILTER (toxic = 0) > 0),
t AS (SELECT count(*) FILTER (toxic = 1)::DOUBLE AS a, count(*) FILTER (toxic = 0)::DOUBLE AS b FROM w)
SELECT word, round(c.a / t.a, 10) AS frequency_1, round(c.b / t.b, 10) AS frequency_0, round((c.a / t.a) / (c.b / t.b), 6) AS ratio FROM c, t
""")
def word_frequency_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """Words of two sets of texts, with the ratio of their frequencies; words of one set only are left out."""
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id").select("toxic", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0))).alias("word"))
    words = rows.groupBy("word").agg(F.count_if(F.col("toxic") == 1).cast("double").alias("a"), F.count_if(F.col("toxic") == 0).cast("double").alias("b"))
    whole = words.agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))
    shares = words.filter("a > 0 and b > 0").crossJoin(F.broadcast(whole)).withColumn("one", F.col("a") / F.col("all_a")).withColumn("zero", F.col("b") / F.col("all_b"))
    return shares.select("word", F.round("one", 10).alias("frequency_1"), F.round("zero", 10).alias("frequency_0"), F.round(F.col("one") / F.col("zero"), 6).alias("ratio"))


@query(f"""
WITH {PREDS_SQL}, places AS (SELECT doc_id, count(DISTINCT split) AS n_splits, min(split) AS split, count(*) AS n_rows FROM preds GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_splits, 0) AS n_splits, CASE WHEN n_splits = 1 THEN split END AS split, coalesce(n_rows, 0) AS n_rows FROM documents d LEFT JOIN places USING (doc_id)
""")
def unique_split_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """In which split each document is; none where it is in no split or in several."""
    found = predictions(spark, folder).groupBy("doc_id").agg(F.count_distinct("split").alias("n_splits"), F.min("split").alias("split"), F.count(F.lit(1)).alias("n_rows"))
    docs = table(spark, folder, "documents").select("doc_id").join(found, "doc_id", "left")
    return docs.select("doc_id", F.coalesce("n_splits", F.lit(0)).alias("n_splits"), F.when(F.col("n_splits") == 1, F.col("split")).alias("split"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


@query("""
WITH g AS (SELECT l_extendedprice, list_min(list_transform(range(0, 12), lambda i: {'gap': abs(l_extendedprice - 50 * 2 ^ i), 'value': 50 * 2 ^ i})).value AS nearest FROM lineitem)
SELECT nearest::DOUBLE AS nearest, count(*) AS n, round(avg(abs(l_extendedprice - nearest)), 6) AS mean_gap FROM g GROUP BY nearest
""")
def nearest_in_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Each price's nearest value of a geometric grid."""
    grid = F.array(*[F.lit(50.0 * 2**i) for i in range(12)])
    nearest = F.array_min(F.transform(grid, lambda v: F.struct(F.abs(F.col("l_extendedprice") - v).alias("gap"), v.alias("value"))))["value"]
    rows = table(spark, folder, "lineitem").select("l_extendedprice", nearest.alias("nearest"))
    return rows.groupBy("nearest").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("l_extendedprice") - F.col("nearest"))), 6).alias("mean_gap"))


@query(f"""
WITH {PREDS_SQL}, {_auc_cte('a', 'long_preds', 'target, method, split')}
SELECT split, target, (SELECT auc FROM a b WHERE b.target = a.target AND b.split = a.split AND b.method = 'nlp') IS NOT NULL AS known,
  round(greatest(min(auc) - 0.05, 0), 8) AS low, round(least(max(auc) + 0.05, 1), 8) AS high FROM a GROUP BY split, target
""")
def axis_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Least and greatest metric of all methods, widened and clamped; whether one method's row can be looked up."""
    scored = metrics.auc(long_predictions(spark, folder), ["target", "method", "split"], "y", "score")
    return scored.groupBy("split", "target").agg(
        F.coalesce(F.bool_or((F.col("method") == "nlp") & F.col("auc").isNotNull()), F.lit(False)).alias("known"),
        F.round(F.greatest(F.min("auc") - 0.05, F.lit(0.0)), 8).alias("low"), F.round(F.least(F.max("auc") + 0.05, F.lit(1.0)), 8).alias("high"))


@query("""
WITH n AS (SELECT text, count(*) AS n_docs, min(doc_id) AS first_doc FROM documents GROUP BY text)
SELECT first_doc, n_docs, length(text)::BIGINT AS size, len(regexp_extract_all(text, '[0-9]'))::BIGINT AS digits, len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS capitals FROM n
""")
def embedded_texts(spark: SparkSession, folder: str) -> DataFrame:
    """A text model (here counts of kinds of characters) run once for each distinct text, in batches."""

    def embed(batches):
        for batch in batches:  # counted in Arrow's buffers: texts become no Python objects and aren't sent back
            t = batch["text"]
            counts = (pc.utf8_length(t), pc.count_substring_regex(t, "[0-9]"), pc.count_substring_regex(t, "[A-Z]"))
            yield pa.RecordBatch.from_arrays([batch["__text_key"], *[c.cast(pa.int64()) for c in counts]], ["__text_key", "size", "digits", "capitals"])

    docs = table(spark, folder, "documents").select("doc_id", "text")
    whole = prompting.once_per_text(docs, "text", lambda d: d.mapInArrow(embed, "__text_key string, size long, digits long, capitals long"))
    return whole.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("k")).agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n_docs"), *[F.first(c).alias(c) for c in ("size", "digits", "capitals")]).drop("k")


@query("""
WITH w AS (SELECT doc_id, text, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS ws FROM documents)
SELECT doc_id, list_contains(ws, 'stupid') AS has_word, length(text) > 2000 AS is_long, CASE WHEN length(text) > 2000 THEN left(text, 20) || '...' ELSE left(text, 20) END AS head FROM w
""")
def shortened_texts(spark: SparkSession, folder: str) -> DataFrame:
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    head = F.substring("text", 1, 20)
    long = F.char_length("text") > 2000
    return table(spark, folder, "documents").select("doc_id", F.array_contains(words, "stupid").alias("has_word"), long.alias("is_long"), F.when(long, F.concat(head, F.lit("..."))).otherwise(head).alias("head"))
