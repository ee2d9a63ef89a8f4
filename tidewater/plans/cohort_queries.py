"""Queries over events, orders and line items: anchoring, relational and window operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions import rules, text
from tidewater.operators import relational, windows
from tidewater.operators.asof import asof_lookback
from tidewater.operators.thinning import thin_by_gap
from tidewater.plans.catalog import query
from tidewater.sources.tables import table

#: Rules by which part types are grouped; the first part that occurs wins.
TYPE_RULES = (("steel", "metal"), (("brass", "copper"), "alloy"), ("tin", "soft metal"))


@query("""
SELECT p.event_id, p.user_id, arg_max(v.event_id, v.ts) AS last_view, count(v.event_id) > 0 AS has_view
FROM events p LEFT JOIN events v ON v.user_id = p.user_id AND v.event_type = 'view' AND v.ts < p.ts AND v.ts >= p.ts - INTERVAL 24 HOUR
WHERE p.event_type = 'purchase' GROUP BY p.event_id, p.user_id
""")
def asof_lookback_last(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    purchases = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = events.filter("event_type = 'view'").select("event_id", "user_id", "ts")
    out = asof_lookback(purchases, views, "user_id", "ts", "ts", "event_id", 24 * 3600)
    return out.select("event_id", "user_id", F.col("last.event_id").alias("last_view"), F.col("last").isNotNull().alias("has_view"))


@query("""
SELECT conv_id, string_agg(role || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS note, max(turn)::BIGINT AS last_turn, list_sort(list_distinct(list(role))) AS roles
FROM conversations GROUP BY conv_id
""")
def notes_by_day_concat(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").withColumn("line", F.concat("role", F.lit(":\n"), "text"))
    note = relational.text_by_key(turns, ["conv_id"], "turn", "line", "\n\n")
    return turns.groupBy("conv_id").agg(note.alias("note"), F.max("turn").alias("last_turn"), F.array_sort(F.collect_set("role")).alias("roles"))


@query("""
WITH f AS (SELECT conv_id, text AS first_text, role AS first_role FROM conversations WHERE role <> 'system' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1)
SELECT c.conv_id, turn, CASE WHEN c.text = first_text THEN c.text ELSE first_text || chr(10) || chr(10) || c.text END AS note,
  CASE WHEN c.text = first_text OR c.role = first_role THEN [c.role] ELSE [c.role, first_role] END AS roles
FROM conversations c JOIN f USING (conv_id)
""")
def first_note_append(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    first = relational.extreme_row(turns.filter(~F.arrays_overlap(F.array("role"), F.array(F.lit("system")))).select("conv_id", "turn", "text", "role"), ["conv_id"], ["turn"])
    first = first.select("conv_id", F.col("text").alias("first_text"), F.col("role").alias("first_role"))
    joined = turns.join(first, "conv_id")
    same = F.col("text") == F.col("first_text")
    note = F.when(same, F.col("text")).otherwise(F.concat("first_text", F.lit("\n\n"), "text"))
    roles = F.when(same, F.array("role")).otherwise(relational.ordered_union(F.array("role"), F.array("first_role")))
    return joined.select("conv_id", "turn", note.alias("note"), roles.alias("roles"))


@query("""
WITH k AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 200000)
SELECT c_mktsegment, EXISTS (SELECT 1 FROM k WHERE o_custkey = c_custkey) AS inside, count(*) AS n, round(avg(c_acctbal), 4) AS mean_balance FROM customer GROUP BY ALL
""")
def pk_semi_anti_partition(spark: SparkSession, folder: str) -> DataFrame:
    keys = table(spark, folder, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    marked = relational.split_by_keys(table(spark, folder, "customer"), keys, ["c_custkey"])
    return marked.groupBy("c_mktsegment", "inside").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean_balance"))


@query("""
WITH d AS (SELECT l_orderkey, p_name || ' (' || l_quantity::BIGINT || 'mg)' AS dose FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT o_orderkey, coalesce(string_agg(dose, ', ' ORDER BY dose), 'not available') AS doses FROM orders LEFT JOIN d ON l_orderkey = o_orderkey GROUP BY o_orderkey
""")
def drug_dose_concat(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select("p_partkey", "p_name")
    given = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(part, F.col("l_partkey") == F.col("p_partkey"))
    dose = F.concat("p_name", F.lit(" ("), F.col("l_quantity").cast("long").cast("string"), F.lit("mg)"))
    doses = given.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.array_sort(F.collect_list(dose)), ", ").alias("doses"))
    return table(spark, folder, "orders").select("o_orderkey").join(doses, "o_orderkey", "left").withColumn("doses", F.coalesce("doses", F.lit("not available")))


@query("""
SELECT p_partkey, CASE WHEN contains(lower(p_type), 'steel') THEN 'metal' WHEN contains(lower(p_type), 'brass') OR contains(lower(p_type), 'copper') THEN 'alloy' WHEN contains(lower(p_type), 'tin') THEN 'soft metal'
  WHEN p_type = 'ECONOMY NICKEL' THEN 'coin' ELSE 'other' END AS type_group,
  CASE WHEN p_size > 30 THEN 16 WHEN p_size > 20 THEN 8 WHEN p_size > 10 THEN 4 ELSE 0 END AS size_bucket,
  CASE p_brand WHEN 'Brand#11' THEN 'first' WHEN 'Brand#12' THEN 'second' ELSE 'unknown' END AS brand_rank
FROM part
""")
def dim_rule_case(spark: SparkSession, folder: str) -> DataFrame:
    brand = rules.map_values(F.col("p_brand"), {"Brand#11": "first", "Brand#12": "second"}, "unknown")
    group = rules.first_match(F.col("p_type"), TYPE_RULES, {"ECONOMY NICKEL": "coin"}, "other")
    return table(spark, folder, "part").select("p_partkey", group.alias("type_group"), rules.buckets(F.col("p_size"), ((30, 16), (20, 8), (10, 4))).alias("size_bucket"), brand.alias("brand_rank"))


@query("""
WITH b AS (SELECT p_partkey, (p_brand = 'Brand#11')::INT AS is_a, (p_brand = 'Brand#12')::INT AS is_b, (p_brand = 'Brand#13')::INT AS is_c FROM part)
SELECT p_partkey, is_a, is_b, is_c, 1 - greatest(is_a, is_b, is_c) AS is_other, 0 AS not_seen FROM b
""")
def onehot_pivot_other(spark: SparkSession, folder: str) -> DataFrame:
    hot = [c.alias(f"is_{n}") for c, n in zip(rules.one_hot(F.col("p_brand"), ("Brand#11", "Brand#12", "Brand#13"), "is_"), "abc", strict=True)]
    wide = table(spark, folder, "part").select("p_partkey", *hot).withColumn("is_other", 1 - F.greatest("is_a", "is_b", "is_c"))
    return rules.align_columns(wide, ["p_partkey", "is_a", "is_b", "is_c", "is_other", "not_seen"])


@query("""
WITH u AS (SELECT l.doc_id, lang, unnest(['quality', 'toxic']) AS target, unnest([quality, toxic]) AS y FROM documents d LEFT JOIN labels l USING (doc_id)),
a AS (SELECT doc_id, lang, unnest(['quality', 'toxic']) AS target, unnest([coalesce(quality, -1), coalesce(toxic, -1)]) AS y FROM documents LEFT JOIN labels USING (doc_id))
SELECT lang, target, count(*) FILTER (y = 1) AS n_positive, count(*) FILTER (y <> -1) AS n_observed, count(DISTINCT doc_id) AS n_docs, round(count(*) FILTER (y = 1) / nullif(count(*) FILTER (y <> -1), 0), 8) AS prevalence
FROM a GROUP BY ALL
""")
def unpivot_prevalence(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang").join(table(spark, folder, "labels"), "doc_id", "left")
    masked = docs.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("quality", "toxic")})
    tall = masked.unpivot(["doc_id", "lang"], ["quality", "toxic"], "target", "y")
    n, seen = F.count_if(F.col("y") == 1), F.count_if(F.col("y") != -1)
    return tall.groupBy("lang", "target").agg(n.alias("n_positive"), seen.alias("n_observed"), F.countDistinct("doc_id").alias("n_docs"), F.round(n / F.nullif(seen, F.lit(0)), 8).alias("prevalence"))


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'early' ELSE 'late' END AS era FROM orders),
seg AS (SELECT era, c_mktsegment AS name, count(DISTINCT o_custkey) AS n FROM o JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
ranked AS (SELECT era, CASE WHEN row_number() OVER (PARTITION BY era ORDER BY n DESC, name) <= 3 THEN name ELSE 'Other' END AS name, n FROM seg),
whole AS (SELECT era, count(DISTINCT o_custkey) AS all_n FROM o GROUP BY era),
price AS (SELECT era, quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS q FROM o GROUP BY era)
SELECT era, 'segment' AS block, name, sum(n)::BIGINT || ' (' || printf('%.1f', 100.0 * sum(n) / any_value(all_n)) || ')' AS shown FROM ranked JOIN whole USING (era) GROUP BY era, name
UNION ALL SELECT era, 'price', 'median (IQR)', printf('%.1f (%.1f-%.1f)', q[2], q[1], q[3]) FROM price
""")
def cohort_table(spark: SparkSession, folder: str) -> DataFrame:
    """Characteristics by era: the three largest segments and the rest, and the price's median and quartiles, as text."""
    orders = table(spark, folder, "orders").withColumn("era", F.when(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"), "early").otherwise("late"))
    segments = orders.join(table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    counts = segments.groupBy("era", F.col("c_mktsegment").alias("name")).agg(F.countDistinct("o_custkey").alias("n"))
    whole = orders.groupBy("era").agg(F.countDistinct("o_custkey").alias("all_n"))
    top = relational.top_and_other(counts, ["era"], "name", "n", 3).join(whole, "era")
    top = top.select("era", F.lit("segment").alias("block"), "name", text.count_percent(F.col("n"), F.col("all_n")).alias("shown"))
    q = orders.groupBy("era").agg(F.percentile("o_totalprice", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return top.unionByName(q.select("era", F.lit("price").alias("block"), F.lit("median (IQR)").alias("name"), F.format_string("%.1f (%.1f-%.1f)", F.col("q")[1], F.col("q")[0], F.col("q")[2]).alias("shown")))


@query("""
SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus, o_orderpriority)::BIGINT AS level, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)
""")
def cube_rollup_ext(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    return orders.rollup("o_orderstatus", "o_orderpriority").agg(F.grouping_id("o_orderstatus", "o_orderpriority").alias("level"), F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
WITH q AS (SELECT lang, quantile_cont(n_chars, 0.25) AS q1, median(n_chars) AS q2, quantile_cont(n_chars, 0.75) AS q3, min(n_chars) AS lo, max(n_chars) AS hi FROM documents GROUP BY lang)
SELECT lang, q1, q2, q3, greatest(q1 - 1.5 * (q3 - q1), lo) AS low_fence, least(q3 + 1.5 * (q3 - q1), hi) AS high_fence FROM q
""")
def quantile_box(spark: SparkSession, folder: str) -> DataFrame:
    q = table(spark, folder, "documents").groupBy("lang").agg(*[F.percentile("n_chars", F.lit(p)).alias(n) for n, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))], F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return q.select("lang", "q1", "q2", "q3", F.greatest(F.col("q1") - reach, F.col("lo")).alias("low_fence"), F.least(F.col("q3") + reach, F.col("hi")).alias("high_fence"))


@query("""
SELECT doc_id, lang, round(coalesce((n_chars - avg(n_chars) OVER w) / nullif(stddev_samp(n_chars) OVER w, 0), 0), 6) AS z, round(n_chars - avg(n_chars) OVER (), 6) AS centred, round(n_chars / max(n_chars) OVER w, 8) AS share_of_max
FROM documents WINDOW w AS (PARTITION BY lang)
""")
def zscore_group(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    scored = windows.share_of_max(windows.zscore(docs, ["lang"], "n_chars", "z"), ["lang"], "n_chars", "share")
    centred = windows.with_group_stats(scored, [], {"__mean": F.avg("n_chars")})
    return centred.select("doc_id", "lang", F.round("z", 6).alias("z"), F.round(F.col("n_chars") - F.col("__mean"), 6).alias("centred"), F.round("share", 8).alias("share_of_max"))


@query("""
SELECT doc_id, source, round(avg(n_chars) OVER (PARTITION BY source, lang), 6) AS group_mean FROM documents
""")
def group_mean_broadcast(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang", "n_chars")
    return windows.with_group_stats(docs, ["source", "lang"], {"m": F.avg("n_chars")}).select("doc_id", "source", F.round("m", 6).alias("group_mean"))


@query("""
WITH w AS (SELECT *, date_trunc('week', ts) AS week FROM events QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('week', ts) ORDER BY ts, event_id) = 1)
SELECT event_id, user_id, week::TIMESTAMP AS week, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS change FROM w
""")
def session_delta_weekly(spark: SparkSession, folder: str) -> DataFrame:
    weekly = windows.one_per_week(table(spark, folder, "events"), "user_id", "ts", "event_id")
    return windows.change_since_last(weekly, "user_id", ["ts", "event_id"], "value", "change").select("event_id", "user_id", "week", F.round("change", 6).alias("change"))


@query("""
WITH RECURSIVE s AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, event_id) AS i FROM events),
k AS (SELECT user_id, i, event_id, t, t AS last, true AS kept FROM s WHERE i = 1
  UNION ALL SELECT s.user_id, s.i, s.event_id, s.t, CASE WHEN s.t - k.last >= 604800 THEN s.t ELSE k.last END, s.t - k.last >= 604800 FROM k JOIN s ON s.user_id = k.user_id AND s.i = k.i + 1)
SELECT event_id, user_id FROM k WHERE kept
""")
def thin_by_seven_days(spark: SparkSession, folder: str) -> DataFrame:
    return thin_by_gap(table(spark, folder, "events"), "user_id", "ts", "event_id", 7 * 86400).select("event_id", "user_id")


@query("""
WITH f AS (SELECT l_orderkey, l_partkey, CASE WHEN l_returnflag = 'A' THEN 2 WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS flag, l_partkey % 7 AS hierarchy FROM lineitem)
SELECT l_orderkey, CASE WHEN max(flag) = 0 THEN 'none' ELSE 'group' || min(hierarchy) FILTER (flag = m) END AS primary_group
FROM (SELECT *, max(flag) OVER (PARTITION BY l_orderkey) AS m FROM f) GROUP BY l_orderkey
""")
def primary_code_pick(spark: SparkSession, folder: str) -> DataFrame:
    flag = F.when(F.col("l_returnflag") == "A", 2).when(F.col("l_returnflag") == "R", 1).otherwise(0)
    best = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct((-flag).alias("f"), F.pmod("l_partkey", F.lit(7)).alias("h"))).alias("b"))
    return best.select("l_orderkey", F.when(F.col("b.f") == 0, "none").otherwise(F.concat(F.lit("group"), F.col("b.h").cast("string"))).alias("primary_group"))


@query("""
WITH e AS (SELECT user_id, event_type, event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS v, props FROM events)
SELECT user_id, event_type, count(*) AS n_replicates, round(avg(v), 8) AS probability, round(stddev_samp(v), 8) AS std_probability, arg_min(props, event_id) AS reason FROM e WHERE v IS NOT NULL GROUP BY ALL
""")
def replicate_collapse(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").withColumn("v", F.get_json_object("props", "$.k"))
    out = relational.collapse_replicates(rows, ["user_id", "event_type"], "v", "props", "event_id")
    return out.select("user_id", "event_type", "n_replicates", F.round("probability", 8).alias("probability"), F.round("std_probability", 8).alias("std_probability"), "reason")


@query("""
WITH d AS (SELECT text, doc_id, source FROM documents)
SELECT md5(text) AS text_key, min(doc_id) AS first_id, arg_min(source, doc_id) AS first_source, max(doc_id) AS last_id, arg_max(source, doc_id) AS last_source, count(*) AS n FROM d GROUP BY text
""")
def dedup_first_vs_last(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.md5(F.col("text").cast("binary")).alias("text_key"), "doc_id", "source")
    return docs.groupBy("text_key").agg(F.min("doc_id").alias("first_id"), F.min_by("source", "doc_id").alias("first_source"), F.max("doc_id").alias("last_id"), F.max_by("source", "doc_id").alias("last_source"), F.count(F.lit(1)).alias("n"))


@query("""
SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)
""")
def pending_work(spark: SparkSession, folder: str) -> DataFrame:
    return relational.pending(table(spark, folder, "documents").select("doc_id", "source"), table(spark, folder, "labels"), ["doc_id"], F.col("quality") == 1)


@query("""
WITH f AS (SELECT text, min(doc_id) AS first_id FROM documents GROUP BY text), r AS (SELECT text, row_number() OVER (ORDER BY first_id) - 1 AS note_index FROM f)
SELECT doc_id, note_index, e.label, e.vec_id IS NOT NULL AS has_vector FROM documents JOIN r USING (text) LEFT JOIN embeddings e ON e.vec_id = note_index
""")
def embedding_gather(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_key"))
    indexed = windows.factorise(docs, "text_key", "doc_id", "note_index")
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("note_index"), "label", "embedding")
    return indexed.join(vectors, "note_index", "left").select("doc_id", "note_index", "label", F.col("embedding").isNotNull().alias("has_vector"))


@query("""
SELECT n_name, r_name, coalesce(c.n, 0) AS n_customers, coalesce(s.n, 0) AS n_suppliers
FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 0 GROUP BY 1) s USING (k)
JOIN nation ON n_nationkey = k JOIN region ON r_regionkey = n_regionkey
""")
def full_outer_counts(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer").filter("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n_customers"))
    s = table(spark, folder, "supplier").filter("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n_suppliers"))
    nation = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = c.join(s, "k", "full").na.fill(0, ["n_customers", "n_suppliers"]).join(nation, F.col("k") == F.col("n_nationkey"))
    return out.select("n_name", "r_name", "n_customers", "n_suppliers")


#: Lines that a task of three_way_join takes.
LINES_A_TASK = 500_000


@query("""
SELECT o_orderkey, count(*) AS n_lines, count(DISTINCT l_suppkey) AS n_suppliers, count(*) FILTER (days BETWEEN 0 AND 30) AS n_in_30_days, max(c_name) AS customer
FROM (SELECT o.*, l.*, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS days FROM orders o JOIN lineitem l ON l_orderkey = o_orderkey) JOIN customer ON c_custkey = o_custkey GROUP BY o_orderkey
""")
def three_way_join(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("ordered"))
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", F.to_date("l_shipdate").alias("shipped"))
    names = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    # What a task sorts and counts stays the same at any size: partitions grow in number with the lines, not in rows.
    parts = max(spark.sparkContext.defaultParallelism, -(-lines.count() // LINES_A_TASK))
    orders, lines = orders.repartition(parts, "o_orderkey"), lines.repartition(parts, "o_orderkey")
    rows = orders.join(lines, "o_orderkey").withColumn("days", F.datediff("shipped", "ordered"))
    per_order = rows.groupBy("o_orderkey", "o_custkey").agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("l_suppkey").alias("n_suppliers"), F.count_if(F.col("days").between(0, 30)).alias("n_in_30_days"))
    return per_order.join(names, "o_custkey").select("o_orderkey", "n_lines", "n_suppliers", "n_in_30_days", F.col("c_name").alias("customer"))


@query("""
WITH s AS (SELECT event_type, width_bucket_ AS bin, count(*) AS n FROM (SELECT event_type, least(floor((value - lo) / nullif(hi - lo, 0) * 30), 29)::INT AS width_bucket_ FROM events JOIN (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1) USING (event_type)) GROUP BY ALL)
SELECT event_type, bin, n, round(n / sum(n) OVER (PARTITION BY event_type), 8) AS share FROM s
""")
def density_histogram(spark: SparkSession, folder: str) -> DataFrame:
    rows = windows.with_group_stats(table(spark, folder, "events").select("event_type", "value"), ["event_type"], {"lo": F.min("value"), "hi": F.max("value")})
    at = F.least(F.floor((F.col("value") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * 30), F.lit(29)).cast("int")
    counts = rows.groupBy("event_type", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("event_type", "bin", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("event_type")), 8).alias("share"))  # 30 rows a type


@query("""
WITH c AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL),
r AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) <= 10 THEN 'top' WHEN row_number() OVER (PARTITION BY event_type ORDER BY n, user_id) <= 10 THEN 'bottom' END AS flag FROM c)
SELECT * FROM r WHERE flag IS NOT NULL
""")
def top_and_bottom(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most and the ten least active users of each event type."""
    counts = table(spark, folder, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    down = [F.col("n").desc(), F.col("user_id")]
    top = windows.first_rows(counts, ["event_type"], "user_id", down, 10).withColumn("flag", F.lit("top"))
    bottom = windows.first_rows(counts, ["event_type"], "user_id", [F.col("n"), F.col("user_id")], 10).withColumn("flag", F.lit("bottom"))
    # A user that is among both is flagged as top.
    return top.unionByName(bottom.join(top, ["event_type", "user_id"], "left_anti"))


@query("""
SELECT o_orderpriority, year(o_orderdate)::INT AS year, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM orders
WHERE year(o_orderdate) BETWEEN 1993 AND 1997 AND (o_orderstatus IS NULL OR o_orderstatus IN ('F', 'O')) AND NOT coalesce(o_orderpriority IN ('5-LOW'), false) GROUP BY ALL
""")
def null_tolerant_filters(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    kept = orders.filter(F.year("o_orderdate").between(1993, 1997) & (F.col("o_orderstatus").isNull() | F.col("o_orderstatus").isin("F", "O")) & F.coalesce(~F.col("o_orderpriority").isin("5-LOW"), F.lit(True)))
    return kept.groupBy("o_orderpriority", F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))


@query("""
SELECT c_nationkey, round(avg(ln((p + 0.001) / (1 - p + 0.001))), 8) AS mean_logit, round(sin(2 * pi() * (c_nationkey % 12 + 1) / 12), 8) AS month_sin, round(cos(2 * pi() * (c_nationkey % 12 + 1) / 12), 8) AS month_cos
FROM (SELECT c_nationkey, (c_custkey % 101) / 101.0::DOUBLE AS p FROM customer) GROUP BY c_nationkey
""")
def logit_and_cyclic(spark: SparkSession, folder: str) -> DataFrame:
    p = F.pmod("c_custkey", F.lit(101)) / F.lit(101.0)
    turn = 2 * F.pi() * (F.pmod("c_nationkey", F.lit(12)) + 1) / 12
    rows = table(spark, folder, "customer").groupBy("c_nationkey").agg(F.round(F.avg(F.log((p + 0.001) / (1 - p + 0.001))), 8).alias("mean_logit"))
    return rows.withColumn("month_sin", F.round(F.sin(turn), 8)).withColumn("month_cos", F.round(F.cos(turn), 8))
