"""Queries of features, models, prompting dataflow, sources and streams."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import rules, text
from tidewater.operators import features, fusion, metrics, mixed, models, prompting, reports, sampling, tree_shap
from tidewater.plans.catalog import query
from tidewater.plans.predictions import PREDS_SQL, long_predictions, predictions
from tidewater.sources import npz, readers, sinks
from tidewater.sources.tables import table
from tidewater.sources.work import materialize, new_folder
from tidewater.streaming import events as streams

#: The prompt grid's parts.
GRID = (("task", ("Estimate the risk. ", "Give the risk. ", "State the risk. ")), ("persona", ("", "You are an expert. ")), ("detail", ("", "Use the dates. ")), ("reasoning", ("", "Think first. ")), ("format", ("Answer as JSON.", "Answer in one line.")))


@query("""
WITH f AS (SELECT p_partkey, nullif(p_size % 5, 0) AS often, CASE WHEN p_size = 7 THEN p_size END AS rare, 0 AS unused, p_brand, coalesce(toxic, -1) AS toxic, coalesce(quality, -1) AS quality FROM part LEFT JOIN labels ON doc_id = p_partkey),
k AS (SELECT * FROM f WHERE toxic <> -1 OR quality <> -1),
c AS (SELECT p_brand, count(*) AS n FROM k GROUP BY p_brand)
SELECT p_partkey, coalesce(often, 0) AS often, (often IS NULL)::INT AS often_is_missing, CASE WHEN n >= 20 THEN p_brand ELSE 'Other' END AS p_brand, toxic, quality FROM k JOIN c USING (p_brand)
""")
def feature_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """Rows without any target go, columns that are unused or mostly missing go, the rest is flagged, filled and collapsed."""
    part = table(spark, folder, "part").select("p_partkey", F.nullif(F.col("p_size") % 5, F.lit(0)).alias("often"), F.when(F.col("p_size") == 7, F.col("p_size")).alias("rare"), F.lit(0).alias("unused"), "p_brand")
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("p_partkey"), "toxic", "quality")
    rows = features.fill_missing(part.join(labels, "p_partkey", "left"), {"toxic": -1, "quality": -1})
    rows = features.drop_rows_without_target(rows, ["toxic", "quality"])
    rows = features.drop_mostly_missing(features.drop_unused(rows, ["unused", "often"]), 0.8, keep=["toxic", "quality"])
    rows = features.fill_missing(features.missing_indicators(rows, ["often"]), {"often": 0})
    return features.collapse_rare(rows, "p_brand", 20).select("p_partkey", "often", "often_is_missing", "p_brand", "toxic", "quality")


@query("""
WITH s AS (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS s FROM documents WHERE doc_id % 2 = 0)
SELECT doc_id, round((n_chars - m) / s, 6) AS n_chars FROM documents, s
""")
def standardise(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"))
    return features.standardise(docs, ["n_chars"], F.col("doc_id") % 2 == 0).withColumn("n_chars", F.round("n_chars", 6))


def _model_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Features of labelled documents, stored once: a model reads its rows many times over, and each time would scan all texts."""
    words = F.size(F.split("text", " "))
    docs = table(spark, folder, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), words.cast("double").alias("n_words"), (F.size(F.split("text", "\n"))).cast("double").alias("n_lines"), (F.length(F.regexp_replace("text", "[^#*$%&|<>]+", ""))).cast("double").alias("n_symbols"), "lang", "source")
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").cast("double").alias("y"))
    return materialize(docs.join(labels, "doc_id").withColumn("part", sampling.random_split(F.col("doc_id"), [("train", 0.8), ("test", 0.2)])), "model_rows")


@query()
def train_and_score(spark: SparkSession, folder: str) -> DataFrame:
    """L1 logistic regression, boosted trees and a perceptron on document features: AUC per model on the test part."""
    rows = _model_rows(spark, folder)
    prepared = models.preprocessing(["n_chars", "n_words", "n_lines", "n_symbols"], ["lang"]).fit(rows.filter("part = 'train'")).transform(rows)
    train = materialize(models.balanced_weights(prepared.filter("part = 'train'"), "y").select("features", "y", "weight"), "score_train")
    test = prepared.filter("part = 'test'").select("doc_id", "features", "y")
    fitted = {"lasso": models.search_lasso(train, "y", (0.001, 0.01)).bestModel, "trees": models.boosted_trees("y").fit(train)}
    fitted["perceptron"] = models.perceptron("y", prepared.schema["features"].metadata["ml_attr"]["num_attrs"]).fit(train)
    out = None
    for name, model in fitted.items():
        part = models.scored(model, test, ["doc_id", "y"]).withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return metrics.auc(materialize(out, "test_scores"), ["model"], "y", "score")


@query()
def linear_attribution(spark: SparkSession, folder: str) -> DataFrame:
    """Mean absolute Shapley values of the logistic model's features."""
    rows = _model_rows(spark, folder)
    prepared = models.preprocessing(["n_chars", "n_words", "n_lines", "n_symbols"], []).fit(rows).transform(rows)
    fitted = models.lasso("y", 0.001).fit(models.balanced_weights(prepared, "y"))
    return models.linear_attribution(prepared, fitted.coefficients.toArray().tolist())


@query()
def stacked_ensemble(spark: SparkSession, folder: str) -> DataFrame:
    """A boosted-tree model over the methods' scores: its AUC beside that of each method."""
    wide = predictions(spark, folder).groupBy("doc_id", F.col("quality").cast("double").alias("y")).pivot("method", ["prompting", "tabular", "nlp", "finetune"]).agg(F.max("score"))
    prepared = models.preprocessing(["prompting", "tabular", "nlp", "finetune"], []).fit(wide).transform(wide)
    part = sampling.random_split(F.col("doc_id"), [("train", 0.7), ("test", 0.3)])
    train, test = prepared.filter(part == "train"), prepared.filter(part == "test")
    scores = models.scored(models.boosted_trees("y", trees=5).fit(train), test, ["y"]).withColumn("method", F.lit("stacked"))
    single = test.unpivot(["y"], ["prompting", "tabular", "nlp", "finetune"], "method", "score")
    return metrics.auc(scores.unionByName(single), ["method"], "y", "score")


@query("""
WITH p AS (SELECT source, count(*)::DOUBLE AS n, avg(n_chars) AS m, coalesce(var_samp(n_chars), 0) AS v FROM documents GROUP BY source),
s AS (SELECT sum(n) AS n, count(*)::DOUBLE AS k, sum(n * m) AS t, sum(n * m * m) AS q, sum((n - 1) * v) AS within, sum(n * n) AS n2 FROM p),
e AS (SELECT (q - t * t / n) / (k - 1) AS b, within / (n - k) AS w, (n - n2 / n) / (k - 1) AS size FROM s)
SELECT round(greatest((b - w) / size, 0) / (greatest((b - w) / size, 0) + w), 8) AS icc FROM e
""")
def variance_share(spark: SparkSession, folder: str) -> DataFrame:
    return models.variance_share(table(spark, folder, "documents"), "source", "n_chars").select(F.round("icc", 8).alias("icc"))


@query()
def tree_attribution(spark: SparkSession, folder: str) -> DataFrame:
    """Mean absolute Shapley values of boosted trees on document features, and the features' correlation with them."""
    rows, numeric = _model_rows(spark, folder), ["n_chars", "n_words", "n_lines", "n_symbols"]
    prepared = models.preprocessing(numeric, []).fit(rows.filter("part = 'train'")).transform(rows)
    fitted = models.boosted_trees("y").fit(prepared.filter("part = 'train'"))
    return tree_shap.importance(tree_shap.tree_attributions(fitted, prepared, ["doc_id"]), numeric)


@query()
def stacked_importance(spark: SparkSession, folder: str) -> DataFrame:
    """What each method's score adds to the stacked model, by Shapley values."""
    names = ["prompting", "tabular", "nlp", "finetune"]
    wide = predictions(spark, folder).groupBy("doc_id", F.col("quality").cast("double").alias("y")).pivot("method", names).agg(F.max("score"))
    prepared = models.preprocessing(names, []).fit(wide).transform(wide)
    return tree_shap.importance(tree_shap.tree_attributions(models.boosted_trees("y", trees=5).fit(prepared), prepared, ["doc_id"]), names)


@query()
def bayes_search(spark: SparkSession, folder: str) -> DataFrame:
    """Strength and mixing of a penalised logistic model searched with expected improvement: each trial with its held-out AUC."""
    rows = _model_rows(spark, folder)
    prepared = models.preprocessing(["n_chars", "n_words", "n_lines", "n_symbols"], ["lang"]).fit(rows.filter("part = 'train'")).transform(rows)
    train = materialize(models.balanced_weights(prepared.filter("part = 'train'"), "y").select("features", "y", "weight"), "search_train")
    test = materialize(prepared.filter("part = 'test'").select("features", "y"), "search_test")
    trials = models.search_bayesian(train, test, "y", trials=6, initial=3)
    return spark.createDataFrame([(i, t["strength"], t["mixing"], t["score"]) for i, t in enumerate(trials)], "trial int, strength double, mixing double, auc double")


def _order_model(spark: SparkSession, folder: str):
    orders = table(spark, folder, "orders").select("o_custkey", F.log("o_totalprice").alias("price"), (F.datediff("o_orderdate", F.lit("1995-01-01")) / 1000.0).alias("day"), "o_orderpriority")
    rows, levels = mixed.with_indicators(orders, "o_orderpriority")
    return mixed.random_intercept(rows, "o_custkey", "price", ["day", *levels])


@query("""
WITH o AS (SELECT o_custkey, ln(o_totalprice) - (SELECT avg(ln(o_totalprice)) FROM orders) AS y FROM orders),
g AS (SELECT count(*)::DOUBLE AS n, sum(y) AS t, sum(y * y) AS q FROM o GROUP BY o_custkey),
r AS (SELECT i / 20.0::DOUBLE AS icc, (i / 20.0::DOUBLE) / (1 - i / 20.0::DOUBLE) AS k FROM range(20) t(i)),
s AS (SELECT icc, sum(n) AS n, sum(ln(1 + k * n)) AS l, sum(n) - sum(k * n * n / (1 + k * n)) AS a, sum(t) - sum(k * n * t / (1 + k * n)) AS b, sum(q) - sum(k * t * t / (1 + k * n)) AS q FROM g, r GROUP BY icc)
SELECT icc, round((n - 1) * ln(q - b * b / a) + l + ln(a), 5) AS criterion FROM s
""")
def reml_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Minus twice the restricted likelihood of a random intercept for each customer, by intraclass correlation."""
    fit = mixed.random_intercept(table(spark, folder, "orders").select("o_custkey", F.log("o_totalprice").alias("y")), "o_custkey", "y")
    return spark.createDataFrame([(i / 20, round(fit.criterion(i / 20), 5)) for i in range(20)], "icc double, criterion double")


@query()
def icc_posterior(spark: SparkSession, folder: str) -> DataFrame:
    """Median and 95 % interval of the customers' share of the variance of log prices, beside day and priority."""
    fit = _order_model(spark, folder)
    return reports.posterior_summary(fit.draw_table(fit.posterior()), [], "icc").withColumn("reml", F.lit(fit.reml()["icc"]))


@query()
def effects_on_characteristics(spark: SparkSession, folder: str) -> DataFrame:
    """Customers' random intercepts regressed on three of their characteristics in each draw, summarised over the draws."""
    fit = _order_model(spark, folder)
    draws = fit.group_draws(fit.posterior(draws=200)).select(F.col("o_custkey").alias("c_custkey"), F.posexplode("effects").alias("draw", "effect"))
    customers = table(spark, folder, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("balance"), (F.col("c_mktsegment") == "BUILDING").cast("double").alias("builds"), (F.col("c_nationkey") < 12).cast("double").alias("near"))
    return reports.posterior_summary(reports.regress_per_draw(draws, "draw", "c_custkey", "effect", customers, ["balance", "builds", "near"]), ["term"], "coefficient")


@query("""
WITH g AS (SELECT i AS prompt_id, ['Estimate the risk. ', 'Give the risk. ', 'State the risk. '][i // 16 % 3 + 1] || ['', 'You are an expert. '][i // 8 % 2 + 1] || ['', 'Use the dates. '][i // 4 % 2 + 1] || ['', 'Think first. '][i // 2 % 2 + 1] || ['Answer as JSON.', 'Answer in one line.'][i % 2 + 1] AS prompt FROM range(48) t(i))
SELECT item_id, prompt_id, prompt || chr(10) || chr(10) || text AS message, CASE WHEN prompt_id < 24 THEN 'plain' ELSE 'simple' END AS phrase, prompt_id % 2 = 1 AS one_line FROM benchmark JOIN g ON prompt_id = item_id % 48
""")
def prompt_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Each benchmark item with the prompt of the grid that its number gives."""
    grid = prompting.grid(spark, GRID).select("prompt_id", "prompt")
    items = table(spark, folder, "benchmark").withColumn("prompt_id", F.pmod("item_id", F.lit(48)))
    phrase = F.when(F.col("prompt_id") < 24, "plain").otherwise("simple")
    rows = items.join(F.broadcast(grid), "prompt_id")  # 48 rows
    return rows.select("item_id", "prompt_id", prompting.assemble(F.col("prompt"), examples=F.col("text")).alias("message"), phrase.alias("phrase"), (F.col("prompt_id") % 2 == 1).alias("one_line"))


def _stub(prompts: list[str]) -> list[str]:
    """A stand-in for a text model: the probability is the share of vowels."""
    return [f'{{"Reason": "vowels", "Probability": {round(sum(c in "aeiou" for c in p) / max(1, len(p)), 4)}}}' for p in prompts]


@query("""
WITH c AS (SELECT conv_id, turn, length(text) - length(regexp_replace(text, '[aeiou]', '', 'g')) AS v, length(text) AS n FROM conversations)
SELECT conv_id, turn, 2::BIGINT AS n_replicates, round(round_even(v / greatest(n, 1), 4), 4) AS probability, 'vowels' AS reason FROM c
""")
def model_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Two samples per message from a stand-in model, parsed and put back together."""
    asked = prompting.replicate(table(spark, folder, "conversations").select("conv_id", "turn", "text"), 2)
    replies = prompting.call_model(asked, "text", _stub).withColumn("r", text.parse_reply(F.col("reply")))
    out = replies.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_replicates"), F.avg("r.probability").alias("probability"), F.min("r.reason").alias("reason"))
    return out.withColumn("probability", F.round("probability", 4))


@query("""
WITH b AS (SELECT list(chr(10) || 'Example: ' || text ORDER BY item_id) AS shots FROM (SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 3)),
w AS (SELECT doc_id, text, shots, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS words, list_transform(shots, lambda s: len(list_filter(regexp_split_to_array(s, '\\s+'), lambda x: x <> ''))) AS sizes FROM documents, b),
k AS (SELECT *, 3 + len(words) > 600 AS cut, len(list_filter(range(1, len(shots) + 1), lambda n: 3 + len(words) + list_sum(sizes[1:n]) <= 600)) AS kept FROM w)
SELECT doc_id, kept::INT AS n_examples, cut AS truncated, sha256('Give the risk.' || coalesce(array_to_string(shots[1:kept], ''), '') || CASE WHEN cut THEN array_to_string(words[1:595], ' ') || chr(10) || '[NOTE TRUNCATED]' ELSE text END) AS message_key FROM k
""")
def context_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with three examples in a context of 600 words: how many examples stay, and whether the text is cut."""
    shots = table(spark, folder, "benchmark").orderBy("item_id").limit(3).agg(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "text"))), lambda x: F.concat(F.lit("\nExample: "), x["text"])).alias("shots"))
    docs = table(spark, folder, "documents").select("doc_id", "text").crossJoin(F.broadcast(shots))  # one row of three texts
    fit = prompting.fit_context(F.lit("Give the risk."), F.col("shots"), F.col("text"), 600)
    return docs.select("doc_id", fit.alias("f")).select("doc_id", "f.n_examples", "f.truncated", F.sha2(F.concat("f.system", "f.note"), 256).alias("message_key"))


@query(f"""
WITH {PREDS_SQL} SELECT method, replace(target, '_', '-') AS target, split, doc_id AS key, score, y::INT AS y FROM long_preds
""")
def prediction_formats(spark: SparkSession, folder: str) -> DataFrame:
    """Long, vector-in-text and parallel-array predictions brought to one table."""
    rows = long_predictions(spark, folder)
    plain = rows.filter("method in ('prompting', 'tabular')")
    as_text = rows.filter("method = 'nlp'").withColumn("prob", F.concat(F.lit("["), (1 - F.col("score")).cast("string"), F.lit(" "), F.col("score").cast("string"), F.lit("]")))
    as_text = as_text.withColumn("score", F.element_at(readers.vector_text(F.col("prob")), 2))
    bundle = rows.filter("method = 'finetune'").groupBy("method", "target", "split", F.pmod("doc_id", F.lit(64)).alias("shard")).agg(F.collect_list(F.struct("doc_id", "score", "y")).alias("a"))
    bundle = bundle.select("method", "target", "split", *[F.col(f"a.{c}").alias(f"{c}s") for c in ("doc_id", "score", "y")])
    tall = readers.bundle_to_long(bundle, ["method", "target", "split"], {"doc_ids": "doc_id", "scores": "score", "ys": "y"})
    parts = [(m, df.filter(F.col("method") == m).withColumnRenamed("doc_id", "key")) for m, df in (("prompting", plain), ("tabular", plain), ("nlp", as_text), ("finetune", tall))]
    return readers.normalised_predictions(parts)


@query("""
SELECT doc_id, lang, source, n_chars FROM documents
""")
def sink_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Documents written by language and as quoted CSV parts, and both read again."""
    path = new_folder(spark, "sink")
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    sinks.write_by(docs.select("doc_id", "lang"), f"{path}/by_lang", ["lang"])
    sinks.write_parts(docs.select("doc_id", "source", "n_chars"), f"{path}/parts.csv", 4, "doc_id", "csv")
    back = readers.load_table(spark, f"{path}/parts.csv", "doc_id long, source string, n_chars long")
    return spark.read.parquet(f"{path}/by_lang").join(back, "doc_id").select("doc_id", "lang", "source", "n_chars")


@query("""
SELECT user_id, event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL HAVING count(*) FILTER (value IS NULL OR value < 20) > 0 AND count(*) FILTER (value >= 20) = 0
""")
def invalid_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that have invalid results only, to be done again, with the number of their rows."""
    keys = ["user_id", "event_type", "day"]
    rows = table(spark, folder, "events").select("user_id", "event_type", F.to_date("ts").alias("day"), "value")
    _, again = sinks.sweep(rows, F.col("value") >= 20, keys)
    return rows.join(again, keys, "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH e AS (SELECT (epoch_us(ts) // 86400000000) AS d, event_type, value FROM events), last AS (SELECT max(epoch_us(ts)) AS t FROM events)
SELECT make_timestamp(d * 86400000000) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM e, last WHERE (d + 1) * 86400000000 <= t - 3600000000 GROUP BY d, event_type
""")
def stream_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    """Daily counts of the stream; days that the watermark has passed."""
    out = streams.drain(streams.tumbling(streams.event_stream(spark, folder)))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
WITH g AS (SELECT user_id, event_id, ts, epoch_us(ts) AS t FROM events),
m AS (SELECT *, (coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 21600000000, true))::INT AS opens FROM g),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS place FROM m)
SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, place HAVING max(t) + 21600000000 <= (SELECT max(t) FROM g) - 3600000000
""")
def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """A user's events with gaps of at most six hours; sessions that the watermark has passed."""
    out = streams.drain(streams.sessions(streams.event_stream(spark, folder)))
    return out.select(*[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")], "user_id", "n")


@query()
def stream_first_of_week(spark: SparkSession, folder: str) -> DataFrame:
    return streams.drain(streams.first_of_week(streams.event_stream(spark, folder))).select("event_id", "user_id", "week")


@query("""
SELECT p.event_id AS purchase_id, v.event_id AS view_id FROM events p JOIN events v ON v.user_id = p.user_id AND v.event_type = 'view' AND v.ts < p.ts AND v.ts >= p.ts - INTERVAL 24 HOUR WHERE p.event_type = 'purchase'
""")
def stream_lookback_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return streams.drain(streams.lookback_pairs(streams.event_stream(spark, folder)))


@query("""
WITH t AS (SELECT * FROM (VALUES ('view', 10.0, 'gte'), ('click', 5.0, 'lte'), ('purchase', 2.0, 'gte')) AS t(event_type, bound, dir))
SELECT e.event_type, count(*) AS n, count(*) FILTER (CASE dir WHEN 'gte' THEN value >= bound ELSE value <= bound END) AS n_eligible, round(100.0 * count(*) FILTER (CASE dir WHEN 'gte' THEN value >= bound ELSE value <= bound END) / count(*), 6) AS percent FROM events e JOIN t USING (event_type) GROUP BY ALL
""")
def threshold_eligibility(spark: SparkSession, folder: str) -> DataFrame:
    """Events eligible by a threshold and its direction per type, from a table of thresholds."""
    bounds = spark.createDataFrame([("view", 10.0, "gte"), ("click", 5.0, "lte"), ("purchase", 2.0, "gte")], "event_type string, bound double, dir string")
    ok = F.when(F.col("dir") == "gte", F.col("value") >= F.col("bound")).otherwise(F.col("value") <= F.col("bound"))
    rows = table(spark, folder, "events").join(F.broadcast(bounds), "event_type")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_eligible"), F.round(100.0 * F.count_if(ok) / F.count(F.lit(1)), 6).alias("percent"))


@query("""
SELECT source, lang, coalesce(r.rank, 9) AS lang_rank, count(*) AS n FROM documents LEFT JOIN (VALUES ('en', 1), ('fr', 2), ('de', 3)) AS r(code, rank) ON code = lang GROUP BY ALL
""")
def dictionary_join(spark: SparkSession, folder: str) -> DataFrame:
    codes = spark.createDataFrame([("en", 1), ("fr", 2), ("de", 3)], "code string, rank int")
    mapped = rules.map_by_join(table(spark, folder, "documents").select("source", "lang"), "lang", codes, "code", "rank", "lang_rank", 9)
    return mapped.groupBy("source", "lang", "lang_rank").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT vec_id, label::BIGINT AS label, len(embedding)::BIGINT AS length, round(list_sum(embedding::DOUBLE[]), 6) AS total, embedding[1]::DOUBLE AS first FROM embeddings
""")
def npz_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings written as bundles of arrays, of unequal size, and read again by slices."""
    path = new_folder(spark, "bundles")
    rows = table(spark, folder, "embeddings")
    npz.write_npz(rows.filter("vec_id % 3 = 0"), path, rows_per_file=70)
    npz.write_npz(rows.filter("vec_id % 3 <> 0").repartition(2, "vec_id"), path, rows_per_file=1000)
    back = npz.read_npz(spark, path, rows_per_task=300)
    total = F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6)
    return back.select("vec_id", "label", F.size("embedding").cast("long").alias("length"), total.alias("total"), F.col("embedding")[0].alias("first"))


@query("""
WITH c AS (SELECT conv_id, turn, length(text) - length(regexp_replace(text, '[aeiou]', '', 'g')) AS v, length(text) AS n FROM conversations)
SELECT conv_id, turn, 1 AS attempts, round(round_even(v / greatest(n, 1), 4), 4) AS probability FROM c
""")
def length_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Each message answered by a stand-in model that is called with batches of like length, one client a task."""
    asked = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    replies = prompting.call_in_batches(asked, "text", lambda: _stub).withColumn("r", text.parse_reply(F.col("reply")))
    return replies.select("conv_id", "turn", "attempts", F.round("r.probability", 4).alias("probability"))


@query()
def mid_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Losses by epoch of a network over document features and embeddings, with early stopping on held-out documents."""
    rows = _model_rows(spark, folder).join(table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    prepared = models.preprocessing(["n_chars", "n_words", "n_lines", "n_symbols"], []).fit(rows.filter("part = 'train'")).transform(rows)
    prepared = prepared.select(vector_to_array("features").alias("features"), "embedding", "y", (F.col("part") == "test").alias("held_out"))
    return fusion.train_fusion(prepared, "features", "embedding", "y", "held_out", epochs=8).losses(spark)
