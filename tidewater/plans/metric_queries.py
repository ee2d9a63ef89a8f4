"""Queries over predictions: metrics, bootstraps, ensembles and hypothesis tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.operators import htest, metrics, windows
from tidewater.operators.ranks import mid_ranks
from tidewater.plans.catalog import query
from tidewater.plans.predictions import PREDS_SQL, long_predictions, predictions
from tidewater.sources.tables import table

#: Bootstrap replicates.
REPS = 1000
_AUC_SQL = "sum(pos * (before_neg + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0)"


def _auc_cte(name: str, source: str, group: str, label: str = "y", weight: str = "1") -> str:
    return f"""
{name}_at AS (SELECT {group}, score, sum({weight} * {label})::DOUBLE AS pos, sum({weight} * (1 - {label}))::DOUBLE AS neg FROM {source} GROUP BY {group}, score),
{name}_run AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {group} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_neg FROM {name}_at),
{name} AS (SELECT {group}, {_AUC_SQL} AS auc FROM {name}_run GROUP BY {group})"""


@query(f"""
WITH {PREDS_SQL}, {_auc_cte('a', 'long_preds', 'target, method')}
SELECT target, method, round(auc, 8) AS auc FROM a
""")
def auc_by_group(spark: SparkSession, folder: str) -> DataFrame:
    out = metrics.auc(long_predictions(spark, folder), ["target", "method"], "y", "score")
    return out.select("target", "method", F.round("auc", 8).alias("auc"))


@query(f"""
WITH {PREDS_SQL},
steps AS (SELECT target, method, score, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM long_preds GROUP BY ALL),
run AS (SELECT *, sum(pos) OVER w AS cum_pos, sum(n) OVER w AS cum_n FROM steps WINDOW w AS (PARTITION BY target, method ORDER BY score DESC)),
ap AS (SELECT target, method, sum(pos * cum_pos / cum_n) / sum(pos) AS ap FROM run GROUP BY ALL),
ll AS (SELECT target, method, -avg(y * ln(greatest(least(score, 1 - 2.220446049250313e-16), 2.220446049250313e-16)) + (1 - y) * ln(1 - greatest(least(score, 1 - 2.220446049250313e-16), 2.220446049250313e-16))) AS ll FROM long_preds GROUP BY ALL)
SELECT target, method, round(ap, 8) AS ap, round(ll, 8) AS log_loss FROM ap JOIN ll USING (target, method)
""")
def ap_logloss(spark: SparkSession, folder: str) -> DataFrame:
    rows, group = long_predictions(spark, folder), ["target", "method"]
    loss = rows.groupBy(*group).agg(metrics.log_loss(F.col("y"), F.col("score")).alias("log_loss"))
    return metrics.average_precision(rows, group, "y", "score").join(loss, group).select(*group, F.round("ap", 8).alias("ap"), F.round("log_loss", 8).alias("log_loss"))


@query(f"""
WITH {PREDS_SQL},
sized AS (SELECT p.*, (score >= 0.5)::INT AS hat, CASE WHEN n_chars <= 1000 THEN 'short' WHEN n_chars < 3000 THEN 'middle' ELSE 'long' END AS size_group FROM long_preds p JOIN documents d USING (doc_id)),
c AS (SELECT target, method, size_group, count(*) FILTER (hat = 1 AND y = 1) AS tp, count(*) FILTER (hat = 1 AND y = 0) AS fp, count(*) FILTER (hat = 0 AND y = 1) AS fn, count(*) FILTER (hat = 0 AND y = 0) AS tn, avg(hat) AS demographic_parity FROM sized GROUP BY ALL)
SELECT target, method, size_group, tp, fp, fn, tn, round(demographic_parity, 8) AS demographic_parity, round(tp / nullif(tp + fn, 0), 8) AS equal_opportunity,
  round(fp / nullif(fp + tn, 0), 8) AS false_positive_rate, round(tp / nullif(tp + fp, 0), 8) AS predictive_parity FROM c
""")
def confusion_fairness(spark: SparkSession, folder: str) -> DataFrame:
    sizes = table(spark, folder, "documents").select("doc_id", F.when(F.col("n_chars") <= 1000, "short").when(F.col("n_chars") < 3000, "middle").otherwise("long").alias("size_group"))
    rows = long_predictions(spark, folder).withColumn("hat", (F.col("score") >= 0.5).cast("int")).join(sizes, "doc_id")
    found = metrics.confusion(F.col("y"), F.col("hat"))
    return rows.groupBy("target", "method", "size_group").agg(*[(c if n in ("tp", "fp", "fn", "tn") else F.round(c, 8)).alias(n) for n, c in found.items()])


@query(f"""
WITH {PREDS_SQL}, {_auc_cte('a', 'long_preds', 'target, method, split')},
best AS (SELECT target, split, max_by(method, (auc, method)) AS best_method, max(auc) AS auc, count(*) AS n_methods FROM a GROUP BY ALL)
SELECT target, split, best_method, round(auc, 8) AS auc, n_methods FROM best
""")
def best_config_per_target(spark: SparkSession, folder: str) -> DataFrame:
    scored = metrics.auc(long_predictions(spark, folder), ["target", "method", "split"], "y", "score")
    best = scored.groupBy("target", "split").agg(F.max(F.struct("auc", "method")).alias("b"), F.count(F.lit(1)).alias("n_methods"))
    return best.select("target", "split", F.col("b.method").alias("best_method"), F.round("b.auc", 8).alias("auc"), "n_methods")


@query(f"""
WITH {PREDS_SQL}, {_auc_cte('a', 'long_preds', 'target, method, split')},
wide AS (SELECT target, split, max(auc) FILTER (method = 'prompting') AS base, max(auc) FILTER (method = 'tabular') AS tabular, max(auc) FILTER (method = 'nlp') AS nlp FROM a GROUP BY ALL)
SELECT target, round(avg(tabular - base), 8) AS mean_delta_tabular, round(median(tabular - base), 8) AS median_delta_tabular, round(avg(abs(nlp - base)), 8) AS mean_abs_delta_nlp, count(*) AS n_pairs
FROM wide WHERE base IS NOT NULL AND tabular IS NOT NULL AND nlp IS NOT NULL GROUP BY target
""")
def paired_pivot_delta(spark: SparkSession, folder: str) -> DataFrame:
    scored = metrics.auc(long_predictions(spark, folder), ["target", "method", "split"], "y", "score")
    wide = scored.groupBy("target", "split").pivot("method", ["prompting", "tabular", "nlp"]).agg(F.first("auc")).na.drop()
    gap, other = F.col("tabular") - F.col("prompting"), F.col("nlp") - F.col("prompting")
    return wide.groupBy("target").agg(F.round(F.avg(gap), 8).alias("mean_delta_tabular"), F.round(F.median(gap), 8).alias("median_delta_tabular"), F.round(F.avg(F.abs(other)), 8).alias("mean_abs_delta_nlp"), F.count(F.lit(1)).alias("n_pairs"))


@query(f"""
WITH {PREDS_SQL},
wide AS (SELECT doc_id, toxic AS y, max(score) FILTER (method = 'prompting') AS p, max(score) FILTER (method = 'tabular') AS t, max(score) FILTER (method = 'nlp') AS n FROM preds GROUP BY ALL),
e AS (SELECT y, unnest(['mean', 'low', 'high']) AS kind, unnest([(p + t + n) / 3, least(p, t, n), greatest(p, t, n)]) AS score FROM wide),
{_auc_cte('a', 'e', 'kind')}
SELECT kind, round(auc, 8) AS auc FROM a
""")
def ensemble_auc(spark: SparkSession, folder: str) -> DataFrame:
    wide = predictions(spark, folder).groupBy("doc_id", F.col("toxic").alias("y")).pivot("method", ["prompting", "tabular", "nlp"]).agg(F.max("score")).na.drop()
    parts = ["prompting", "tabular", "nlp"]
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("score")) for k, c in (("mean", sum(F.col(p) for p in parts) / 3), ("low", F.least(*parts)), ("high", F.greatest(*parts)))])
    rows = wide.withColumn("k", F.explode(kinds)).select("y", "k.kind", "k.score")
    return metrics.auc(rows, ["kind"], "y", "score").select("kind", F.round("auc", 8).alias("auc"))


@query(f"""
WITH {PREDS_SQL}
SELECT a.method AS method_a, b.method AS method_b, a.method || ' vs ' || b.method AS pair, round(corr(a.score, b.score), 8) AS r, round(regr_slope(b.score, a.score), 8) AS slope, round(regr_intercept(b.score, a.score), 8) AS intercept
FROM preds a JOIN preds b ON a.doc_id = b.doc_id AND a.method < b.method GROUP BY ALL
""")
def ensemble_corr(spark: SparkSession, folder: str) -> DataFrame:
    rows = predictions(spark, folder)
    a, b = rows.select("doc_id", F.col("method").alias("method_a"), F.col("score").alias("x")), rows.select("doc_id", F.col("method").alias("method_b"), F.col("score").alias("y"))
    pairs = a.join(b, "doc_id").filter("method_a < method_b")
    pair = F.concat(F.least("method_a", "method_b"), F.lit(" vs "), F.greatest("method_a", "method_b"))
    return pairs.groupBy("method_a", "method_b", pair.alias("pair")).agg(F.round(F.corr("x", "y"), 8).alias("r"), F.round(F.regr_slope("y", "x"), 8).alias("slope"), F.round(F.regr_intercept("y", "x"), 8).alias("intercept"))


@query(f"""
WITH {PREDS_SQL}, {_auc_cte('a', 'long_preds', 'target, method, split')},
w AS (SELECT method, target, max(auc) FILTER (split = 'split0') AS x, max(auc) FILTER (split = 'split1') AS y FROM a GROUP BY ALL)
SELECT method, round(2 * covar_pop(x, y) / nullif(var_pop(x) + var_pop(y) + (avg(x) - avg(y)) * (avg(x) - avg(y)), 0), 6) AS ccc, round(avg(abs(x - y)), 8) AS mean_gap FROM w GROUP BY method
""")
def ccc_slope(spark: SparkSession, folder: str) -> DataFrame:
    scored = metrics.auc(long_predictions(spark, folder), ["target", "method", "split"], "y", "score")
    wide = scored.groupBy("method", "target").pivot("split", ["split0", "split1"]).agg(F.max("auc"))
    return wide.groupBy("method").agg(F.round(metrics.concordance("split0", "split1"), 6).alias("ccc"), F.round(F.avg(F.abs(F.col("split0") - F.col("split1"))), 8).alias("mean_gap"))


def _boot_cte(name: str, source: str, group: str, seed: int) -> str:
    """CTE `name` (group, rep, auc) of bootstrap replicates over `source`."""
    return f"""
{name}_draws AS ({metrics.draws_sql(source, 'doc_id', REPS, seed)}),
{name}_rows AS (SELECT s.*, rep, w FROM {source} s JOIN {name}_draws USING (doc_id) WHERE w > 0), {_auc_cte(name, f'{name}_rows', f'{group}, rep', weight='w')}"""


@query(f"""
WITH {PREDS_SQL}, {_auc_cte('a', 'long_preds', 'target, method')}, {_boot_cte('b', 'long_preds', 'target, method', 0)},
bounds AS (SELECT target, method, quantile_cont(auc, 0.025) AS lo, quantile_cont(auc, 0.975) AS hi, count(auc) AS n_reps FROM b GROUP BY ALL)
SELECT target, method, round(auc, 8) AS auc, round(lo, 8) AS lo, round(hi, 8) AS hi, n_reps, printf('%.3f [%.3f,%.3f]', auc, lo, hi) AS ci FROM a JOIN bounds USING (target, method)
""")
def boot_auc_ci(spark: SparkSession, folder: str) -> DataFrame:
    """Percentile interval of the AUC over Poisson bootstrap replicates, with the point estimate."""
    rows, group = long_predictions(spark, folder), ["target", "method"]
    return _with_interval(rows, group, metrics.bootstrap_auc(rows, group, "doc_id", "y", "score", REPS))


def _with_interval(rows: DataFrame, group: list[str], reps: DataFrame) -> DataFrame:
    bounds = reps.groupBy(*group).agg(F.percentile("auc", F.lit(0.025)).alias("lo"), F.percentile("auc", F.lit(0.975)).alias("hi"), F.count("auc").alias("n_reps"))
    point = metrics.auc(rows, group, "y", "score").select(*group, "auc")
    text = F.format_string("%.3f [%.3f,%.3f]", "auc", "lo", "hi")
    return point.join(bounds, group).select(*group, *[F.round(c, 8).alias(c) for c in ("auc", "lo", "hi")], "n_reps", text.alias("ci"))


_ELIGIBLE_SQL = "eligible AS (SELECT target, method, split FROM long_preds GROUP BY ALL HAVING count(*) FILTER (y = 1) >= 3 AND count(*) FILTER (y = 0) >= 3), kept AS (SELECT p.* FROM long_preds p JOIN eligible USING (target, method, split) WHERE split <> 'split0')"


@query(f"""
WITH {PREDS_SQL}, {_ELIGIBLE_SQL}, {_auc_cte('a', 'kept', 'target, method, split')}, {_boot_cte('b', 'kept', 'target, method, split', 5)},
bounds AS (SELECT target, method, split, quantile_cont(auc, 0.025) AS lo, quantile_cont(auc, 0.975) AS hi, count(auc) AS n_reps FROM b GROUP BY ALL)
SELECT target, method, split, round(auc, 8) AS auc, round(lo, 8) AS lo, round(hi, 8) AS hi, n_reps, printf('%.3f [%.3f,%.3f]', auc, lo, hi) AS ci FROM a JOIN bounds USING (target, method, split)
""")
def boot_restricted(spark: SparkSession, folder: str) -> DataFrame:
    """The same over the evaluation splits that have three rows of each class at least."""
    rows, group = long_predictions(spark, folder), ["target", "method", "split"]
    enough = rows.groupBy(*group).agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n")).filter("p >= 3 and n >= 3").select(*group)
    kept = rows.filter("split <> 'split0'").join(enough, group, "left_semi")
    return _with_interval(kept, group, metrics.bootstrap_auc(kept, group, "doc_id", "y", "score", REPS, seed=5))


_GAPS = tuple(f"split{i} - split0" for i in range(1, 5))
_FIVE = "five AS (SELECT * REPLACE ('split' || (doc_id % 5) AS split) FROM long_preds)"
_GAP_QUANTILES = (("lo", 0.025), ("mid", 0.5), ("hi", 0.975))


@query(f"""
WITH {PREDS_SQL}, {_FIVE}, {_boot_cte('b', 'five', 'target, method, split', 1)},
wide AS (SELECT target, method, rep, {', '.join(f"max(auc) FILTER (split = 'split{i}') AS split{i}" for i in range(5))} FROM b GROUP BY ALL)
SELECT target, method, {', '.join(f'round(quantile_cont({gap}, {q}), 8) AS d{i}_{n}' for i, gap in enumerate(_GAPS) for n, q in _GAP_QUANTILES)} FROM wide GROUP BY ALL
""")
def boot_multi_split(spark: SparkSession, folder: str) -> DataFrame:
    """Paired bootstrap of all methods in each of five splits; the differences of a method's AUCs from the first split's, per replicate."""
    rows = long_predictions(spark, folder).withColumn("split", F.concat(F.lit("split"), F.pmod("doc_id", F.lit(5)).cast("string")))
    reps = metrics.bootstrap_auc(rows, ["target", "method", "split"], "doc_id", "y", "score", REPS, seed=1)
    wide = reps.groupBy("target", "method", "rep").pivot("split", [f"split{i}" for i in range(5)]).agg(F.max("auc"))
    return wide.groupBy("target", "method").agg(*[F.round(F.percentile(F.expr(gap), F.lit(q)), 8).alias(f"d{i}_{n}") for i, gap in enumerate(_GAPS) for n, q in _GAP_QUANTILES])


@query(f"""
WITH {PREDS_SQL}, {_boot_cte('b', 'long_preds', 'target, method, split', 6)},
wide AS (SELECT target, method, rep, max(auc) FILTER (split = 'split0') AS x, max(auc) FILTER (split = 'split1') AS y FROM b GROUP BY ALL),
c AS (SELECT target, rep, 2 * covar_pop(x, y) / nullif(var_pop(x) + var_pop(y) + (avg(x) - avg(y)) * (avg(x) - avg(y)), 0) AS ccc FROM wide WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL)
SELECT target, round(quantile_cont(ccc, 0.025), 7) AS lo, round(quantile_cont(ccc, 0.5), 7) AS mid, round(quantile_cont(ccc, 0.975), 7) AS hi FROM c GROUP BY target
""")
def boot_concordance(spark: SparkSession, folder: str) -> DataFrame:
    """Interval of the concordance of methods' AUCs in two splits, over bootstrap replicates."""
    reps = metrics.bootstrap_auc(long_predictions(spark, folder), ["target", "method", "split"], "doc_id", "y", "score", REPS, seed=6)
    wide = reps.groupBy("target", "method", "rep").pivot("split", ["split0", "split1"]).agg(F.max("auc")).na.drop()
    per_rep = wide.groupBy("target", "rep").agg(metrics.concordance("split0", "split1").alias("ccc"))
    return per_rep.groupBy("target").agg(*[F.round(F.percentile("ccc", F.lit(q)), 7).alias(n) for n, q in _GAP_QUANTILES])


def _gap_and_slope(spark: SparkSession, folder: str) -> DataFrame:
    """By language: slope, r2 and n, and bootstrap bounds of the slope and of the difference of two groups' means."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("size"))
    rows = predictions(spark, folder).filter("method = 'prompting'").join(docs, "doc_id").withColumn("g", (F.col("quality") == 1).cast("double"))
    x, y, g = F.col("size"), F.col("score"), F.col("g")
    sums = {"n": F.lit(1.0), "n1": g, "y1": g * y, "sx": x, "sy": y, "sxy": x * y, "sxx": x * x}
    reps = metrics.bootstrap_sums(rows, ["lang"], "doc_id", sums, REPS, seed=2)
    zero, c = F.lit(0.0), F.col
    gap = c("y1") / F.nullif(c("n1"), zero) - (c("sy") - c("y1")) / F.nullif(c("n") - c("n1"), zero)
    slope = (c("n") * c("sxy") - c("sx") * c("sy")) / F.nullif(c("n") * c("sxx") - c("sx") * c("sx"), zero)
    bounds = reps.select("lang", gap.alias("gap"), slope.alias("slope")).groupBy("lang").agg(*[F.percentile(v, F.lit(q)).alias(f"{v}_{k}") for v in ("gap", "slope") for k, q in (("lo", 0.025), ("hi", 0.975))])
    point = rows.groupBy("lang").agg(F.regr_slope("score", "size").alias("slope"), F.regr_r2("score", "size").alias("r2"), F.count(F.lit(1)).alias("n"))
    return point.join(bounds, "lang")


@query()
def boot_mean_and_slope(spark: SparkSession, folder: str) -> DataFrame:
    """Bootstrap of the difference of two groups' means and of a regression slope, per language; the slope's t-test."""
    t = F.sqrt(F.col("r2") * (F.col("n") - 2) / F.nullif(1 - F.col("r2"), F.lit(0.0)))
    return _gap_and_slope(spark, folder).withColumn("p_value", htest.two_sided_t(t, (F.col("n") - 2).cast("double")))


@query(f"""
WITH {PREDS_SQL},
r AS (SELECT doc_id, lang, n_chars::DOUBLE AS x, score AS y, (quality = 1)::INT AS g FROM preds JOIN documents USING (doc_id) WHERE method = 'prompting'),
w AS ({metrics.draws_sql('r', 'doc_id', REPS, 2)}),
s AS (SELECT lang, rep, sum(w)::DOUBLE AS n, sum(w * g)::DOUBLE AS n1, sum(w * g * y) AS y1, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * y) AS sxy, sum(w * x * x) AS sxx FROM r JOIN w USING (doc_id) GROUP BY ALL),
b AS (SELECT lang, y1 / nullif(n1, 0) - (sy - y1) / nullif(n - n1, 0) AS gap, (n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0) AS slope FROM s),
p AS (SELECT lang, regr_slope(y, x) AS slope, regr_r2(y, x) AS r2, count(*) AS n FROM r GROUP BY lang)
SELECT p.lang, round(any_value(p.slope), 10) AS slope, round(any_value(r2), 7) AS r2, any_value(n) AS n, round(quantile_cont(gap, 0.025), 7) AS gap_lo, round(quantile_cont(gap, 0.975), 7) AS gap_hi,
  round(quantile_cont(b.slope, 0.025), 10) AS slope_lo, round(quantile_cont(b.slope, 0.975), 10) AS slope_hi FROM p JOIN b ON p.lang = b.lang GROUP BY p.lang
""")
def boot_gap_and_slope(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics of boot_mean_and_slope, compared with SQL."""
    places = {"slope": 10, "r2": 7, "gap_lo": 7, "gap_hi": 7, "slope_lo": 10, "slope_hi": 10}
    return _gap_and_slope(spark, folder).select("lang", "n", *[F.round(c, n).alias(c) for c, n in places.items()])


_RANK_SUM_SQL = """
r AS (SELECT *, rank() OVER (PARTITION BY method ORDER BY score) + (count(*) OVER (PARTITION BY method, score) - 1) / 2.0 AS mid, count(*) OVER (PARTITION BY method, score) AS tied FROM preds),
s AS (SELECT method, sum(mid) FILTER (toxic = 1) AS w, count(*) FILTER (toxic = 1)::DOUBLE AS a, count(*) FILTER (toxic = 0)::DOUBLE AS b, sum(tied * tied - 1)::DOUBLE AS ties FROM r GROUP BY method)"""


@query(f"""
WITH {PREDS_SQL}, {_RANK_SUM_SQL}
SELECT method, w, a::BIGINT AS n_1, b::BIGINT AS n_0, round((w - a * (a + b + 1) / 2) / sqrt(a * b * (a + b + 1) / 12), 8) AS z, w - a * (a + 1) / 2 AS u,
  round((abs(w - a * (a + 1) / 2 - a * b / 2) - 0.5) / sqrt(a * b / 12 * ((a + b + 1) - ties / ((a + b) * (a + b - 1)))), 8) AS z_tied FROM s
""")
def ranksum_mwu(spark: SparkSession, folder: str) -> DataFrame:
    out = htest.rank_sum(predictions(spark, folder), ["method"], "toxic", "score")
    return out.select("method", "w", "n_1", "n_0", F.round("z", 8).alias("z"), "u", F.round("z_tied", 8).alias("z_tied"))


@query(f"""
WITH {PREDS_SQL},
w AS (SELECT doc_id, toxic, max(score) FILTER (method = 'prompting') - max(score) FILTER (method = 'tabular') AS d FROM preds GROUP BY ALL),
k AS (SELECT toxic, round(d, 9) AS d, abs(round(d, 9)) AS s FROM w WHERE round(d, 9) <> 0),
r AS (SELECT *, rank() OVER (PARTITION BY toxic ORDER BY s) + (count(*) OVER (PARTITION BY toxic, s) - 1) / 2.0 AS mid, count(*) OVER (PARTITION BY toxic, s) AS tied FROM k),
s AS (SELECT toxic, count(*)::DOUBLE AS n, coalesce(sum(mid) FILTER (d > 0), 0) AS w_plus, sum(tied * tied - 1)::DOUBLE AS ties FROM r GROUP BY toxic)
SELECT toxic, n::BIGINT AS n, w_plus, least(w_plus, n * (n + 1) / 2 - w_plus) AS w, round((w_plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 8) AS z FROM s
""")
def wilcoxon(spark: SparkSession, folder: str) -> DataFrame:
    wide = predictions(spark, folder).groupBy("doc_id", "toxic").pivot("method", ["prompting", "tabular"]).agg(F.max("score"))
    out = htest.signed_rank(wide.withColumn("d", F.round(F.col("prompting") - F.col("tabular"), 9)), ["toxic"], "d")
    return out.select("toxic", "n", "w_plus", "w", F.round("z", 8).alias("z"))


#: Groups of at most twelve labels, whose sign patterns SQL can enumerate.
SMALL_GROUP = 12


@query(f"""
WITH {PREDS_SQL},
b AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // {SMALL_GROUP} AS block_group FROM labels),
q AS (SELECT block_group, p.* FROM preds p JOIN b USING (doc_id)),
d AS (SELECT x.block_group, x.method AS level_a, y.method AS level_b, round(x.score * 101)::BIGINT - round(y.score * 101)::BIGINT AS d FROM q x JOIN q y ON x.doc_id = y.doc_id AND x.method < y.method),
k AS (SELECT *, abs(d) AS s, row_number() OVER (PARTITION BY block_group, level_a, level_b) - 1 AS i FROM d WHERE d <> 0),
r AS (SELECT *, 2 * rank() OVER (PARTITION BY block_group, level_a, level_b ORDER BY s) + count(*) OVER (PARTITION BY block_group, level_a, level_b, s) - 1 AS r2 FROM k),
w AS (SELECT block_group, level_a, level_b, count(*) AS n, coalesce(sum(r2) FILTER (d > 0), 0) AS w2 FROM r GROUP BY ALL),
e AS (SELECT block_group, level_a, level_b, n, w2, unnest(range(1 << n)) AS signs FROM w),
t AS (SELECT e.block_group, e.level_a, e.level_b, e.n, e.w2, signs, sum(CASE WHEN (signs >> i) & 1 = 1 THEN r2 ELSE 0 END) AS w FROM e JOIN r USING (block_group, level_a, level_b) GROUP BY ALL)
SELECT block_group, level_a, level_b, n, w2 / 2.0::DOUBLE AS w_plus, true AS exact, round(least(1.0, 2.0 * least(count(*) FILTER (w <= w2), count(*) FILTER (w >= w2)) / (1 << n)), 10) AS p_value FROM t GROUP BY block_group, level_a, level_b, n, w2
UNION ALL SELECT block_group, level_a, level_b, 0, 0.0, true, 1.0 FROM d GROUP BY ALL HAVING count(*) FILTER (d <> 0) = 0
""")
def wilcoxon_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Exact signed-rank tests of all pairs of methods within groups of twelve labelled documents."""
    order = windows.factorise(table(spark, folder, "labels").select("doc_id"), "doc_id", "doc_id", "place")
    groups = order.select("doc_id", F.floor(F.col("place") / SMALL_GROUP).alias("block_group"))
    rows = predictions(spark, folder).join(groups, "doc_id").withColumn("points", F.round(F.col("score") * 101).cast("long"))
    out = htest.signed_rank_pairs(rows, ["block_group"], ["doc_id"], "method", "points")
    return out.select("block_group", "level_a", "level_b", "n", "w_plus", "exact", F.round("p_value", 10).alias("p_value"))


@query(f"""
WITH {PREDS_SQL},
d AS (SELECT x.method AS level_a, y.method AS level_b, round(x.score * 101)::BIGINT - round(y.score * 101)::BIGINT AS d FROM preds x JOIN preds y ON x.doc_id = y.doc_id AND x.method < y.method),
k AS (SELECT *, abs(d) AS s FROM d WHERE d <> 0),
r AS (SELECT *, rank() OVER (PARTITION BY level_a, level_b ORDER BY s) + (count(*) OVER (PARTITION BY level_a, level_b, s) - 1) / 2.0 AS mid, count(*) OVER (PARTITION BY level_a, level_b, s) AS tied FROM k),
s AS (SELECT level_a, level_b, count(*)::DOUBLE AS n, coalesce(sum(mid) FILTER (d > 0), 0) AS w_plus, sum(tied * tied - 1)::DOUBLE AS ties FROM r GROUP BY ALL)
SELECT level_a, level_b, n::BIGINT AS n, w_plus::DOUBLE AS w_plus, n <= 50 AS exact, round((w_plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 8) AS z FROM s
""")
def wilcoxon_all_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Signed-rank statistics of all pairs of methods over all labelled documents."""
    rows = predictions(spark, folder).withColumn("points", F.round(F.col("score") * 101).cast("long"))
    return htest.signed_rank_pairs(rows, [], ["doc_id"], "method", "points").select("level_a", "level_b", "n", "w_plus", "exact", F.round("z", 8).alias("z"))


@query(f"""
WITH {PREDS_SQL},
r AS (SELECT toxic, method, rank() OVER (PARTITION BY toxic ORDER BY score) + (count(*) OVER (PARTITION BY toxic, score) - 1) / 2.0 AS mid, count(*) OVER (PARTITION BY toxic, score) AS tied FROM preds),
p AS (SELECT toxic, method, sum(mid) AS r, count(*)::DOUBLE AS n, sum(tied * tied - 1)::DOUBLE AS ties FROM r GROUP BY ALL),
s AS (SELECT toxic, sum(r * r / n) AS s, sum(n) AS n, sum(ties) AS ties, count(*) - 1 AS df FROM p GROUP BY toxic)
SELECT toxic, round((12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 6) AS h, df FROM s
""")
def kruskal(spark: SparkSession, folder: str) -> DataFrame:
    return htest.kruskal_wallis(predictions(spark, folder), ["toxic"], "method", "score").select("toxic", F.round("h", 6).alias("h"), "df")


@query(f"""
WITH {PREDS_SQL},
r AS (SELECT doc_id, method, rank() OVER (PARTITION BY doc_id ORDER BY score) + (count(*) OVER (PARTITION BY doc_id, score) - 1) / 2.0 AS mid, count(*) OVER (PARTITION BY doc_id, score) AS tied, count(*) OVER (PARTITION BY doc_id) AS k FROM preds),
p AS (SELECT method, sum(mid) AS r, count(*)::DOUBLE AS n, sum(tied * tied - 1)::DOUBLE AS ties, max(k)::DOUBLE AS k FROM r GROUP BY method),
s AS (SELECT sum(r * r) AS s, max(n) AS n, sum(ties) AS ties, max(k) AS k FROM p)
SELECT round((12 / (n * k * (k + 1)) * s - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1))), 6) AS chi2, (k - 1)::BIGINT AS df FROM s
""")
def friedman(spark: SparkSession, folder: str) -> DataFrame:
    return htest.friedman(predictions(spark, folder), "doc_id", "method", "score").select(F.round("chi2", 6).alias("chi2"), "df")


@query(f"""
WITH {PREDS_SQL},
w AS (SELECT doc_id, toxic AS y, max(score) FILTER (method = 'prompting') AS s1, max(score) FILTER (method = 'tabular') AS s2 FROM preds GROUP BY ALL),
pos AS (SELECT p.doc_id, avg((p.s1 > q.s1)::INT + 0.5 * (p.s1 = q.s1)::INT) AS v1, avg((p.s2 > q.s2)::INT + 0.5 * (p.s2 = q.s2)::INT) AS v2 FROM w p, w q WHERE p.y = 1 AND q.y = 0 GROUP BY p.doc_id),
neg AS (SELECT q.doc_id, avg((p.s1 > q.s1)::INT + 0.5 * (p.s1 = q.s1)::INT) AS v1, avg((p.s2 > q.s2)::INT + 0.5 * (p.s2 = q.s2)::INT) AS v2 FROM w p, w q WHERE p.y = 1 AND q.y = 0 GROUP BY q.doc_id),
a AS (SELECT avg(v1) AS a1, avg(v2) AS a2, (var_samp(v1) + var_samp(v2) - 2 * covar_samp(v1, v2)) / count(*) AS s FROM pos),
b AS (SELECT (var_samp(v1) + var_samp(v2) - 2 * covar_samp(v1, v2)) / count(*) AS s FROM neg)
SELECT round(a1, 8) AS auc_1, round(a2, 8) AS auc_2, round((a1 - a2) / sqrt(a.s + b.s), 6) AS z FROM a, b
""")
def delong_paired(spark: SparkSession, folder: str) -> DataFrame:
    out = htest.delong_paired(predictions(spark, folder), [], "doc_id", "toxic", "method", "score", "prompting", "tabular")
    return out.select(F.round("auc_1", 8).alias("auc_1"), F.round("auc_2", 8).alias("auc_2"), F.round("z", 6).alias("z"))


@query(f"""
WITH {PREDS_SQL},
w AS (SELECT doc_id, method, split, toxic AS y, score AS s FROM preds WHERE split IN ('split0', 'split1')),
pos AS (SELECT p.method, p.split, p.doc_id, avg((p.s > q.s)::INT + 0.5 * (p.s = q.s)::INT) AS v FROM w p JOIN w q USING (method, split) WHERE p.y = 1 AND q.y = 0 GROUP BY ALL),
neg AS (SELECT q.method, q.split, q.doc_id, avg((p.s > q.s)::INT + 0.5 * (p.s = q.s)::INT) AS v FROM w p JOIN w q USING (method, split) WHERE p.y = 1 AND q.y = 0 GROUP BY ALL),
a AS (SELECT method, split, avg(v) AS auc, var_samp(v) / count(*) AS s FROM pos GROUP BY ALL),
b AS (SELECT method, split, var_samp(v) / count(*) AS s FROM neg GROUP BY ALL),
j AS (SELECT method, split, auc, a.s + b.s AS v FROM a JOIN b USING (method, split))
SELECT method, round(max(auc) FILTER (split = 'split0'), 8) AS auc_1, round(max(auc) FILTER (split = 'split1'), 8) AS auc_2,
  round((max(auc) FILTER (split = 'split0') - max(auc) FILTER (split = 'split1')) / sqrt(sum(v)), 6) AS z FROM j GROUP BY method
""")
def delong_unpaired(spark: SparkSession, folder: str) -> DataFrame:
    out = htest.delong_unpaired(predictions(spark, folder), ["method"], "toxic", "score", "split", "split0", "split1")
    return out.select("method", F.round("auc_1", 8).alias("auc_1"), F.round("auc_2", 8).alias("auc_2"), F.round("z", 6).alias("z"))


@query(f"""
WITH p AS (SELECT event_type, user_id, least(1.0, 0.0005 + (sum(value) % 1) * (sum(value) % 1)) AS p FROM (SELECT event_type, user_id, round(sum(value), 2) AS value FROM events GROUP BY ALL) GROUP BY ALL),
m AS (SELECT *, count(*) OVER (PARTITION BY event_type) AS m, row_number() OVER (PARTITION BY event_type ORDER BY p) AS i, rank() OVER (PARTITION BY event_type ORDER BY p) + count(*) OVER (PARTITION BY event_type, p) - 1 AS r FROM p),
h AS (SELECT event_type, sum(1.0 / i) AS h FROM m GROUP BY event_type),
raw AS (SELECT m.*, p * m * h / r AS q FROM m JOIN h USING (event_type)),
adj AS (SELECT *, least(min(q) OVER (PARTITION BY event_type ORDER BY p DESC), 1.0) AS p_by FROM raw)
SELECT event_type, user_id, round(least(p * m, 1.0), 8) AS p_bonferroni, round(p_by, 8) AS p_by FROM adj
""")
def bonferroni_by(spark: SparkSession, folder: str) -> DataFrame:
    sums = table(spark, folder, "events").groupBy("event_type", "user_id").agg(F.round(F.sum("value"), 2).alias("v"))
    rows = sums.withColumn("p", F.least(F.lit(1.0), F.lit(0.0005) + (F.col("v") % 1) * (F.col("v") % 1)))
    out = htest.benjamini_yekutieli(rows, ["event_type"], "p").withColumn("p_bonferroni", htest.bonferroni(F.col("p"), ["event_type"]))
    return out.select("event_type", "user_id", F.round("p_bonferroni", 8).alias("p_bonferroni"), F.round("p_by", 8).alias("p_by"))


@query(f"""
WITH {PREDS_SQL},
s AS (SELECT method, min(score) AS lo, max(score) AS hi, stddev_samp(score) * pow(count(*), -0.2) AS h FROM preds GROUP BY method),
g AS (SELECT s.*, step, lo + (hi - lo) * step / 49 AS x FROM s, (SELECT unnest(range(0, 50)) AS step)),
k AS (SELECT g.method, step, x, sum(exp(-pow((x - score) / h, 2) / 2)) AS k FROM g JOIN preds p ON p.method = g.method GROUP BY ALL)
SELECT method, step::INT AS step, round(x, 8) AS x, round(k / max(k) OVER (PARTITION BY method), 8) AS density FROM k
""")
def density_grid(spark: SparkSession, folder: str) -> DataFrame:
    return htest.density_on_grid(predictions(spark, folder), ["method"], "score").select("method", "step", F.round("x", 8).alias("x"), F.round("density", 8).alias("density"))


@query("""
WITH p AS (SELECT source, avg(toxic)::DOUBLE AS p FROM labels JOIN documents USING (doc_id) GROUP BY source),
c AS (SELECT source, p, pow(0.05 / 1.959963984540054, 2) AS l, 0.75 * 0.25 AS a, 0.75 / 1.25 - 0.5625 AS b, 1.125 / 1.75 - 0.5625 AS c FROM p WHERE p > 0 AND p < 1)
SELECT source, round(p, 8) AS prevalence, ceil((p * b + (1 - p) * c + sqrt(pow(p * b + (1 - p) * c, 2) + 4 * l * p * (1 - p) * (a - b - c))) / (2 * l * p * (1 - p)))::BIGINT AS n FROM c
""")
def auc_sample_size(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "source"), "doc_id")
    share = rows.groupBy("source").agg(F.avg("toxic").alias("p")).filter("p > 0 and p < 1")
    return share.select("source", F.round("p", 8).alias("prevalence"), htest.auc_sample_size(F.col("p")).alias("n"))


@query()
def test_p_values(spark: SparkSession, folder: str) -> DataFrame:
    """p-values of the tests above, by functions that SQL doesn't have."""
    rows = predictions(spark, folder)
    ranks = htest.rank_sum(rows, ["method"], "toxic", "score").select(F.concat(F.lit("rank sum "), "method").alias("test"), F.col("z").alias("statistic"), htest.two_sided_normal("z").alias("p_value"))
    h = htest.kruskal_wallis(rows, ["toxic"], "method", "score").select(F.concat(F.lit("kruskal "), F.col("toxic").cast("string")).alias("test"), F.col("h").alias("statistic"), htest.chi_square_upper("h", F.col("df").cast("double")).alias("p_value"))
    return ranks.unionByName(h)


@query(f"""
WITH {PREDS_SQL}, r AS (SELECT doc_id, method, rank() OVER (PARTITION BY method ORDER BY score) + (count(*) OVER (PARTITION BY method, score) - 1) / 2.0 AS mid_rank FROM preds)
SELECT * FROM r
""")
def mid_rank(spark: SparkSession, folder: str) -> DataFrame:
    return mid_ranks(predictions(spark, folder), ["method"], "score").select("doc_id", "method", "mid_rank")


@query(f"""
WITH {PREDS_SQL}, m AS (SELECT method, score, abs(score - 0.5) AS size FROM preds),
g AS (SELECT method, avg(size) AS importance FROM m GROUP BY method HAVING avg(size) > 1e-8)
SELECT method, round(importance, 8) AS importance, rank() OVER (ORDER BY round(importance, 10) DESC)::INT AS place FROM g
""")
def mean_abs_importance(spark: SparkSession, folder: str) -> DataFrame:
    """Mean absolute contribution per feature, near-zero ones left out, largest first."""
    means = predictions(spark, folder).groupBy("method").agg(F.avg(F.abs(F.col("score") - 0.5)).alias("importance")).filter("importance > 1e-8")
    # One row per feature: a single window over them is small.
    return means.withColumn("place", F.rank().over(Window.orderBy(F.round("importance", 10).desc()))).withColumn("importance", F.round("importance", 8))
