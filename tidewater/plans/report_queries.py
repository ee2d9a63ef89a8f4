"""Queries of report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import metrics, reports
from tidewater.plans.catalog import query
from tidewater.plans.metric_queries import REPS, _auc_cte, _boot_cte
from tidewater.plans.predictions import PREDS_SQL, long_predictions
from tidewater.sources.tables import table


@query("""
WITH l AS (SELECT user_id AS run, event_id % 50 AS step, (epoch_us(ts) // 1000000 - 1704067200) / 86400.0::DOUBLE AS epoch, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS loss FROM events),
s AS (SELECT run, step, min(epoch) AS e, arg_min(loss, epoch) FILTER (loss IS NOT NULL) AS loss FROM l GROUP BY ALL)
SELECT run, floor(e)::BIGINT AS epoch, round(avg(loss), 8) AS mean_loss, max(loss) AS max_loss FROM s GROUP BY ALL
""")
def loss_curve(spark: SparkSession, folder: str) -> DataFrame:
    """Events read as training logs: a run per user, losses by step, days as epochs."""
    day = (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000) - 1704067200) / F.lit(86400.0)
    log = table(spark, folder, "events").select(F.col("user_id").alias("run"), F.pmod("event_id", F.lit(50)).alias("step"), day.alias("at"), F.when(F.col("event_type") != "error", F.col("value")).alias("loss"))
    out = reports.loss_curve(log, ["run"], "step", "at", ["loss"])
    return out.select("run", "epoch", F.round("mean_loss", 8).alias("mean_loss"), "max_loss")


@query(f"""
WITH {PREDS_SQL}, {_auc_cte('a', 'long_preds', 'target, method, split')},
w AS (SELECT target, method, max(auc) FILTER (split = 'split0') AS b, max(auc) FILTER (split = 'split1') AS c FROM a GROUP BY ALL)
SELECT target, 'auc' AS metric, round(avg(c - b), 8) AS delta FROM w GROUP BY target
""")
def phase_deltas(spark: SparkSession, folder: str) -> DataFrame:
    scored = metrics.auc(long_predictions(spark, folder), ["target", "method", "split"], "y", "score")
    return reports.phase_deltas(scored, ["target", "method"], "split", "split0", "split1", ["auc"], ["target"]).withColumn("delta", F.round("delta", 8))


@query(f"""
WITH {PREDS_SQL}, {_auc_cte('a', 'long_preds', 'target, method, split')},
b AS (SELECT a.*, base.auc AS baseline, ((a.auc - base.auc) * 1000) % 1 AS u FROM a JOIN a base ON base.target = a.target AND base.split = a.split AND base.method = 'prompting' WHERE a.method <> 'prompting')
SELECT method, count(DISTINCT CASE WHEN abs(auc - baseline) > 0.02 AND auc > baseline THEN target || split END) AS n_better, count(DISTINCT CASE WHEN abs(auc - baseline) > 0.02 AND auc <= baseline THEN target || split END) AS n_worse, count(DISTINCT target || split) AS n
FROM b GROUP BY method
""")
def baseline_tally(spark: SparkSession, folder: str) -> DataFrame:
    """In how many targets and splits a method is clearly above or below the baseline's AUC."""
    scored = metrics.auc(long_predictions(spark, folder), ["target", "method", "split"], "y", "score").withColumn("item", F.concat("target", "split"))
    rows = reports.with_baseline(scored, ["target", "split"], "method", "prompting", "auc").filter("method <> 'prompting'")
    close = F.when(F.abs(F.col("auc") - F.col("baseline")) > 0.02, 0.0).otherwise(1.0)
    return reports.significance_tally(rows, ["method"], "item", F.col("is_better"), close)


@query(f"""
WITH {PREDS_SQL}, {_boot_cte('b', 'long_preds', 'target, method, split', 4)},
wide AS (SELECT target, method, rep, max(auc) FILTER (split = 'split0') AS x, max(auc) FILTER (split = 'split1') AS y FROM b GROUP BY ALL),
lines AS (SELECT rep, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM wide WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY rep),
heights AS (SELECT k / 20.0::DOUBLE AS x, i + s * (k / 20.0::DOUBLE) AS height FROM lines, range(21) t(k))
SELECT x, round(quantile_cont(height, 0.025), 6) AS low, round(quantile_cont(height, 0.5), 6) AS middle, round(quantile_cont(height, 0.975), 6) AS high FROM heights GROUP BY x
""")
def fitted_ribbon(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of one split's AUC on another's over bootstrap replicates: median and percentiles on a grid."""
    reps = metrics.bootstrap_auc(long_predictions(spark, folder), ["target", "method", "split"], "doc_id", "y", "score", REPS, seed=4)
    wide = reps.groupBy("target", "method", "rep").pivot("split", ["split0", "split1"]).agg(F.max("auc")).na.drop()
    ribbon = reports.fitted_ribbon(wide, "rep", "split0", "split1", [x / 20 for x in range(21)])
    return ribbon.select("x", *[F.round(c, 6).alias(c) for c in ("low", "middle", "high")])


@query("""
WITH d AS (SELECT o_orderstatus AS draw, o_custkey AS unit, avg(o_totalprice) AS v FROM orders GROUP BY ALL),
r AS (SELECT draw, v, c_acctbal AS x FROM d JOIN customer ON c_custkey = unit)
SELECT draw, unnest(['constant', 'c_acctbal']) AS term, unnest([round(regr_intercept(v, x), 3), round(regr_slope(v, x), 6)]) AS coefficient FROM r GROUP BY draw
""")
def regress_per_draw(spark: SparkSession, folder: str) -> DataFrame:
    """Mean order price of a customer on the account balance, solved per order status."""
    draws = table(spark, folder, "orders").groupBy(F.col("o_orderstatus").alias("draw"), F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("v"))
    out = reports.regress_per_draw(draws, "draw", "c_custkey", "v", table(spark, folder, "customer"), ["c_acctbal"])
    return out.withColumn("coefficient", F.when(F.col("term") == "constant", F.round("coefficient", 3)).otherwise(F.round("coefficient", 6)))


@query("""
WITH s AS (SELECT lang, count(*)::DOUBLE AS n, avg(toxic)::DOUBLE AS p FROM labels JOIN documents USING (doc_id) GROUP BY lang), w AS (SELECT sum(n) AS n, sum(n * p) / sum(n) AS p FROM s)
SELECT lang, round(s.n / w.n * s.p, 8) AS part, round(greatest(w.p - s.n / w.n * s.p, 0), 8) AS rest FROM s, w
""")
def prevalence_parts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "lang"), "doc_id")
    per = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg("toxic").alias("p"))
    whole = rows.agg(F.count(F.lit(1)).alias("all_n"), F.avg("toxic").alias("all_p"))
    part, rest = reports.prevalence_parts(F.col("n") / F.col("all_n"), F.col("p"), F.col("all_p"))
    return per.crossJoin(F.broadcast(whole)).select("lang", F.round(part, 8).alias("part"), F.round(rest, 8).alias("rest"))


@query("""
SELECT user_id, min(ts) FILTER (event_type = 'purchase') AS first_purchase, median(value) FILTER (event_type = 'view') AS median_view, median(value) FILTER (event_type = 'click') AS median_click FROM events GROUP BY user_id
""")
def conditional_firsts(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, folder, "events").groupBy("user_id").agg(F.min(F.when(kind == "purchase", F.col("ts"))).alias("first_purchase"), F.median(F.when(kind == "view", F.col("value"))).alias("median_view"), F.median(F.when(kind == "click", F.col("value"))).alias("median_click"))
