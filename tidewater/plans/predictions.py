"""The prediction table of the queries: labels with a deterministic pseudo-score per method, in both languages.

The score of method m for a document is ((doc_id * a_m + b_m) mod 101) / 101, so that both engines compute the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.sources.tables import table

#: Fixed values: (method, a, b).
METHODS = (("prompting", 37, 11), ("tabular", 53, 7), ("nlp", 71, 29), ("finetune", 17, 3))

#: CTEs `preds` (doc_id, method, score, toxic, quality, split) and `long_preds` (the same with a row per target).
PREDS_SQL = f"""
preds AS (
  SELECT l.doc_id, m.method, ((l.doc_id * m.a + m.b) % 101) / 101.0::DOUBLE AS score, l.toxic, l.quality, 'split' || (l.doc_id % 3) AS split
  FROM labels l, (VALUES {', '.join(f"('{m}', {a}, {b})" for m, a, b in METHODS)}) AS m(method, a, b)),
long_preds AS (
  SELECT doc_id, method, score, split, 'toxic' AS target, toxic AS y FROM preds
  UNION ALL SELECT doc_id, method, score, split, 'quality', quality FROM preds)"""


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, method, score, toxic, quality, split."""
    methods = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(a).alias("a"), F.lit(b).alias("b")) for m, a, b in METHODS])
    rows = table(spark, folder, "labels").withColumn("m", F.explode(methods))
    score = F.pmod(F.col("doc_id") * F.col("m.a") + F.col("m.b"), F.lit(101)) / F.lit(101.0)
    return rows.select("doc_id", F.col("m.method").alias("method"), score.alias("score"), "toxic", "quality", F.concat(F.lit("split"), F.pmod("doc_id", F.lit(3)).cast("string")).alias("split"))


def long_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, method, score, split, target, y."""
    targets = F.array(F.struct(F.lit("toxic").alias("target"), F.col("toxic").alias("y")), F.struct(F.lit("quality").alias("target"), F.col("quality").alias("y")))
    return predictions(spark, folder).withColumn("t", F.explode(targets)).select("doc_id", "method", "score", "split", "t.target", "t.y")
