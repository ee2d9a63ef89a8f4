"""Queries without SQL against brute force or identities, and models against answers that are known."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tidewater.functions import text
from tidewater.operators import models, reports
from tidewater.operators.textstats import word_metric_change
from tidewater.plans import catalog


def _rows(spark, sf, name):
    return [r.asDict() for r in catalog.queries()[name](spark, sf).collect()]


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def test_p_values_are_those_of_the_normal_distribution(spark, sf):
    rows = [r for r in _rows(spark, sf, "test_p_values") if r["test"].startswith("rank sum")]
    assert rows and all(r["p_value"] == pytest.approx(_two_sided(r["statistic"]), abs=1e-6) for r in rows)


def test_adjusted_p_values_of_words(spark, sf):
    """Benjamini and Yekutieli: the running minimum, from the greatest p, of p * m * H(m) / rank."""
    rows = sorted(_rows(spark, sf, "word_p_values"), key=lambda r: r["p_value"])
    m = len(rows)
    harmonic, least = sum(1 / i for i in range(1, m + 1)), 1.0
    for rank, r in sorted(enumerate(rows, 1), reverse=True):
        assert r["p_value"] == pytest.approx(_two_sided(r["z"]), abs=1e-5)
        least = min(least, r["p_value"] * m * harmonic / rank)
        assert r["p_adjusted"] == pytest.approx(least, rel=1e-6)


def test_balanced_parts_hold_every_row(spark, sf):
    rows = _rows(spark, sf, "balanced_parts")
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    assert sum(r["n"] for r in rows) == len(labels) and sum(r["load"] for r in rows) == int((labels.quality != -1).sum() + (labels.toxic == 1).sum())
    assert {r["part"] for r in rows} <= set(range(8))


def test_models_score_their_test_part(spark, sf):
    rows = {r["model"]: r for r in _rows(spark, sf, "train_and_score")}
    assert set(rows) == {"lasso", "trees", "perceptron"} and len({(r["n_pos"], r["n_neg"]) for r in rows.values()}) == 1
    assert all(0 <= r["auc"] <= 1 for r in rows.values()) and rows["trees"]["auc"] > 0.5


def test_ribbon_and_intervals_are_in_order(spark, sf):
    assert all(r["low"] <= r["middle"] <= r["high"] for r in _rows(spark, sf, "fitted_ribbon"))
    for r in _rows(spark, sf, "boot_mean_and_slope"):
        assert all(r[f"{c}_lo"] is None or r[f"{c}_lo"] <= r[f"{c}_hi"] for c in ("gap", "slope")) and 0 <= r["r2"] <= 1


def test_perceptron_learns_what_no_line_divides(spark):
    from pyspark.ml.feature import VectorAssembler

    points = spark.createDataFrame([(float(a), float(b), float(a != b)) for a in (0, 1) for b in (0, 1)] * 25, "a double, b double, y double")
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(points)
    scored = models.scored(models.perceptron("y", 2).fit(rows), rows, ["y"]).collect()
    assert all((r["score"] >= 0.5) == (r["y"] == 1) for r in scored)


def test_posterior_summary_by_group(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(101)] + [(None, 3.0)], "g string, v double")
    assert {tuple(r) for r in reports.posterior_summary(df, ["g"], "v").collect()} == {("a", 50.0, 2.5, 97.5), (None, 3.0, 3.0, 3.0)}


def test_words_and_numbers_in_text(spark):
    df = spark.createDataFrame([("a pain b", "x 'Probability': 0.25, y"), (None, None), ("", "none")], "t string, r string")
    rows = df.select(text.replace_words(F.col("t"), {"pain": "ache"}), text.number_in_text(F.col("r"))).collect()
    assert [tuple(r) for r in rows] == [("a ache b", 0.25), (None, None), ("", None)]


def test_word_metrics_of_few_documents(spark):
    """Null texts hold no word; a side without positives or hits has no metric; repeated words count once."""
    docs = spark.createDataFrame([(1, "pain pain"), (2, "pain."), (3, "calm"), (4, "calm 7"), (5, None), (6, "")], "doc_id long, text string")
    scores = spark.createDataFrame([(1, 0.9, 1), (2, 0.2, 0), (3, 0.8, 0), (4, 0.7, 1), (5, 0.6, 1), (6, 0.1, 0)], "doc_id long, score double, y int")
    found = {r["word"]: tuple(r)[1:] for r in word_metric_change(docs, scores, "doc_id", "text", "y", "score", 2).collect()}
    # pain: AUC 1 against 2 of 4 pairs; no false hit against 1 of 3. calm: 0 of 1 pair against 4 of 4; 1 of 2 against 0 of 2.
    assert found == {"pain": (2, 0.5, pytest.approx(-1 / 3)), "calm": (2, -1.0, 0.5)}
    assert word_metric_change(docs.limit(0), scores, "doc_id", "text", "y", "score", 2).count() == 0
