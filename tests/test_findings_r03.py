"""Rows that are shuffled stay few: words are added up before the shuffle, bootstrap sums within a task (findings of round 3)."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tidewater.operators import metrics, textstats
from tidewater.plans import model_queries, table_queries

DOCS, WORDS = 400, 60


@pytest.fixture(scope="module")
def docs(spark):
    """Documents of the same words: many (document, word) pairs, few words; each id holds its words in two texts."""
    words = " ".join(f"w{chr(97 + i // 10)}{chr(97 + i % 10)}" for i in range(WORDS))
    return spark.createDataFrame([(i, f"{words} in{chr(97 + i % 26)}") for i in range(DOCS)] + [(i, "waa. wab") for i in range(DOCS)], "doc_id long, text string").repartition(2).cache()


@pytest.fixture(scope="module")
def scores(spark):
    return spark.createDataFrame([(i, i % 7 / 7, i % 2) for i in range(DOCS)], "doc_id long, score double, y int")


def shuffled(spark, action, what: str = "shuffleWriteRecords") -> int:
    """Rows (or bytes) written to shuffles by an action."""
    sc, jvm = spark.sparkContext, spark._jvm

    def total() -> int:
        stages = sc._jsc.sc().statusStore().stageList(jvm.java.util.Collections.emptyList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.Collections.emptyList())
        return sum(getattr(stages.apply(i), what)() for i in range(stages.size()))

    before = total()
    action()
    return total() - before


def test_word_contrast_shuffles_words_not_pairs(spark, docs, scores):
    assert shuffled(spark, lambda: textstats.word_contrast(docs, scores, "doc_id", "text", "score", 0.5).collect()) < DOCS * WORDS / 2


def test_word_metric_change_stores_sums_by_score(spark, docs, scores):
    assert shuffled(spark, lambda: textstats.word_metric_change(docs, scores, "doc_id", "text", "y", "score", 2).collect()) < DOCS * WORDS / 2


def test_tfidf_shuffles_pairs_once(spark, docs):
    found = []
    assert shuffled(spark, lambda: found.extend(textstats.tfidf_terms(docs, "doc_id", "text", [1], 3).collect())) < DOCS * WORDS * 1.5
    # waa and wab are found twice in every document; the last word of a text joins no other by being grouped.
    assert [r["word"] for r in found[:2]] == ["waa", "wab"]
    grams = {r["word"] for r in textstats.tfidf_terms(docs, "doc_id", "text", [2], 1000).collect()}
    assert "waa wab" in grams and not any(g.startswith("wab w") and g.endswith("waa") for g in grams)


def test_bootstrap_sends_one_sum_for_each_score_of_a_task(spark):
    rows = spark.range(40000).select(F.col("id").alias("k"), (F.col("id") % 50 / 50).alias("s"), (F.col("id") % 3 == 0).cast("int").alias("y"), F.lit("a").alias("g"))
    held = metrics.bootstrap_auc(rows, ["g"], "k", "y", "s", 1000)
    # 20 batches of 50 scores, 8 KB each, were sent before; now as many for each of four tasks, and the narrow rows.
    assert shuffled(spark, held.collect, "shuffleWriteBytes") < 4_000_000


def test_bootstrap_of_more_scores_than_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(metrics, "SUMS_HELD", 2500)
    rows = spark.range(20000).select(F.col("id").alias("k"), F.rand(1).alias("s"), (F.col("id") % 3 == 0).cast("int").alias("y"), F.when(F.col("id") % 2 == 0, "a").alias("g"))
    want = metrics.auc(metrics.bootstrap_counts(rows, "k", 2, 4), ["g", "rep"], "y", "s", "w")
    found = {(r["g"], r["rep"]): r["auc"] for r in metrics.bootstrap_auc(rows, ["g"], "k", "y", "s", 2, 4).collect()}
    assert found == {(r["g"], r["rep"]): pytest.approx(r["auc"], abs=1e-12) for r in want.collect()}


def test_model_rows_read_texts_once(spark, sf):
    """What models read again and again are stored features, not texts; they are those that Python finds."""
    rows = model_queries._model_rows(spark, sf)
    assert not [f for f in rows.inputFiles() if "/documents.parquet" in f]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = rows.collect()
    assert len(found) == spark.read.parquet(f"{sf}/labels.parquet").count()
    for r in found:
        t = texts[r["doc_id"]]
        assert (r["n_words"], r["n_lines"], r["n_symbols"]) == (len(t.split(" ")), len(t.split("\n")), sum(c in "#*$%&|<>" for c in t))


def test_embedded_texts_come_back_without_the_texts(spark, tmp_path):
    """The Python step returns keys and counts only; null is a text of its own, as in SQL."""
    texts = [(1, "A1 b2 Ä٣ 😀"), (2, None), (3, "A1 b2 Ä٣ 😀"), (4, ""), (5, None), (6, "XYZ\n12")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = table_queries.embedded_texts(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    steps = re.findall(r"MapIn(Arrow|Pandas) [^\n]*\[__text_key#\d+([^\]]*)\]", plan)
    assert steps and all(kind == "Arrow" and "text#" not in columns for kind, columns in steps)
    assert sorted(map(tuple, found.collect())) == [(1, 2, 10, 2, 1), (2, 2, None, None, None), (4, 1, 0, 0, 0), (6, 1, 6, 2, 3)]
