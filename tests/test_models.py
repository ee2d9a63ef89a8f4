"""The random-intercept model, the search and the tree attributions against brute force."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidewater.operators import mixed, reports, tree_shap
from tidewater.operators.search import Range, bayesian_search
from tidewater.plans import catalog


def intercept_rows(spark, groups=40, seed=1, between=1.5):
    rng, rows = np.random.default_rng(seed), []
    for g in range(groups):
        u = rng.normal(0, between)
        for _ in range(int(rng.integers(1, 9))):
            x, w = rng.normal(), float(rng.integers(0, 3))
            rows.append((f"g{g}", 1e4 + 2 * x - w + u + rng.normal(), x, w))
    return rows, spark.createDataFrame(rows, "g string, y double, x double, w double")


def dense_criterion(rows, icc):
    """Minus twice the restricted likelihood from the whole covariance matrix of the rows."""
    names = [r[0] for r in rows]
    y, x = np.array([r[1] for r in rows]), np.array([[1.0, r[2], r[3]] for r in rows])
    v = np.eye(len(y)) + icc / (1 - icc) * np.equal.outer(names, names)
    inverse = np.linalg.inv(v)
    b = np.linalg.solve(x.T @ inverse @ x, x.T @ inverse @ y)
    r = y - x @ b
    return (len(y) - 3) * math.log(r @ inverse @ r) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(x.T @ inverse @ x)[1], b, (r @ inverse @ r) / (len(y) - 3)


def test_criterion_and_reml_equal_dense_matrices(spark):
    rows, df = intercept_rows(spark)
    fit = mixed.random_intercept(df, "g", "y", ["x", "w"])
    for icc in (0.0, 0.2, 0.7, 0.95):
        assert fit.criterion(icc) == pytest.approx(dense_criterion(rows, icc)[0], rel=1e-9)
    found = fit.reml()
    best = min(np.linspace(0, 0.999, 1000), key=lambda i: dense_criterion(rows, i)[0])
    _, b, residual = dense_criterion(rows, found["icc"])
    assert found["icc"] == pytest.approx(best, abs=2e-3)
    assert [found[t] for t in ("constant", "x", "w")] == pytest.approx(b.tolist(), rel=1e-7) and found["residual_variance"] == pytest.approx(residual, rel=1e-6)


def test_draws_follow_the_posterior(spark):
    rows, df = intercept_rows(spark)
    fit = mixed.random_intercept(df, "g", "y", ["x", "w"])
    draws = fit.posterior(4000)
    grid = np.linspace(0.0005, 0.9995, 1000)
    density = np.array([-0.5 * fit.criterion(i) for i in grid])
    density = np.exp(density - density.max())
    density /= density.sum()
    assert draws[:, 0].mean() == pytest.approx(float(grid @ density), abs=0.01)
    assert np.quantile(draws[:, 0], [0.025, 0.975]) == pytest.approx(np.interp([0.025, 0.975], np.cumsum(density), grid), abs=0.02)
    assert (fit.posterior(50) == fit.posterior(50)).all()
    summary = reports.posterior_summary(fit.draw_table(draws), [], "icc").first()
    assert summary["low"] < summary["median"] < summary["high"]
    # Effects: the mean over draws is the shrunken mean of the group's residuals.
    effects = {r.g: np.array(r.effects) for r in fit.group_draws(draws).collect()}
    best = fit.reml()
    k = best["icc"] / (1 - best["icc"])
    for g in ("g0", "g7"):
        mine = [r for r in rows if r[0] == g]
        left = sum(r[1] - best["constant"] - best["x"] * r[2] - best["w"] * r[3] for r in mine)
        assert effects[g].mean() == pytest.approx(k * left / (1 + k * len(mine)), abs=0.1)


def test_no_variance_between_groups_and_nulls(spark):
    rows, df = intercept_rows(spark, groups=150, between=0.0)
    more = spark.createDataFrame([(None, 1.0, 1.0, 1.0), ("g1", None, 1.0, 1.0), ("g1", 1.0, None, 1.0)], df.schema)
    fit = mixed.random_intercept(df.unionByName(more), "g", "y", ["x", "w"])
    assert fit.rows == len(rows) and fit.reml()["icc"] < 0.1 and np.median(fit.posterior(1000)[:, 0]) < 0.15


def test_indicators(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), ("b",)], "c string")
    out, names = mixed.with_indicators(df, "c")
    assert names == ["c_b", "c_null"] and sorted((r.c or "", r.c_b, r.c_null) for r in out.collect()) == [("", 0, 1), ("a", 0, 0), ("b", 1, 0), ("b", 1, 0)]
    with pytest.raises(ValueError, match="levels"):
        mixed.with_indicators(df, "c", most=2)


def test_interval_queries(spark, sf):
    row = catalog.queries()["icc_posterior"](spark, sf).first()
    assert 0 <= row["low"] <= row["median"] <= row["high"] < 1 and row["low"] - 0.02 <= row["reml"] <= row["high"] + 0.02
    rows = {r["term"]: r for r in catalog.queries()["effects_on_characteristics"](spark, sf).collect()}
    assert set(rows) == {"constant", "balance", "builds", "near"} and all(r["low"] < r["median"] < r["high"] for r in rows.values())


def hills(p):
    x, y = math.log10(p["a"]), p["b"]
    return math.exp(-((x + 2.3) ** 2) / 0.3 - (y - 0.31) ** 2 / 0.02) + 0.4 * math.exp(-((x + 0.5) ** 2) - (y - 0.8) ** 2 / 0.05)


SPACE = [Range("a", 1e-4, 1.0, log=True), Range("b", 0.0, 1.0)]


def test_search_beats_a_grid_of_as_many_points():
    trials = bayesian_search(hills, SPACE, 25)
    grid = [hills({"a": 10 ** (-4 + 4 * (i + 0.5) / 5), "b": (j + 0.5) / 5}) for i in range(5) for j in range(5)]
    assert max(t["score"] for t in trials) > max(grid) and max(t["score"] for t in trials) > 0.97
    assert trials == bayesian_search(hills, SPACE, 25)


def test_search_with_whole_numbers_and_failures():
    space = [Range("n", 1, 9, whole=True), Range("r", 1, 1)]
    trials = bayesian_search(lambda p: float("nan") if p["n"] == 3 else -abs(p["n"] - 7), space, 12)
    assert max(t["score"] for t in trials if t["score"] == t["score"]) == 0 and all(t["n"] == int(t["n"]) and 1 <= t["n"] <= 9 and t["r"] == 1 for t in trials)
    assert bayesian_search(lambda p: 1.0, space, 0) == []


@pytest.fixture(scope="module")
def boosted(spark):
    rng = np.random.default_rng(4)
    rows = [tuple(map(float, (*x, (x[0] > 0.2) ^ (x[1] > 0) or x[2] > 1))) for x in rng.normal(size=(300, 4))]
    data = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(spark.createDataFrame(rows, "a double, b double, c double, d double, y double"))
    return GBTClassifier(labelCol="y", maxIter=4, maxDepth=3, seed=1).fit(data), data.withColumn("i", F.monotonically_increasing_id())


def expected(node, x, known):
    """What a tree gives where only the features in `known` are; the others follow the training rows."""
    if node.getClass().getSimpleName() == "LeafNode":
        return node.prediction()
    left, right, f = node.leftChild(), node.rightChild(), node.split().featureIndex()
    if f in known:
        return expected(left if x[f] <= node.split().threshold() else right, x, known)
    n = node.impurityStats().count()
    return sum(child.impurityStats().count() / n * expected(child, x, known) for child in (left, right))


def test_attributions_equal_all_subsets(boosted):
    model, data = boosted
    x = np.array([r[0] for r in data.select(vector_to_array("features")).limit(6).collect()])
    found = tree_shap.shapley_values(tree_shap.leaves(model), x)
    for row, values in zip(x, found, strict=True):
        for f in range(4):
            wanted = 0.0
            for k in range(4):
                for known in itertools.combinations([g for g in range(4) if g != f], k):
                    weight = math.factorial(k) * math.factorial(3 - k) / math.factorial(4)
                    wanted += weight * sum(w * (expected(t._java_obj.rootNode(), row, {*known, f}) - expected(t._java_obj.rootNode(), row, known)) for t, w in zip(model.trees, model.treeWeights))
            assert values[f] == pytest.approx(wanted, abs=1e-10)


def test_attributions_add_up_to_the_margin(boosted):
    model, data = boosted
    base = tree_shap.base_value(tree_shap.leaves(model))
    margin = {r["i"]: r["p"] for r in model.transform(data).select("i", vector_to_array("rawPrediction")[1].alias("p")).collect()}
    rows = tree_shap.tree_attributions(model, data, ["i"]).collect()
    assert len(rows) == 300 and all(2 * (base + sum(r["attribution"])) == pytest.approx(2 * margin[r["i"]], abs=1e-9) or base + sum(r["attribution"]) == pytest.approx(margin[r["i"]], abs=1e-9) for r in rows)
    found = {r["feature"]: r for r in tree_shap.importance(tree_shap.tree_attributions(model, data, ["i"]), ["a", "b", "c", "d"]).collect()}
    assert found["a"]["importance"] == pytest.approx(np.mean([abs(r["attribution"][0]) for r in rows])) and found["a"]["importance"] > found.get("d", {"importance": 0})["importance"]
    assert tree_shap.tree_attributions(model, data.limit(0), ["i"]).count() == 0
    idle = data.sparkSession.createDataFrame([([1.0, 2.0], [0.5, 0.0]), ([1.0, 3.0], [-0.5, 0.0])], "x array<double>, attribution array<double>")
    assert [tuple(r) for r in tree_shap.importance(idle, ["flat", "unused"]).collect()] == [("flat", 0.5, None)]


def test_stacked_model_uses_the_scores(spark, sf):
    rows = catalog.queries()["stacked_importance"](spark, sf).collect()
    assert rows and {r["feature"] for r in rows} <= {"prompting", "tabular", "nlp", "finetune"} and all(r["importance"] > 0 for r in rows)


def test_searched_trials(spark, sf):
    rows = catalog.queries()["bayes_search"](spark, sf).collect()
    assert [r["trial"] for r in rows] == list(range(6)) and all(1e-4 <= r["strength"] <= 1 and 0 <= r["mixing"] <= 1 and 0 <= r["auc"] <= 1 for r in rows)


def test_linear_attribution_is_coefficient_times_distance(spark):
    from tidewater.operators import models

    x = np.random.default_rng(6).normal(size=(40, 3))
    data = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double"))
    found = {r["feature"]: r for r in models.linear_attribution(data, [2.0, -0.5, 0.0]).collect()}
    assert set(found) == {0, 1}  # the third never counts
    for i, c in ((0, 2.0), (1, -0.5)):
        assert found[i]["importance"] == pytest.approx(np.abs(c * (x[:, i] - x[:, i].mean())).mean()) and found[i]["correlation"] == pytest.approx(np.sign(c))


def test_stacking_beats_its_inputs_where_they_complete_each_other(spark):
    """Two scores that only together tell the label: the stacked model's AUC is above both, as the query measures it."""
    from tidewater.operators import metrics, models

    rng = np.random.default_rng(7)
    rows = [(float(a), float(b), float((a > 0.5) ^ (b > 0.5))) for a, b in rng.random((400, 2))]
    wide = spark.createDataFrame(rows, "one double, two double, y double")
    prepared = models.preprocessing(["one", "two"], []).fit(wide).transform(wide)
    scores = models.scored(models.boosted_trees("y", trees=5).fit(prepared), prepared, ["y"]).withColumn("method", F.lit("stacked"))
    single = prepared.unpivot(["y"], ["one", "two"], "method", "score")
    auc = {r["method"]: r["auc"] for r in metrics.auc(scores.unionByName(single), ["method"], "y", "score").collect()}
    assert auc["stacked"] > 0.9 > max(auc["one"], auc["two"])
