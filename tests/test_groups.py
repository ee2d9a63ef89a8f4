"""Null groups, values with long tails, bootstraps by brute force, replies, budgets and work tables."""

from __future__ import annotations

from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions import text
from tidewater.operators import htest, metrics, prompting, ranks, windows
from tidewater.sources import work

ROWS = [("a", 1.0, 1), ("a", 3.0, 0), (None, 2.0, 1), (None, 6.0, 0), (None, 6.0, 1), ("b", 5.0, 0)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(g, v, y, i) for i, (g, v, y) in enumerate(ROWS)], "g string, v double, y int, i int")


def test_null_groups_stay(frame):
    z = {r["i"]: r["z"] for r in windows.zscore(frame, ["g"], "v", "z").collect()}
    assert len(z) == 6 and z[5] == 0 and z[2] == pytest.approx((2 - 14 / 3) / np.std([2, 6, 6], ddof=1))
    assert {r["i"]: r["mid_rank"] for r in ranks.mid_ranks(frame, ["g"], "v").collect()} == {0: 1, 1: 2, 2: 1, 3: 2.5, 4: 2.5, 5: 1}
    assert {r["g"] for r in metrics.auc(frame, ["g"], "y", "v").collect()} == {"a", "b", None}
    assert htest.placements(frame, ["g"], "y", "v").count() == 6
    assert htest.benjamini_yekutieli(frame.withColumn("p", F.col("v") / 10), ["g"], "p").filter("p_by is not null").count() == 6
    assert windows.share_of_max(frame, ["g"], "v", "s").count() == 6


def test_ranks_of_a_long_tail(spark):
    rng = np.random.default_rng(1)
    values = np.append(np.exp(6 * rng.normal(size=3000)), [1e300, -1e300, 0, 0])
    frame = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    got = {r["i"]: r["mid_rank"] for r in ranks.mid_ranks(frame, [], "v").collect()}
    order = np.sort(values)
    want = (np.searchsorted(order, values, "left") + np.searchsorted(order, values, "right") + 1) / 2
    assert [got[i] for i in range(len(values))] == want.tolist()


def test_bootstrap_by_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [("g" if i % 3 else None, f"k{i // 2}", int(rng.integers(2)), float(round(rng.random(), 2))) for i in range(120)]
    frame = spark.createDataFrame(rows, "g string, k string, y int, s double").repartition(4)
    reps = metrics.bootstrap_auc(frame, ["g"], "k", "y", "s", 40, seed=3)
    got = {(r["g"], r["rep"]): r["auc"] for r in reps.collect()}
    drawn = defaultdict(list)
    for r in metrics.bootstrap_counts(frame, "k", 40, seed=3).collect():
        drawn[r["g"], r["rep"]].append((r["y"], r["s"], r["w"]))
    for key, own in drawn.items():
        one, zero = [(s, w) for y, s, w in own if y], [(s, w) for y, s, w in own if not y]
        area = sum(w * v * ((a > b) + (a == b) / 2) for a, w in one for b, v in zero)
        pairs = sum(w for _, w in one) * sum(w for _, w in zero)
        assert got[key] == pytest.approx(area / pairs) if pairs else got[key] is None
    assert len(got) == 80


def test_draws_are_poisson_and_free_of_each_other():
    w = metrics.draws(np.arange(1, 2001)[:, None] * 1_000_003 % metrics.PRIME, np.arange(300)[None, :], 1)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and np.abs(np.corrcoef(w[:60])[np.triu_indices(60, 1)]).max() < 0.3


def test_replies_with_quotes_inside(spark):
    replies = ['{"Reason": "he is "95% better" now", "Probability": 20}', "{'Reason': 'don't know', 'Probability': 0.3}", '{"Reason": "plain", "Probability": 0.1}']
    rows = spark.createDataFrame(list(enumerate(replies)), "i int, raw string").select("i", text.parse_reply(F.col("raw")).alias("r")).orderBy("i").collect()
    assert [(r["r"]["reason"], r["r"]["probability"]) for r in rows] == [('he is "95% better" now', 0.2), ("don't know", 0.3), ("plain", 0.1)]


def test_a_cut_note_keeps_within_its_budget(spark):
    row = spark.createDataFrame([("one two", ["x"], "\n".join(f"w{i}\t v" for i in range(50)))], "s string, e array<string>, n string")
    fit = row.select(prompting.fit_context(F.col("s"), F.col("e"), F.col("n"), 20).alias("f")).first()["f"]
    assert fit["truncated"] and len(fit["note"].split()) + 2 <= 20 and fit["note"].startswith("w0 v w1 v")


def test_work_tables_are_dropped(spark):
    stored = work.materialize(spark.range(5), "some")
    path = Path(stored.inputFiles()[0].removeprefix("file://"))
    assert path.exists() and stored.count() == 5
    work.drop_work_tables(spark)
    assert not path.exists()
