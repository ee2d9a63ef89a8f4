"""Operators on groups that one task can't hold, against brute force on groups with many ties and bins."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import htest, windows


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    groups = rng.choice(["a", "b", ""], 4000, p=[0.8, 0.15, 0.05])
    rows = [(i, g or None, float(round(p, 3)), int(c)) for i, (g, p, c) in enumerate(zip(groups, rng.random(4000) ** 4, rng.integers(0, 9, 4000)))]
    return spark.createDataFrame(rows, "id long, g string, p double, c int")


def by_group(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["g"]].append(r)
    return out


@pytest.mark.parametrize("group", [["g"], []])
def test_adjusted_p_values_over_bins(frame, group):
    rows = frame if group else frame.withColumn("g", F.lit("all"))
    for found in by_group(htest.benjamini_yekutieli(rows, group, "p", "q")).values():
        found.sort(key=lambda r: r["p"])
        p, m = np.array([r["p"] for r in found]), len(found)
        raw = p * m * (1 / np.arange(1, m + 1)).sum() / np.searchsorted(p, p, "right")
        want = np.minimum(np.minimum.accumulate(raw[::-1])[::-1], 1)
        assert np.allclose([r["q"] for r in found], want, rtol=1e-12)


def test_harmonic(spark):
    for m in (1, 2, 1000, 1001, 1_000_000):
        got = spark.range(1).select(htest.harmonic(F.lit(m).cast("long")).alias("h")).first()["h"]
        assert got == pytest.approx((1 / np.arange(1, m + 1)).sum(), rel=1e-13)


@pytest.mark.parametrize("budget, most", [(500, None), (500, 16), (10**9, None), (0, None)])
def test_budget_prefix(frame, budget, most):
    kept = by_group(windows.budget_prefix(frame, ["g"], "id", F.col("c"), budget, most))
    for g, rows in by_group(frame).items():
        want, total = [], 0
        for r in sorted(rows, key=lambda r: r["id"]):
            total += r["c"]
            if total >= budget or len(want) == most:
                break
            want.append((r["id"], total))
        assert sorted((r["id"], r["running_cost"]) for r in kept[g]) == want


def test_first_rows(frame):
    order = [F.col("p").desc(), F.col("id")]
    found = by_group(windows.first_rows(frame, ["g"], "id", order, 10))
    for g, rows in by_group(frame).items():
        want = sorted(rows, key=lambda r: (-r["p"], r["id"]))[:10]
        assert {r["id"] for r in found[g]} == {r["id"] for r in want}
