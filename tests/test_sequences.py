"""Joins, thinning, packing and tests that were sequential, against brute force; with keys that hold very many rows."""

from __future__ import annotations

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.operators import htest, windows
from tidewater.operators.asof import asof_lookback
from tidewater.operators.thinning import successors, thin_by_gap


@pytest.mark.parametrize(("include_now", "include_start", "bucket"), [(False, True, None), (True, True, None), (False, False, 3), (True, False, 50)])
def test_asof_equals_all_pairs(spark, include_now, include_start, bucket):
    rng = random.Random(5)
    sessions = [(rng.choice(["a", "b", None]), rng.choice([None, *range(60)]), i % 7) for i in range(200)]
    measures = [(rng.choice(["a", "b", None]), rng.choice([None, *range(60)]), i) for i in range(120)]
    s = spark.createDataFrame(sessions, "k string, t int, last_seen int").withColumn("t", F.timestamp_seconds("t"))
    m = spark.createDataFrame(measures, "k string, t int, id int").withColumn("t", F.timestamp_seconds("t"))
    out = asof_lookback(s, m, "k", "t", "t", "id", 10, include_now, include_start, bucket).select("k", F.unix_seconds("t").alias("t"), "last_seen", "last.id")

    def best(k, t):
        if k is None or t is None:
            return None
        fits = [(u, i) for j, u, i in measures if j == k and u is not None and (u <= t if include_now else u < t) and (u >= t - 10 if include_start else u > t - 10)]
        return max(fits)[1] if fits else None

    key = lambda r: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in r)
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(((k, t, x, best(k, t)) for k, t, x in sessions), key=key)


def test_asof_of_a_key_with_a_million_events(spark):
    events = spark.range(1_000_000).select(F.lit("hot").alias("k"), F.timestamp_seconds("id").alias("t"), "id")
    asked = events.filter("id % 1000 = 7")
    out = asof_lookback(asked, events.filter("id % 10 = 0"), "k", "t", "t", "id", 3600)
    assert out.filter("last.id = id - 7").count() == 1000
    plan = out._jdf.queryExecution().toString()
    assert "Join" not in plan  # nothing is paired


def brute_thinned(rows, gap):
    kept, last = [], {}
    for k, t, i in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        if k not in last or t - last[k] >= gap:
            last[k] = t
            kept.append(i)
    return sorted(kept)


@pytest.mark.parametrize("fold_events", [0, 30, 10_000])
@pytest.mark.parametrize("gap", [1, 7, 200])
def test_thinning_equals_greedy(spark, fold_events, gap):
    rng = random.Random(gap)
    rows = [(rng.choice(["a", "b", "b", "b", None]), rng.choice([None, *range(0, 900, 3), *range(2000, 2100)]), i) for i in range(150)]
    df = spark.createDataFrame(rows, "k string, s int, id long").withColumn("t", F.timestamp_seconds("s"))
    assert sorted(r["id"] for r in thin_by_gap(df, "k", "t", "id", gap, fold_events).collect()) == brute_thinned(rows, gap)


def test_thinning_without_a_gap_and_of_nothing(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", None, 2), (None, 1, 3)], "k string, s int, id long").withColumn("t", F.timestamp_seconds("s"))
    assert sorted(r["id"] for r in thin_by_gap(df, "k", "t", "id", 0).collect()) == [1, 3]
    assert thin_by_gap(df.limit(0), "k", "t", "id", 5).count() == 0


def test_thinning_of_a_key_with_a_million_events(spark):
    events = spark.range(1_000_000).select(F.lit("hot").alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("t"), "id")
    kept = thin_by_gap(events, "k", "t", "id", 7 * 86400)
    assert sorted(r["id"] for r in kept.collect()) == list(range(0, 1_000_000, 7 * 1440))


def test_successors(spark):
    times = spark.createDataFrame([("a", t) for t in (0, 5, 6, 20, 500)] + [("b", 3), (None, 1), (None, 9)], "k string, t long")
    found = {(r.k, r.t): r.next for r in successors(times, 6).collect()}
    assert found == {("a", 0): 6, ("a", 5): 20, ("a", 6): 20, ("a", 20): 500, ("a", 500): None, ("b", 3): None, (None, 1): 9, (None, 9): None}


def greedy(weights, n):
    loads = [0] * n
    for w in sorted(weights, reverse=True):
        loads[loads.index(min(loads))] += w
    return loads


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 40), st.integers(0, 10**9)), max_size=300), st.integers(1, 9))
def test_shares_give_the_loads_of_greedy(weights, n):
    counts = sorted(((w, weights.count(w)) for w in set(weights)), reverse=True)
    loads = [0] * n
    for (w, c), (same, share) in zip(counts, windows.greedy_shares(counts, n), strict=True):
        assert w == same and sum(share) == c
        loads = [x + w * k for x, k in zip(loads, share, strict=True)]
    assert loads == greedy(weights, n)


def test_a_class_of_billions_is_filled_at_once():
    (_, first), (_, second) = windows.greedy_shares([(7, 3), (2, 10**10)], 4)
    loads = sorted(7 * a + 2 * b for a, b in zip(first, second, strict=True))
    assert sum(second) == 10**10 and loads[-1] - loads[0] <= 2


@pytest.mark.parametrize("tail", [1.1, 3.0])
def test_balanced_parts_have_the_loads_of_greedy(spark, tail):
    rng = random.Random(3)
    weights = [None, 0, 0] + [int(rng.paretovariate(tail)) for _ in range(700)] + [5] * 400
    rows = spark.createDataFrame(list(enumerate(weights)), "id long, w long")
    parts = windows.balanced_parts(rows, "id", "w", 7)
    assert parts.count() == len(weights) and parts.columns == ["id", "w", "part"]
    loads = {r["part"]: r["l"] for r in parts.groupBy("part").agg(F.sum("w").alias("l")).collect()}
    assert [loads.get(i) or 0 for i in range(7)] == greedy([w or 0 for w in weights], 7)
    with pytest.raises(ValueError, match="round them"):
        windows.balanced_parts(rows, "id", "w", 7, most_classes=2)


def brute_p(differences):
    d = [x for x in differences if x]
    if not d:
        return 1.0
    sizes = sorted(abs(x) for x in d)
    rank = lambda x: sizes.index(abs(x)) + (sizes.count(abs(x)) + 1) / 2
    w, sums = sum(rank(x) for x in d if x > 0), [sum(r for r, on in zip(map(rank, d), flags, strict=True) if on) for flags in itertools.product((0, 1), repeat=len(d))]
    return min(1.0, 2 * min(sum(s <= w for s in sums), sum(s >= w for s in sums)) / len(sums))


def test_exact_p_equals_enumeration(spark):
    rng = random.Random(9)
    rows = [(g, b, level, float(rng.randint(0, 6))) for g in ("x", "y", None) for b in range(3 * (1 + (g is not None)) + 4) for level in ("l1", "l2", "l3") if rng.random() < 0.95]
    rows += [("same", b, level, 1.0) for b in range(4) for level in ("l1", "l2")] + [("lone", 1, "l1", 2.0), ("gap", 1, "l1", None), ("gap", 1, "l2", 3.0)]
    df = spark.createDataFrame(rows, "g string, b int, level string, v double")
    found = {(r.g, r.level_a, r.level_b): r for r in htest.signed_rank_pairs(df, ["g"], ["b"], "level", "v").collect()}
    value, wanted = {(g, b, level): v for g, b, level, v in rows if v is not None}, {}
    for g, x, y in itertools.product(("x", "y", None, "same", "lone", "gap"), ("l1", "l2", "l3"), ("l1", "l2", "l3")):
        d = [value[g, b, x] - value[g, b, y] for b in range(12) if (g, b, x) in value and (g, b, y) in value]
        if x < y and d:
            wanted[g, x, y] = brute_p(d)
    assert {k: pytest.approx(r.p_value) for k, r in found.items()} == wanted and all(r.exact for r in found.values())
    assert found["same", "l1", "l2"].p_value == 1.0 and found["same", "l1", "l2"].n == 0


def test_normal_p_above_the_limit(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(b, level, rng.gauss(level == "p", 3)) for b in range(40) for level in ("p", "q")], "b int, level string, v double")
    exact, normal = (htest.signed_rank_pairs(rows, [], ["b"], "level", "v", exact_upto=n).first() for n in (50, 30))
    assert exact.exact and not normal.exact and exact.z == normal.z and abs(exact.p_value - normal.p_value) < 0.01
