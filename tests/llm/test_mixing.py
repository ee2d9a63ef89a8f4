"""Mixing: equal rows, arrays of sources, many sources, and optimal flows by enumeration."""

from __future__ import annotations

from collections import Counter
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.llm import mixing


def taken_of(taken):
    return {r["source"]: r["t"] for r in taken.groupBy("source").agg(F.sum("taken").alias("t")).collect()}


def test_equal_rows_are_split(spark):
    text = " ".join(["w"] * 10)
    rows = [(1, text, "a")] * 100 + [(100 + i, text, "b") for i in range(50)] + [(500 + i, text, "c") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    taken, sources = mixing.mix(docs, "source")
    target = {r["source"]: r["target"] for r in sources.collect()}
    assert target == pytest.approx({"a": 2000 / 6, "b": 2000 / 3, "c": 1000})
    got = taken_of(taken)
    assert all(abs(got[s] - t) <= 5 for s, t in target.items())
    again = mixing.mix(docs.repartition(3), "source")[0]
    assert Counter((r["doc_id"], r["copies"]) for r in again.collect()) == Counter((r["doc_id"], r["copies"]) for r in taken.collect())


def test_long_documents_do_not_block(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(n)), f"s{i % 3}") for i, n in enumerate([*rng.integers(1, 60, 600), *[9000] * 6])]
    taken, sources = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), "source")
    got = taken_of(taken)
    assert all(abs(got[r["source"]] - r["target"]) <= 0.001 * r["target"] + 1 for r in sources.collect())


def test_arrays_of_sources(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(["w"] * int(rng.integers(5, 50))), sorted(rng.choice(["x", "y", "z"], int(rng.integers(1, 4)), replace=False).tolist())) for i in range(900)]
    docs = spark.createDataFrame([*rows, (1000, "no source", None), (1001, "none", [])], "doc_id long, text string, source array<string>")
    taken, sources = mixing.mix(docs, "source", weights={"x": 1.0, "y": 1.0, "z": 2.0})
    rows, target = taken.collect(), {r["source"]: r["target"] for r in sources.collect()}
    words = Counter()
    for r in rows:
        words[tuple(r["source"] or ())] += r["size"]
    assert sum(target.values()) == pytest.approx(sum(w for p, w in words.items() if p))
    given_ = mixing.route(dict(words), {s: round(t) for s, t in target.items()})
    got = Counter()
    for r in rows:
        got[tuple(r["source"] or ())] += r["taken"]
    assert all(abs(got[p] - given_[p]) <= 0.002 * given_[p] + 25 for p in words) and got[()] == 0


def test_many_plain_sources_need_no_driver(docs, odd_docs):
    for frame in (docs, odd_docs):
        by_flow, one = mixing.mix(frame, "source")
        by_table, two = mixing.mix(frame, "source", max_patterns=1)
        assert {tuple(r) for r in one.collect()} == {tuple(r) for r in two.collect()}
        key = lambda t: sorted(((r["doc_id"], r["size"], r["copies"]) for r in t.collect()), key=repr)
        assert key(by_flow) == key(by_table)
    with pytest.raises(ValueError):
        mixing.mix(docs.withColumn("source", F.array("source")), "source", max_patterns=1)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from([("a",), ("b",), ("a", "b"), ("b", "c"), ("a", "b", "c")]), st.integers(0, 3), min_size=1, max_size=3), st.tuples(*[st.integers(0, 5)] * 3))
def test_flow_is_cheapest(patterns, quotas):
    quota = dict(zip("abc", quotas))
    given_ = mixing.route(patterns, quota)
    cost = lambda x: sum(sum(mixing.repeat_cost(i) * min(max(x[p] - i * w, 0), w) for i in range(3)) for p, w in patterns.items())

    def feasible(x):
        # Hall's condition over sets of patterns.
        names = list(patterns)
        return all(sum(x[p] for p in chosen) <= sum(quota[s] for s in {s for p in chosen for s in p}) for bits in product([0, 1], repeat=len(names)) for chosen in [[p for p, b in zip(names, bits) if b]])

    options = [dict(zip(patterns, x)) for x in product(*[range(3 * w + 1) for w in patterns.values()])]
    best = min((-sum(x.values()), cost(x)) for x in options if feasible(x))
    assert feasible(given_) and (-sum(given_.values()), cost(given_)) == best


@given(st.lists(st.tuples(st.integers(0, 50), st.integers(1, 4)), max_size=30), st.integers(0, 2000))
def test_take_near(items, wanted):
    sizes, copies = np.array([i[0] for i in items], np.int64), np.array([i[1] for i in items], np.int64)
    taken = mixing.take_near(sizes, copies, wanted)
    assert (taken >= 0).all() and (taken <= copies).all()
    total = int((taken * sizes).sum())
    if total < wanted:  # nothing left fits twice over
        left = sizes[(taken < copies) & (sizes > 0)]
        assert not len(left) or 2 * (wanted - total) <= left.min() or abs(wanted - total) <= mixing.CLOSE_ENOUGH * wanted or (wanted - total) < left.min()
