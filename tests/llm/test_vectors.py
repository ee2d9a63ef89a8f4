"""Near-duplicate embeddings: recall against brute force on planted neighbours, tables, lengths."""

from __future__ import annotations

import numpy as np
import pytest

from tidewater.llm import embedding_dedup
from tidewater.llm.arrow_groups import least_reachable, pairs_between
from tidewater.llm.embedding_dedup import Model, neighbours, unit_rows


def planted(rng, n, dims, low=0.93, high=0.95):
    """n vectors in a few clusters, a third of them with a neighbour at a cosine between low and high."""
    centres = rng.normal(size=(8, dims)) * 0.6
    x = unit_rows(centres[rng.integers(0, 8, n)] + rng.normal(size=(n, dims)))
    near = x[: n // 3]
    cosine = rng.uniform(low, high, (len(near), 1))
    u = rng.normal(size=near.shape)
    u = unit_rows(u - (u * near).sum(axis=1, keepdims=True) * near)
    return np.concatenate([x, cosine * near + np.sqrt(1 - cosine**2) * u])


def brute(x, labels, threshold=0.93):
    d = unit_rows(x)
    near = (d @ d.T >= threshold) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    return near


def run(spark, x, labels):
    rows = [(i, [float(v) for v in row], int(label)) for i, (row, label) in enumerate(zip(x, labels, strict=True))]
    out = embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    return {r["vec_id"]: r for r in out}


@pytest.mark.parametrize("dims", [32, 64])
def test_recall_of_neighbours_at_the_threshold(spark, dims):
    rng = np.random.default_rng(dims)
    x = planted(rng, 3000, dims)
    labels = np.concatenate([np.zeros(3000, int), np.zeros(1000, int)])
    labels[rng.permutation(4000)[:500]] = 1
    there = brute(x, labels)
    model = Model(dims, x[:2000], 3500, 0.93, embedding_dedup.RECALL)
    assert len(model.tables) > 1 and sorted(b for bits, _ in model.tables for b in bits) == list(range(dims))  # disjoint substrings
    out = run(spark, x, labels)
    found = sum(r["n_links"] for r in out.values())
    assert 0.97 * there.sum() <= found <= there.sum() and all(out[i]["n_links"] <= there[i].sum() for i in out)


def test_plans_follow_the_largest_label():
    rng = np.random.default_rng(1)
    x = unit_rows(rng.normal(size=(2000, 64)))
    plans = [Model(64, x, n, 0.93, 0.98).tables for n in (3, 5000, 1_000_000)]
    assert len(plans[0]) == 1 and not len(plans[0][0][0])  # whole labels
    assert np.mean([len(b) for b, _ in plans[2]]) > np.mean([len(b) for b, _ in plans[1]])  # longer substrings


def test_tables_find_every_code_within_their_radius():
    rng = np.random.default_rng(2)
    model = Model(64, unit_rows(rng.normal(size=(500, 64))), 5000, 0.93, 0.98)
    least = sum(r + 1 for _, r in model.tables)  # fewer differing bits must meet in some table
    for _ in range(200):
        x = sum(1 << int(b) for b in rng.permutation(64)[: least - 1])
        assert any((x & int(m)) in {f % 2**64 for f in model.flips(t)} for t, m in enumerate(model.masks))


def test_lengths_do_not_mix(spark):
    rng = np.random.default_rng(3)
    blocks = {16: rng.normal(size=(40, 16)), 8: rng.normal(size=(30, 8)), 24: rng.normal(size=(1, 24))}
    rows = [(100 * d + i, [float(v) for v in row], 1) for d, x in blocks.items() for i, row in enumerate(np.concatenate([x, x + 1e-3]))]
    out = {r["vec_id"]: r for r in embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    for d, x in blocks.items():
        there = brute(np.concatenate([x, x + 1e-3]), np.zeros(2 * len(x), int)).sum(axis=1)
        found = np.array([out[100 * d + i]["n_links"] for i in range(2 * len(x))])
        assert (found <= there).all() and found.sum() >= 0.95 * there.sum() and (found >= 1).all()
        assert all(out[100 * d + i]["component_id"] // 100 == d for i in range(2 * len(x)))


def test_hot_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 32)
    rng = np.random.default_rng(5)
    base = rng.normal(size=32)
    x = np.concatenate([base + 0.05 * rng.normal(size=(400, 32)), rng.normal(size=(400, 32))])
    labels = np.zeros(800, int)
    there, out = brute(x, labels), run(spark, x, labels)
    assert [out[i]["n_links"] for i in range(800)] == there.sum(axis=1).tolist()
    assert {out[i]["component_id"] for i in range(400)} == {0}


def test_pairs_between_groups():
    start, split, end = np.array([0, 3, 8]), np.array([2, 3, 9]), np.array([3, 8, 10])
    want = {(0, 2), (1, 2), (8, 9)} | {(i, j) for i in range(3, 8) for j in range(i + 1, 8)}
    for most in (1, 3, 100):
        got = [(int(a), int(b)) for i, j in pairs_between(start, split, end, most) for a, b in zip(i, j)]
        assert len(got) == len(want) and set(got) == want


def test_least_reachable():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = rng.integers(0, 30, 20), rng.integers(0, 30, 20)
        want = list(range(30))
        for _ in range(30):
            for i, j in zip(a, b):
                want[i] = want[j] = min(want[i], want[j])
        assert least_reachable(a, b, 30).tolist() == want


def test_neighbours_have_the_cosine():
    rng = np.random.default_rng(6)
    x = unit_rows(rng.normal(size=(50, 12)))
    assert (x * neighbours(x, 0.93, rng.normal(size=x.shape))).sum(axis=1) == pytest.approx(0.93)
