"""Near-duplicates of documents and vectors, components: brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import embedding_dedup, minhash_dedup
from tidewater.llm.components import connected_components


def groups(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent=80):
    sets = {i: shingles(t, k) for i, t in rows}
    ids = sorted(sets)
    links = []
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    return groups(ids, links), sets


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (1, 2), (7, 7), (2, 1), (20, 21)] + [(100 + i, 101 + i) for i in range(60)] + [(200, 201 + i) for i in range(50)]
    frame = spark.createDataFrame([*edges, (None, 1)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(frame).collect()}
    want = groups({x for e in edges for x in e} - {7}, [e for e in edges if e != (7, 7)])
    assert got == want
    assert connected_components(frame.filter("a = -1")).count() == 0


@pytest.mark.parametrize("k", [2, 5])
def test_minhash_matches_brute_force(docs, k):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want, sets = brute(rows, k)
    out = minhash_dedup.near_duplicates(docs, k=k).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == want
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_minhash_families(spark, monkeypatch):
    """Families in which many pairs are close to the threshold, in blocks of three."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 3)
    rng = np.random.default_rng(5)
    rows = []
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(60)]
        for _ in range(40):
            words = list(base)
            for p in rng.integers(0, 60, rng.integers(0, 7)):
                words[p] = f"z{rng.integers(1 << 30)}"
            rows.append((len(rows), " ".join(words)))
    want, _ = brute(rows, 2)
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()}
    assert got == want and len(set(want.values())) > 3


def test_superminhash_is_unbiased():
    rng = np.random.default_rng(1)
    estimates = []
    for _ in range(60):
        common, own = rng.integers(0, 1 << 62, 60, dtype=np.uint64), rng.integers(0, 1 << 62, 30, dtype=np.uint64)
        rows = np.repeat([0, 1], [75, 75])
        elements = np.concatenate([common, own[:15], common, own[15:]])
        ranks = minhash_dedup.superminhash(rows, elements, 2, 64)
        estimates.append((ranks[0] == ranks[1]).mean())
        assert len(np.unique(ranks[0] >> np.uint64(56))) >= 1 and (ranks != minhash_dedup._EMPTY).all()
    assert abs(np.mean(estimates) - 60 / 90) < 0.03


def test_minhash_edge_cases(odd_docs, no_docs):
    out = minhash_dedup.near_duplicates(odd_docs, k=2).collect()
    of = {}
    for r in out:
        of.setdefault(r["doc_id"], []).append(r)
    assert len(out) == odd_docs.count() and [r["component_id"] for r in of[2]] == [1, 1]
    assert of[9][0]["component_id"] == 1 and of[10][0]["component_id"] == 1  # lower-cased; one more line
    assert of[3][0]["n_shingles"] == 0 and of[3][0]["kept"] and of[6][0]["component_id"] == 6
    assert all(r["component_id"] is None and r["kept"] for r in of[None])
    kept = minhash_dedup.drop_near_duplicates(odd_docs, k=2)
    assert kept.columns == odd_docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 3, 4, 5, 6, 7, 8]
    assert minhash_dedup.near_duplicates(no_docs).count() == 0


def vectors(rng, n, dims=16):
    x = rng.normal(size=(n, dims))
    near = x[: n // 2] + rng.normal(size=(n // 2, dims)) * rng.choice([0.05, 0.35], (n // 2, 1))
    return np.concatenate([x, near, x[:5]]).astype(np.float32)


def test_embeddings_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(3)
    x = np.concatenate([vectors(rng, 120), np.tile(rng.normal(size=16), (60, 1)).astype(np.float32) + rng.normal(size=(60, 16)).astype(np.float32) * 0.02])
    labels = [int(v) for v in rng.integers(0, 2, len(x))]
    rows = [(i, [float(v) for v in x[i]], labels[i]) for i in range(len(x))]
    out = {r["vec_id"]: r for r in embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    d = x.astype(float)
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    near = (d @ d.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(near, False)
    found, there = sum(r["n_links"] for r in out.values()), int(near.sum())
    assert 0.9 * there <= found <= there and all(out[i]["n_links"] <= near[i].sum() for i in out)
    want = groups(range(len(x)), np.argwhere(np.triu(near)).tolist())
    assert np.mean([out[i]["component_id"] == want[i] for i in out]) > 0.97


def test_embeddings_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, -0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [None, 1.0], 1), (9, [], 1), (10, [1.0, 0.0], 2), (None, [1.0, 0.0], 1), (11, [1.0, -0.0], 1), (12, [1.0], 1)]
    out = embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("x"))).collect()
    assert len(out) == len(rows)
    links = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in out)
    assert links == sorted([(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (11, 3, 1, False), (0, 0, 0, True), *[(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 12)]])
    assert embedding_dedup.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_strays_among_many_copies_stay_linear(spark, monkeypatch):
    """A stray is compared with each block of the copies; blocks of the copies are not compared with each other."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 10)
    placed = spark.createDataFrame([(1, c, 5, 7) for c in range(1000)] + [(1, 5000, 5, 5000), (1, 5001, 5, 5001)], "bucket long, c long, n long, comp long")
    tasks = minhash_dedup._compared(placed).collect()
    assert len(tasks) <= 1000 + 2 * 101 + 2 and {r["c"] for r in tasks} == {*range(1000), 5000, 5001}
    sides = {}
    for r in tasks:
        sides.setdefault(r["task"], set()).add(r["comp"])
    assert all(s != {7} for s in sides.values())


def test_links_across_blocks_of_components(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 4)
    monkeypatch.setattr(minhash_dedup, "BLOCK_ELEMENTS", 300)
    rng = np.random.default_rng(9)
    base, rows = [f"w{i}" for i in range(50)], []
    for _ in range(120):
        words = list(base)
        for p in rng.integers(0, 50, rng.integers(0, 6)):
            words[p] = f"z{rng.integers(1 << 30)}"
        rows.append((len(rows), " ".join(words)))
    want, _ = brute(rows, 2)
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()}
    assert got == want


def test_hot_joins(spark, monkeypatch):
    from tidewater.llm import skew

    monkeypatch.setattr(skew, "LEAST_ROWS", 5)
    left = spark.createDataFrame([(1, i) for i in range(500)] + [(k, k) for k in range(2, 40)] + [(None, 3)], "k int, x int")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(0, 30)], "k int, y string")
    for how in ("inner", "left"):
        got = sorted(map(tuple, skew.join_hot(left, right, ["k"], "x", how).select("k", "x", "y").collect()), key=repr)
        assert got == sorted(map(tuple, left.join(right, "k", how).select("k", "x", "y").collect()), key=repr)


def test_equal_rows_are_numbered(spark, monkeypatch):
    from tidewater.llm import skew

    monkeypatch.setattr(skew, "CELL_BITS", 3)
    rows = spark.createDataFrame([("a", None)] * 100 + [("b", 1)] * 3 + [(None, None)] * 20, "x string, y int").repartition(3)
    got = [(r["x"], r["n"]) for r in skew.number_equal_rows(rows, ["x", "y"], "n").collect()]
    assert sorted(got, key=repr) == sorted([("a", i) for i in range(100)] + [("b", i) for i in range(3)] + [(None, i) for i in range(20)], key=repr)
