"""Bundles of arrays, restarts of streams, batches by length, vocabulary vectors and the fused network."""

from __future__ import annotations

import math
from pathlib import Path

import numpy as np
import pytest
from pyspark import TaskContext
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidewater.operators import fusion, models, prompting
from tidewater.operators.textstats import vocabulary_model
from tidewater.sources import npz
from tidewater.streaming import events as streams


def test_bundles_of_each_kind_come_back(spark, tmp_path):
    rows = [(i, i / 7 if i % 5 else None, f"é{i}", i % 2 == 0, [float(i), -1.5]) for i in range(25)]
    df = spark.createDataFrame(rows, "id long, x double, name string, flag boolean, v array<double>").coalesce(2)
    npz.write_npz(df, str(tmp_path / "b"), rows_per_file=10)
    assert len(list((tmp_path / "b").glob("*.npz"))) >= 3 and not list((tmp_path / "b").glob("_run*"))
    back = npz.read_npz(spark, str(tmp_path / "b"), rows_per_task=4)
    found = {r.id: r for r in back.collect()}
    assert back.rdd.getNumPartitions() >= 7 and sorted(found) == list(range(25))
    for i, x, name, flag, v in rows:
        r = found[i]
        assert (r.name, r.flag, r.v) == (name, flag, v) and (math.isnan(r.x) if x is None else r.x == x)
    with_file = npz.read_npz(spark, str(tmp_path / "b"), "id long, missing string, source_file string")
    assert all(r.missing is None and Path(r.source_file).exists() for r in with_file.collect())
    npz.write_npz(df.limit(3), str(tmp_path / "b"), mode="overwrite")
    assert npz.read_npz(spark, str(tmp_path / "b")).count() == 3


def test_bundles_of_numpy_itself(spark, tmp_path):
    np.savez_compressed(tmp_path / "a.npz", y=np.arange(5, dtype=np.int8), p=np.asfortranarray(np.arange(10.0).reshape(5, 2)))
    np.savez(tmp_path / "b.npz", y=np.arange(3), p=np.ones((3, 2)), s=np.array([b"x", b"yy", b""]))
    rows = sorted(tuple(r) for r in npz.read_npz(spark, str(tmp_path), rows_per_task=2).collect())
    assert rows == sorted([(i, [2.0 * i, 2.0 * i + 1]) for i in range(5)] + [(i, [1.0, 1.0]) for i in range(3)])
    assert sorted(r.s or "" for r in npz.read_npz(spark, str(tmp_path / "b.npz")).collect()) == ["", "x", "yy"]
    np.savez(tmp_path / "c.npz", y=np.arange(3), p=np.ones((4, 2)))
    with pytest.raises(Exception, match="unequal length"):
        npz.read_npz(spark, str(tmp_path), "y long").collect()


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    df = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "v array<double>").coalesce(1)
    with pytest.raises(Exception, match="unequal length"):
        npz.write_npz(df, str(tmp_path / "b"))
    assert not list((tmp_path / "b").glob("*.npz"))


def event_file(spark, path, ids):
    spark.createDataFrame([(i, i % 3) for i in ids], "event_id long, user_id long").withColumn("ts", F.timestamp_seconds(F.col("event_id") * 3600).cast("timestamp_ntz")).withColumn("event_type", F.lit("view")).withColumn("value", F.lit(1.0)).coalesce(1).write.mode("append").parquet(path)


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    source, out = str(tmp_path / "in/events.parquet"), str(tmp_path / "out")
    event_file(spark, source, range(50))
    read = lambda: streams.event_stream(spark, str(tmp_path / "in")).select("event_id")
    assert sorted(r[0] for r in streams.drain(read(), folder=out).collect()) == list(range(50))
    event_file(spark, source, range(50, 80))
    assert sorted(r[0] for r in streams.drain(read(), folder=out).collect()) == list(range(80))
    assert sorted(r[0] for r in streams.drain(read(), folder=out).collect()) == list(range(80))  # nothing new


def test_state_lasts_over_a_restart(spark, tmp_path):
    source, out = str(tmp_path / "in/events.parquet"), str(tmp_path / "out")
    counts = lambda: streams.tumbling(streams.event_stream(spark, str(tmp_path / "in")))
    event_file(spark, source, range(40))
    first = streams.drain(counts(), folder=out).count()
    event_file(spark, source, range(40, 100))
    found = {r.start: r.n for r in streams.drain(counts(), folder=out).collect()}
    wanted = {}
    for r in spark.read.parquet(source).groupBy(F.date_trunc("day", "ts").cast("timestamp").alias("d")).count().collect():
        wanted[r.d] = r["count"]
    last = max(wanted)
    assert found == {d: n for d, n in wanted.items() if d != last} and 0 < first < len(found)


def client_class():
    """A class that workers get by value, as they don't import tests."""

    class Client:
        """Counts what is opened, called and closed, a file for each."""

        def __init__(self, folder, fail=0):
            self.folder, self.fail, self.calls = Path(folder), fail, 0
            self.mark("open")

        def mark(self, what):
            n = len(list(self.folder.glob("*")))
            (self.folder / f"{what}-{TaskContext.get().partitionId()}-{n}").write_text("")

        def __call__(self, prompts):
            self.calls += 1
            self.mark(f"call{len(prompts)}")
            if self.calls <= self.fail:
                raise RuntimeError("busy")
            return ["" if "bad" in p else p.upper() for p in prompts]

        def close(self):
            self.mark("close")

    return Client


Client = client_class()


def test_one_client_a_task_and_little_padding(spark, tmp_path):
    rng, folder = np.random.default_rng(1), str(tmp_path)
    texts = ["x" * int(n) for n in np.exp(rng.normal(4, 1.2, 400))]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(3)
    rows = prompting.call_in_batches(df, "t", lambda: Client(folder), most_padded=4000).collect()
    assert sorted((r.i, r.reply) for r in rows) == [(i, t.upper()) for i, t in enumerate(texts)]
    names = [p.name for p in tmp_path.iterdir()]
    assert sum(n.startswith("open") for n in names) == sum(n.startswith("close") for n in names) == 3
    batches = {}
    for r in rows:
        batches.setdefault(r.batch, []).append(len(texts[r.i]))
    assert all(len(b) * max(b) <= 4000 or len(b) == 1 for b in batches.values()) and all(r.padded == max(batches[r.batch]) for r in rows)
    padding = sum(len(b) * max(b) - sum(b) for b in batches.values())
    size, shuffled = max(1, len(texts) // len(batches)), rng.permutation([len(t) for t in texts])
    parts = [shuffled[i : i + size] for i in range(0, len(texts), size)]
    assert padding < 0.2 * sum(len(b) * max(b) - sum(b) for b in parts)


def test_failed_calls_are_tried_again(spark, tmp_path):
    folder = str(tmp_path)
    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None), (4, "")], "i long, t string").coalesce(1)
    rows = {r.i: r for r in prompting.call_in_batches(df, "t", lambda: Client(folder, fail=1), retries=3).collect()}
    assert (rows[1].reply, rows[1].attempts, rows[1].error) == ("GOOD", 2, None)
    assert (rows[2].reply, rows[2].attempts, rows[2].error) == (None, 3, "not ok") and (rows[3].reply, rows[3].attempts) == (None, 0)
    lost = prompting.call_in_batches(df.filter("i = 1"), "t", lambda: Client(folder, fail=9), retries=2).first()
    assert (lost.reply, lost.attempts, lost.error) == (None, 2, "busy")
    assert prompting.call_in_batches(df.limit(0), "t", lambda: Client(folder)).count() == 0


DOCS = [(1, ["pain", "calm", "pain"], 1.0), (2, ["calm"], 0.0), (3, [], 0.0), (4, None, 0.0), (5, ["pain", "other"], 1.0), (6, ["calm", "calm"], 0.0)]


def test_vocabulary_vectors(spark):
    docs = spark.createDataFrame(DOCS, "id long, terms array<string>, y double")
    model = vocabulary_model(docs, "terms", ["pain", "calm", "never"])
    idf = [math.log(7 / 3) + 1, math.log(7 / 4) + 1, math.log(7 / 1) + 1]
    for r in model.transform(docs).select("id", vector_to_array("features").alias("f")).collect():
        terms = DOCS[r.id - 1][1] or []
        raw = [terms.count(w) * x for w, x in zip(["pain", "calm", "never"], idf, strict=True)]
        norm = math.sqrt(sum(x * x for x in raw)) or 1.0
        assert r.f == pytest.approx([x / norm for x in raw])
    counts = vocabulary_model(docs, "terms", ["pain", "calm"], idf=False).transform(docs)
    assert [r.f for r in counts.orderBy("id").select(vector_to_array("features").alias("f")).collect()] == [[2, 1], [0, 1], [0, 0], [0, 0], [1, 0], [0, 2]]
    assert counts.columns == ["id", "terms", "y", "features"]


def test_a_saved_model_scores_alike(spark, tmp_path):
    docs = spark.createDataFrame(DOCS * 5, "id long, terms array<string>, y double")
    vectors = vocabulary_model(docs, "terms", ["pain", "calm"])
    whole = PipelineModel([vectors, models.lasso("y", 0.001).fit(models.balanced_weights(vectors.transform(docs), "y"))])
    whole.write().overwrite().save(str(tmp_path / "m"))
    score = lambda m: sorted((r.id, r.score) for r in models.scored(m, docs, ["id"]).collect())
    before = score(whole)
    assert score(models.load_pipeline(str(tmp_path / "m"))) == before and dict(before)[1] > 0.5 > dict(before)[2]
    prepared = models.preprocessing(["y"], []).fit(docs)
    prepared.write().overwrite().save(str(tmp_path / "p"))
    assert models.load_pipeline(str(tmp_path / "p")).transform(docs).select("features").collect() == prepared.transform(docs).select("features").collect()


@pytest.fixture(scope="module")
def crossed(spark):
    """Neither input tells the label: it is whether their signs differ."""
    rng = np.random.default_rng(0)
    rows = [([float(a), float(n)], [float(b)], float(a * b < 0), i % 4 == 0) for i, (a, b, n) in enumerate(zip(rng.choice([-1, 1], 240), rng.choice([-1, 1], 240), rng.normal(size=240), strict=True))]
    return spark.createDataFrame([*rows, (None, [1.0], 1.0, False)], "one array<double>, two array<double>, y double, held boolean").coalesce(2)


def test_fused_inputs_learn_what_neither_tells(crossed):
    model = fusion.train_fusion(crossed, "one", "two", "y", "held", epochs=45, rate=0.06)
    rows = model.scored(crossed.filter("one is not null and held"), ["y"], "one", "two").collect()
    assert np.mean([(r.score > 0.5) == (r.y == 1) for r in rows]) > 0.95
    losses = [tuple(r) for r in model.losses(crossed.sparkSession).collect()]
    assert losses[-1][2] < 0.5 * losses[0][2] and [e for e, _, _ in losses] == list(range(len(losses)))


def test_gradient_equals_differences():
    rng = np.random.default_rng(3)
    shapes = [(3, 4), (4,), (2, 4), (4,), (8, 5), (5,), (5, 1), (1,)]
    model = fusion.FusionModel(shapes, rng.normal(size=sum(int(np.prod(s)) for s in shapes)), [])
    one, two, y = rng.normal(size=(6, 3)), rng.normal(size=(6, 2)), rng.integers(0, 2, 6).astype(float)
    loss = lambda: -np.sum(y * np.log(model.forward(one, two)[-1]) + (1 - y) * np.log(1 - model.forward(one, two)[-1]))
    found, base = model.gradient(one, two, y), model.weights.copy()
    for i in range(0, len(base), 7):
        ends = []
        for h in (1e-6, -1e-6):
            model.weights = base.copy()
            model.weights[i] += h
            ends.append(loss())
        assert found[i] == pytest.approx((ends[0] - ends[1]) / 2e-6, abs=1e-4)


def test_training_stops_early_and_keeps_the_best(spark):
    rng = np.random.default_rng(5)
    rows = [([float(x)], [float(z)], float(rng.integers(0, 2)), bool(i % 2)) for i, (x, z) in enumerate(rng.normal(size=(60, 2)))]
    df = spark.createDataFrame(rows, "one array<double>, two array<double>, y double, held boolean").coalesce(1)
    model = fusion.train_fusion(df, "one", "two", "y", "held", epochs=40, rate=0.2, patience=2)
    held = [h for _, _, h in model.history]
    assert len(held) < 40 and held.index(min(held)) == len(held) - 3
    rows = model.scored(df.filter("held"), ["y"], "one", "two").collect()
    assert -np.mean([math.log(r.score if r.y else 1 - r.score) for r in rows]) == pytest.approx(min(held))
    assert fusion.train_fusion(df.limit(0), "one", "two", "y", "held", epochs=3).history == [(0, 0.0, 0.0)]
