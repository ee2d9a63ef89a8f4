"""Histories of notes by configuration, lemmas, summaries, lookups, column orders and bootstrap sums."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions import text
from tidewater.operators import metrics, notes, prompting, relational, sampling

NOTES = [
    (1, "2024-01-01", 1, "letter", "a", "one"), (1, "2024-01-01", 2, "clinic", None, "two"), (1, "2024-02-01", 3, "letter", "b", "three"), (2, "2024-01-05", 4, "scan", "c", "four"),
    (2, "2024-01-06", 5, "letter", "c", "five"), (3, "2024-01-07", 6, "scan", "d", "six"), (None, "2024-01-07", 7, "letter", "d", "lost"), (4, None, 8, "letter", "d", "lost"), (5, "2024-01-09", 9, "letter", None, None),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(NOTES, "mrn long, day string, i int, kind string, author string, note string")


def history(rows, name, **options):
    out = notes.note_history(rows, name, "mrn", "day", "i", "kind", "author", "note", **options)
    return {(r.mrn, r.day): (r.note, r.kinds, r.authors) for r in out.collect()}


def test_each_configuration(rows):
    plain = history(rows, "x-mostRecentVisit-medOnc-ConsultLetterClinic-y")
    assert plain[1, "2024-01-01"] == ("letter:\none\n\nclinic:\ntwo", ["letter", "clinic"], ["a"]) and len(plain) == 6 and plain[5, "2024-01-09"] == ("", ["letter"], [])
    for name in ("mostRecentVisit-appendFirst-medOnc-ConsultLetterClinic", "firstTreatmentOnly-medOnc-ConsultLetterClinic"):
        found = history(rows, name, leave_out=["scan"])
        assert found[1, "2024-02-01"] == ("letter:\none\n\nclinic:\ntwo\n\nletter:\nthree", ["letter"], ["a", "b"])
        assert found[1, "2024-01-01"] == plain[1, "2024-01-01"]
        assert found[2, "2024-01-05"][0] == "letter:\nfive\n\nscan:\nfour" and (3, "2024-01-07") not in found  # 3 has scans only
    first = history(rows, "firstVisitOnly-medOnc-ConsultLetterClinic")
    assert set(first) == {(1, "2024-01-01"), (2, "2024-01-05"), (3, "2024-01-07"), (5, "2024-01-09")}


def test_an_unknown_configuration_is_an_error(rows):
    with pytest.raises(NotImplementedError, match="lastVisit"):
        history(rows, "lastVisit")
    assert notes.steps_of("b-a", {"a": ["x"], "b": ["y", "x"]}) == ["x", "y"]
    assert history(rows.limit(0), "firstVisitOnly-medOnc-ConsultLetterClinic") == {}


def test_lemmas(spark):
    df = spark.createDataFrame([(1, "Cells  were dividing"), (2, None), (3, "")], "i int, t string")
    table = {("cells", "n"): "cell", ("were", "v"): "be", ("dividing", "v"): "divide", ("dividing", "a"): "dividing!"}
    lemma = lambda w, p: table.get((w, p), w)
    got = lambda c: [r.x for r in df.select("i", c.alias("x")).orderBy("i").collect()]
    assert got(text.lemmatise(F.lower("t"), lemma)) == ["cell be divide", None, ""]
    assert got(text.lemmatise(F.lower("t"), lemma, lambda words: ["zz" if w == "cells" else "a" for w in words])) == ["cell were dividing!", None, ""]
    assert got(text.lemmatise(F.col("t"))) == ["Cells were dividing", None, ""]


def test_summaries_of_pending_notes(spark):
    replies = {"a": '{"Summary": "short"} {"Summary": "other"}', "b": "nothing", "c": '{"Other": 1}', "d": '{"Summary": {"x": 1}}'}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(replies)], "id int, note string")
    done = df.filter("id = 0")
    ask = lambda prompts: [replies[p[-1]] for p in prompts]
    every = {r.id: (r.summary, r.raw) for r in prompting.summarise(df, ["id"], "note", None, lambda: ask, "Do.").collect()}
    assert every[0] == ("short", replies["a"]) and every[1] == (None, "nothing") and every[2][0] is None
    assert sorted(r.id for r in prompting.summarise(df, ["id"], "note", done, lambda: ask, "Do.").collect()) == [1, 2, 3]


def test_lookups_orders_and_merged_parts(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 5, "z")], "k string, n int, v string")
    assert [r.v for r in relational.look_up(df, "k", "a", ["v"], [F.asc("n")]).collect()] == ["y"]
    assert [r.v for r in relational.look_up(df, "k", None, ["v"], [F.asc("n")]).collect()] == ["z"] and relational.look_up(df, "k", "q", ["v"], [F.asc("n")]).count() == 0
    assert relational.columns_by_priority(["mean", "z", "AutoGluon2", "max", "a", "autogluon1"], ["max", "min", "mean"], "autogluon") == ["a", "z", "max", "mean", "AutoGluon2", "autogluon1"]
    parts = spark.createDataFrame([("train",), ("eval",), ("test",), (None,)], "p string").select(sampling.merge_parts(F.col("p"), "train", "eval").alias("p"))
    assert [r.p for r in parts.collect()] == ["train", "train", "test", None]


def test_bootstrap_sums_equal_repeated_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(None if i % 5 == 0 else f"g{i % 3}", i % 40, float(x) if i % 7 else None) for i, x in enumerate(rng.normal(size=200))]
    df = spark.createDataFrame(rows, "g string, id int, x double").repartition(3)
    found = {(r.g, r.rep): (r.n, r.sx) for r in metrics.bootstrap_sums(df, ["g"], "id", {"n": F.lit(1), "sx": F.col("x")}, 20, seed=3).collect()}
    repeated = metrics.bootstrap_counts(df, "id", 20, seed=3).groupBy("g", "rep").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.coalesce("x", F.lit(0.0))).alias("sx"))
    wanted = {(r.g, r.rep): (r.n, r.sx) for r in repeated.collect()}
    assert len(found) == 80 and all(found[k] == (pytest.approx(n), pytest.approx(sx)) for k, (n, sx) in wanted.items())
    whole = metrics.bootstrap_sums(df, [], "id", {"n": F.lit(1)}, 20, seed=3)
    assert whole.count() == 20 and sum(r.n for r in whole.collect()) == pytest.approx(sum(n for n, _ in wanted.values()))
