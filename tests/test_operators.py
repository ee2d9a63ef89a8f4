"""Edge cases of operators on small frames with results worked out by hand."""

from __future__ import annotations

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.functions import rules, text
from tidewater.operators import features, htest, metrics, prompting, relational, sampling, windows
from tidewater.operators.asof import asof_lookback
from tidewater.operators.thinning import thin_by_gap
from tidewater.operators.ranks import mid_ranks
from tidewater.sources import readers


def test_asof_bounds(spark):
    s = spark.createDataFrame([(1, 100), (2, 100)], "k int, t long").withColumn("t", F.timestamp_seconds("t"))
    m = spark.createDataFrame([(1, 90, 1), (1, 100, 2), (1, 89, 3), (1, 95, 4), (1, 95, 5)], "k int, t long, id int").withColumn("t", F.timestamp_seconds("t"))
    pick = lambda **o: {r["k"]: r["last"]["id"] if r["last"] else None for r in asof_lookback(s, m, "k", "t", "t", "id", 10, **o).collect()}
    assert pick() == {1: 5, 2: None}
    assert pick(include_now=True) == {1: 2, 2: None}
    only = m.filter("id = 1")
    left = lambda start: asof_lookback(s, only, "k", "t", "t", "id", 10, include_start=start).filter("k = 1 and last is not null").count()
    assert (left(True), left(False)) == (1, 0)


def test_auc_by_hand(spark):
    rows = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8), (1, 0.4), (0, 0.8)], "y int, s double")
    assert metrics.auc(rows, [], "y", "s").first()["auc"] == pytest.approx(5 / 9)
    assert metrics.auc(rows.filter("y = 1"), [], "y", "s").first()["auc"] is None
    assert metrics.auc(rows.withColumn("s", F.lit(0.5)), [], "y", "s").first()["auc"] == 0.5


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=2, max_size=30))
def test_auc_properties(spark, rows):
    df = spark.createDataFrame([(y, s / 7) for y, s in rows], "y int, s double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    found = metrics.auc(df, [], "y", "s").first()["auc"]
    if not pos or not neg:
        assert found is None
        return
    assert found == pytest.approx(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)))
    assert metrics.auc(df.withColumn("y", 1 - F.col("y")), [], "y", "s").first()["auc"] == pytest.approx(1 - found)


def test_mid_ranks_span_bins(spark):
    rows = spark.range(1, 2001).select((F.col("id") % 500).cast("double").alias("v"), F.lit("g").alias("g"))
    got = {r["v"]: r["mid_rank"] for r in mid_ranks(rows, ["g"], "v", bins=7).collect()}
    assert got == {float(v): 4 * v + 2.5 for v in range(500)}


def test_p_values(spark):
    rows = spark.createDataFrame([(1.959963984540054, 3.841458820694124, 2.0, 10.0)], "z double, c double, t double, df double")
    p = rows.select(htest.two_sided_normal("z").alias("n"), htest.chi_square_upper("c", F.lit(1.0)).alias("c"), htest.two_sided_t("t", "df").alias("t")).first()
    assert p["n"] == pytest.approx(0.05) and p["c"] == pytest.approx(0.05) and p["t"] == pytest.approx(0.07338803, abs=1e-7)


def test_signed_rank_without_differences(spark):
    assert htest.signed_rank(spark.createDataFrame([(0.0,)], "d double"), [], "d").first()["z"] is None


def test_concordance_of_itself(spark):
    rows = spark.range(10).select(F.col("id").cast("double").alias("x"))
    assert rows.withColumn("y", F.col("x")).agg(metrics.concordance("x", "y")).first()[0] == pytest.approx(1)


def test_adjusted_p_values(spark):
    p = [0.01, 0.02, 0.02, 0.5]
    h = sum(1 / i for i in range(1, 5))
    out = {r["p"]: r["q"] for r in htest.benjamini_yekutieli(spark.createDataFrame([(x,) for x in p], "p double"), [], "p", "q").collect()}
    assert out[0.02] == pytest.approx(min(1, 0.02 * 4 * h / 3)) and out[0.01] == pytest.approx(min(out[0.02], 0.01 * 4 * h)) and out[0.5] == 1


def test_zscore_of_constant_and_single(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 5.0)], "g string, v double")
    assert {r["z"] for r in windows.zscore(rows, ["g"], "v", "z").collect()} == {0.0}


def test_interleave(spark):
    rows = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 0)], "id int, y int")
    order = [r["id"] for r in windows.interleave(rows, "y", [F.col("id")]).orderBy("position").collect()]
    assert order == [1, 4, 2, 3]
    assert windows.interleave(rows.filter("y = 1"), "y", [F.col("id")]).orderBy("position").first()["position"] == 1


def test_budget_stops_at_first_overflow(spark):
    rows = spark.createDataFrame([(1, 3), (2, 9), (3, 1)], "id int, c int").withColumn("g", F.lit(1))
    assert [r["id"] for r in windows.budget_prefix(rows, ["g"], "id", F.col("c"), 10).collect()] == [1]


@pytest.mark.parametrize("n", [10, 3, 4])
def test_contiguous_parts(spark, n):
    parts = [r["part"] for r in windows.contiguous_parts(spark.range(n), "id", 4).orderBy("id").collect()]
    assert parts == sorted(parts) and [parts.count(i) for i in range(4)] == [n // 4 + (i < n % 4) for i in range(4)]


def test_balanced_parts(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 3).cast("int").alias("w"))
    loads = [r["l"] for r in windows.balanced_parts(rows, "id", "w", 4).groupBy("part").agg(F.sum("w").alias("l")).collect()]
    assert sum(loads) == 999 and max(loads) - min(loads) < 60


def test_thin_by_gap(spark):
    rows = spark.createDataFrame([(1, t, t) for t in (0, 5, 9, 10, 19, 25)], "k int, t long, id long").withColumn("t", F.timestamp_seconds("t"))
    assert sorted(r["id"] for r in thin_by_gap(rows, "k", "t", "id", 10).collect()) == [0, 10, 25]


def test_replicates(spark):
    rows = spark.createDataFrame([("a", "0.2", "x", 1), ("a", "0.4", "y", 2), ("a", "bad", "z", 0), ("b", "1", "q", 1)], "k string, v string, r string, o int")
    out = {r["k"]: r for r in relational.collapse_replicates(rows, ["k"], "v", "r", "o").collect()}
    assert out["a"]["probability"] == pytest.approx(0.3) and out["a"]["reason"] == "x" and out["b"]["std_probability"] is None


def test_first_row_keeps_nulls(spark):
    rows = spark.createDataFrame([(1, 1, None), (1, 2, "b")], "k int, o int, v string")
    assert relational.first_row(rows, ["k"], [F.col("o")]).first()["v"] is None
    assert relational.extreme_row(rows, ["k"], ["o"]).first()["v"] is None


def test_ordered_union(spark):
    rows = spark.createDataFrame([(["b", None, "a"], ["a", "c"]), (None, ["x"])], "a array<string>, b array<string>")
    assert [r[0] for r in rows.select(relational.ordered_union(F.col("a"), F.col("b"))).collect()] == [["b", "a", "c"], ["x"]]


def test_unique_or_error(spark):
    assert relational.assert_unique(spark.range(3), ["id"]).count() == 3
    with pytest.raises(Exception, match="repeated key"):
        relational.assert_unique(spark.range(2).union(spark.range(1)), ["id"]).collect()


def test_replies(spark):
    replies = ['{"Reason": "a", "Probability": 85}', 'say {"Reason": "n {x}", "Probability": 0.4} end', "none", None, '{"Prediction": 0.4}', '{"Prediction": 0.5}', "{'Probability': 0.25}"]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, raw string").select("i", text.parse_reply(F.col("raw")).alias("r")).orderBy("i").collect()
    assert [r["r"]["probability"] for r in rows] == [0.85, 0.4, None, None, None, None, 0.25]
    assert [r["r"]["prediction"] for r in rows] == [None, None, None, None, 0, 1, None]


def test_text_rules(spark):
    row = spark.createDataFrame([("Éa b2 été. No-stop! ok", "Gallbladder")], "t string, s string")
    out = row.select(text.clean(F.col("t")).alias("c"), text.sentence_ngrams(F.lit("a b. c d e? f"), [2]).alias("g"), text.capitalise(F.lit("aBC")).alias("u"),
                     rules.first_match(F.col("s"), (("bladder", "bladder"), ("gallbladder", "bile")), default="other").alias("f")).first()
    assert out["c"] == "éa b2 été. nostop ok" and out["g"] == ["a b", "c d", "d e"] and out["u"] == "Abc" and out["f"] == "bladder"


def test_path_and_vector_text(spark):
    row = spark.createDataFrame([("/x/note_model-8B-Q4_1_2/statistics.csv", "[0.25 0.75]")], "p string, v string")
    out = row.select(*[c.alias(n) for n, c in readers.path_parameters(F.col("p"), {"last": -1, "model": -3, "none": -9}).items()], readers.vector_text(F.col("v")).alias("v")).first()
    assert (out["last"], out["model"], out["none"], out["v"]) == ("2", "model-8B-Q4", None, [0.25, 0.75])


def test_feature_columns(spark):
    rows = spark.createDataFrame([(1, 0, None, "a"), (2, 0, None, "a"), (3, 0, 1, "b")], "id int, z int, m int, c string")
    assert features.drop_mostly_missing(features.drop_unused(rows, ["z"]), 0.6).columns == ["id", "c"]
    assert sorted(r["c"] for r in features.collapse_rare(rows, "c", 2).collect()) == ["Other", "a", "a"]


def test_sampling_repeats(spark):
    rows = spark.range(200).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"))
    a = {r["id"] for r in sampling.balanced(rows, "y", "id", 60).collect()}
    assert a == {r["id"] for r in sampling.balanced(rows.repartition(7), "y", "id", 60).collect()} and len(a) == 120
    shots = sampling.few_shot(rows, "y", "id", 6).collect()
    assert sum(r["y"] for r in shots) == 3 and len(shots) == 6


def test_model_calls_retry(spark):
    calls = prompting.call_model(spark.createDataFrame([("a",), ("bad",)], "p string"), "p", lambda ps: ["" if p == "bad" else p.upper() for p in ps], retries=3)
    assert {r["p"]: (r["reply"], r["attempts"]) for r in calls.collect()} == {"a": ("A", 1), "bad": (None, 3)}


def test_context_fit(spark):
    row = spark.createDataFrame([("s s", [" e1 e1 e1", " e2 e2 e2"], "n n n n n n")], "s string, e array<string>, n string")
    fit = lambda b: row.select(prompting.fit_context(F.col("s"), F.col("e"), F.col("n"), b).alias("f")).first()["f"]
    assert (fit(20)["n_examples"], fit(12)["n_examples"], fit(8)["n_examples"]) == (2, 1, 0)
    assert fit(6)["truncated"] and fit(6)["note"] == "n n\n[NOTE TRUNCATED]"


def test_density_peaks_at_one(spark):
    out = htest.density_on_grid(spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", 1.1)], "g string, v double"), ["g"], "v", 5).agg(F.max("density")).first()[0]
    assert math.isclose(out, 1)


def test_reports_and_settings(spark):
    from tidewater.operators import reports
    from tidewater.sources.settings import parse_settings

    assert parse_settings(["# x", "", "export A=1", "B = 'two words'", 'C="x=y"', "bad"]) == {"A": "1", "B": "two words", "C": "x=y"}
    rows = spark.createDataFrame([(1, "a", 0.5, 0), (2, "b", 0.6, 1)], "lab_id int, lab_name string, p double, target_x int")
    assert reports.columns_like(rows, contains=["lab"], starts=["target_"], without=["name"]) == ["lab_id", "target_x"]
    assert reports.rename_by_rules(rows, [("lab_n", "n"), ("lab", "test")]).columns == ["test_id", "name", "p", "target_x"]
    assert [r["p"] for r in reports.set_where(rows, {"lab_id": 2, "lab_name": "b"}, ["p"], -1.0).orderBy("lab_id").collect()] == [0.5, -1.0]
    lines = spark.createDataFrame([(d, x, 2.0 * x + d) for d in (0, 1) for x in (1.0, 2.0, 4.0)], "draw int, x double, v double").withColumn("u", F.col("x"))
    out = {(r["draw"], r["term"]): r["coefficient"] for r in reports.regress_per_draw(lines.select("draw", "u", "v"), "draw", "u", "v", lines.select("u", "x").distinct(), ["x"]).collect()}
    assert out[(1, "x")] == pytest.approx(2) and out[(1, "constant")] == pytest.approx(1) and out[(0, "constant")] == pytest.approx(0, abs=1e-9)


def test_sources_round_trip(spark, tmp_path):
    from tidewater.sources import sinks

    rows = spark.createDataFrame([(1, 'say "x",\ny'), (2, None)], "id long, t string")
    sinks.write_parts(rows, f"{tmp_path}/t.csv", 2, "id", "csv", "none")
    assert {(r["id"], r["t"]) for r in readers.load_table(spark, f"{tmp_path}/t.csv", "id long, t string").collect()} == {(1, 'say "x",\ny'), (2, None)}
    sinks.write_json_map(rows.filter("id = 1"), f"{tmp_path}/m", "id", "t")
    assert [(r["id"], r["text"]) for r in readers.read_json_map(spark, f"{tmp_path}/m").collect()] == [("1", 'say "x",\ny')]
    many = readers.read_many(spark, f"{tmp_path}/t.csv", "csv", "id long, t string")
    assert "source_file" in many.columns
    good, again = sinks.sweep(spark.createDataFrame([("a", None), ("a", 1), ("b", None)], "k string, v int"), F.col("v").isNotNull(), ["k"])
    assert good.count() == 1 and [r["k"] for r in again.collect()] == ["b"]
    bundle = spark.createDataFrame([("m", [1, 2], [0.1, 0.2])], "m string, a array<int>, b array<double>")
    assert [(r["x"], r["y"]) for r in readers.bundle_to_long(bundle, ["m"], {"a": "x", "b": "y"}).collect()] == [(1, 0.1), (2, 0.2)]
    with pytest.raises(Exception, match="unequal"):
        readers.bundle_to_long(bundle.withColumn("b", F.array(F.lit(0.5))), ["m"], {"a": "x", "b": "y"}).collect()
