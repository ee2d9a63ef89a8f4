"""Characteristics by split and eligibility by thresholds, on small tables worked out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import characteristics as ch
from tidewater.operators import eligibility as el

LIMITS = (el.Limit("a", "lab", True, 10.0), el.Limit("b", "lab", False, 5.0))


def test_shares_have_two_digits_and_commas(spark):
    df = spark.createDataFrame([(1, 3), (2, 3), (0, 0), (1234567, 1234567), (1, 800)], "n long, w long").coalesce(1)
    assert [r[0] for r in df.select(ch.share_text(F.col("n"), F.col("w"))).collect()] == ["1 (33.33)", "2 (66.67)", "0 (0.00)", "1,234,567 (100.00)", "1 (0.13)"]


def test_lines_of_splits(spark):
    rows = [("x", 1, 1, 1.0, "p"), ("x", 1, -1, 2.0, "q"), ("x", 2, 0, None, "p"), ("x", 3, 1, 4.0, None), ("y", 4, 1, 3.0, "r"), ("y", None, None, 3.0, "q")]
    df = spark.createDataFrame(rows, "split string, id int, flag int, size double, kind string")
    top = ch.top_names(df, "id", "kind", ["x"], 1)
    lines = [ch.medians(df, "m", {"size": F.col("size")}), ch.shares(df, "f", {"flag": F.col("flag")}, missing=-1), ch.categories(df, "k", "id", "kind", "x"), ch.others(df, "k", "id", "kind", top)]
    got = [tuple(r) for r in ch.by_split(lines, ["m", "f", "k"], ["x", "y", "z"]).orderBy("line").collect()]
    assert got == [
        (1, "m", "size", "2.00 (1.50-3.00)", "3.00 (3.00-3.00)", "0 (0)"),
        (2, "f", "flag", "2 (66.67)", "1 (50.00)", "0 (0)"),
        (3, "k", "p", "2 (66.67)", "0 (0)", "0 (0)"),
        (4, "k", "q", "1 (33.33)", "1 (100.00)", "0 (0)"),
        (5, "k", "r", "0 (0)", "1 (100.00)", "0 (0)"),
        (6, "k", "Other", "2 (66.67)", "1 (100.00)", "0 (0)")]
    assert [r.name for r in top.collect()] == ["p"]
    by_key = {(r.split, r.name): r.shown for r in ch.categories(df.union(df), "k", "id", "kind", "x", by_key=True).collect()}
    assert by_key == {("x", "p"): "2 (66.67)", ("x", "q"): "1 (33.33)", ("y", "q"): "0 (0.00)", ("y", "r"): "1 (100.00)"}


def test_no_rows_give_no_lines(spark):
    df = spark.createDataFrame([], "split string, id int, flag int, size double, kind string")
    lines = [ch.medians(df, "m", {"size": F.col("size")}), ch.shares(df, "f", {"flag": F.col("flag")}), ch.categories(df, "k", "id", "kind", "x"), ch.others(df, "k", "id", "kind", ch.top_names(df, "id", "kind", ["x"], 3))]
    assert ch.by_split(lines, ["m", "f", "k"], ["x"]).count() == 0


def test_thresholds(spark):
    rows = [(1, 0, 1, 10.0), (1, 0, 1, 10.0), (2, -1, 0, 20.0), (3, None, 1, 5.0), (4, 1, -1, 4.0), (5, 1, 1, None), (6, None, None, 12.0)]
    df = spark.createDataFrame(rows, "id int, a int, b int, lab double")
    assert {tuple(r) for r in el.eligible_keys(df, ["id"], LIMITS).collect()} == {(1, "a"), (6, "a"), (3, "b")}
    assert el.eligible_keys(df, ["id"], LIMITS).count() == 3
    assert [tuple(r) for r in el.eligibility(df, LIMITS).collect()] == [("a", "lab", ">=", 10.0, 6, 3, 3), ("b", "lab", "<=", 5.0, 6, 5, 1)]
    assert [tuple(r)[4:] for r in el.eligibility(df.limit(0), LIMITS).collect()] == [(0, 0, 0), (0, 0, 0)]
    assert el.eligible_keys(df, ["id"], ()).count() == 0


def test_parts_and_their_differences(spark):
    df = spark.createDataFrame([("g", 0.9, True), ("g", 0.6, None)], "g string, v double, flag boolean")
    tall = el.in_parts(df, {"one": F.col("v") > 0.8, "two": F.col("v") < 0.8, "flagged": F.col("flag")})
    assert sorted((r.part, r.v) for r in tall.collect()) == [("flagged", 0.9), ("one", 0.9), ("two", 0.6)]
    got = {r.part: r.v for r in el.with_differences(tall, ["g"], "part", "v", ["one", "two", "none"], [("one", "two"), ("one", "none")]).collect()}
    assert got == {"one": 0.9, "two": 0.6, "none": None, "one_minus_two": 0.9 - 0.6, "one_minus_none": None}
