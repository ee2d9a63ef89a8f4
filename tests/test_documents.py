"""Rows as documents of sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions.documents import Flags, Item, row_document


def test_each_kind_of_line(spark):
    df = spark.createDataFrame([(1, 0.5, "B", True), (0, 0.0, None, False), (9, None, "b", None)], "sex int, dose double, site string, flag boolean").coalesce(1)
    note = row_document("Title:", [
        ("One", [Item("sex", F.col("sex"), recode={1: "female", 0: "male"}), Item("site NAME", F.col("site")), Item("gone", None, "kg")]), ("None", []),
        ("Two", [Item("dose", F.col("dose"), "%", percent=True), Flags("place", [("x", F.col("flag")), ("x", F.col("sex") == 9), ("y", F.col("sex") == 1)])]),
    ], wording={"name": "label"})
    assert [r.n for r in df.select(note.alias("n")).collect()] == [
        "Title:\n\nOne:\nSex: female\nSite label: b\nGone: not available\n\nTwo:\nDose: 50.0 %\nPlace: x\nPlace: y\n\n",
        "Title:\n\nOne:\nSex: male\nSite label: not measured\nGone: not available\n\nTwo:\n\n\n",
        "Title:\n\nOne:\nSex: not available\nSite label: b\nGone: not available\n\nTwo:\nDose: not measured\nPlace: x\n\n"]


def test_settings_of_a_file(tmp_path, monkeypatch):
    import os

    from tidewater.sources.settings import load_settings

    file = tmp_path / "env"
    file.write_text("# x\nTIDEWATER_A=1\nexport TIDEWATER_B='two words'\n")
    monkeypatch.setenv("TIDEWATER_A", "kept")
    monkeypatch.delenv("TIDEWATER_B", raising=False)
    assert load_settings(str(file)) == {"TIDEWATER_A": "1", "TIDEWATER_B": "two words"}
    assert (os.environ["TIDEWATER_A"], os.environ["TIDEWATER_B"]) == ("kept", "two words")
    load_settings(str(file), override=True)
    assert os.environ["TIDEWATER_A"] == "1"
    monkeypatch.delenv("TIDEWATER_B")
