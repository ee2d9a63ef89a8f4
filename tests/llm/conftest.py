from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, bucket int, kept string, n_words string, comp int"


def rows_of(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    full = [(*r, len(r[1]) if r[1] is not None else None, "x", 1, "k", "w", 2) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


WORDS = " ".join(f"w{i}" for i in range(40))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    return rows_of(spark, [
        (1, WORDS, "en", "a"), (2, WORDS, "en", "a"), (2, WORDS, "en", "a"), (3, None, "en", "a"), (4, "", None, None), (None, WORDS + " tail", "fr", "b"),
        (5, "word", "fr", "b"), (6, " \n\t ", "fr", "b"), (7, "x" * 300_000, "de", None), (8, "lé mot été\n" * 3000, "de", "c"), (9, WORDS.upper(), "en", "c"),
        (None, None, None, None), (10, "Shared line\n" + WORDS, "en", "a")])


@pytest.fixture(scope="session")
def no_docs(spark):
    return rows_of(spark, [])


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
