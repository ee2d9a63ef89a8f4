"""tf-idf sums by chunks: different terms leave a chunk, not (document, term) pairs; results are those of counting (finding of round 4)."""

from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.test_findings_r03 import shuffled
from tidewater.functions.text import sentence_ngrams, sentence_words
from tidewater.operators import textstats

DOCS, WORDS = 400, 60


def counted(docs, lengths, k):
    """The k terms by plain counting, from all n-grams on the driver."""
    rows = docs.select("doc_id", sentence_ngrams(F.col("text"), lengths).alias("terms")).collect()
    tf: dict = {}
    for r in rows:
        tf.setdefault(r["doc_id"], Counter()).update(r["terms"] or [])
    df = Counter(t for c in tf.values() for t in c)
    sums: Counter = Counter()
    for doc, c in tf.items():
        w = {t: m * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t, m in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        if doc is not None:
            sums.update({t: x / norm for t, x in w.items()})
    kept = [(round(s, 6), t) for t, s in sums.items() if not any(d in t for d in "0123456789") and not (len(t) == 1 and t.isascii() and t.isalpha())]
    return [(t, s) for s, t in sorted(kept, key=lambda x: (-x[0], x[1]))[:k]]


def found(docs, lengths, k, size=None):
    return [(r["word"], pytest.approx(r["tfidf_sum"], abs=2e-6)) for r in textstats.tfidf_terms(docs, "doc_id", "text", lengths, k, size).collect()]


def test_tfidf_shuffles_terms_of_chunks(spark):
    words = " ".join(f"w{chr(97 + i // 10)}{chr(97 + i % 10)}" for i in range(WORDS))
    docs = spark.createDataFrame([(i, words) for i in range(DOCS)], "doc_id long, text string").repartition(2).cache()
    # DOCS * WORDS (document, term) pairs were shuffled before.
    assert shuffled(spark, lambda: textstats.tfidf_terms(docs, "doc_id", "text", [1], 3).collect()) < DOCS * WORDS / 4


@pytest.mark.parametrize("lengths", [[1], [1, 2], [3], [2, 1, 4]])
@pytest.mark.parametrize("chunk", [1, 1 << 20])
def test_tfidf_of_odd_texts(spark, monkeypatch, lengths, chunk):
    """No key, no text, texts of one key, sentences, control characters, Greek sigmas at the end of a sentence."""
    monkeypatch.setattr(textstats, "CHUNK", chunk)
    texts = ["One two. Two three?Three four!! one two", "one\x01two three four five", None, "", " . ? ", "ΟΔΟΣ.ΟΔΟΣ ΑΣ'Α x_1 b 7", "\tein Straße áb", "two two two two", "x", "İstanbul two"]
    rows = [(i % 13 if i % 5 else None, t) for i, t in enumerate(texts * 3)] + [(100 + i, "solo") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(docs, lengths, 1000) == counted(docs, lengths, 1000)
    assert textstats.tfidf_terms(docs.filter("text is null"), "doc_id", "text", lengths, 5).collect() == []
    assert textstats.tfidf_terms(docs.limit(0), "doc_id", "text", lengths, 5).collect() == []


@pytest.mark.parametrize("k", [1, 2, 20])
def test_tfidf_bound_that_was_guessed_too_high(spark, k):
    """A term of few documents leads, as the others are spread thin; and a k that more terms have to be added up for."""
    common = " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(600))
    docs = spark.createDataFrame([(i, common) for i in range(360)] + [(1000 + i, "solo") for i in range(40)], "doc_id long, text string").withColumn("bytes", F.octet_length("text"))
    want = counted(docs, [1], k)
    assert want[0][0] == "solo" and found(docs, [1], k, "bytes") == want


def test_words_are_parted_by_blanks_and_sentences_by_one_sign(spark):
    row = spark.createDataFrame([("A-b.C? d\x01e\n!F_2",)], "text string").select(sentence_words(F.col("text")).alias("w")).first()
    assert row["w"] == "a b\x01c\x01 d e \x01f_2"
