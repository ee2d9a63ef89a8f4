"""Language identification: the sample, and a brute-force nearest centroid."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from tidewater.llm import language_id

EN = "the quick brown fox jumps over lazy dogs and runs away from home number"
FR = "le petit chat noir est couché sur la chaise près de la fenêtre ouverte"


@pytest.mark.parametrize("same_id", [False, True])
def test_a_repeated_text_is_learned(spark, same_id):
    rows = [(i, f"{EN} {i}", "en") for i in range(3000)] + [(10_000 if same_id else 10_000 + i, FR, "fr") for i in range(8000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language_id.draw(frame).filter("lang = 'fr'").count() == (1 if same_id else language_id.SAMPLE_PER_LANGUAGE)
    out = language_id.identify(frame).filter("doc_id >= 10000").groupBy("lang_pred").count().collect()
    assert [(r["lang_pred"], r["count"]) for r in out] == [("fr", 8000)]


def test_many_languages_are_all_learned(spark):
    rows = [(1000 * k + i, f"l{k:03d} " * (i % 5 + 1), f"l{k:03d}") for k in range(300) for i in range(5 + 40 * (k % 9 == 0))]
    sample = language_id.draw(spark.createDataFrame(rows, "doc_id long, text string, lang string")).groupBy("lang").count().collect()
    assert len(sample) == 300 and max(r["count"] for r in sample) <= language_id.SAMPLE_TOTAL // 300


def grams(text):
    """Counts by dimension of the n-grams of 1 to 3 folded bytes, by a plain loop."""
    folded = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in text.encode()]
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(folded) - n + 1):
            code = 0
            for b in folded[i : i + n]:
                code = code * 256 + b
            out[((code + (n << 24)) * 2654435761 % 2**32) >> 20] += 1
    return out


def test_nearest_centroid_by_brute_force(spark, docs):
    plain = docs.select("doc_id", "text", "lang")
    learned = plain.filter("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2")
    model = language_id.fit(learned)
    texts = [r["text"] for r in learned.collect()]
    df = Counter(d for t in texts for d in grams(t))
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    for r in docs.limit(80).collect():
        tf = grams(r["text"])
        v = {d: math.log1p(n) * (math.log((1 + len(texts)) / (1 + df[d])) + 1) for d, n in tf.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cosines = [sum(x * c[d] for d, x in v.items()) / norm for c in model.centres]
        best = int(np.argmax(cosines))
        assert got[r["doc_id"]]["score"] == pytest.approx(min(1.0, cosines[best]), abs=1e-4)
        near = {model.languages[model.owner[i]] for i, c in enumerate(cosines) if c > cosines[best] - 1e-4}
        assert got[r["doc_id"]]["lang_pred"] in near


def test_several_centroids_for_a_language(spark, docs):
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    assert all(Counter(model.owner.tolist())[i] > 1 for i in range(len(model.languages)))
