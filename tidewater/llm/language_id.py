"""Language identification by the nearest centroid.

A text becomes counts of its n-grams of 1 to 3 bytes (A-Z lower-cased, other ASCII than letters as one blank), hashed to
DIMS dimensions, with log term frequency, inverse document frequency and unit length. Each language has several
centroids: spherical k-means over a sample of its texts. A text gets the language of the centroid with the greatest
cosine; it is marked rejected where that cosine is below what nearly all of the language's sample has.

Document frequencies are counted over all texts to learn from. The centroids are fitted on at most SAMPLE_PER_LANGUAGE
texts of a language and SAMPLE_TOTAL in all (CENTROIDS of each at least): the ones with the smallest hash of (id, text)
among the language's different rows. So a text that many documents repeat is drawn as often as its documents are, a row
that is repeated as a whole is drawn once, and no language with a text is left without centroids.

Defined cases: a null text, or one without any letter, is `und` with score 0 and rejected; so is every text when there
is nothing to learn from. Repeated rows get a row each. A null id is never held out and never learned from. More than
MAX_LANGUAGES values of lang to learn from are refused with an error: the centroids are held whole by each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.held_out import held_out
from tidewater.llm.textkernel import Chunk, chunks

DIMS, LONGEST = 4096, 3
CENTROIDS, ROUNDS = 3, 8
SAMPLE_PER_LANGUAGE, SAMPLE_TOTAL, MAX_LANGUAGES = 400, 4000, 1000
#: Rows of a language that are ranked by their hash to draw the sample, as a multiple of it and beyond it.
SPARE, SPARE_ROWS = 1.5, 50
#: Share of a language's sample whose cosine a text may not fall below, and how much of that cosine is asked for.
REJECT_QUANTILE, REJECT_SLACK = 0.005, 0.8
UNKNOWN = "und"
ROWS_AT_ONCE = 256

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = 0x20
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def gram_counts(chunk: Chunk) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rows x DIMS counts) for blocks of a chunk's rows."""
    folded = _FOLD[chunk.data]
    row = np.repeat(np.arange(chunk.rows), np.diff(chunk.offsets))
    for lo in range(0, chunk.rows, ROWS_AT_ONCE):
        hi = min(chunk.rows, lo + ROWS_AT_ONCE)
        a, b = chunk.offsets[lo], chunk.offsets[hi]
        out, code = np.zeros((hi - lo) * DIMS, np.float32), np.zeros(b - a, np.uint32)
        here = row[a:b] - lo
        for n in range(1, LONGEST + 1):
            if b - a < n:
                break
            code = code[: b - a - n + 1] * np.uint32(256) + folded[a + n - 1 : b]
            cell = ((code + np.uint32(n << 24)) * np.uint32(2654435761)) >> np.uint32(32 - 12)
            start = here[: b - a - n + 1]
            inside = start == here[n - 1 :]
            out += np.bincount(start[inside] * DIMS + cell[inside], minlength=len(out)).astype(np.float32)
        yield lo, out.reshape(hi - lo, DIMS)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(counts) * idf)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """At most k unit centroids of the unit rows of x; the first is near the mean, each next the row farthest from those before."""
    centres = [_unit(x.mean(axis=0, keepdims=True))[0]]
    while len(centres) < min(k, len(x)):
        centres.append(x[np.argmin(np.max(x @ np.array(centres).T, axis=1))])
    centres = np.array(centres)
    for _ in range(rounds):
        nearest = np.argmax(x @ centres.T, axis=1)
        centres = np.array([_unit(x[nearest == i].mean(axis=0, keepdims=True))[0] if (nearest == i).any() else c for i, c in enumerate(centres)])
    return centres


class Model:
    def __init__(self, languages: list[str], owner: np.ndarray, centres: np.ndarray, idf: np.ndarray, floor: np.ndarray):
        self.languages, self.owner, self.centres, self.idf, self.floor = languages, owner, centres, idf, floor

    def __call__(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language number, cosine) of each row."""
        cosine = weighted(counts, self.idf) @ self.centres.T
        best = np.argmax(cosine, axis=1)
        return self.owner[best], np.clip(cosine[np.arange(len(best)), best], 0, 1)


def draw(rows: DataFrame) -> DataFrame:
    """(text, lang): of each language those of the different rows (doc_id, text, lang) that have the smallest hashes."""
    hashed = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(3), "doc_id", "text"), 2))
    of = hashed.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n"), F.min("h").alias("least")).collect()  # a row per language
    each = max(CENTROIDS, min(SAMPLE_PER_LANGUAGE, SAMPLE_TOTAL // max(1, len(of))))
    # A share of the hashes that holds the `each` smallest ones; the smallest of all is in it in any case.
    bounds = [(r["lang"], max(r["least"], int(min(1.0, (SPARE * each + SPARE_ROWS) / max(1, r["n"])) * 2**62))) for r in of]
    limits = F.broadcast(rows.sparkSession.createDataFrame(bounds, "lang string, most long"))  # at most MAX_LANGUAGES rows
    near = hashed.join(limits, "lang").filter(F.col("h") <= F.col("most")).dropDuplicates(["lang", "h"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))  # about SPARE * each + SPARE_ROWS rows of a language
    return near.withColumn("place", place).filter(F.col("place") <= each).select("text", "lang")


def fit(rows: DataFrame) -> Model | None:
    """Learn from rows (doc_id, text, lang) with a text and a lang."""
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    of = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(of) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    if not of:
        return None

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMS, np.int64)
        for batch in batches:
            for c in chunks(batch.column(0)):
                for _, counts in gram_counts(c):
                    total += (counts > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS), pa.int32()), pa.array(total)], ["dim", "n"])

    df = np.zeros(DIMS)
    for r in rows.select("text").mapInArrow(frequencies, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect():  # DIMS rows
        df[r["dim"]] = r["n"]
    idf = (np.log((1 + sum(of.values())) / (1 + df)) + 1).astype(np.float32)
    languages = sorted(of)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(0)):
                for lo, counts in gram_counts(c):
                    packed = pa.array([x.astype(np.float16).tobytes() for x in np.log1p(counts)], pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column(1).slice(c.lo + lo, len(counts)), packed], ["lang", "v"])

    sample = draw(rows).mapInArrow(vectors, "lang string, v binary").collect()  # SAMPLE_TOTAL rows of 8 KB, or CENTROIDS for each language
    found: dict[str, list[np.ndarray]] = {}
    for r in sorted(sample, key=lambda r: (r["lang"], bytes(r["v"]))):
        found.setdefault(r["lang"], []).append(np.frombuffer(r["v"], np.float16).astype(np.float32))
    languages = [name for name in languages if name in found]
    if not languages:
        return None
    owner, centres, floor = [], [], []
    for i, name in enumerate(languages):
        x = _unit(np.array(found[name]) * idf)
        own = spherical_kmeans(x, CENTROIDS)
        owner += [i] * len(own)
        centres.append(own)
        floor.append(REJECT_SLACK * np.quantile(np.max(x @ own.T, axis=1), REJECT_QUANTILE))
    return Model(languages, np.array(owner), np.concatenate(centres).astype(np.float32), idf, np.array(floor))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """For each document: doc_id, held_out, lang_pred, score (the cosine) and rejected."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), held_out(F.col(doc_id)).alias("held_out"))
    model = fit(plain.filter(~F.col("held_out") & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang"))
    kind = docs.schema[doc_id].dataType.simpleString()
    ask = plain.select("doc_id", "held_out", F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("has_letter"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(3)):
                for lo, counts in gram_counts(c):
                    part = batch.slice(c.lo + lo, len(counts))
                    if model is None:
                        which, score = np.zeros(len(counts), int), np.zeros(len(counts))
                    else:
                        which, score = model(counts)
                    known = np.asarray(part.column(2)) & (model is not None)
                    names = [model.languages[w] if k else UNKNOWN for w, k in zip(which, known, strict=True)]
                    low = ~known | (score < (model.floor[which] if model else 1))
                    yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0), pa.float64()), pa.array(low)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return ask.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")
