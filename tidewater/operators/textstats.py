"""Statistics of words and n-grams over a corpus, as explode-and-aggregate plans; tf-idf sums by chunks of texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import IDF, CountVectorizerModel, ElementwiseProduct, Normalizer, SQLTransformer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.text import sentence_ngrams, sentence_words
from tidewater.operators import term_chunks
from tidewater.operators.ranks import mid_ranks
from tidewater.sources.work import materialize

#: Bytes of texts in a chunk of tfidf_terms.
CHUNK = 8 << 20


def ngram_totals(docs: DataFrame, text: str, lengths: Sequence[int]) -> DataFrame:
    """word, total and percentage of the n-grams without digits."""
    grams = docs.select(F.explode(sentence_ngrams(F.col(text), lengths)).alias("word"))
    totals = grams.groupBy("word").agg(F.count(F.lit(1)).alias("total")).filter(~F.col("word").rlike(r"\p{N}"))
    totals = materialize(totals, "ngram-totals")
    whole = totals.agg(F.sum("total").alias("__all"))
    return totals.crossJoin(F.broadcast(whole)).withColumn("percentage", 100.0 * F.col("total") / F.col("__all")).drop("__all")


def tfidf(docs: DataFrame, key: str, text: str, lengths: Sequence[int], vocabulary: DataFrame | None = None) -> DataFrame:
    """key, word and unit-length tf-idf weight; idf = ln((1 + n) / (1 + df)) + 1, fitted within the vocabulary if given."""
    counts = docs.select(key, F.explode(sentence_ngrams(F.col(text), lengths)).alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    if vocabulary is not None:
        counts = counts.join(vocabulary.select("word"), "word", "left_semi")
    # Three plans read the counts; the texts are gone through once.
    counts = materialize(counts, "term-counts")
    df = counts.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    weighed = counts.join(df, "word").crossJoin(F.broadcast(n)).withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norms = weighed.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighed.join(norms, key).select(key, "word", (F.col("w") / F.col("norm")).alias("weight"))


def by_key(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per key with its texts, parted by a full stop that no n-gram crosses; the texts are dealt to all tasks by that."""
    return docs.groupBy(key).agg(F.array_join(F.collect_list(text), " . ").alias(text))


def marked(words: str) -> Column:
    """(word, first) of a sorted array of words: equal words lie together, and `first` marks the first of them."""
    return F.transform(words, lambda w, i: F.struct(w.alias("word"), F.coalesce(F.get(F.col(words), i - 1) != w, F.lit(True)).alias("first")))


def tfidf_terms(docs: DataFrame, key: str, text: str, lengths: Sequence[int], k: int, size: str | None = None) -> DataFrame:
    """The k terms of the greatest summed tf-idf, without digits and single letters. `size`, a column of bytes, spares a look at texts.

    Texts are dealt to chunks by their key, once. A chunk sends its different terms, and gets the numbers of documents
    that hold them back; with these it knows the lengths of its documents. A weight is 1 at most, so a term's sum is at most
    the number of its documents: terms of fewer documents than the least of k sums needn't be added up. `least` is a guess of
    that bound; if the k-th sum turns out to be below it, the sums are taken again down to what that sum proves.
    """
    n, size_of_all = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(size or F.octet_length(text)), F.lit(0))).first()
    chunks = max(size_of_all // CHUNK + 1, 3 * docs.sparkSession.sparkContext.defaultParallelism)
    chunk = F.pmod(F.xxhash64(key), F.lit(chunks)).cast("int").alias("chunk")
    rows = docs.select(chunk, F.col(key).alias("key"), F.concat(F.coalesce(sentence_words(F.col(text)), F.lit("")), F.lit("\x01")).alias("text"))

    def found(least: int) -> DataFrame:
        back = rows.groupBy("chunk").applyInArrow(term_chunks.sent(lengths, (chunks + 2) // 3), term_chunks.SENT).groupBy("bucket").applyInArrow(term_chunks.added, term_chunks.BACK)
        sums = rows.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(term_chunks.weighed(lengths, n, least), term_chunks.SUMS)
        sums = sums.filter(~F.col("word").rlike("[0-9]") & ~F.col("word").rlike("^[a-zA-Z]$")).groupBy("word").agg(F.round(F.sum("s"), 6).alias("tfidf_sum"))
        return materialize(sums.orderBy(F.col("tfidf_sum").desc(), "word").limit(k), "tfidf-terms")

    least = max(n // (8 * k), 1)
    top = found(least)
    many, last = top.agg(F.count(F.lit(1)), F.min("tfidf_sum")).first()
    if least > 1 and (many < k or last < least):
        top = found(max(int(last), 1) if many == k else 1)
    return top.orderBy(F.col("tfidf_sum").desc(), "word")


def word_contrast(docs: DataFrame, scores: DataFrame, key: str, text: str, score: str, quantile: float) -> DataFrame:
    """For each frequent word: how the mean score differs between documents with and without it, and the rank-sum z.

    What documents without a word have is the whole minus what those with it have. A document's scores and ranks are
    joined to its text, and its words are added up by word before they are shuffled: no (document, word) pairs are built.
    """
    ranked = materialize(mid_ranks(scores.select(key, score), [], score, "mid"), "ranks")
    whole = ranked.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(score).alias("s"))
    per_key = ranked.groupBy(key).agg(F.count(F.lit(1)).cast("double").alias("k"), F.sum(score).alias("sp"), F.sum("mid").alias("r"))
    words = by_key(docs, key, text).select(key, F.sort_array(sentence_ngrams(F.col(text), [1])).alias("words")).join(per_key, key, "left")
    rows = words.select("k", "sp", "r", F.explode(marked("words")).alias("w")).select("w.word", *[F.when(F.col("w.first"), F.col(c)).alias(c) for c in ("k", "sp", "r")])
    found = rows.groupBy("word").agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum("k"), F.lit(0.0)).alias("k"), F.sum("sp").alias("sp"), F.sum("r").alias("r")).filter(~F.col("word").rlike(r"\p{N}"))
    found = materialize(found, "words")
    least = found.agg(F.percentile("total", F.lit(quantile)).alias("least"))
    k, n = F.col("k"), F.col("n")
    out = found.crossJoin(F.broadcast(least)).filter("total >= least and k > 0").crossJoin(F.broadcast(whole)).filter("k < n")
    change = F.col("sp") / k - (F.col("s") - F.col("sp")) / (n - k)
    z = (F.col("r") - k * (n + 1) / 2) / F.sqrt(k * (n - k) * (n + 1) / 12)
    return out.select("word", k.cast("long").alias("n_present"), F.round(k / n, 8).alias("frequency"), F.least(k, n - k).cast("long").alias("n_metric_samples"), F.round(change, 8).alias("change_in_metric"), F.round(z, 6).alias("z"))


def word_metric_change(docs: DataFrame, scores: DataFrame, key: str, text: str, y: str, score: str, least: int, threshold: float = 0.5) -> DataFrame:
    """For each word of at least `least` documents, with as many without it: AUC and false discovery rate of the documents with the word less those of the others.

    Pairs (positive, negative) in right order among the documents without a word are all such pairs, less those of which
    one has the word, plus those of which both have it. The first two are sums of one number per document. Scores are
    joined to texts and all is added up by (word, score) before it is shuffled; areas are taken within the bins that the
    scores of all documents are cut into, then over a word's bins. A metric is null where a side has no positive, no negative or no hit.
    """
    # Ranks read their rows several times over, and three plans read the ranks: both are stored.
    ranked = materialize(mid_ranks(scores.select(key, y, score), [], score, "__all", keep_bin="__bin").drop("tied"), "ranks")
    ranked = materialize(mid_ranks(ranked, [y], score, "__own").drop("tied").withColumn("__hit", (F.col(score) >= threshold).cast("double")), "own-ranks")
    pos, neg, hits = F.sum(y), F.sum(1 - F.col(y)), F.sum("__hit")
    # The rank among all less that within the own class: negatives below a positive, or positives below a negative.
    sums = [pos.cast("double").alias("all_pos"), neg.cast("double").alias("all_neg"), hits.alias("all_hits"), F.sum(F.col("__hit") * (1 - F.col(y))).alias("all_wrong")]
    whole = ranked.agg(*sums, F.coalesce(F.sum(F.when(F.col(y) == 1, F.col("__all") - F.col("__own"))), F.lit(0.0)).alias("all_right"))
    right = F.when(F.col(y) == 1, F.col("__all") - F.col("__own")).otherwise(F.col("n_pos") - (F.col("__all") - F.col("__own")))
    entry = F.struct(F.col(y).cast("long").alias("y"), F.col(score).alias("score"), F.col("__bin").alias("bin"), right.alias("right"))
    per_key = ranked.crossJoin(F.broadcast(whole.select(F.col("all_pos").alias("n_pos")))).groupBy(key).agg(F.collect_list(entry).alias("scored"))
    words = by_key(docs, key, text).select(key, F.array_distinct(sentence_ngrams(F.col(text), [1])).alias("words")).join(per_key, key, "left")
    rows = words.select("words", F.posexplode_outer("scored").alias("i", "s")).select("i", "s", F.explode(F.filter("words", lambda w: ~w.rlike(r"\p{N}"))).alias("word"))
    at = rows.groupBy("word", "s.bin", "s.score").agg(
        F.count_if(F.coalesce(F.col("i"), F.lit(0)) == 0).alias("docs"), F.count("s").alias("n"), F.coalesce(F.sum("s.y"), F.lit(0)).alias("pos"),
        F.coalesce(F.sum(1 - F.col("s.y")), F.lit(0)).alias("neg"), F.coalesce(F.sum("s.right"), F.lit(0.0)).alias("right"))
    at = materialize(at, "words-by-score")
    often = at.groupBy("word").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least).select("word")
    below = Window.partitionBy("word", "bin").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    hit = (F.col("score") >= threshold).cast("double")
    steps = at.filter("score is not null").join(often, "word", "left_semi").withColumn("area", F.col("pos") * (F.coalesce(F.sum("neg").over(below), F.lit(0)) + F.col("neg") / 2))
    bins = steps.groupBy("word", "bin").agg(*[F.sum(c).alias(c) for c in ("n", "pos", "neg", "right", "area")], F.sum(hit * F.col("n")).alias("hits"), F.sum(hit * F.col("neg")).alias("wrong"))
    before = Window.partitionBy("word").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("area", F.col("area") + F.col("pos") * F.coalesce(F.sum("neg").over(before), F.lit(0)))
    sides = bins.groupBy("word").agg(F.sum("n").alias("n"), F.sum("pos").cast("double").alias("in_pos"), F.sum("neg").cast("double").alias("in_neg"), F.sum("hits").alias("in_hits"), F.sum("wrong").alias("in_wrong"), F.sum("right").alias("touching"), F.sum("area").alias("both"))
    out = sides.crossJoin(F.broadcast(whole))
    auc = F.col("both") / F.nullif(F.col("in_pos") * F.col("in_neg"), F.lit(0.0))
    pairs = (F.col("all_pos") - F.col("in_pos")) * (F.col("all_neg") - F.col("in_neg"))
    others = (F.col("all_right") - F.col("touching") + F.col("both")) / F.nullif(pairs, F.lit(0.0))
    rate = F.col("in_wrong") / F.nullif(F.col("in_hits"), F.lit(0.0)) - (F.col("all_wrong") - F.col("in_wrong")) / F.nullif(F.col("all_hits") - F.col("in_hits"), F.lit(0.0))
    kept = out.filter(F.col("all_pos") + F.col("all_neg") - F.col("n") >= least)
    return kept.select("word", F.col("n").alias("n_present"), F.round(auc - others, 8).alias("change_in_auc"), F.round(rate, 8).alias("change_in_fdr"))


def vocabulary_model(docs: DataFrame, terms: str, vocabulary: Sequence[str], idf: bool = True, out: str = "features") -> PipelineModel:
    """Sparse vectors over a fixed vocabulary from an array column of terms, as a pipeline that can be saved and loaded.

    Counts; with `idf` weighed by ln((1 + n) / (1 + df)) + 1, fitted on `docs`, and scaled to unit length. A document
    without a term of the vocabulary, or with null terms, is a vector of zeros.
    """
    known = SQLTransformer(statement=f"SELECT *, coalesce(`{terms}`, array()) AS __terms FROM __THIS__")
    counts = CountVectorizerModel.from_vocabulary(list(vocabulary), "__terms", "__counts" if idf else out)
    stages = [known, counts]
    if idf:
        fitted = IDF(inputCol="__counts", outputCol="__idf").fit(counts.transform(known.transform(docs)))
        scale = ElementwiseProduct(scalingVec=Vectors.dense([x + 1 for x in fitted.idf.toArray()]), inputCol="__counts", outputCol="__weights")
        stages += [scale, Normalizer(p=2.0, inputCol="__weights", outputCol=out)]
    return PipelineModel([*stages, SQLTransformer(statement=f"SELECT * EXCEPT ({'__terms, __counts, __weights' if idf else '__terms'}) FROM __THIS__")])
