"""Queries over texts: n-grams, tf-idf, word contrasts, replies, sampling for prompts."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import documents, text
from tidewater.functions.documents import Flags, Item
from tidewater.operators import htest, notes, prompting, relational, sampling, windows
from tidewater.operators.textstats import ngram_totals as count_ngrams
from tidewater.operators.textstats import marked, tfidf_terms, vocabulary_model, word_contrast as contrast
from tidewater.plans.catalog import query
from tidewater.plans.predictions import PREDS_SQL, predictions
from tidewater.sources.tables import spread, table
from tidewater.sources.work import materialize

#: Words left out before counting.
STOP_WORDS = ("the", "and", "of", "to", "in", "is", "it", "la", "de", "der", "die", "und", "el", "le")

_CLEAN_SQL = "regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s.]', '', 'g')"
_STOPPED_SQL = f"array_to_string(list_filter(regexp_split_to_array({_CLEAN_SQL}, '\\s+'), lambda w: NOT list_contains([{', '.join(repr(w) for w in STOP_WORDS)}], w)), ' ')"
_SENTENCES_SQL = f"sentences AS (SELECT doc_id, unnest(regexp_split_to_array({_STOPPED_SQL}, '[.?!]+')) AS s FROM documents), tokens AS (SELECT doc_id, regexp_extract_all(lower(s), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM sentences)"
_BIGRAMS_SQL = "bigrams AS (SELECT doc_id, array_to_string(ws[i:i + 1], ' ') AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM tokens))"
_UNIGRAMS_SQL = "unigrams AS (SELECT doc_id, unnest(ws) AS word FROM tokens)"


def _clean_docs(spark: SparkSession, folder: str, *more: Column) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", text.remove_words(text.clean(F.col("text")), STOP_WORDS).alias("text"), *more)


@query(f"""
WITH {_SENTENCES_SQL}, {_BIGRAMS_SQL}, t AS (SELECT word, count(*) AS total FROM bigrams GROUP BY word HAVING NOT regexp_matches(word, '\\p{{N}}'))
SELECT word, total, round(100.0 * total / (SELECT sum(total) FROM t), 8) AS percentage FROM t
""")
def ngram_totals(spark: SparkSession, folder: str) -> DataFrame:
    return count_ngrams(_clean_docs(spark, folder), "text", [2]).select("word", "total", F.round("percentage", 8).alias("percentage"))


@query(f"""
WITH {_SENTENCES_SQL}, {_BIGRAMS_SQL}, {_UNIGRAMS_SQL},
c AS (SELECT doc_id, word, count(*)::DOUBLE AS tf FROM (SELECT * FROM unigrams UNION ALL SELECT * FROM bigrams) GROUP BY ALL),
df AS (SELECT word, count(*)::DOUBLE AS df FROM c GROUP BY word),
w AS (SELECT doc_id, word, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM c JOIN df USING (word)),
n AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id),
t AS (SELECT word, sum(w / norm) AS tfidf_sum FROM w JOIN n USING (doc_id) GROUP BY word)
SELECT word, round(tfidf_sum, 6) AS tfidf_sum FROM t WHERE NOT regexp_matches(word, '[0-9]') AND NOT regexp_matches(word, '^[a-zA-Z]$') ORDER BY round(tfidf_sum, 6) DESC, word LIMIT 250
""")
def tfidf_topk(spark: SparkSession, folder: str) -> DataFrame:
    return tfidf_terms(_clean_docs(spark, folder, F.octet_length("text").alias("size")), "doc_id", "text", [1, 2], 250, "size")


#: The vocabulary of vocabulary_tfidf.
VOCABULARY = ("the", "of", "and", "in", "der", "die", "la", "de", "el", "of the", "in the", "de la")


@query(f"""
WITH {_SENTENCES_SQL}, {_BIGRAMS_SQL}, {_UNIGRAMS_SQL},
c AS (SELECT doc_id, word, count(*)::DOUBLE AS tf FROM (SELECT * FROM unigrams UNION ALL SELECT * FROM bigrams) WHERE list_contains({list(VOCABULARY)}, word) GROUP BY ALL),
df AS (SELECT word, count(*)::DOUBLE AS df FROM c GROUP BY word),
w AS (SELECT doc_id, word, tf, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM c JOIN df USING (word)),
n AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id)
SELECT doc_id, word, tf, round(w / norm, 8) AS weight FROM w JOIN n USING (doc_id)
""")
def vocabulary_tfidf(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and tf-idf of a fixed vocabulary as sparse vectors, shown as rows."""
    docs = materialize(_clean_docs(spark, folder).select("doc_id", text.sentence_ngrams(F.col("text"), [1, 2]).alias("terms")), "terms")
    weighed = vocabulary_model(docs, "terms", VOCABULARY).transform(docs).drop("terms")
    counted = vocabulary_model(docs, "terms", VOCABULARY, idf=False, out="counts").transform(docs).drop("terms")
    both = F.arrays_zip(vector_to_array("counts").alias("tf"), vector_to_array("features").alias("weight"))
    rows = weighed.join(counted, "doc_id").select("doc_id", F.posexplode(both).alias("i", "v")).filter("v.tf > 0")
    word = F.element_at(F.array(*[F.lit(w) for w in VOCABULARY]), F.col("i") + 1)
    return rows.select("doc_id", word.alias("word"), F.col("v.tf").alias("tf"), F.round("v.weight", 8).alias("weight"))


@query(f"""
WITH {PREDS_SQL}, {_SENTENCES_SQL}, {_UNIGRAMS_SQL},
vocabulary AS (SELECT word, count(*) AS total FROM unigrams GROUP BY word HAVING NOT regexp_matches(word, '\\p{{N}}')),
chosen AS (SELECT word FROM vocabulary WHERE total >= (SELECT quantile_cont(total, 0.9) FROM vocabulary)),
p AS (SELECT doc_id, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS mid FROM preds WHERE method = 'prompting'),
whole AS (SELECT count(*)::DOUBLE AS n, sum(score) AS s FROM p),
present AS (SELECT word, count(*)::DOUBLE AS k, sum(score) AS s, sum(mid) AS r FROM (SELECT DISTINCT doc_id, word FROM unigrams JOIN chosen USING (word)) JOIN p USING (doc_id) GROUP BY word)
SELECT word, k::BIGINT AS n_present, round(k / n, 8) AS frequency, least(k, n - k)::BIGINT AS n_metric_samples, round(present.s / k - (whole.s - present.s) / (n - k), 8) AS change_in_metric,
  round((r - k * (n + 1) / 2) / sqrt(k * (n - k) * (n + 1) / 12), 6) AS z
FROM present, whole WHERE k < n
""")
def word_contrast(spark: SparkSession, folder: str) -> DataFrame:
    scores = predictions(spark, folder).filter("method = 'prompting'").select("doc_id", "score")
    return contrast(_clean_docs(spark, folder), scores, "doc_id", "text", "score", 0.9)


@query("""
WITH m AS (SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN 'Sure. {"Reason": "r' || turn || '", "Probability": ' || (turn * 17 % 100) || '} done' WHEN 1 THEN '{''Reason'': ''x'', ''Probability'': 0.' || (turn % 10) || '}'
  WHEN 2 THEN 'no braces' WHEN 3 THEN '{"Prediction": 0.5, "Reason": "tie"}' ELSE NULL END AS raw FROM conversations)
SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN 'r' || turn WHEN 1 THEN 'x' WHEN 3 THEN 'tie' END AS reason,
  CASE conv_id % 5 WHEN 0 THEN CASE WHEN turn * 17 % 100 > 1 THEN round((turn * 17 % 100) / 100.0::DOUBLE, 8) ELSE (turn * 17 % 100)::DOUBLE END WHEN 1 THEN round((turn % 10) / 10.0::DOUBLE, 8) END AS probability,
  CASE WHEN conv_id % 5 = 3 THEN 1 END AS prediction FROM m
""")
def reply_parse(spark: SparkSession, folder: str) -> DataFrame:
    turn, kind = F.col("turn").cast("string"), F.pmod("conv_id", F.lit(5))
    raw = F.when(kind == 0, F.concat(F.lit('Sure. {"Reason": "r'), turn, F.lit('", "Probability": '), F.pmod(F.col("turn") * 17, F.lit(100)).cast("string"), F.lit("} done")))
    raw = raw.when(kind == 1, F.concat(F.lit("{'Reason': 'x', 'Probability': 0."), F.pmod("turn", F.lit(10)).cast("string"), F.lit("}"))).when(kind == 2, "no braces").when(kind == 3, '{"Prediction": 0.5, "Reason": "tie"}')
    rows = table(spark, folder, "conversations").select("conv_id", "turn", text.parse_reply(raw).alias("r"))
    return rows.select("conv_id", "turn", "r.reason", F.round("r.probability", 8).alias("probability"), "r.prediction")


@query("""
SELECT page_id, split_part(url, '/', 3) AS host, regexp_extract(url, '^https?://[^/]*/([a-z]+)', 1) AS lang, coalesce(try_cast(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT), -1) AS number,
  nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '') AS page_param, split_part(split_part(split_part(url, '/', 3), ':', 1), '.', -1) AS domain
FROM pages
""")
def path_param_parse(spark: SparkSession, folder: str) -> DataFrame:
    url = F.col("url")
    host = F.element_at(F.split(url, "/"), 3)
    number = F.coalesce(F.regexp_extract(url, "/([0-9]+)", 1).try_cast("long"), F.lit(-1))
    return table(spark, folder, "pages").select(
        "page_id", host.alias("host"), F.regexp_extract(url, "^https?://[^/]*/([a-z]+)", 1).alias("lang"), number.cast("long").alias("number"),
        F.nullif(F.regexp_extract(url, "[?&]page=([0-9]+)", 1), F.lit("")).alias("page_param"), F.element_at(F.split(F.element_at(F.split(host, ":"), 1), r"\."), -1).alias("domain"))


@query("""
SELECT c_custkey, 'Below is the customer''s data:' || chr(10) || chr(10) || chr(10) || 'Account:' || chr(10) || 'Name: ' || c_name || chr(10) || 'Balance: ' || (round(c_acctbal, 0)::BIGINT) || ' USD' || chr(10)
  || 'Market segment: ' || CASE WHEN c_custkey % 10 = 0 THEN 'not measured' ELSE c_mktsegment END || chr(10) || chr(10) || 'Place:' || chr(10) || 'Nation: ' || n_name AS note
FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
def row_to_text(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    segment = F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment"))
    note = text.sections_as_text("Below is the customer's data:", [
        ("Account", [("NAME", F.col("c_name"), ""), ("balance", F.round("c_acctbal", 0).cast("long"), "USD"), ("market segment", segment, "")]), ("Place", [("nation", F.col("n_name"), "")])])
    return rows.select("c_custkey", note.alias("note"))


@query(f"""
WITH u AS (SELECT doc_id, toxic, ('0x' || substr(md5('42|' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM labels),
s AS (SELECT doc_id, toxic FROM u QUALIFY row_number() OVER (PARTITION BY toxic ORDER BY u, doc_id) <= CASE toxic WHEN 1 THEN 8 ELSE 8 END),
r AS (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) AS rn, least((SELECT count(*) FROM s WHERE toxic = 1), (SELECT count(*) FROM s WHERE toxic = 0)) AS n_both FROM s)
SELECT doc_id, toxic, CASE WHEN rn <= n_both THEN 2 * rn - toxic ELSE n_both + rn END AS position FROM r
""")
def interleave_fewshot(spark: SparkSession, folder: str) -> DataFrame:
    sample = sampling.few_shot(table(spark, folder, "labels").select("doc_id", "toxic"), "toxic", "doc_id", 16)
    return windows.interleave(sample, "toxic", [F.col("doc_id")]).select("doc_id", "toxic", "position")


@query("""
WITH t AS (SELECT source, doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS tokens FROM documents),
r AS (SELECT *, sum(tokens) OVER w AS running, row_number() OVER w AS rn FROM t WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)),
o AS (SELECT *, max((running >= 3000)::INT) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS over_ FROM r)
SELECT source, doc_id, tokens::BIGINT AS tokens, running::BIGINT AS running_cost FROM o WHERE over_ = 0 AND rn <= 16
""")
def token_budget_prefix(spark: SparkSession, folder: str) -> DataFrame:
    tokens = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("long")
    rows = table(spark, folder, "documents").select("source", "doc_id", tokens.alias("tokens"))
    return windows.budget_prefix(rows, ["source"], "doc_id", F.col("tokens"), 3000, 16)


@query("""
WITH u AS (SELECT doc_id, quality, toxic, ('0x' || substr(md5('42|' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM labels),
p AS (SELECT least(30, count(*)) AS n FROM labels WHERE toxic = 1),
k AS (SELECT doc_id FROM u QUALIFY row_number() OVER (PARTITION BY toxic ORDER BY u, doc_id) <= CASE toxic WHEN 1 THEN (SELECT n FROM p) ELSE 60 - (SELECT n FROM p) END)
SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM k) THEN toxic ELSE -1 END AS toxic FROM u
""")
def balanced_mask_sample(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    return relational.mask_outside(labels, sampling.balanced(labels, "toxic", "doc_id", 30), ["doc_id"], ["toxic"])


@query("""
SELECT doc_id, (ntile(7) OVER (ORDER BY doc_id) - 1)::INT AS part FROM documents
""")
def ntile_partition(spark: SparkSession, folder: str) -> DataFrame:
    return windows.contiguous_parts(table(spark, folder, "documents").select("doc_id"), "doc_id", 7)


_GREEDY = """
WITH RECURSIVE w AS ({rows}), s AS (SELECT weight, row_number() OVER (ORDER BY weight DESC) AS i FROM w),
g AS (SELECT 0::BIGINT AS i, list_transform(range({n}), lambda x: 0::BIGINT) AS loads, 0 AS part
  UNION ALL SELECT s.i, list_transform(range(1, {n} + 1), lambda j: loads[j] + CASE WHEN j = list_position(loads, list_min(loads)) THEN s.weight ELSE 0 END), list_position(loads, list_min(loads))
  FROM g JOIN s ON s.i = g.i + 1)
SELECT (part - 1)::INT AS part, sum(weight)::BIGINT AS load, count(*) AS n FROM g JOIN s USING (i) GROUP BY part
"""


def _loads(rows: DataFrame, n: int) -> DataFrame:
    return windows.balanced_parts(rows, "doc_id", "weight", n).groupBy("part").agg(F.sum("weight").cast("long").alias("load"), F.count(F.lit(1)).alias("n"))


@query(_GREEDY.format(rows="SELECT (quality <> -1)::BIGINT + (toxic = 1)::BIGINT AS weight FROM labels", n=8))
def balanced_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents dealt to 8 parts whose numbers of observed targets come close; the parts' loads."""
    return _loads(table(spark, folder, "labels").select("doc_id", ((F.col("quality") != -1).cast("int") + (F.col("toxic") == 1).cast("int")).alias("weight")), 8)


@query(_GREEDY.format(rows="SELECT coalesce(n_chars, 0) AS weight FROM documents", n=12))
def greedy_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Documents dealt longest first to 12 workers; the workers' loads in characters."""
    return _loads(table(spark, folder, "documents").select("doc_id", F.col("n_chars").alias("weight")), 12)


@query("""
WITH u AS (SELECT doc_id, ('0x' || substr(md5('42|' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM documents)
SELECT doc_id, CASE WHEN u < 0.65 THEN 'train' WHEN u < 0.85 THEN 'test' ELSE 'eval' END AS part FROM u
""")
def random_split(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", sampling.random_split(F.col("doc_id"), [("train", 0.65), ("test", 0.2), ("eval", 0.15)]).alias("part"))


@query("""
SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN 'test' WHEN ('0x' || substr(md5('42|' || user_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.15 THEN 'eval' ELSE 'train' END AS part FROM events
""")
def temporal_split(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", sampling.temporal_split(F.col("ts"), F.col("user_id"), "2024-01-20").alias("part"))


@query()
def word_p_values(spark: SparkSession, folder: str) -> DataFrame:
    """word_contrast with rank-sum p-values, adjusted over all words (Benjamini-Yekutieli)."""
    rows = materialize(word_contrast(spark, folder).withColumn("p_value", htest.two_sided_normal("z")), "word-p-values")
    return htest.benjamini_yekutieli(rows, [], "p_value", "p_adjusted")


_NOTES_SQL = """
n AS (SELECT user_id, ts::DATE AS day, event_id, event_type AS kind, 'd' || (event_id % 4) AS author, 'value ' || event_id AS text FROM events),
d AS (SELECT user_id, day, string_agg(kind || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY event_id) AS note, list(kind ORDER BY event_id) AS kinds, list(author ORDER BY event_id) AS authors FROM n GROUP BY ALL)"""


def _event_notes(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("event_id").cast("string")
    return table(spark, folder, "events").select("user_id", F.to_date("ts").alias("day"), "event_id", F.col("event_type").alias("kind"), F.concat(F.lit("d"), F.pmod("event_id", F.lit(4)).cast("string")).alias("author"), F.concat(F.lit("value "), number).alias("text"))


@query(f"""
WITH {_NOTES_SQL},
f AS (SELECT user_id, arg_min(note, day) AS first_note, arg_min(authors, day) AS first_authors FROM d WHERE NOT list_contains(kinds, 'error') GROUP BY user_id),
j AS (SELECT d.*, first_note, CASE WHEN note = first_note THEN authors ELSE list_concat(first_authors, authors) END AS all_authors FROM d JOIN f USING (user_id))
SELECT user_id, day, md5(CASE WHEN note = first_note THEN note ELSE first_note || chr(10) || chr(10) || note END) AS note, len(list_distinct(all_authors))::INT AS n_authors FROM j
""")
def note_history_append_first(spark: SparkSession, folder: str) -> DataFrame:
    """Notes of a user's days after the first note that holds no error, by the name of a configuration."""
    out = notes.note_history(_event_notes(spark, folder), "run-7-mostRecentVisit-appendFirst-medOnc-ConsultLetterClinic", "user_id", "day", "event_id", "kind", "author", "text", leave_out=["error"])
    return out.select("user_id", "day", F.md5(F.col("note").cast("binary")).alias("note"), F.size("authors").alias("n_authors"))


@query(f"""
WITH {_NOTES_SQL} SELECT user_id, min(day) AS day, md5(arg_min(note, day)) AS note FROM d GROUP BY user_id
""")
def note_history_first_visit(spark: SparkSession, folder: str) -> DataFrame:
    out = notes.note_history(_event_notes(spark, folder), "firstVisitOnly-medOnc-ConsultLetterClinic", "user_id", "day", "event_id", "kind", "author", "text")
    return out.select("user_id", "day", F.md5(F.col("note").cast("binary")).alias("note"))


def _summarising_stub(prompts: list[str]) -> list[str]:
    """A stand-in for a text model: the length of the prompt as its summary, with more text and braces behind it."""
    return ["no summary" if len(p) % 7 == 0 else f'Sure: {{"Summary": "{len(p)} characters"}} and {{more}}' for p in prompts]


@query("""
WITH p AS (SELECT conv_id, turn, length('Summarise the note.' || chr(10) || chr(10) || text) AS n FROM conversations WHERE turn % 3 <> 0)
SELECT conv_id, turn, CASE WHEN n % 7 <> 0 THEN n || ' characters' END AS summary, CASE WHEN n % 7 = 0 THEN 'no summary' ELSE 'Sure: {"Summary": "' || n || ' characters"} and {more}' END AS raw FROM p
""")
def note_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries of the messages that have none yet; every third turn is done."""
    messages = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    return prompting.summarise(messages, ["conv_id", "turn"], "text", messages.filter("turn % 3 = 0"), lambda: _summarising_stub, "Summarise the note.")


#: Words of normalised_words that stand for others.
SYNONYMS = {"chemo": "chemotherapy", "the": "this", "les": "le"}


@query(f"""
WITH w AS (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS w FROM documents),
n AS (SELECT doc_id, CASE {' '.join(f"WHEN w = '{a}' THEN '{b}'" for a, b in SYNONYMS.items())} ELSE w END AS w FROM w),
s AS (SELECT doc_id, CASE WHEN length(w) > 3 AND w LIKE '%s' THEN substr(w, 1, length(w) - 1) ELSE w END AS w FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(w, '\\s+'), lambda x: x <> '')) AS w FROM n)),
v AS (SELECT doc_id, CASE WHEN length(w) > 4 AND w LIKE '%ed' THEN substr(w, 1, length(w) - 2) ELSE w END AS w FROM s)
SELECT w AS word, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM v GROUP BY w HAVING count(*) >= 20
""")
def normalised_words(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of frequent words after synonyms and lemmas; a stand-in for a dictionary cuts endings of nouns, then of verbs."""

    def cut(word: str, part: str) -> str:
        if part == "n":
            return word[:-1] if len(word) > 3 and word.endswith("s") else word
        return word[:-2] if len(word) > 4 and word.endswith("ed") else word

    docs = table(spark, folder, "documents").select("doc_id", "text")
    words = text.lemmatise(text.replace_words(F.lower("text"), SYNONYMS), cut)
    # A document's words are added up by word before they are shuffled; texts of one document have blanks between them.
    rows = docs.groupBy("doc_id").agg(F.array_join(F.collect_list("text"), " ").alias("text")).select("doc_id", words.alias("words"))
    rows = rows.select("doc_id", F.sort_array(F.filter(F.split("words", " "), lambda w: w != "")).alias("words")).select("doc_id", F.explode(marked("words")).alias("w")).select("doc_id", "w.word", "w.first")
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("first") & F.col("doc_id").isNotNull()).alias("n_docs")).filter("n >= 20")


@query("""
WITH u AS (SELECT doc_id, ('0x' || substr(md5('42|' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM documents)
SELECT doc_id, CASE WHEN u < 0.65 THEN 'train' WHEN u < 0.85 THEN 'test' ELSE 'train' END AS part FROM u
""")
def merged_split(spark: SparkSession, folder: str) -> DataFrame:
    """A split whose eval part joins the training rows, as for a model without early stopping."""
    part = sampling.random_split(F.col("doc_id"), [("train", 0.65), ("test", 0.2), ("eval", 0.15)])
    return table(spark, folder, "documents").select("doc_id", sampling.merge_parts(part, "train", "eval").alias("part"))


@query("""
SELECT c_name, c_acctbal, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_name = (SELECT n_name FROM nation WHERE n_nationkey = 7) ORDER BY c_acctbal DESC, c_custkey LIMIT 1
""")
def point_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The best row of one value of a key: a nation found by number, then its customer with the highest balance."""
    nation = relational.look_up(table(spark, folder, "nation"), "n_nationkey", 7, ["n_nationkey", "n_name"], [F.col("n_nationkey")]).first()
    rows = relational.look_up(table(spark, folder, "customer"), "c_nationkey", nation["n_nationkey"] if nation else None, ["c_name", "c_acctbal"], [F.desc("c_acctbal"), F.asc("c_custkey")])
    return rows.withColumn("n_name", F.lit(nation["n_name"] if nation else None).cast("string"))


@query("""
WITH w AS (SELECT lang, avg(n_chars) AS mean, max(n_chars) AS max, min(n_chars) AS min, count(*) AS autogluon_n, sum(n_chars)::BIGINT AS total FROM documents GROUP BY lang)
SELECT lang, '2 total' AS c1, '3 max' AS c2, '4 min' AS c3, '5 mean' AS c4, '6 autogluon_n' AS c5, total, max, min, round(mean, 8) AS mean, autogluon_n FROM w
""")
def ordered_columns(spark: SparkSession, folder: str) -> DataFrame:
    """A report's columns in their order of priority, with the place that each has got."""
    n = F.col("n_chars")
    wide = table(spark, folder, "documents").groupBy("lang").agg(F.round(F.avg(n), 8).alias("mean"), F.count(F.lit(1)).alias("autogluon_n"), F.max(n).alias("max"), F.sum(n).alias("total"), F.min(n).alias("min"))
    names = relational.columns_by_priority(wide.columns, ["max", "min", "mean"], "autogluon")
    shown = wide.select(*names)
    return shown.select("*", *[F.lit(f"{i + 1} {c}").alias(f"c{i}") for i, c in enumerate(shown.columns) if i])


@query("""
WITH d AS (SELECT o_custkey, string_agg(lower(o_orderpriority) || ' (' || o_orderkey || 'mg)', ', ' ORDER BY o_orderkey) AS drugs FROM orders WHERE o_orderkey % 3 = 0 GROUP BY o_custkey)
SELECT c_custkey, 'Below is the data on the treatment date:' || chr(10) || chr(10)
  || 'Demographic:' || chr(10) || 'Sex assigned at birth: ' || CASE c_custkey % 3 WHEN 1 THEN 'female' WHEN 0 THEN 'male' ELSE 'not available' END || chr(10)
  || 'Age: ' || (20 + c_nationkey) || ' years' || chr(10) || 'Weight: ' || CASE WHEN c_custkey % 7 = 0 THEN 'not measured' ELSE (50 + c_custkey % 40) || ' kg' END || chr(10) || chr(10)
  || 'Acute care use:' || chr(10) || 'Number of prior emergency department visits: ' || (c_custkey % 4) || chr(10) || chr(10)
  || 'Cancer:' || chr(10) || concat_ws(chr(10), CASE WHEN c_mktsegment = 'BUILDING' THEN 'Cancer site: breast' END, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'Morphology: ductal' END) || chr(10) || chr(10)
  || 'Laboratory:' || chr(10) || 'Albumin: ' || CASE WHEN c_custkey % 5 = 0 THEN 'not measured' ELSE (c_custkey % 50) || ' g/l' END || chr(10) || chr(10)
  || 'Symptoms:' || chr(10) || 'Pain: not available' || chr(10) || chr(10)
  || 'Treatment:' || chr(10) || 'Drug and dose: ' || coalesce(drugs, 'not available') || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE chr(10) || 'Ideal dose given: ' || (c_custkey % 5 * 25) || '.0 %' END || chr(10) || chr(10) AS note
FROM customer LEFT JOIN d ON o_custkey = c_custkey
""")
def sectioned_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as documents of six sections, with their orders as drugs."""
    orders = table(spark, folder, "orders").filter("o_orderkey % 3 = 0").select("o_custkey", "o_orderkey", F.concat(F.lower("o_orderpriority"), F.lit(" ("), F.col("o_orderkey").cast("string"), F.lit("mg)")).alias("drug"))
    drugs = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(relational.text_by_key(orders, ["o_custkey"], "o_orderkey", "drug", ", ").alias("drugs"))
    rows = table(spark, folder, "customer").join(drugs, "c_custkey", "left")
    k, segment = F.col("c_custkey"), F.col("c_mktsegment")
    note = documents.row_document("Below is the data on the treatment date:", [
        ("Demographic", [Item("sex assigned at birth", k % 3, recode={1: "female", 0: "male"}), Item("age", 20 + F.col("c_nationkey"), "years"), Item("weight", F.when(k % 7 != 0, 50 + k % 40), "kg")]),
        ("Acute care use", [Item("number of prior ED visits", k % 4)]),
        ("Cancer", [Flags("cancer site", [("breast", segment == "BUILDING")]), Flags("morphology", [("ductal", segment == "BUILDING"), ("ductal", segment == "MACHINERY")])]),
        ("Laboratory", [Item("albumin", F.when(k % 5 != 0, k % 50), "g/L")]), ("Symptoms", [Item("pain", None)]), ("Unused", []),
        ("Treatment", [Item("drug and dose", F.col("drugs"), missing="not available"), Item("ideal dose given", (k % 5) / 4, "%", digits=4, percent=True)]),
    ], wording={" ed ": " emergency department "})
    return rows.select("c_custkey", note.alias("note"))
