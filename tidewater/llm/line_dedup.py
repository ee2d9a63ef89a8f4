"""Dropping lines that many documents share, by levelled sorted runs of line hashes.

A line's key is the line without [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased. Documents come in batches. A batch's keys,
with the number of its documents that hold each, are a run that is sorted by hash. Each new batch is anti-joined with the
keys already found common, and then with the runs: keys that no run holds are new, those of the runs are counted up with
what the runs know, and the keys that so reach `min_docs` documents move to the common keys. The rest, new or not, is
added as a run of its own. Once `fan_out` runs stand on the same level they are compacted to one run of the next level,
which also leaves out what has become common since. In the end every line whose key is common goes, in every document.

Runs and common keys are stored tables that are bucketed and sorted by the hash alike, so that all these joins and merges
read them as they lie, without a shuffle. `LineRuns.add()` takes any later batch of counted keys.

DataFrame functions only. Keys are compared by 64 + 32 hash bits. Batches are taken by a hash of the document's id; each is
counted and added by itself, and only the runs know of the batches before. Runs can be saved by name and taken up again
(`LineRuns.saved`, `LineRuns.restored`) for documents that come later. A lost executor repeats single tasks.

Defined cases: a null or empty text is one empty line. An empty key is common only if min_key_chars is 0. Rows are told
apart by id and text, so that rows with the same or a null id don't mix. Repeated rows count as documents each. An input
column named n_lines or n_dropped is replaced by the operator's; keep_own_lines() leaves all columns as they are.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.skew import join_hot
from tidewater.sources.work import materialize, materialize_bucketed

MIN_DOCS, MIN_KEY_CHARS = 10, 1
BATCHES, FAN_OUT = 4, 2
_SPACES = "\t\n\x0b\x0c\r "
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else. lower() does the same, and faster, where no other letter has a lower case."""
    return F.when(text.rlike("[\\p{IsUppercase}\\p{Lt}&&[^A-Z]]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def line_keys(text: Column) -> Column:
    """The keys of a text's lines, in order."""
    return F.transform(F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n"), lambda x: F.btrim(x, F.lit(_SPACES)))


def key_hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h"), F.hash(F.lit(11), key).alias("g"))


class LineRuns:
    """Levels of sorted runs (h, g, n_docs) and the keys found common so far, (h, g); no key is common twice."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fan_out: int = FAN_OUT):
        self.spark, self.min_docs, self.fan_out = spark, min_docs, fan_out
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = [[]]
        self.common: list[DataFrame] = []  # (h, g, n_docs), n_docs as far as known when the key became common
        self.later: list[DataFrame] = []  # the same of later batches

    def stored(self, rows: DataFrame) -> DataFrame:
        """The rows as a table that is bucketed and sorted by (h, g)."""
        return materialize_bucketed(rows, "line_run", ["h", "g"], self.buckets)

    def saved(self, name: str) -> None:
        """Keep the runs and common keys as tables of the session's catalogue: `name`_runs_<level>_<place> and `name`_common."""
        kept = {f"{name}_common": self.common_counts(), **{f"{name}_runs_{i}_{j}": run for i, level in enumerate(self.levels) for j, run in enumerate(level)}}
        for table, rows in kept.items():
            rows.write.mode("overwrite").bucketBy(self.buckets, "h", "g").sortBy("h", "g").saveAsTable(table)

    @classmethod
    def restored(cls, spark: SparkSession, name: str, min_docs: int = MIN_DOCS, fan_out: int = FAN_OUT) -> LineRuns:
        """The runs that saved() has kept under the name."""
        runs = cls(spark, min_docs, fan_out)
        runs.common = [spark.table(f"{name}_common")]
        for table in sorted(t.name for t in spark.catalog.listTables() if t.name.startswith(f"{name.lower()}_runs_")):
            level = int(table.split("_")[-2])
            runs.levels += [[] for _ in range(level + 1 - len(runs.levels))]
            runs.levels[level].append(spark.table(table))
        return runs

    def _undecided(self, run: DataFrame) -> DataFrame:
        for known in self.common:
            run = run.hint("merge").join(known.select("h", "g"), ["h", "g"], "left_anti")
        return run

    def add(self, batch: DataFrame) -> None:
        """Add a batch of (h, g, n_docs), bucketed and sorted as stored() does; a key is in it once."""
        runs = [run for level in self.levels for run in level]
        mine = self._undecided(batch)
        if self.common:
            again = [batch.hint("merge").join(known.select("h", "g"), ["h", "g"], "left_semi") for known in self.common]
            self.later.append(self.stored(reduce(DataFrame.unionByName, again)))
        if runs:
            before = runs[0]
            for run in runs[1:]:
                before = before.unionByName(run)
            fresh = mine
            for run in runs:
                fresh = fresh.hint("merge").join(run.select("h", "g"), ["h", "g"], "left_anti")
            again = mine
            for i, run in enumerate(runs):
                again = again.hint("merge").join(run.withColumnRenamed("n_docs", f"n_{i}"), ["h", "g"], "left")
            known = reduce(add, [F.coalesce(f"n_{i}", F.lit(0)) for i in range(len(runs))])
            again = again.withColumn("known", known).filter("known > 0").select("h", "g", "n_docs", (F.col("n_docs") + F.col("known")).alias("total"))
            rows = fresh.withColumn("total", F.col("n_docs")).unionByName(again)
        else:
            rows = mine.withColumn("total", F.col("n_docs"))
        run = self.stored(rows)
        self._settle(run)
        self.levels[0].append(run.filter(F.col("total") < self.min_docs).select("h", "g", "n_docs"))
        level = 0
        while len(self.levels[level]) >= self.fan_out:
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._compacted(self.levels[level]))
            self.levels[level] = []
            level += 1

    def _settle(self, run: DataFrame) -> None:
        self.common.append(run.filter(F.col("total") >= self.min_docs).select("h", "g", F.col("total").alias("n_docs")))
        if len(self.common) > self.fan_out:
            self.common, self.later = [self.stored(self.common_counts())], []

    def _compacted(self, runs: list[DataFrame]) -> DataFrame:
        merged, names = runs[0].withColumnRenamed("n_docs", "n_0"), [f"n_{i}" for i in range(len(runs))]
        for name, run in zip(names[1:], runs[1:], strict=True):
            merged = merged.hint("merge").join(run.withColumnRenamed("n_docs", name), ["h", "g"], "full")
        total = reduce(add, [F.coalesce(n, F.lit(0)) for n in names])
        return self.stored(self._undecided(merged.select("h", "g", total.alias("n_docs"))))

    def common_keys(self) -> DataFrame:
        """All keys found in min_docs documents or more, as (h, g)."""
        return self.common_counts().select("h", "g")

    def common_counts(self) -> DataFrame:
        """All keys found in min_docs documents or more, with the number of documents: (h, g, n_docs)."""
        if not self.common:
            return self.spark.createDataFrame([], "h long, g int, n_docs long")
        return reduce(DataFrame.unionByName, [*self.common, *self.later]).groupBy("h", "g").agg(F.sum("n_docs").alias("n_docs"))


def drop_common_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_key_chars: int = MIN_KEY_CHARS,
                      batches: int = BATCHES, fan_out: int = FAN_OUT) -> DataFrame:
    """The rows and columns of `docs` with the kept lines as text, and n_lines and n_dropped beside."""
    columns = docs.columns
    inner = docs.toDF(*[f"__c{i}" for i in range(len(columns))])
    at = {c: F.col(f"__c{i}") for i, c in enumerate(columns)}
    row_key = F.xxhash64(at[doc_id], at[text])
    long_enough = lambda k: F.char_length(k) >= min_key_chars
    keys = F.array_distinct(F.filter(line_keys(at[text]), long_enough))
    exploded = inner.select(at[doc_id].alias("of"), F.explode(keys).alias("key")).select("of", key_hash(F.col("key")).alias("k")).select("of", "k.h", "k.g")
    runs = LineRuns(docs.sparkSession, min_docs, fan_out)
    for b in range(batches):
        batch = exploded.filter(F.pmod(F.hash("of"), F.lit(batches)) == b)
        runs.add(runs.stored(batch.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n_docs"))))
    # How often each common line occurs tells the hot ones.
    common = materialize(runs.common_counts().withColumnRenamed("n_docs", "rows"), "common_lines")
    marked = F.transform(line_keys(at[text]), lambda k, i: F.struct(i.alias("i"), long_enough(k).alias("long"), key_hash(k).alias("k")))
    lines = inner.select(row_key.alias("row_key"), F.explode(F.filter(marked, lambda x: x["long"])).alias("x")).select("row_key", "x.i", "x.k.h", "x.k.g")
    hits = join_hot(lines, common.select("h", "g"), ["h", "g"], "row_key", counts=common).groupBy("row_key").agg(F.collect_set("i").alias("__gone"))
    hits = materialize(hits, "line_hits").withColumnRenamed("row_key", "__row_key")
    # The hits grow with the documents: they are merged, and never broadcast, at any size.
    joined = inner.withColumn("__row_key", row_key).join(hits.hint("merge"), "__row_key", "left")
    every = F.split(F.coalesce(at[text], F.lit("")), "\n")
    joined = joined.withColumn("__lines", every).withColumn("__stay", F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone"))
    kept = F.array_join(F.transform("__stay", lambda i: F.get(F.col("__lines"), i)), "\n")
    out = [F.when(F.col("__gone").isNull(), F.coalesce(at[text], F.lit(""))).otherwise(kept).alias(c) if c == text else at[c].alias(c) for c in columns if c not in ("n_lines", "n_dropped")]
    return joined.select(*out, F.size("__lines").cast("long").alias("n_lines"), F.coalesce(F.size("__lines") - F.size("__stay"), F.lit(0)).cast("long").alias("n_dropped"))


def keep_own_lines(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` without common lines, with the same columns."""
    back = {c: f"__kept_{c}" for c in docs.columns if c in ("n_lines", "n_dropped")}
    out = drop_common_lines(docs.withColumnsRenamed(back), **options).drop("n_lines", "n_dropped")
    return out.withColumnsRenamed({v: k for k, v in back.items()}).select(*docs.columns)
