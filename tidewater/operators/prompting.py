"""The dataflow around a text model: prompt grids, assembly, fitting a context, calls with retries, regrouping samples.

The model is any function from a list of prompts to a list of replies; it runs in mapInPandas tasks over batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.text import summary_of

Generate = Callable[[list[str]], list[str]]


def grid(spark: SparkSession, dims: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """All combinations of the dimensions' texts, numbered with the last dimension fastest, and joined to one text.

    The dimensions are written down in a program, not data: their product is built as a sequence of numbers.
    """
    total = 1
    for _, values in dims:
        total *= len(values)
    rows, step = spark.range(total).withColumnRenamed("id", "prompt_id"), total
    for name, values in dims:
        step //= len(values)
        rows = rows.withColumn(name, F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(F.col("prompt_id") / step) % len(values) + 1).cast("int")))
    return rows.withColumn("prompt", F.concat(*[n for n, _ in dims]))


def assemble(prompt: Column, date: Column | None = None, examples: Column | None = None, hint: Column | None = None) -> Column:
    """The prompt with the date put in, then examples and hints where there are any."""
    text = prompt if date is None else F.replace(prompt, F.lit("<DATE>"), F.date_format(date, "MMM dd, yyyy"))
    more = [F.concat(F.lit("\n\n"), x) for x in (examples, hint) if x is not None]
    return F.concat(text, *[F.coalesce(m, F.lit("")) for m in more])


def fit_context(system: Column, examples: Column, note: Column, budget: int, flag: str = "\n[NOTE TRUNCATED]") -> Column:
    """Struct (system, note, n_examples, truncated): examples go from the end until all fits; then the note is cut.

    Tokens are words parted by white space; a note that is cut keeps its words, with single blanks between them.
    """
    words_of = lambda t: F.filter(F.split(t, r"\s+"), lambda w: w != "")
    count = lambda t: F.size(words_of(t))
    base = count(system) + count(note)
    sizes = F.transform(examples, count)
    running = F.transform(F.sequence(F.lit(0), F.size(examples)), lambda n: F.aggregate(F.slice(sizes, 1, n), F.lit(0), lambda s, x: s + x))
    kept = F.greatest(F.size(F.filter(running, lambda r: base + r <= budget)) - 1, F.lit(0))
    words, room = words_of(note), F.lit(budget) - count(system) - len(flag.split())
    cut = base > budget
    shown = F.when(~cut, note).when(room <= 0, F.lit(flag)).otherwise(F.concat(F.array_join(F.slice(words, 1, F.greatest(room, F.lit(1))), " "), F.lit(flag)))
    return F.struct(F.concat(system, F.array_join(F.slice(examples, 1, kept), "")).alias("system"), shown.alias("note"), kept.alias("n_examples"), cut.alias("truncated"))


def replicate(df: DataFrame, n: int) -> DataFrame:
    """Each row n times, numbered from 0, so that replies can be put back together by key."""
    return df.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def call_model(df: DataFrame, prompt: str, generate: Generate, retries: int = 10, ok: Callable[[str], bool] = bool, batch: int = 64) -> DataFrame:
    """The rows with `reply` and `attempts`; replies that aren't ok are asked for again, up to `retries` times, then null."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), batch):
                part = frame.iloc[lo : lo + batch].reset_index(drop=True)
                replies, tries = [None] * len(part), [0] * len(part)
                left = list(range(len(part)))
                for attempt in range(1, retries + 1):
                    if not left:
                        break
                    for i, text in zip(left, generate([part[prompt][i] for i in left]), strict=True):
                        tries[i] = attempt
                        replies[i] = text if ok(text) else None
                    left = [i for i in left if replies[i] is None]
                yield part.assign(reply=replies, attempts=tries)

    return df.mapInPandas(run, f"{fields}, reply string, attempts int")


def call_in_batches(df: DataFrame, prompt: str, open_client: Callable[[], Generate], most_padded: int = 65536, retries: int = 3, ok: Callable[[str], bool] = bool) -> DataFrame:
    """The rows with `reply`, `attempts`, `error`, and their `batch` and its length (`padded`): calls to a client that pads a batch to its longest text.

    Each task opens one client, which is any function from prompts to replies, and closes it at the end if it can be
    closed. Rows are sorted by length within their partitions, and a batch is closed before its rows times its longest
    text pass `most_padded` characters; a longer text is a batch of its own. A call that fails, and replies that aren't
    ok, are tried again up to `retries` times in all; what is left has a null reply and the last error. A null prompt isn't
    asked.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def asked(client: Generate, part: list[dict], number: int) -> pd.DataFrame:
        replies, tries, errors = [None] * len(part), [0] * len(part), [None] * len(part)
        left = [i for i, row in enumerate(part) if row[prompt] is not None]
        for attempt in range(1, retries + 1):
            if not left:
                break
            try:
                found, error = client([part[i][prompt] for i in left]), None
            except Exception as e:  # whatever a client may raise: the batch is asked for again
                found, error = [None] * len(left), str(e)
            for i, text in zip(left, found, strict=True):
                tries[i], errors[i] = attempt, error or ("not ok" if text is None or not ok(text) else None)
                replies[i] = text if errors[i] is None else None
            left = [i for i in left if errors[i] is not None]
        longest = max((len(row[prompt] or "") for row in part), default=0)
        return pd.DataFrame(part).assign(reply=replies, attempts=tries, error=errors, batch=number, padded=longest)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, part, number = None, [], TaskContext.get().partitionId() << 32
        try:
            for frame in frames:
                for row in frame.to_dict("records"):
                    if part and (len(part) + 1) * len(row[prompt] or "") > most_padded:
                        yield asked(client, part, number)
                        part, number = [], number + 1
                    client = client or open_client()
                    part.append(row)
            if part:
                yield asked(client, part, number)
        finally:
            if hasattr(client, "close"):
                client.close()

    by_length = df.sortWithinPartitions(F.char_length(prompt).asc_nulls_first())
    return by_length.mapInPandas(run, f"{fields}, reply string, attempts int, error string, batch long, padded long")


def once_per_text(df: DataFrame, text: str, apply: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a costly step on distinct texts only, null being one of them, and join its result back by `__text_key`; the step needn't return the text."""
    keyed = df.withColumn("__text_key", F.coalesce(F.sha2(F.col(text).cast("binary"), 256), F.lit("")))
    distinct = keyed.groupBy("__text_key").agg(F.first(text).alias(text))
    return keyed.join(apply(distinct).drop(text), "__text_key").drop("__text_key")


def summarise(notes: DataFrame, keys: Sequence[str], note: str, done: DataFrame | None, open_client: Callable[[], Generate], instructions: str, **options) -> DataFrame:
    """Summaries of the notes that `done` (the keys of earlier results) doesn't hold: keys, summary and raw reply.

    The reply is asked for in batches of like length; one that holds no summary keeps its raw text and a null summary, so
    that it can be looked at and, by leaving it out of `done`, asked for again.
    """
    open_ = notes if done is None else notes.join(done.select(*keys), list(keys), "left_anti")
    asked = open_.select(*keys, F.concat(F.lit(instructions), F.lit("\n\n"), F.col(note)).alias("__prompt"))
    replies = call_in_batches(asked, "__prompt", open_client, **options)
    return replies.select(*keys, summary_of(F.col("reply")).alias("summary"), F.col("reply").alias("raw"))
