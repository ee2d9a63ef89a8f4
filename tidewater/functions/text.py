"""Text functions: cleaning, n-grams, replies of models, key-value text."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean(text: Column) -> Column:
    """Lower case, without characters other than letters, digits, _, white space and full stops."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s.]+", "")


def remove_words(text: Column, words: Sequence[str], phrases: Sequence[str] = ()) -> Column:
    """Without the words, then without the phrases (at word bounds, any case); white space is squeezed."""
    kept = F.array_join(F.filter(F.split(text, r"\s+"), lambda w: ~w.isin(*words)), " ")
    if phrases:
        kept = F.regexp_replace(F.regexp_replace(kept, r"(?iU)\b(?:" + "|".join(f"\\Q{p}\\E" for p in phrases) + r")\b", ""), r"\s+", " ")
    return F.trim(kept)


def replace_words(text: Column, table: Mapping[str, str]) -> Column:
    """Whole words by others."""
    pairs = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.coalesce(pairs[w], w)), " ")


def lemmatise(text: Column, lemma: Callable[[str, str], str] | None = None, tag: Callable[[list[str]], list[str]] | None = None) -> Column:
    """Words, parted by white space, by their lemmas.

    `lemma` maps a word and a part of speech ("n", "v", "a" or "r") to its lemma. With `tag`, which gives a part of speech for
    each word of a text, words are looked up as what they are tagged (other tags count as "n"); without it as nouns and
    then as verbs. Without `lemma`, where no dictionary is installed, the text stays as it is, with single blanks. Each
    word of a batch (and each tagged word) is looked up once. Null gives null.
    """
    if lemma is None:
        return F.trim(F.regexp_replace(text, r"\s+", " "))

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], str] = {}

        def look_up(word: str, part: str) -> str:
            if (word, part) not in known:
                known[word, part] = lemma(word, part) if part in ("n", "v", "a", "r") else lemma(word, "n")
            return known[word, part]

        def one(value: str | None) -> str | None:
            if value is None:
                return None
            words = value.split()
            if tag is not None:
                return " ".join(look_up(w, p) for w, p in zip(words, tag(words), strict=True))
            return " ".join(look_up(look_up(w, "n"), "v") for w in words)

        return texts.map(one, na_action="ignore")

    return run(text)


def sentence_ngrams(text: Column, lengths: Sequence[int]) -> Column:
    """Word n-grams of the given lengths that don't cross the end of a sentence (. ? !)."""

    # Words are found in a step of their own: within one step a lambda would find them again for every n-gram.
    words_of = F.transform(F.split(text, r"[.?!]+"), lambda s: F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))

    def grams(words: Column, n: int) -> Column:
        if n == 1:
            return words
        # Without a slice for each n-gram, which copies the sentence's words each time.
        last = F.greatest(F.size(words) - n + 1, F.lit(0))
        return F.slice(F.transform(words, lambda w, i: F.concat_ws(" ", w, *[F.get(words, i + j) for j in range(1, n)])), F.lit(1), last)

    return F.flatten(F.transform(words_of, lambda words: F.concat(*[grams(words, n) for n in lengths])))


def sentence_words(text: Column) -> Column:
    """The words of sentence_ngrams parted by blanks, and sentences by \\x01: these two alone stand between words."""
    sentences = F.regexp_replace(F.regexp_replace(text, "\x01", " "), r"[.?!]+", "\x01")
    return F.regexp_replace(F.lower(sentences), "[^\\p{L}\\p{N}_\x01]+", " ")


def capitalise(text: Column) -> Column:
    """First letter upper, the rest lower."""
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substr(text, F.lit(2))))


_REPLY = T.StructType([T.StructField("Reason", T.StringType()), T.StructField("Probability", T.DoubleType()), T.StructField("Prediction", T.DoubleType())])


def json_span(raw: Column, greedy: bool = True) -> Column:
    """From the first { to the last } (or to the first } after it); null where there is none."""
    return F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}" if greedy else r"(?s)\{.*?\}", 0), F.lit(""))


def parse_reply(raw: Column, greedy: bool = True) -> Column:
    """Struct (reason, probability, prediction) from a model's reply.

    Where the span is no JSON, quotes within texts (not beside {, [, a comma, a colon, ] or }) are escaped, or else single
    quotes at the ends of texts taken as double ones. A probability over 1 is a percentage; a prediction is drawn to the
    nearer of 0 and 1, and to 1 from the middle.
    """
    span = F.regexp_replace(json_span(raw, greedy), "\n", " ")
    escaped = lambda s: F.regexp_replace(s, r'(?<![{\[,:]\s{0,3})(?<!\\)"(?!\s*[,:}\]])', r'\\"')
    double = F.regexp_replace(span, r"(?<=[{\[,:]\s{0,3})'|'(?=\s*[,:}\]])", '"')
    as_json = F.coalesce(*[F.when(F.try_parse_json(s).isNotNull(), F.from_json(s, _REPLY)) for s in (span, escaped(span), double, escaped(double))])
    p, hat = as_json["Probability"], as_json["Prediction"]
    return F.struct(as_json["Reason"].alias("reason"), F.when(p > 1, p / 100).otherwise(p).alias("probability"), F.when(hat.isNotNull(), F.when(F.abs(hat) < F.abs(hat - 1), 0).otherwise(1)).alias("prediction"))


def summary_of(raw: Column) -> Column:
    """The text under "Summary" in a reply, from its first { to the first } after it; null where that is no such object."""
    span = json_span(raw, greedy=False)
    return F.when(F.try_parse_json(span).isNotNull(), F.from_json(span, "Summary string")["Summary"])


def number_in_text(raw: Column, name: str = "Probability") -> Column:
    """The first number after a quoted name, for replies that can't be parsed."""
    return F.regexp_extract(raw, rf"['\"]{name}['\"]\s*:\s*([0-9]*\.?[0-9]+)", 1).try_cast("double")


def key_values(text: Column) -> Column:
    """A map from "a=1,b=2"."""
    return F.str_to_map(text, F.lit(","), F.lit("="))


def shorten(text: Column, most: int = 18) -> Column:
    """At most `most` characters, the rest given by dots."""
    return F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def count_percent(n: Column, whole: Column) -> Column:
    return F.format_string("%d (%.1f)", n.cast("long"), F.coalesce(100.0 * n / F.nullif(whole, F.lit(0)), F.lit(0.0)))


def parse_interval(text: Column) -> tuple[Column, Column]:
    """The bounds of "[lo,hi]"."""
    parts = F.split(F.translate(text, "[] ", ""), ",")
    return F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")


def sections_as_text(title: str, sections: Sequence[tuple[str, Sequence[tuple[str, Column, str]]]], missing: str = "not measured") -> Column:
    """Sectioned "Name: value unit" text of a row, from (section, [(name, value, unit)]).

    A missing value is given by `missing`, without its unit.
    """
    parts: list[Column] = [F.lit(title + "\n")]
    for name, items in sections:
        parts.append(F.lit(f"\n{name}:"))
        for label, value, unit in items:
            shown = F.coalesce(F.concat(value.cast("string"), F.lit(f" {unit}" if unit else "")), F.lit(missing))
            parts.append(F.concat(F.lit(f"{label[:1].upper()}{label[1:].lower()}: "), shown))
    return F.array_join(F.array(*parts), "\n")
