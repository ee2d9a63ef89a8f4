"""Histories of notes by a named configuration: which notes of an entity a later step sees, and in what form."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The configurations and what each does after notes of a day are joined.
CONFIGURATIONS: dict[str, tuple[str, ...]] = {
    "mostRecentVisit-medOnc-ConsultLetterClinic": (),
    "mostRecentVisit-appendFirst-medOnc-ConsultLetterClinic": ("append_first",),
    "firstVisitOnly-medOnc-ConsultLetterClinic": ("first_only",),
    "firstTreatmentOnly-medOnc-ConsultLetterClinic": ("append_first",),
}


def steps_of(name: str, configurations: Mapping[str, Sequence[str]] = CONFIGURATIONS) -> list[str]:
    """The steps of all configurations whose name occurs in `name`; an error where there is none."""
    found = [steps for known, steps in configurations.items() if known in name]
    if not found:
        raise NotImplementedError(f"configuration '{name}' is unknown; there are {', '.join(configurations)}")
    return list(dict.fromkeys(s for steps in found for s in steps))


def daily_notes(notes: DataFrame, key: str, day: str, order: str, kind: str, author: str, text: str, with_kind: bool = True) -> DataFrame:
    """One note for each key and day: texts in their order under their kinds, with the different kinds and authors.

    A row whose text (or kind, where it is shown) is null adds none. Rows with a null key or day have no history and go.
    """
    shown = F.concat(F.col(kind), F.lit(":\n"), F.col(text)) if with_kind else F.col(text)
    rows = notes.filter(F.col(key).isNotNull() & F.col(day).isNotNull()).groupBy(key, day).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), shown.alias("t"), F.col(kind).alias("k"), F.col(author).alias("a")))).alias("all"))
    different = lambda field: F.array_compact(F.array_distinct(F.transform("all", lambda x: x[field])))
    return rows.select(key, day, F.array_join(F.transform("all", lambda x: x["t"]), "\n\n").alias("note"), different("k").alias("kinds"), different("a").alias("authors"))


def append_first(daily: DataFrame, key: str, day: str, leave_out: Sequence[str] = ()) -> DataFrame:
    """Each note after the key's first one follows that first note, whose authors come before its own.

    A note whose kinds are among `leave_out` is no first note; keys without a first note go.
    """
    fit = daily if not leave_out else daily.filter(~F.arrays_overlap("kinds", F.array(*[F.lit(k) for k in leave_out])))
    first = fit.groupBy(key).agg(F.min_by(F.struct("note", "authors"), day).alias("__first"))
    same = F.col("note") == F.col("__first.note")
    joined = daily.join(first, key)
    note = F.when(same, F.col("note")).otherwise(F.concat("__first.note", F.lit("\n\n"), "note"))
    authors = F.when(same, F.col("authors")).otherwise(F.array_distinct(F.concat("__first.authors", "authors")))
    return joined.select(key, day, note.alias("note"), "kinds", authors.alias("authors"))


def first_only(daily: DataFrame, key: str, day: str) -> DataFrame:
    """The key's first note alone."""
    rest = [c for c in daily.columns if c not in (key, day)]
    return daily.groupBy(key).agg(F.min(F.struct(day, *rest)).alias("__b")).select(key, "__b.*").select(*daily.columns)


def note_history(notes: DataFrame, configuration: str, key: str, day: str, order: str, kind: str, author: str, text: str, leave_out: Sequence[str] = (),
                 configurations: Mapping[str, Sequence[str]] = CONFIGURATIONS) -> DataFrame:
    """Daily notes by a configuration's steps. Which plan is built is decided before anything runs."""
    steps = steps_of(configuration, configurations)
    out = daily_notes(notes, key, day, order, kind, author, text)
    for step in steps:
        out = append_first(out, key, day, leave_out) if step == "append_first" else first_only(out, key, day)
    return out
