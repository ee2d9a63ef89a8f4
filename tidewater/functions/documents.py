"""A row as a text document of sections with a line for each value."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_MEASURED, NOT_AVAILABLE = "not measured", "not available"


@dataclass(frozen=True)
class Item:
    """One line, "Label: value unit". A column that the table lacks (value None) is not available.

    `recode` maps values to words, and all others, null as well, to not available. A `percent` is given times 100 and has no
    line where it is 0. Numbers are rounded to `digits`. A null value is given by `missing`, without the unit.
    """

    label: str
    value: Column | None
    unit: str = ""
    digits: int | None = None
    recode: Mapping | None = None
    percent: bool = False
    missing: str = NOT_MEASURED

    def line(self) -> Column:
        name = F.lit(f"{self.label}: ")
        if self.value is None:
            return F.concat(name, F.lit(NOT_AVAILABLE))
        if self.recode is not None:
            pairs = F.create_map(*[x for k, v in self.recode.items() for x in (F.lit(k), F.lit(v))])
            return F.concat(name, F.coalesce(pairs[self.value], F.lit(NOT_AVAILABLE)))
        value = self.value * 100 if self.percent else self.value
        value = value if self.digits is None else F.round(value, self.digits)
        shown = F.concat(name, F.coalesce(F.concat(value.cast("string"), F.lit(f" {self.unit}" if self.unit else "")), F.lit(self.missing)))
        return F.when(F.coalesce(value == 0, F.lit(False)), F.lit(None).cast("string")).otherwise(shown) if self.percent else shown


@dataclass(frozen=True)
class Flags:
    """A line "Label: name" for each flag that is set; flags of the same name give one line."""

    label: str
    flags: Sequence[tuple[str, Column]] = field(default_factory=tuple)

    def lines(self) -> list[Column]:
        names: dict[str, Column] = {}
        for name, flag in self.flags:
            names[name] = names[name] | F.coalesce(flag, F.lit(False)) if name in names else F.coalesce(flag, F.lit(False))
        return [F.when(flag, F.lit(f"{self.label}: {name}")) for name, flag in names.items()]


def row_document(title: str, sections: Sequence[tuple[str, Sequence[Item | Flags]]], wording: Mapping[str, str] | None = None) -> Column:
    """The title, then each section's name and lines; a section without items is left out, one without lines is a name.

    Lines begin with a capital letter and go on in lower case. `wording` replaces parts of the whole text.
    """
    parts: list[Column] = [F.lit(f"{title}\n\n")]
    for name, items in sections:
        lines = [line for item in items for line in (item.lines() if isinstance(item, Flags) else [item.line()])]
        if lines:
            shown = F.transform(F.array_compact(F.array(*lines)), lambda s: F.concat(F.upper(F.left(s, F.lit(1))), F.lower(F.substr(s, F.lit(2)))))
            parts += [F.lit(f"{name}:\n"), F.array_join(shown, "\n"), F.lit("\n\n")]
    out = F.concat(*parts)
    for old, new in (wording or {}).items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out
