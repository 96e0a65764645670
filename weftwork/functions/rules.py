"""Small decisions as Column expressions: ordered patterns, ages, templates of events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(text: Column, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The name of the first rule (name, pattern) that the text matches, case ignored. The order of the rules is their priority."""
    out = F.lit(otherwise)
    for name, pattern in reversed(rules):
        out = F.when(text.rlike("(?i)" + pattern), name).otherwise(out)
    return out


def captured(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The first group of the first rule that matches, or null."""
    out = F.lit(None).cast("string")
    for _, pattern in reversed(rules):
        out = F.when(text.rlike("(?i)" + pattern), F.nullif(F.regexp_extract(text, "(?i)" + pattern, 1), F.lit(""))).otherwise(out)
    return out


def age_at(born: Column, day: Column) -> Column:
    """Completed years; one born on 29 February is a year older on 1 March of other years."""
    before = (F.month(day) < F.month(born)) | ((F.month(day) == F.month(born)) & (F.dayofmonth(day) < F.dayofmonth(born)))
    return F.year(day) - F.year(born) - F.when(before, 1).otherwise(0)


def described(kind: Column, templates: dict[str, Column]) -> Column:
    """A text for each kind of event; kinds without a template are their own text."""
    out = kind
    for name, text in templates.items():
        out = F.when(kind == name, text).otherwise(out)
    return out
