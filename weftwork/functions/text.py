"""Text primitives as Column expressions, all JVM-side."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\s\p{Z}]+"


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it: it is bound as the one element of an array."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """Runs without white space, Unicode white space included."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0)).cast("long")


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"[^\s\p{Z}]")


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores, lower case: what a word boundary separates."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def contained(text: Column, phrases) -> Column:
    """Those of ``phrases`` that stand anywhere in ``text``, without case, sorted."""
    low = F.lower(text)
    return F.array_sort(F.array_compact(F.array(*[F.when(low.contains(p.lower()), F.lit(p)) for p in phrases])))


def whole_words(toks: Column, low: Column, terms) -> Column:
    """Those of ``terms`` that stand in the text as whole words, sorted: single words by their tokens (``toks``, each once), phrases by containment."""
    single = [t for t in terms if " " not in t]
    phrases = [t for t in terms if " " in t]
    found = F.array_intersect(toks, lit_array(single)) if single else F.array().cast("array<string>")
    if phrases:
        found = F.concat(found, F.array_compact(F.array(*[F.when(low.contains(p), F.lit(p)) for p in phrases])))
    return F.array_sort(found)


def matches(text: Column, pattern: str, group: int = 0, ignore_case: bool = True) -> Column:
    return F.regexp_extract_all(text, F.lit(("(?i)" if ignore_case else "") + pattern), F.lit(group))


def count_matches(text: Column, pattern: str, flags: str = "i") -> Column:
    return F.size(F.regexp_extract_all(text, F.lit((f"(?{flags})" if flags else "") + pattern), F.lit(0)))


def fragment(pattern: str) -> str:
    """Text that any match of ``pattern`` begins with, lower case; empty if there is none."""
    body = re.sub(r"^\\b", "", pattern)
    found = re.match(r"[A-Za-z' ]+", body)
    if not found:
        return ""
    whole = found.group()
    optional = len(whole) < len(body) and body[len(whole)] in "?*{"
    return (whole[:-1] if optional else whole).lower()


def when_contained(low: Column, pattern: str, value: Column, otherwise: Column) -> Column:
    """``value`` where the lower-case text can match ``pattern`` at all: a plain search is far cheaper than the regex."""
    part = fragment(pattern)
    return F.when(low.contains(part), value).otherwise(otherwise) if part else value


def first_of(values: Column, cap: int | None) -> Column:
    """The first ``cap`` values, or all of them."""
    return values if cap is None else F.slice(values, 1, cap)


def distinct_by_lower(values: Column, cap: int | None) -> Column:
    """The first of each spelling without case, in order, at most ``cap`` if there is one."""
    low = F.transform(values, lambda v: F.lower(F.trim(v)))
    kept = F.filter(values, lambda v, i: F.array_position(low, F.lower(F.trim(v))) == i + 1)
    return first_of(F.transform(kept, lambda v: F.trim(v)), cap)


def strip_html(html: Column) -> Column:
    """Text of an HTML page: scripts and styles dropped, tags to blanks, the common entities read, white space squeezed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.regexp_replace(out, entity, char)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def clean_pages(text: Column) -> Column:
    """Text of printed pages: words divided at line ends joined, blanks squeezed, at most one empty line."""
    out = F.regexp_replace(text, r"-\n([\p{L}\p{N}_])", "$1")
    return F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n{3,}", "\n\n")


def normalise_phone(raw: Column) -> Column:
    """Digits, and a plus sign at the start only."""
    kept = F.regexp_replace(raw, r"[^\d+]", "")
    return F.concat(F.substring(kept, 1, 1), F.regexp_replace(F.substring(kept, F.lit(2), F.length(kept)), r"\+", ""))


def normalise_email(raw: Column) -> Column:
    return F.lower(F.trim(raw))


def normalise_name(raw: Column) -> Column:
    """Every run of letters with a capital first and small letters after: "o'brien" gives "O'Brien"."""
    parts = F.regexp_extract_all(F.trim(raw), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p))))), "")


def content_hash(text: Column) -> Column:
    """SHA-256 of the text without outer white space."""
    return F.sha2(F.regexp_replace(text, r"^\s+|\s+$", ""), 256)


def truncated(text: Column, most: int = 8000, mark: str = "\n\n[... content truncated ...]") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def strip_fences(reply: Column) -> Column:
    """A model's reply without a code fence around it."""
    out = F.regexp_replace(reply, r"(?s)^\s*```(?:json)?\s*\n?", "")
    return F.regexp_replace(out, r"(?s)\n?\s*```\s*$", "")
