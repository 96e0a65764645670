"""Patterns of personal data, prompt injection and secrets in texts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from weftwork.functions import text as T

# (type, pattern, case ignored). What counts as a detection.
PII = [
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", False), ("ssn", r"\b\d{9}\b", False),
    ("credit_card", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12}|(?:2131|1800|35\d{3})\d{11})\b", False),
    ("credit_card", r"\b(?:\d{4}[-\s]?){3}\d{4}\b", False), ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", False),
    ("phone", r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", False), ("phone", r"\b\+\d{1,3}[-.\s]?\d{1,4}[-.\s]?\d{1,4}[-.\s]?\d{1,9}\b", False),
    ("ip_address", r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b", False),
    ("date_of_birth", r"\b(?:dob|date\s+of\s+birth|born)[:\s]+\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}\b", True), ("bank_account", r"\b(?:account|acct)[#:\s]+\d{8,17}\b", True),
    ("passport", r"\b(?:passport)[#:\s]+[A-Z0-9]{9}\b", True), ("drivers_license", r"\b(?:dl|driver'?s?\s+license)[#:\s]+[A-Z0-9]{5,15}\b", True),
]
# (name, risk 1 low to 4 critical, pattern, case ignored). Groups do not capture: a match counts as a whole, and regexp_extract_all would give a group.
INJECTION = [
    ("instruction_override", 3, r"ignore\s+(?:all\s+)?(?:previous|prior|above)\s+instructions?", True), ("instruction_disregard", 3, r"disregard\s+(?:all\s+)?(?:previous|prior|above)", True),
    ("memory_wipe", 3, r"forget\s+(?:everything|all|what)\s+(?:you|i)\s+(?:said|told|know)", True), ("mode_switch", 4, r"you\s+are\s+now\s+(?:in\s+)?(?:developer|admin|sudo|root|god)\s+mode", True),
    ("role_change", 2, r"(?:act|pretend|behave)\s+(?:as|like)\s+(?:if\s+)?(?:you\s+are\s+)?(?:a\s+)?(?:different|new|another)", True),
    ("persistent_change", 2, r"from\s+now\s+on[,\s]+(?:you|your)\s+(?:will|must|should|are)", True),
    ("prompt_extraction", 3, r"(?:reveal|show|print|display|output)\s+(?:your\s+)?(?:system\s+)?(?:prompt|instructions?)", True),
    ("prompt_query", 3, r"(?:what|tell\s+me)\s+(?:are\s+)?(?:your\s+)?(?:initial|original|system)\s+(?:instructions?|prompt)", True),
    ("prompt_repeat", 3, r"repeat\s+(?:the\s+)?(?:text|words?|instructions?)\s+(?:above|before)", True), ("xml_system_tag", 4, r"<\s*system\s*>", True),
    ("xml_role_tag", 3, r"<\s*/?\s*(?:assistant|user|human)\s*>", True), ("dan_jailbreak", 4, r"\b(?:DAN|do\s+anything\s+now)\b", True), ("jailbreak_keyword", 2, r"\bjailbreak(?:ed|ing)?\b", True),
    ("output_constraint", 1, r"(?:respond|reply|answer)\s+(?:only\s+)?(?:with|using)\s+(?:yes|no|true|false|json)", True), ("base64_content", 1, r"[A-Za-z0-9+/]{50,}={0,2}", False),
    ("delimiter_attack", 2, r"(?:```|\"\"\"|''')\s*(?:system|instructions?|prompt)", True),
]
COMBINED = [r"\b(?:important|critical|urgent|must|always)\b", r"\b(?:override|bypass|ignore|skip|disable)\b", r"\b(?:secret|hidden|internal|private)\b"]
RISKS = ["none", "low", "medium", "high", "critical"]
# (pattern, replacement in the dialect of java.util.regex). No key matches both of the first two.
SECRETS = [
    (r"sk-ant-[a-zA-Z0-9\-]{20,}", "[ANTHROPIC_KEY]"), (r"sk-[a-zA-Z0-9]{20,}", "[OPENAI_KEY]"), (r"(?i)api[_-]?key\s*[:=]\s*[\"']?([a-zA-Z0-9\-_]{20,})[\"']?", "api_key=[REDACTED]"),
    (r"(?i)Bearer\s+[a-zA-Z0-9\-_\.]{20,}", "Bearer [REDACTED]"), (r"(?i)(password|passwd|pwd)\s*[:=]\s*[\"']?[^\s\"']+[\"']?", "$1=[REDACTED]"),
    (r"(?i)(secret|token|credential)\s*[:=]\s*[\"']?[^\s\"']+[\"']?", "$1=[REDACTED]"), (r"(?i)(://[^:]+:)[^@]+(@)", "$1[REDACTED]$2"),
]


def pii_counts(text: Column) -> dict[str, Column]:
    """Detections a type, pattern by pattern (two patterns may see one place)."""
    out: dict[str, Column] = {}
    for kind, pattern, loose in PII:
        n = T.count_matches(text, pattern, "i" if loose else "")
        out[kind] = out[kind] + n if kind in out else n
    return out


def pii_types(text: Column) -> Column:
    """The types found, sorted."""
    by_type: dict[str, Column] = {}
    for kind, pattern, loose in PII:
        hit = text.rlike(("(?i)" if loose else "") + pattern)
        by_type[kind] = by_type[kind] | hit if kind in by_type else hit
    return F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in by_type.items()])))


SPANS = "array<struct<type:string,start:int,end:int,original:string>>"


def pii_spans(text: str) -> list[dict]:
    """All detections of one text; of those that overlap the leftmost, then the longest, then the earliest pattern holds."""
    found = []
    for rank, (kind, pattern, loose) in enumerate(PII):
        found += [(m.start(), -m.end(), rank, kind, m.group()) for m in re.finditer(pattern, text, re.I if loose else 0)]
    out, reach = [], 0
    for start, end, _, kind, original in sorted(found):
        if start >= reach:
            out.append({"type": kind, "start": start, "end": -end, "original": original})
            reach = -end
    return out


def detect_pii(text: Column | str) -> Column:
    """The detections of each text, by an Arrow UDF."""

    @pandas_udf(SPANS)
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: pii_spans(t or ""))

    return find(text)


REDACTED = "struct<text:string,map:map<string,string>>"


def redact(text: str, numbered: bool = True) -> dict:
    """The text with placeholders such as [EMAIL_1], and what each stands for."""
    parts, at, counts, stands = [], 0, {}, {}
    for s in pii_spans(text):
        name = s["type"].upper()
        counts[name] = counts.get(name, 0) + 1
        mark = f"[{name}_{counts[name]}]" if numbered else f"[{name}]"
        stands[mark] = s["original"]
        parts += [text[at : s["start"]], mark]
        at = s["end"]
    return {"text": "".join([*parts, text[at:]]), "map": stands}


def redact_pii(text: Column | str) -> Column:
    """``redact`` of each text, by an Arrow UDF; null stays null."""

    @pandas_udf(REDACTED)
    def replace(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([redact(t) if t is not None else {"text": None, "map": {}} for t in texts], columns=["text", "map"])

    return replace(text)


# Words of which a match of the pattern holds one; the regex runs only where one stands.
NEEDED = {
    "instruction_override": ["ignore"], "instruction_disregard": ["disregard"], "memory_wipe": ["forget"], "mode_switch": ["mode"], "role_change": ["pretend", "behave", "act as", "act like", "act "],
    "persistent_change": ["from"], "prompt_extraction": ["prompt", "instruction"], "prompt_query": ["prompt", "instruction"], "prompt_repeat": ["repeat"], "xml_system_tag": ["system"], "xml_role_tag": ["<"],
    "dan_jailbreak": ["dan", "anything"], "jailbreak_keyword": ["jailbreak"], "output_constraint": ["respond", "reply", "answer"], "delimiter_attack": ["system", "instruction", "prompt"],
}


def with_injection(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with matches, risk and confidence. Each pattern runs once a text; null and blank texts are clean.

    risk is the greatest of the patterns that match; without any, keywords of
    all three classes together are low. confidence is 0.3 and 0.15 a match,
    at most 0.9.
    """
    t = F.coalesce(text, F.lit(""))
    counts = []
    for name, _, pattern, loose in INJECTION:
        if name == "base64_content":
            pattern = "(?<![A-Za-z0-9+/])" + pattern  # a run matches from its start or not at all
        n = T.count_matches(t, pattern, "i" if loose else "")
        if name in NEEDED:
            may = F.col("_low").contains(NEEDED[name][0])
            for word in NEEDED[name][1:]:
                may = may | F.col("_low").contains(word)
            if name == "role_change":
                may = may | F.col("_low").rlike(r"act\s")
            n = F.when(may, n).otherwise(0)
        counts.append(n)
    out = df.withColumn("_low", F.lower(t)).withColumn("_counts", F.array(*counts))
    level = F.greatest(*[F.when(F.col("_counts")[k] > 0, risk).otherwise(0) for k, (_, risk, _, _) in enumerate(INJECTION)])
    together = F.lit(True)
    for p in COMBINED:
        together = together & F.col("_low").rlike(p)
    out = out.withColumns({"matches": F.aggregate("_counts", F.lit(0), lambda a, x: a + x).cast("long"), "_level": level})
    out = out.withColumn("_level", F.when((F.col("_level") == 0) & together, 1).otherwise(F.col("_level")))
    confidence = F.when(F.col("matches") > 0, F.least(F.lit(0.9), F.lit(0.3) + F.col("matches") * 0.15)).when(F.col("_level") > 0, 0.3).otherwise(0.0)
    return out.withColumns({"risk": F.element_at(T.lit_array(RISKS), F.col("_level") + 1), "confidence": confidence}).drop("_low", "_counts", "_level")


def without_secrets(text: Column) -> Column:
    for pattern, replacement in SECRETS:
        text = F.regexp_replace(text, pattern, replacement)
    return text
