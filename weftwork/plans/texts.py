"""Queries of the other text functions: safety, cleaning, normalising, hashing, chunking, replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.functions import replies, rules
from weftwork.functions import safety as S
from weftwork.functions import text as T
from weftwork.operators import chunking
from weftwork.plans.signals import q
from weftwork.session import spread, table


def _docs(spark: SparkSession, sf: str, text: str = "text") -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))


def pii_types(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.array_join(S.pii_types(F.col("text")), "|").alias("types"))


def pii_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", *[n.cast("long").alias(k) for k, n in S.pii_counts(F.col("text")).items()])


def pii_spans(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.explode(S.detect_pii("text")).alias("s")).select("doc_id", "s.*")


def pii_redact(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", S.redact_pii("text").alias("r")).select("doc_id", F.col("r.text").alias("text"), F.to_json("r.map").alias("placeholders"))


def injection_detect(spark: SparkSession, sf: str) -> DataFrame:
    return S.with_injection(_docs(spark, sf)).select("doc_id", "matches", "risk", "confidence")


def secrets_sanitise(spark: SparkSession, sf: str) -> DataFrame:
    made = F.concat(F.lit("token="), F.sha2(F.col("text"), 256), F.lit(" Bearer "), F.md5(F.col("text")), F.lit(" "), F.col("text"))
    return _docs(spark, sf).select("doc_id", F.sha2(S.without_secrets(made), 256).alias("clean_hash"))


def html_strip(spark: SparkSession, sf: str) -> DataFrame:
    page = F.concat(F.lit("<html><head><style>p {}</style><script>x < 1</script></head><body><p>"), F.regexp_replace(F.col("text"), "\n+", "</p>\n<p>"), F.lit("</p>&nbsp;A &amp; B</body></html>"))
    return _docs(spark, sf).select("doc_id", T.strip_html(page).alias("plain"))


def pdf_clean(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", T.clean_pages(F.regexp_replace("text", ", ", ",-\n")).alias("clean"))


def normalise_values(spark: SparkSession, sf: str) -> DataFrame:
    raw, kind = F.col("raw_value"), F.lower(F.trim("entity_type"))
    value = F.when(kind == "phone", T.normalise_phone(raw)).when(kind == "email", T.normalise_email(raw)).otherwise(T.normalise_name(raw))
    return table(spark, sf, "entity_registry").select("id", value.alias("normalised"))


def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Exact copies by content: one row a hash, its first document and the number of copies."""
    docs = _docs(spark, sf).select("doc_id", T.content_hash(F.col("text")).alias("hash"))
    return docs.groupBy("hash").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


def doc_truncate(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.length(T.truncated(F.col("text"), 500)).cast("long").alias("chars"), F.sha2(T.truncated(F.col("text"), 500), 256).alias("hash"))


def chunk_text(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in chunks of 1,000 characters with 100 of overlap."""
    return chunking.chunk(_docs(spark, sf), "text", chunking.Sizes(1000, 100, 200, 200)).select("doc_id", "chunk_index", "start_char", "end_char", F.sha2("content", 256).alias("hash"), "tokens")


def chunk_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of paged texts with the page each begins on; here pages are blank-line paragraphs."""
    pages = _docs(spark, sf).select("doc_id", F.split("text", "\n\n").alias("pages"))
    return chunking.chunk_pages(pages, "pages", chunking.Sizes(1000, 100, 200, 200)).select("doc_id", "chunk_index", "start_char", "end_char", "page_number")


def parse_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Model replies read as insights, with defaults and filters: one a document, fenced, an insight a paragraph, and a broken one beside each."""
    said = F.transform(F.split("text", "\n\n"), lambda p: F.struct(p.alias("summary"), F.least(F.lit(1.0), F.length(p) / F.lit(400.0)).alias("significance"), F.array(F.lit("Work"), F.lit("home ")).alias("themes")))
    good = F.concat(F.lit("```json\n"), F.to_json(F.struct(said.alias("insights"))), F.lit("\n```"))
    rows = _docs(spark, sf).select("doc_id", F.explode(F.array(good, F.lit("no json {"))).alias("reply"))
    return replies.parse_insights(rows, "reply").select("doc_id", "ordinal", "summary", "significance", "confidence", "insight_type", F.array_join("themes", "|").alias("themes"))


COMMANDS = [("remove", r"\b(?:remove|exclude|drop|delete)\w*\s+(\w+)"), ("show", r"\b(?:show|open|list|display)\w*\s+(?:the\s+)?(\w+)"), ("count", r"how\s+many\s+(\w+)"), ("find", r"\b(?:find|search|look)\w*\s+(\w+)")]


def intent_classify(spark: SparkSession, sf: str) -> DataFrame:
    """The first command that a text gives, and what it is about; the table of commands is the caller's."""
    t = F.col("text")
    return _docs(spark, sf).select("doc_id", rules.first_match(t, COMMANDS, "none").alias("intent"), rules.captured(t, COMMANDS).alias("about"))


def age_at(spark: SparkSession, sf: str) -> DataFrame:
    """Completed years of each order on the last day of orders."""
    orders = table(spark, sf, "orders")
    return orders.select("o_orderkey", rules.age_at(F.to_date("o_orderdate"), F.lit("2026-03-01").cast("date")).cast("long").alias("age"))


def event_description(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    made = {"purchase": F.concat(F.lit("Bought something by user "), F.col("user_id").cast("string")), "error": F.lit("Something failed")}
    return e.select("event_id", rules.described(F.col("event_type"), made).alias("description"))


QUERIES = {f.__name__: f for f in (intent_classify, age_at, event_description, pii_types, pii_counts, pii_spans, pii_redact, injection_detect, secrets_sanitise, html_strip, pdf_clean, normalise_values, content_hash, doc_truncate, chunk_text, chunk_pages, parse_replies)}

_D = "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents) "


def _n(pattern: str, loose: bool) -> str:
    return f"len(regexp_extract_all(text, {q(('(?i)' if loose else '') + pattern)}))"


def _hit(pattern: str, loose: bool) -> str:
    return f"regexp_matches(text, {q(('(?i)' if loose else '') + pattern)})"


_kinds = list(dict.fromkeys(k for k, _, _ in S.PII))
_type_cases = ", ".join("CASE WHEN " + " OR ".join(_hit(p, c) for k, p, c in S.PII if k == kind) + f" THEN '{kind}' END" for kind in _kinds)
_inj_n = " + ".join(_n(p, c) for _, _, p, c in S.INJECTION)
_level = "greatest(" + ", ".join(f"CASE WHEN {_hit(p, c)} THEN {r} ELSE 0 END" for _, r, p, c in S.INJECTION) + ")"
_together = " AND ".join(f"regexp_matches(lower(text), {q(p)})" for p in S.COMBINED)


def _secrets(expression: str) -> str:
    for pattern, replacement in S.SECRETS:
        sql = replacement.replace("$1", "\\1").replace("$2", "\\2")
        expression = f"regexp_replace({expression}, {q(pattern)}, {q(sql)}, 'g')"
    return expression


def _chain(expression: str, steps) -> str:
    for pattern, replacement in steps:
        expression = f"regexp_replace({expression}, {q(pattern)}, {q(replacement)}, 'g')"
    return expression


_page = "'<html><head><style>p {}</style><script>x < 1</script></head><body><p>' || regexp_replace(text, chr(10) || '+', '</p>' || chr(10) || '<p>', 'g') || '</p>&nbsp;A &amp; B</body></html>'"
ORACLES = {
    "intent_classify": _D + "SELECT doc_id, CASE " + " ".join(f"WHEN {_hit(p, True)} THEN '{n}'" for n, p in COMMANDS) + " ELSE 'none' END AS intent, CASE " + " ".join(f"WHEN {_hit(p, True)} THEN regexp_extract(text, {q('(?i)' + p)}, 1)" for _, p in COMMANDS) + " END AS about FROM d",
    "age_at": "SELECT o_orderkey, date_sub('year', CAST(o_orderdate AS DATE), DATE '2026-03-01') AS age FROM orders",
    "event_description": "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'Bought something by user ' || user_id WHEN 'error' THEN 'Something failed' ELSE event_type END AS description FROM events",
    "pii_types": _D + f"SELECT doc_id, array_to_string(list_sort(list_filter([{_type_cases}], lambda x: x IS NOT NULL)), '|') AS types FROM d",
    "pii_counts": _D + "SELECT doc_id, " + ", ".join("+".join(_n(p, c) for k, p, c in S.PII if k == kind) + f" AS {kind}" for kind in _kinds) + " FROM d",
    "injection_detect": _D + f", m AS (SELECT doc_id, {_inj_n} AS matches, CASE WHEN {_level} = 0 AND {_together} THEN 1 ELSE {_level} END AS level FROM d) SELECT doc_id, matches, ['none', 'low', 'medium', 'high', 'critical'][level + 1] AS risk, CAST(CASE WHEN matches > 0 THEN least(0.9::DOUBLE, 0.3::DOUBLE + matches * 0.15::DOUBLE) WHEN level > 0 THEN 0.3 ELSE 0.0 END AS DOUBLE) AS confidence FROM m",
    "html_strip": _D + "SELECT doc_id, trim(" + _chain(_page, [(r"(?is)<script\b[^>]*>.*?</script>", " "), (r"(?is)<style\b[^>]*>.*?</style>", " "), (r"<[^>]+>", " "), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"), (r"\s+", " ")]) + ") AS plain FROM d",
    "pdf_clean": _D + "SELECT doc_id, " + _chain("regexp_replace(text, ', ', ',-' || chr(10), 'g')", [(r"-\n([\p{L}\p{N}_])", r"\1"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")]) + " AS clean FROM d",
    "content_hash": _D + r"SELECT sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS hash, min(doc_id) AS first_doc, count(*) AS copies FROM d GROUP BY 1",
    "doc_truncate": _D + r", c AS (SELECT doc_id, CASE WHEN length(text) > 500 THEN substring(text, 1, 500) || chr(10) || chr(10) || '[... content truncated ...]' ELSE text END AS t FROM d) SELECT doc_id, length(t) AS chars, sha256(t) AS hash FROM c",
    "normalise_values": r"""
SELECT id, CASE lower(trim(entity_type))
  WHEN 'phone' THEN substring(regexp_replace(raw_value, '[^\d+]', '', 'g'), 1, 1) || replace(substring(regexp_replace(raw_value, '[^\d+]', '', 'g'), 2), '+', '')
  WHEN 'email' THEN lower(trim(raw_value))
  ELSE array_to_string(list_transform(regexp_extract_all(trim(raw_value), '\p{L}+|[^\p{L}]+'), lambda p: upper(substring(p, 1, 1)) || lower(substring(p, 2))), '') END AS normalised
FROM entity_registry""",
    "parse_replies": _D + """, p AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS summary, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) - 1 AS o FROM d)
SELECT doc_id, CAST(o AS INTEGER) AS ordinal, summary, least(1.0::DOUBLE, length(summary) / 400.0::DOUBLE) AS significance, CAST(0.5 AS DOUBLE) AS confidence, 'observation' AS insight_type, 'Work|home' AS themes
FROM p WHERE trim(summary) <> '' AND length(summary) / 400.0::DOUBLE >= 0.2""",
    "secrets_sanitise": _D + "SELECT doc_id, sha256(" + _secrets("'token=' || sha256(text) || ' Bearer ' || md5(text) || ' ' || text") + ") AS clean_hash FROM d",
}
