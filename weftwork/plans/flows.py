"""Queries of streams, sources and prompts on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.functions import replies
from weftwork.operators import prompts
from weftwork.sources import chats, documents, exports
from weftwork.streaming import jobs
from weftwork.session import ship, table


def stream_daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    counts = jobs.daily_counts(jobs.read_table_stream(spark, f"{sf}/events.parquet"), "ts", "event_type", "60 days")
    return jobs.once(counts, "daily").withColumn("day", F.col("day").cast("string"))


def stream_case_tracker(spark: SparkSession, sf: str) -> DataFrame:
    """The last state of each user's tracker."""
    ship(spark)
    states = jobs.track_cases(jobs.read_table_stream(spark, f"{sf}/events.parquet"), "user_id", "ts", "event_type", "60 days")
    last = jobs.once(states, "tracker", "update").groupBy("case_id").agg(F.max_by(F.struct("events", "kinds"), "events").alias("s"))
    return last.select("case_id", "s.events", "s.kinds")


def src_generic_chat(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that are chats, read as messages."""
    docs = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("path"), "text")
    one = docs.where(chats.format_of(F.col("text")) == "generic")
    return chats.parse_generic(one).select(F.col("path").alias("doc_id"), "sender", "text", F.date_format("at", "yyyy-MM-dd HH:mm").alias("sent_at"))


def conv_prepare(spark: SparkSession, sf: str) -> DataFrame:
    """The chat of each chat document in tagged blocks; here its first speaker is the user."""
    rows = src_generic_chat(spark, sf)
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("sent_at", "sender", "text")
    rows = rows.withColumn("turn", F.row_number().over(order)).withColumn("first", F.first("sender").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = rows.withColumn("role", F.when(F.col("sender") == F.col("first"), "user").otherwise("assistant"))
    return chats.as_documents(rows, ["doc_id"], "role", "text", "turn").select("doc_id", "messages", F.sha2("text", 256).alias("hash"))


def csv_bank(spark: SparkSession, sf: str) -> DataFrame:
    """Orders read as a bank statement."""
    rows = table(spark, sf, "orders").select(F.col("o_orderdate").cast("string").alias("date"), F.col("o_orderpriority").alias("description"), (F.round("o_totalprice", 2) * F.when(F.col("o_custkey") % 3 == 0, 1).otherwise(-1)).alias("amount"))
    return exports.summarise(rows).select("metric", "value", F.round("n", 2).alias("n"))


def src_adapter(spark: SparkSession, sf: str) -> DataFrame:
    return documents.load(table(spark, sf, "documents"), source_type="email", since="2025-02-01").select("doc_id")


_BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"  # \p{Zs}


def prompt_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts for all documents, answered by the stand-in model, replies parsed."""
    # white space as SQL has it: runs of these five squeezed, then blanks of any kind trimmed; \v and U+2028 are neither
    line = F.trim(F.regexp_replace("text", r"[\t\n\f\r ]+", " "), F.lit(_BLANKS))
    docs = table(spark, sf, "documents").where(F.col("text").rlike(r"[^\t\n\f\r\p{Zs}]"))
    docs = docs.select("doc_id", prompts.render("Language: {lang}\n{text}", {"lang": F.col("lang"), "text": line}).alias("prompt"))
    return replies.parse_insights(prompts.ask(docs, "prompt", prompts.Echo()), "reply").select("doc_id", "ordinal", "summary")


QUERIES = {f.__name__: f for f in (stream_daily_counts, stream_case_tracker, src_generic_chat, conv_prepare, csv_bank, src_adapter, prompt_replies)}
_LINE = r"^\[?(\d{4}-\d{2}-\d{2}\s*\d{2}:\d{2}(?::\d{2})?)\]?\s*([^:\n]+):\s*(.+)$"
# a line that begins with a time and a sender opens a message; the lines after it belong to it
_CHAT = rf"""
WITH d AS (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '<smses\b|SMS Backup & Restore') AND NOT coalesce(json_valid(text) AND regexp_matches(trim(text), '^[\[{{]'), FALSE)
  AND NOT regexp_matches(text, '(?m)^\[?(\d{{1,2}}/\d{{1,2}}/\d{{2,4}},?\s*\d{{1,2}}:\d{{2}}(?::\d{{2}})?\s*(?:AM|PM|am|pm)?)\]?\s*-?\s*([^:\n]+):\s*(.+)$') AND regexp_matches(text, '(?m){_LINE}')),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM d),
o AS (SELECT *, sum(CASE WHEN regexp_matches(line, '{_LINE}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS k FROM l),
m AS (SELECT doc_id, k, string_agg(line, chr(10) ORDER BY n) AS m, min(line) FILTER (regexp_matches(line, '{_LINE}')) AS head FROM o WHERE k > 0 GROUP BY 1, 2)"""

ORACLES = {
    "src_generic_chat": _CHAT + rf"""
SELECT doc_id, trim(regexp_extract(head, '{_LINE}', 2)) AS sender, trim(regexp_extract(m, '^\[?\d{{4}}-\d{{2}}-\d{{2}}\s*\d{{2}}:\d{{2}}(?::\d{{2}})?\]?\s*[^:\n]+:\s*((?s:.*))$', 1)) AS text, substring(trim(regexp_extract(head, '{_LINE}', 1)), 1, 16) AS sent_at FROM m""",
    "prompt_replies": r"SELECT doc_id, 0 AS ordinal, trim(regexp_replace(text, '\s+', ' ', 'g')) AS summary FROM documents WHERE trim(coalesce(text, '')) <> '' AND trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''",
    "stream_daily_counts": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_case_tracker": "SELECT CAST(user_id AS VARCHAR) AS case_id, count(*) AS events, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY 1",
    "src_adapter": "SELECT doc_id FROM documents WHERE source = 'email' AND created_at >= TIMESTAMPTZ '2025-02-01 00:00:00+00'",
    "csv_bank": """WITH b AS (SELECT o_orderpriority AS d, round(o_totalprice, 2) * CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE -1 END AS a FROM orders)
SELECT 'rows' AS metric, '' AS value, CAST(count(*) AS DOUBLE) AS n FROM b UNION ALL SELECT 'income', '', round(sum(a) FILTER (a > 0), 2) FROM b UNION ALL SELECT 'expense', '', round(sum(-a) FILTER (a < 0), 2) FROM b
UNION ALL SELECT 'net', '', round(sum(a), 2) FROM b UNION ALL SELECT 'expense by name', substring(d, 1, 30), round(sum(-a), 2) FROM b WHERE a < 0 GROUP BY 2""",
}
