"""Tables of the engine's data model, made from the test tables in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.session import table

TYPES = ["observation", "pattern", "relationship", "emotional"]
STATUSES = ["raw", "refined", "surfaced", "rejected", "merged"]


def insights(spark: SparkSession, sf: str) -> DataFrame:
    """Insights with one document each as their source."""
    d = F.col("doc_id")
    pick = lambda values, step: F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(d / step) % len(values) + 1).cast("int"))
    source = F.lower(F.trim(F.coalesce("source", F.lit("none"))))
    return table(spark, sf, "documents").select(
        d.alias("id"), F.coalesce("text", F.lit("")).alias("summary"),
        F.array_distinct(F.array(F.coalesce("lang", F.lit("xx")), source, F.concat(F.lit("size"), F.floor(F.coalesce(F.length("text"), F.lit(0)) / 250).cast("string")))).alias("themes"),
        ((d * 7 % 101) / 100).alias("significance"), ((d * 13 % 101) / 100).alias("confidence"), F.when(d % 11 != 0, pick(TYPES, 1)).alias("insight_type"), pick(STATUSES, 1).alias("status"),
        (d % 5 + 1).alias("source_count"), F.array(F.lit("joy"), F.when(d % 3 == 0, "fear").otherwise("hope")).alias("emotional_tags"), "case_id", "created_at", F.col("processed_at").alias("updated_at"),
    )


def sentiment(spark: SparkSession, sf: str) -> DataFrame:
    """Sentiment records: users as entities, scores from -1 to 1."""
    e = table(spark, sf, "events")
    score = (F.round(F.coalesce("value", F.lit(0.0)) * 100).cast("long") % 201 - 100) / 100
    return e.select(F.col("user_id").alias("entity_id"), score.alias("score"), F.col("ts").alias("at"), "event_type")


INSIGHTS = f"""
insights AS (
  SELECT doc_id AS id, coalesce(text, '') AS summary,
         [coalesce(lang, 'xx'), lower(trim(coalesce(source, 'none'))), 'size' || CAST(CAST(floor(coalesce(length(text), 0) / 250) AS BIGINT) AS VARCHAR)] AS themes,
         CAST(doc_id * 7 % 101 AS DOUBLE) / 100 AS significance, CAST(doc_id * 13 % 101 AS DOUBLE) / 100 AS confidence,
         CASE WHEN doc_id % 11 <> 0 THEN {TYPES}[doc_id % 4 + 1] END AS insight_type, {STATUSES}[doc_id % 5 + 1] AS status, doc_id % 5 + 1 AS source_count, case_id, created_at, processed_at AS updated_at
  FROM documents)"""
SENTIMENT = """
sentiment AS (SELECT user_id AS entity_id, CAST(CAST(round(coalesce(value, 0.0) * 100) AS BIGINT) % 201 - 100 AS DOUBLE) / 100 AS score, ts AS said_at, event_type FROM events)"""
COSTS = "costs AS (SELECT DISTINCT * FROM cost_logs)"
DOCS = "docs AS (SELECT DISTINCT ON (id) * FROM ingested_documents)"
CHUNKS = "chunks AS (SELECT DISTINCT ON (id) * FROM document_chunks)"
EDGES = """
edges AS (SELECT src, dst, max(w) AS weight FROM (
  SELECT entity_a_id AS src, entity_b_id AS dst, count AS w FROM entity_co_occurrences UNION ALL SELECT entity_b_id, entity_a_id, count FROM entity_co_occurrences)
  WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst GROUP BY 1, 2)"""
