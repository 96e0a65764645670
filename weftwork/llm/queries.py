"""Queries of the training-data problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm import leakage, mixing, naming, newtext, pairing, personal, shared_spans, splitting
from weftwork.session import table


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.lit("documents").alias("src"), F.col("doc_id").alias("row_id"), "text")
    mails = table(spark, sf, "parsed_content").select(F.lit("parsed_content").alias("src"), F.col("id").alias("row_id"), "text")
    return docs.unionByName(mails)


def _personal(spark: SparkSession, sf: str) -> DataFrame:
    return personal.find_personal(_texts(spark, sf), personal.learn_given(table(spark, sf, "parsed_content")))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _personal(spark, sf).select("src", "row_id", "pii_type", "pii_text").distinct()


def p1_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return personal.redact(_texts(spark, sf).distinct(), _personal(spark, sf))


def p2_pieces(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "document_chunks").select("id", "content")
    return splitting.split_oversized(chunks)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    pieces = p2_pieces(spark, sf)
    return pieces.groupBy("id").agg(F.when(F.bool_or(F.col("cut") == "forced"), "forced").otherwise("natural").alias("cut"))


def p3_entities(spark: SparkSession, sf: str) -> DataFrame:
    return naming.link_variants(table(spark, sf, "entity_registry"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return naming.same_pairs(p3_entities(spark, sf))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return newtext.classified(table(spark, sf, "parsed_content")).where(F.col("kind") == "new").select("id", "line_no").distinct()


def p5_new_text(spark: SparkSession, sf: str) -> DataFrame:
    return newtext.new_text(table(spark, sf, "parsed_content"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = pairing.co_occurrence(table(spark, sf, "entity_insight_links"), min_shared=5)
    return pairing.attracted(pairs).select(F.col("a").alias("entity_a_id"), F.col("b").alias("entity_b_id"))


def p7_co_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs that share an insight, whatever their count and lift, with their sources."""
    return pairing.all_with_sources(table(spark, sf, "entity_insight_links"))


def p7_attracted(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs of p7_found with their sources."""
    links = table(spark, sf, "entity_insight_links")
    pairs = pairing.attracted(pairing.co_occurrence(links, min_shared=5))
    return pairing.with_sources(pairs, links)


def p8_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and items with a template in common, slots checked; numbers of any length are one slot."""
    met = leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"), merge=True)
    met = met.where(F.col("kind") != "inconsistent")
    return met.groupBy("doc_id", "item_id").agg(F.max(F.col("kind") == "verbatim").alias("verbatim"), F.count("*").alias("windows"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    met = leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))
    return met.where(F.col("kind") == "verbatim").select("doc_id", "item_id").distinct()


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "source_targets"))[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "source_targets"))[1]


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    classes, windows = shared_spans.shared_windows(table(spark, sf, "documents"))
    shared = classes.where(F.col("copies") == 1).join(windows.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    return classes.where(F.col("copies") > 1).unionByName(shared).select(F.col("id").alias("doc_id"))


def p10_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return shared_spans.coverage(table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {
    "p1_found": p1_found, "p1_redacted": p1_redacted,
    "p2_found": p2_found, "p2_pieces": p2_pieces,
    "p3_found": p3_found, "p3_entities": p3_entities,
    "p5_found": p5_found, "p5_new_text": p5_new_text,
    "p7_found": p7_found, "p7_co_occurrences": p7_co_occurrences, "p7_attracted": p7_attracted,
    "p8_found": p8_found, "p8_leaks": p8_leaks,
    "p9_mix": p9_mix, "p9_shares": p9_shares,
    "p10_found": p10_found, "p10_coverage": p10_coverage,
}

_P7 = """
WITH links AS (SELECT DISTINCT entity_id, insight_id FROM entity_insight_links WHERE entity_id IS NOT NULL AND insight_id IS NOT NULL),
degrees AS (SELECT entity_id, count(*) AS degree FROM links GROUP BY 1),
n AS (SELECT count(DISTINCT insight_id) AS n FROM links),
pairs AS (SELECT a.entity_id AS entity_a_id, b.entity_id AS entity_b_id, count(*) AS shared,
                 to_json(list('insight:' || a.insight_id ORDER BY 'insight:' || a.insight_id)) AS source_ids_json
          FROM links a JOIN links b ON a.insight_id = b.insight_id AND a.entity_id < b.entity_id GROUP BY 1, 2 HAVING count(*) >= 5),
found AS (SELECT entity_a_id, entity_b_id, shared, CAST(source_ids_json AS VARCHAR) AS source_ids_json,
                 CAST(shared AS DOUBLE) * n / (da.degree * db.degree) AS lift
          FROM pairs JOIN degrees da ON da.entity_id = entity_a_id JOIN degrees db ON db.entity_id = entity_b_id, n
          WHERE shared * n >= 4 * da.degree * db.degree)
"""

_P7_ALL = """
WITH links AS (SELECT DISTINCT entity_id, insight_id FROM entity_insight_links WHERE entity_id IS NOT NULL AND insight_id IS NOT NULL),
degrees AS (SELECT entity_id, count(*) AS degree FROM links GROUP BY 1),
n AS (SELECT count(DISTINCT insight_id) AS n FROM links),
pairs AS (SELECT a.entity_id AS entity_a_id, b.entity_id AS entity_b_id, count(*) AS shared,
                 CAST(to_json(list('insight:' || a.insight_id ORDER BY 'insight:' || a.insight_id)) AS VARCHAR) AS source_ids_json
          FROM links a JOIN links b ON a.insight_id = b.insight_id AND a.entity_id < b.entity_id GROUP BY 1, 2)
SELECT entity_a_id, entity_b_id, shared AS count, source_ids_json, CAST(shared AS DOUBLE) * n / (da.degree * db.degree) AS lift
FROM pairs JOIN degrees da ON da.entity_id = entity_a_id JOIN degrees db ON db.entity_id = entity_b_id, n"""

ORACLES = {
    "p2_found": r"""
SELECT id, CASE WHEN max(list_max(list_transform(regexp_split_to_array(content, '\s+'), lambda w: length(w)))) > 2000 THEN 'forced' ELSE 'natural' END AS cut
FROM document_chunks WHERE length(regexp_replace(content, '^\s+|\s+$', '', 'g')) > 2000 GROUP BY id""",
    "p7_found": _P7 + "SELECT entity_a_id, entity_b_id FROM found",
    "p7_attracted": _P7 + "SELECT entity_a_id, entity_b_id, shared AS count, source_ids_json, lift FROM found",
    "p7_co_occurrences": _P7_ALL,
    "p8_found": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
dw AS (SELECT doc_id, array_to_string(w[i : i + 11], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d WHERE len(w) >= 12)),
e AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM eval_items WHERE text IS NOT NULL),
ew AS (SELECT item_id, array_to_string(w[i : i + 11], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM dw JOIN ew USING (s)""",
    "p10_found": """
WITH d AS (SELECT doc_id, text FROM documents WHERE length(text) >= 200),
w AS (SELECT doc_id, hash(substring(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM d)),
k AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id))
SELECT DISTINCT doc_id FROM w JOIN k USING (h)""",
    # windows of 200 that another document has too: each covers 200 characters, or as many as lie before the next one
    "p10_coverage": """
WITH d AS (SELECT doc_id, text FROM documents WHERE length(text) >= 200),
w AS (SELECT doc_id, i, hash(substring(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM d)),
k AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
s AS (SELECT DISTINCT doc_id, i FROM w JOIN k USING (h)),
g AS (SELECT doc_id, least(200, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 200)) AS covered, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 1 ELSE 0 END AS apart FROM s),
c AS (SELECT doc_id, CAST(sum(covered) AS BIGINT) AS shared_chars, CAST(sum(apart) + 1 AS BIGINT) AS spans FROM g GROUP BY 1)
SELECT doc_id, length(text) AS n_chars, coalesce(shared_chars, 0) AS shared_chars, coalesce(spans, 0) AS spans, CASE WHEN length(text) > 0 THEN CAST(coalesce(shared_chars, 0) AS DOUBLE) / length(text) ELSE 0.0 END AS share
FROM documents LEFT JOIN c USING (doc_id)""",
}
