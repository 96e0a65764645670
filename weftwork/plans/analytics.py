"""Queries of aggregations, joins, set-level operators, filters and mutations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.functions import signals
from weftwork.functions import text as T
from weftwork.operators import chunking, clustering, graph, matching, mutations, patterns, similarity, stats
from weftwork.plans import views as V
from weftwork.session import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _costs(spark, sf):
    return stats.repeated_once(table(spark, sf, "cost_logs"))


def _docs(spark, sf):
    return stats.repeated_once(table(spark, sf, "ingested_documents"))


def _chunks(spark, sf):
    return stats.repeated_once(table(spark, sf, "document_chunks"))


def _edges(spark, sf):
    return graph.undirected(table(spark, sf, "entity_co_occurrences"))


def _iso(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


# aggregations ------------------------------------------------------------------------------------
@query(f"""WITH {V.INSIGHTS}
SELECT 'status' AS dimension, status AS value, count(*) AS n FROM insights GROUP BY 2 UNION ALL SELECT 'type', coalesce(insight_type, 'unknown'), count(*) FROM insights GROUP BY 2""")
def agg_insight_counts(spark: SparkSession, sf: str) -> DataFrame:
    return stats.counts_by(V.insights(spark, sf), {"status": F.col("status"), "type": F.col("insight_type")})


@query(f"""WITH {V.INSIGHTS}
SELECT CAST(round(avg(significance), 3) AS DOUBLE) AS significance, CAST(round(avg(confidence), 3) AS DOUBLE) AS confidence, CAST(round(avg(source_count), 1) AS DOUBLE) AS sources, count(*) AS n FROM insights WHERE status <> 'rejected'""")
def agg_insight_means(spark: SparkSession, sf: str) -> DataFrame:
    kept = V.insights(spark, sf).where("status <> 'rejected'")
    return kept.agg(F.round(F.avg("significance"), 3).alias("significance"), F.round(F.avg("confidence"), 3).alias("confidence"), F.round(F.avg("source_count"), 1).alias("sources"), F.count("*").alias("n"))


@query("""SELECT coalesce(lower(trim(entity_type)), 'all') AS entity_type, count(*) AS n, count(*) FILTER (confirmed) AS confirmed, count(*) - count(*) FILTER (confirmed) AS unconfirmed
FROM entity_registry GROUP BY GROUPING SETS ((lower(trim(entity_type))), ())""")
def agg_entity_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "entity_registry").select(F.lower(F.trim("entity_type")).alias("entity_type"), "confirmed")
    out = rows.rollup("entity_type").agg(F.count("*").alias("n"), F.count_if("confirmed").alias("confirmed"))
    return out.select(F.coalesce("entity_type", F.lit("all")).alias("entity_type"), "n", "confirmed", (F.col("n") - F.col("confirmed")).alias("unconfirmed"))


@query(f"""WITH {V.EDGES} SELECT src AS entity_id, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS strength FROM edges GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def agg_graph_degree(spark: SparkSession, sf: str) -> DataFrame:
    top = graph.degrees(_edges(spark, sf)).orderBy(F.desc("degree"), "src").limit(10)
    return top.select(F.col("src").alias("entity_id"), "degree", "strength")


@query("SELECT count(*) AS pairs, CAST(sum(count) AS BIGINT) AS total, avg(count) AS mean FROM entity_co_occurrences")
def agg_graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "entity_co_occurrences").agg(F.count("*").alias("pairs"), F.sum("count").alias("total"), F.avg("count").alias("mean"))


_label = "CASE WHEN score < -0.3 THEN 'negative' WHEN score > 0.3 THEN 'positive' WHEN abs(score) < 0.1 THEN 'neutral' ELSE 'mixed' END"


@query(f"""WITH {V.SENTIMENT}, l AS (SELECT *, {_label} AS label FROM sentiment)
SELECT entity_id, count(*) AS n, round(avg(score), 6) AS mean, min(score) AS least, max(score) AS greatest, count(*) FILTER (label = 'positive') AS positive, count(*) FILTER (label = 'negative') AS negative,
  count(*) FILTER (label = 'neutral') AS neutral, count(*) FILTER (label = 'mixed') AS mixed, strftime(min(said_at), '%Y-%m-%d %H:%M:%S.%f') AS first_at, strftime(max(said_at), '%Y-%m-%d %H:%M:%S.%f') AS last_at,
  CASE WHEN avg(score) > 0.3 THEN 'positive' WHEN avg(score) < -0.3 THEN 'negative' ELSE 'stable' END AS trend FROM l GROUP BY 1""")
def agg_sentiment_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = stats.sentiment_summary(V.sentiment(spark, sf), "entity_id", "score", "at")
    return out.withColumns({"mean": F.round("mean", 6), "first_at": F.date_format("first_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "last_at": F.date_format("last_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")})


@query(f"""WITH {V.COSTS} SELECT provider, lower(trim(feature)) AS feature, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  CAST(sum(CAST(round(total_cost * 1000000) AS BIGINT)) AS BIGINT) AS cost_millionths, count(*) FILTER (NOT success) AS failed, CAST(grouping(provider, lower(trim(feature))) AS BIGINT) AS level
FROM costs GROUP BY GROUPING SETS ((provider), (lower(trim(feature))), ())""")
def agg_cost_summary(spark: SparkSession, sf: str) -> DataFrame:
    return stats.rollup_costs(_costs(spark, sf))


@query(f"""WITH {V.COSTS} SELECT CAST(CAST(created_at AT TIME ZONE 'UTC' AS DATE) AS VARCHAR) AS day, provider, lower(trim(feature)) AS feature, count(*) AS calls, CAST(sum(total_tokens) AS BIGINT) AS tokens,
  CAST(sum(CAST(round(total_cost * 1000000) AS BIGINT)) AS BIGINT) AS cost_millionths, CAST(sum(latency_ms) AS BIGINT) AS latency_sum, count(latency_ms) AS latency_n, count(*) FILTER (NOT success) AS failed FROM costs GROUP BY 1, 2, 3""")
def agg_cost_daily(spark: SparkSession, sf: str) -> DataFrame:
    return stats.daily_costs(_costs(spark, sf))


def _used(days: int) -> str:
    return f"CAST(sum(CASE WHEN success AND a >= 0 AND a < {days} THEN total_tokens ELSE 0 END) AS BIGINT)"


@query(f"""WITH {V.COSTS}, c AS (SELECT user_id, success, total_tokens, DATE '2025-06-30' - CAST(created_at AT TIME ZONE 'UTC' AS DATE) AS a FROM costs)
SELECT user_id, {_used(1)} AS used_1, {_used(7)} AS used_7, {_used(30)} AS used_30, greatest(0, 100000 - {_used(1)}) AS remaining FROM c GROUP BY 1""")
def agg_period_usage(spark: SparkSession, sf: str) -> DataFrame:
    return stats.period_usage(_costs(spark, sf), F.lit("2025-06-30").cast("date"), 100000)


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 7")
def agg_timeline_daily(spark: SparkSession, sf: str) -> DataFrame:
    return stats.daily_summary(table(spark, sf, "events"), "ts", "event_type", 7).withColumn("day", F.col("day").cast("string"))


@query("SELECT event_type, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_at, count(*) FILTER (value > 10) AS annotated FROM events GROUP BY 1")
def agg_timeline_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count_if(F.col("value") > 10).alias("annotated"))
    return out.select("event_type", "n", _iso("first_at"), _iso("last_at"), "annotated")


@query(f"WITH {V.INSIGHTS} SELECT CAST(CAST(created_at AT TIME ZONE 'UTC' AS DATE) AS VARCHAR) AS day, count(*) AS n FROM insights GROUP BY 1")
def agg_insight_activity(spark: SparkSession, sf: str) -> DataFrame:
    return V.insights(spark, sf).groupBy(F.to_date("created_at").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query(f"""WITH {V.DOCS}, {V.CHUNKS}, n AS (SELECT document_id, count(*) AS chunks, count(*) FILTER (is_processed) AS processed, coalesce(sum(token_count), 0) AS tokens FROM chunks GROUP BY 1)
SELECT status, file_type, count(*) AS documents, CAST(sum(coalesce(chunks, 0)) AS BIGINT) AS chunks, CAST(sum(coalesce(processed, 0)) AS BIGINT) AS processed, CAST(sum(coalesce(tokens, 0)) AS BIGINT) AS tokens FROM docs LEFT JOIN n ON n.document_id = docs.id GROUP BY 1, 2""")
def agg_ingest_stats(spark: SparkSession, sf: str) -> DataFrame:
    n = _chunks(spark, sf).groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("chunks"), F.count_if("is_processed").alias("processed"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"))
    joined = _docs(spark, sf).join(n, "id", "left")
    return joined.groupBy("status", "file_type").agg(F.count("*").alias("documents"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("chunks", "processed", "tokens")])


@query(f"""WITH {V.DOCS} SELECT status, count(*) AS n, CAST(sum(CASE WHEN status = 'pending' THEN file_size ELSE 0 END) AS BIGINT) AS pending_bytes FROM docs GROUP BY 1""")
def agg_queue_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).groupBy("status").agg(F.count("*").alias("n"), F.sum(F.when(F.col("status") == "pending", F.col("file_size")).otherwise(0)).alias("pending_bytes"))


@query(f"""WITH {V.CHUNKS} SELECT document_id, string_agg(content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY chunk_index, id) AS text FROM chunks WHERE content IS NOT NULL GROUP BY 1""")
def agg_doc_text(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "id", "content")))
    rows = _chunks(spark, sf).where("content is not null").groupBy("document_id").agg(parts.alias("p"))
    return rows.select("document_id", F.array_join(F.transform("p", lambda p: p["content"]), "\n\n---\n\n").alias("text"))


@query(f"""WITH {V.INSIGHTS} SELECT coalesce(insight_type, 'unknown') AS kind, count(*) FILTER (themes[1] = 'en') AS n_left, count(*) FILTER (themes[1] = 'de') AS n_right, round(avg(significance) FILTER (themes[1] = 'en'), 6) AS mean_left,
 round(avg(significance) FILTER (themes[1] = 'de'), 6) AS mean_right, count(*) FILTER (themes[1] = 'de') - count(*) FILTER (themes[1] = 'en') AS delta FROM insights WHERE themes[1] IN ('en', 'de') GROUP BY 1""")
def agg_run_compare(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.insights(spark, sf).select(F.col("themes")[0].alias("run"), F.coalesce("insight_type", F.lit("unknown")).alias("kind"), "significance")
    return stats.compare_groups(rows, "run", "en", "de", "kind", "significance").withColumns({c: F.round(c, 6) for c in ("mean_left", "mean_right")})


@query(f"""WITH {V.INSIGHTS} SELECT status, id, position FROM (SELECT status, id, CAST(row_number() OVER (PARTITION BY status ORDER BY significance DESC, id) AS INTEGER) AS position FROM insights) WHERE position <= 5""")
def agg_run_deltas(spark: SparkSession, sf: str) -> DataFrame:
    return stats.first_of_each(V.insights(spark, sf), ["status"], [F.desc("significance"), F.col("id")], 5).select("status", "id", "position")


@query(r"""WITH d AS (SELECT coalesce(case_id, 'none') AS case_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT case_id, count(*) AS items, CAST(sum(len(regexp_extract_all(t, '[^\s\p{Z}]+'))) AS BIGINT) AS words FROM d GROUP BY 1),
e AS (SELECT case_id, count(DISTINCT lower(m)) AS emails FROM (SELECT case_id, unnest(regexp_extract_all(t, '(?i)[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}')) AS m FROM d) GROUP BY 1)
SELECT w.case_id, items, words, coalesce(emails, 0) AS emails, CAST(floor(words * 1.3) AS BIGINT) AS tokens FROM w LEFT JOIN e USING (case_id)""")
def agg_preflight_scan(spark: SparkSession, sf: str) -> DataFrame:
    """By case: items, words, different e-mail addresses, estimated tokens."""
    t = F.coalesce("text", F.lit(""))
    docs = table(spark, sf, "documents").select(F.coalesce("case_id", F.lit("none")).alias("case_id"), T.word_count(t).alias("w"), T.matches(t, signals.L.EMAIL).alias("m"))
    words = docs.groupBy("case_id").agg(F.count("*").alias("items"), F.sum("w").alias("words"))
    mails = docs.select("case_id", F.explode(F.transform("m", lambda m: F.lower(m))).alias("m")).groupBy("case_id").agg(F.count_distinct("m").alias("emails"))
    return words.join(mails, "case_id", "left").select("case_id", "items", "words", F.coalesce("emails", F.lit(0)).alias("emails"), F.floor(F.col("words") * 1.3).alias("tokens"))


@query(f"WITH {V.INSIGHTS} SELECT DISTINCT unnest(themes) AS theme FROM insights")
def existing_themes(spark: SparkSession, sf: str) -> DataFrame:
    return V.insights(spark, sf).select(F.explode("themes").alias("theme")).distinct()


@query(r"""WITH c AS (UNPIVOT (SELECT CAST(COLUMNS(*) AS VARCHAR) FROM cost_logs) ON COLUMNS(*)), v AS (SELECT name, nullif(trim(value), '') AS v FROM c)
SELECT name AS "column", (SELECT count(*) FROM cost_logs) AS rows, count(v) AS non_empty, count(DISTINCT v) AS distinct_values, count(*) FILTER (regexp_full_match(regexp_replace(v, '[$,€£ ]', '', 'g'), '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?')) AS numeric,
  count(*) FILTER (regexp_full_match(v, '\d{4}-\d{2}-\d{2}([T ].*)?') AND TRY_CAST(substring(v, 1, 10) AS DATE) IS NOT NULL) AS dates FROM v GROUP BY 1""")
def col_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.column_profile(table(spark, sf, "cost_logs"))


# joins -------------------------------------------------------------------------------------------
@query(f"""WITH {V.DOCS}, {V.CHUNKS} SELECT c.id AS chunk_id, d.id AS document_id, d.filename, c.chunk_index FROM chunks c JOIN docs d ON d.id = c.document_id WHERE NOT coalesce(c.is_processed, FALSE)""")
def join_chunks_docs(spark: SparkSession, sf: str) -> DataFrame:
    waiting = _chunks(spark, sf).where(~F.coalesce("is_processed", F.lit(False))).select(F.col("id").alias("chunk_id"), "document_id", "chunk_index")
    return waiting.join(_docs(spark, sf).select(F.col("id").alias("document_id"), "filename"), "document_id").select("chunk_id", "document_id", "filename", "chunk_index")


@query(f"""WITH {V.INSIGHTS} SELECT e.id AS finding_id, i.id AS insight_id, i.status FROM entity_registry e LEFT JOIN insights i ON i.id = e.merged_into_id""")
def join_findings_insights(spark: SparkSession, sf: str) -> DataFrame:
    findings = table(spark, sf, "entity_registry").select(F.col("id").alias("finding_id"), F.col("merged_into_id").alias("insight_id"))
    insights = V.insights(spark, sf).select(F.col("id").alias("insight_id"), "status", F.lit(True).alias("_i"))
    return findings.join(insights, "insight_id", "left").select("finding_id", F.when(F.col("_i"), F.col("insight_id")).alias("insight_id"), "status")


@query(f"""WITH {V.COSTS}, c AS (SELECT DISTINCT case_id FROM documents WHERE case_id IS NOT NULL), n AS (SELECT case_id, count(*) AS n FROM costs GROUP BY 1) SELECT c.case_id, coalesce(n.n, 0) AS calls FROM c LEFT JOIN n USING (case_id)""")
def join_case_counts(spark: SparkSession, sf: str) -> DataFrame:
    cases = table(spark, sf, "documents").where("case_id is not null").select("case_id").distinct()
    calls = _costs(spark, sf).groupBy("case_id").agg(F.count("*").alias("calls"))
    return cases.join(calls, "case_id", "left").select("case_id", F.coalesce("calls", F.lit(0)).alias("calls"))


@query(f"""WITH {V.DOCS} SELECT id FROM docs WHERE NOT EXISTS (SELECT 1 FROM document_chunks c WHERE c.document_id = docs.id)""")
def antijoin_queue(spark: SparkSession, sf: str) -> DataFrame:
    return mutations.hard_delete(_docs(spark, sf).select("id"), table(spark, sf, "document_chunks").select(F.col("document_id").alias("id")), ["id"])


@query("""SELECT id AS entity_id, (SELECT insight_id FROM entity_insight_links l WHERE l.entity_id = e.id ORDER BY l.created_at, l.insight_id LIMIT 1) AS first_source FROM entity_registry e""")
def scalar_first_source(spark: SparkSession, sf: str) -> DataFrame:
    first = matching.first_by(table(spark, sf, "entity_insight_links").where("entity_id is not null"), "entity_id", "insight_id", ["created_at"])
    return table(spark, sf, "entity_registry").select(F.col("id").alias("entity_id")).join(first.withColumnRenamed("insight_id", "first_source"), "entity_id", "left")


_framed = r"' ' || regexp_replace({0}, '[^\p{{L}}\p{{N}}_]', ' ', 'g') || ' '"


_GIVEN = r"p AS (SELECT regexp_extract(raw_value, '^(\p{L}{3,}) ', 1) AS name, min(id) AS id FROM entity_registry WHERE lower(trim(entity_type)) = 'person' AND regexp_matches(raw_value, '^\p{L}{3,} ') AND confirmed IS NOT NULL GROUP BY 1)"


def _given_names(spark, sf):
    """(id, raw_value): the first words of persons' names as they were typed, each with the first of its rows; the test mails name nobody of the registry in full."""
    rows = table(spark, sf, "entity_registry").where((F.lower(F.trim("entity_type")) == "person") & F.col("raw_value").rlike(r"^\p{L}{3,} ") & F.col("confirmed").isNotNull())
    return rows.groupBy(F.regexp_extract("raw_value", r"^(\p{L}{3,}) ", 1).alias("raw_value")).agg(F.min("id").alias("id"))


@query(rf"""WITH {_GIVEN}, t AS (SELECT DISTINCT id, lower(text) AS low FROM parsed_content WHERE text IS NOT NULL)
SELECT DISTINCT t.id, p.id AS entity_id FROM t JOIN p ON contains({_framed.format('low')}, {_framed.format('lower(name)')})""")
def theta_entity_mention(spark: SparkSession, sf: str) -> DataFrame:
    """Which mails and notes hold which given names of the registry, as whole words."""
    names = _given_names(spark, sf).withColumnRenamed("id", "entity_id")
    return matching.mentions(stats.repeated_once(table(spark, sf, "parsed_content")), "id", "text", names, "entity_id", "raw_value")


@query(f"""WITH {V.INSIGHTS}, s AS (SELECT case_id, min(created_at) AS a, CASE WHEN case_id NOT LIKE '%7' THEN max(created_at) END AS b FROM cost_logs WHERE case_id IS NOT NULL GROUP BY 1)
SELECT i.id, s.case_id AS span FROM insights i JOIN s ON s.a <= i.created_at AND (s.b IS NULL OR i.created_at <= s.b)""")
def interval_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Which cases were running when an insight was made; some have no end yet."""
    spans = table(spark, sf, "cost_logs").where("case_id is not null").groupBy(F.col("case_id").alias("span")).agg(F.min("created_at").alias("a"), F.max("created_at").alias("b"))
    spans = spans.withColumn("b", F.when(~F.col("span").endswith("7"), F.col("b")))
    return matching.during(V.insights(spark, sf).select("id", "created_at"), "created_at", spans, "a", "b").select("id", "span")


@query("""WITH f AS (SELECT DISTINCT lower(trim(entity_type)) AS entity_type, trim(raw_value) AS value FROM entity_registry),
r AS (SELECT lower(trim(entity_type)) AS t, lower(trim(normalised_value)) AS v, arg_min({'d': display_name, 'a': anonymise_in_prompts, 'p': placeholder_name}, id) AS x FROM entity_registry WHERE confirmed GROUP BY 1, 2)
SELECT f.entity_type, value, r.t IS NOT NULL AS known, CASE WHEN x.a THEN coalesce(x.p, '[' || upper(f.entity_type) || ']') ELSE coalesce(x.d, value) END AS shown FROM f LEFT JOIN r ON r.t = f.entity_type AND r.v = lower(trim(value))""")
def lookup_registry(spark: SparkSession, sf: str) -> DataFrame:
    reg = table(spark, sf, "entity_registry")
    found = reg.select(F.lower(F.trim("entity_type")).alias("entity_type"), F.trim("raw_value").alias("value")).distinct()
    return matching.resolve(found, reg)


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_one(spark: SparkSession, sf: str) -> DataFrame:
    return matching.latest_each(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query(f"""WITH {V.INSIGHTS}, big AS (SELECT case_id FROM insights WHERE case_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 5) SELECT id FROM insights WHERE case_id IN (SELECT case_id FROM big)""")
def in_list(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.insights(spark, sf)
    big = rows.where("case_id is not null").groupBy("case_id").count().where("count >= 5").select("case_id")
    return rows.join(big, "case_id", "left_semi").select("id")


# set-level operators -----------------------------------------------------------------------------
_jt, _jw = "len(list_intersect(a.themes, b.themes))::DOUBLE / len(list_distinct(list_concat(a.themes, b.themes)))", "len(list_intersect(a.w, b.w))::DOUBLE / greatest(1, len(list_distinct(list_concat(a.w, b.w))))"


@query(rf"""WITH {V.INSIGHTS}, x AS (SELECT id, list_distinct(themes) AS themes, list_distinct(regexp_extract_all(lower(summary), '[^\s\p{{Z}}]+')) AS w FROM insights),
s AS (SELECT a.id, b.id AS match, 0.6::DOUBLE * ({_jt}) + 0.4::DOUBLE * ({_jw}) AS score FROM x a JOIN x b ON a.id <> b.id AND a.id % 100 = 0 WHERE {_jt} >= 0.5 AND {_jw} >= 0.25)
SELECT id, match, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, match) AS r FROM s WHERE score >= 0.7) WHERE r = 1""")
def sim_best(spark: SparkSession, sf: str) -> DataFrame:
    """The most similar insight of each searched one; searched are all whose id is divisible by 100."""
    rows = V.insights(spark, sf).select("id", "themes", "summary")
    out = similarity.best_match(rows.where("id % 100 = 0"), rows)
    return out.withColumn("score", F.round("score", 9))


@query(f"""WITH {V.INSIGHTS} SELECT theme, count(DISTINCT id) AS n, min(id) AS first_id FROM (SELECT id, lower(trim(unnest(themes))) AS theme FROM insights) GROUP BY 1""")
def cluster_theme_counts(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.theme_counts(V.insights(spark, sf))


@query()
def cluster_theme(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.by_theme(V.insights(spark, sf))


@query(f"""WITH {V.INSIGHTS}, p AS (SELECT *, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m') AS period FROM insights),
n AS (SELECT period, count(*) AS n, round(avg(significance), 6) AS mean_significance FROM p GROUP BY 1 HAVING count(*) >= 3),
t AS (SELECT period, t, row_number() OVER (PARTITION BY period ORDER BY c DESC, t) AS r FROM (SELECT period, t, count(*) AS c FROM (SELECT period, unnest(themes) AS t FROM p) GROUP BY 1, 2)),
l AS (SELECT period, string_agg(t, '|' ORDER BY r) AS themes FROM t WHERE r <= 5 GROUP BY 1) SELECT n.period, n, mean_significance, themes FROM n JOIN l USING (period)""")
def cluster_time(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.by_time(V.insights(spark, sf)).select("period", "n", F.round("mean_significance", 6).alias("mean_significance"), "themes")


@query(rf"""WITH {_GIVEN}, t AS (SELECT DISTINCT id, lower(text) AS low FROM parsed_content WHERE text IS NOT NULL),
m AS (SELECT DISTINCT t.id, p.id AS entity_id FROM t JOIN p ON contains({_framed.format('low')}, {_framed.format('lower(name)')})) SELECT entity_id, id FROM m WHERE entity_id IN (SELECT entity_id FROM m GROUP BY 1 HAVING count(*) >= 3)""")
def cluster_entity(spark: SparkSession, sf: str) -> DataFrame:
    """Mails and notes by the given names they hold, of names that three of them hold; the texts stand for insights."""
    rows = stats.repeated_once(table(spark, sf, "parsed_content")).select("id", F.col("text").alias("summary"))
    names = _given_names(spark, sf).withColumns({"confirmed": F.lit(True), "entity_type": F.lit("person")})
    return clustering.by_entity(rows, names)


@query()
def cluster_auto(spark: SparkSession, sf: str) -> DataFrame:
    """Theme, period and entity clusters together, the best first."""
    rows = V.insights(spark, sf)
    themes = clustering.by_theme(rows).select(F.concat(F.lit("theme:"), "theme").alias("cluster"), "id")
    keyed = rows.select(clustering.period_key(F.col("created_at"), 30).alias("period"), "id")
    periods = keyed.join(clustering.by_time(rows).select("period"), "period", "left_semi").select(F.concat(F.lit("time:"), "period").alias("cluster"), "id")
    named = clustering.by_entity(rows, table(spark, sf, "entity_registry")).select(F.concat(F.lit("entity:"), F.col("entity_id").cast("string")).alias("cluster"), "id")
    return clustering.combine(themes.unionByName(periods).unionByName(named), rows.select("id", "significance"))


@query(rf"""WITH {V.INSIGHTS}, t AS (SELECT id, unnest(list_distinct(list_transform(themes, lambda x: lower(trim(x))))) AS w FROM insights), p AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text || ' en de size1 email'), '[^\s\p{{Z}}]+'))) AS w FROM eval_items),
c AS (SELECT id, item_id, count(*) AS shared FROM t JOIN p USING (w) GROUP BY 1, 2)
SELECT id, item_id AS pattern_id, shared FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY shared DESC, item_id) AS r FROM c) WHERE r = 1""")
def link_unclustered(spark: SparkSession, sf: str) -> DataFrame:
    """Each insight and its nearest of all patterns."""
    patterns = table(spark, sf, "eval_items").select(F.col("item_id").alias("id"), F.concat("text", F.lit(" en de size1 email")).alias("summary"))
    return clustering.link_loose(V.insights(spark, sf), patterns)


@query("""WITH l AS (SELECT DISTINCT entity_id, insight_id FROM entity_insight_links WHERE entity_id IS NOT NULL AND insight_id IS NOT NULL)
SELECT a.entity_id AS entity_a_id, b.entity_id AS entity_b_id, count(*) AS count FROM l a JOIN l b ON a.insight_id = b.insight_id AND a.entity_id < b.entity_id GROUP BY 1, 2""")
def cooccur(spark: SparkSession, sf: str) -> DataFrame:
    return graph.co_occurrences(table(spark, sf, "entity_insight_links"), "entity_id", "insight_id")


@query(f"WITH {V.EDGES} SELECT dst, weight FROM edges WHERE src = 1 AND weight >= 1 ORDER BY weight DESC, dst LIMIT 20")
def cooccur_of(spark: SparkSession, sf: str) -> DataFrame:
    return graph.neighbours(_edges(spark, sf), 1)


@query("""WITH r AS (SELECT entity_a_id AS src, entity_b_id AS dst, count(*) AS occurrence_count, arg_min(count, id) AS c FROM entity_co_occurrences GROUP BY 1, 2)
SELECT src, dst, occurrence_count, round(least(1.0::DOUBLE, CAST(c % 10 AS DOUBLE) / 10 + 0.1::DOUBLE * (occurrence_count - 1)), 6) AS strength FROM r""")
def rel_accumulate(spark: SparkSession, sf: str) -> DataFrame:
    seen = table(spark, sf, "entity_co_occurrences").select(F.col("entity_a_id").alias("src"), F.col("entity_b_id").alias("dst"), ((F.col("count") % 10) / 10).alias("s"), "id")
    return graph.accumulate_relationships(seen, ["src", "dst"], "s", "id").withColumn("strength", F.round("strength", 6))


@query(f"""WITH {V.EDGES}, s AS (SELECT * FROM edges WHERE weight >= 5), r AS (SELECT dst FROM s WHERE src = 1 UNION SELECT 1), r2 AS (SELECT dst FROM r UNION SELECT s.dst FROM s JOIN r ON s.src = r.dst)
SELECT src, dst, weight FROM s WHERE src < dst AND src IN (SELECT dst FROM r2) AND dst IN (SELECT dst FROM r2)""")
def network(spark: SparkSession, sf: str) -> DataFrame:
    return graph.network(_edges(spark, sf), 1, depth=2, least=5)


def _step(k: int) -> str:
    """The entities first reached by k edges, each with its best path; s has them flat, a all reached so far."""
    return f"""b{k} AS (SELECT dst AS node, min({{'o': list_append(o, -CAST(weight AS DOUBLE)), 'p': list_append(p, dst)}}) AS b FROM s{k - 1} JOIN edges ON src = node WHERE dst NOT IN (SELECT node FROM a{k - 1}) GROUP BY dst),
s{k} AS (SELECT node, b.o AS o, b.p AS p FROM b{k}), a{k} AS (SELECT node FROM a{k - 1} UNION SELECT node FROM s{k})"""


@query(f"""WITH {V.EDGES}, s0 AS (SELECT CAST(1 AS BIGINT) AS node, CAST([] AS DOUBLE[]) AS o, [CAST(1 AS BIGINT)] AS p), a0 AS (SELECT node FROM s0), {', '.join(_step(k) for k in (1, 2, 3, 4))},
found AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4)
SELECT len(p) - 1 AS length, array_to_string(p, '>') AS path FROM found WHERE node = (SELECT max(src) FROM edges)""")
def path_bfs(spark: SparkSession, sf: str) -> DataFrame:
    """A shortest path from entity 1 to the last one of the graph, over all edges."""
    edges = _edges(spark, sf)
    goal = edges.agg(F.max("src").alias("g")).first()["g"]
    return graph.shortest_path(edges, 1, goal if goal is not None else 1).select("length", F.array_join(F.transform("path", lambda p: p.cast("string")), ">").alias("path"))


@query("""WITH RECURSIVE up AS (SELECT id, id AS node, 0 AS steps FROM entity_registry UNION ALL SELECT up.id, e.merged_into_id, steps + 1 FROM up JOIN entity_registry e ON e.id = up.node WHERE e.merged_into_id IS NOT NULL)
SELECT id, arg_max(node, steps) AS root, CAST(max(steps) AS BIGINT) AS steps FROM up GROUP BY 1""")
def run_lineage(spark: SparkSession, sf: str) -> DataFrame:
    return graph.lineage(table(spark, sf, "entity_registry"), "id", "merged_into_id")


@query(f"""WITH {V.SENTIMENT}, r AS (SELECT strftime(said_at, '%Y-%m-%d %H:%M:%S.%f') AS "at", 'sentiment' AS kind, {_label} AS detail FROM sentiment WHERE entity_id = 8
  UNION ALL SELECT strftime(first_seen_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S.%f'), 'relationship', 'met:' || entity_b_id FROM entity_co_occurrences WHERE entity_a_id = 8)
SELECT "at", kind, detail FROM r ORDER BY 1 DESC, kind, detail LIMIT 100""")
def entity_timeline(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.sentiment(spark, sf).withColumns({"label": stats.sentiment_label(F.col("score")), "at": F.col("at").cast("timestamp")})
    met = table(spark, sf, "entity_co_occurrences").select(F.col("entity_a_id").alias("src"), F.col("entity_b_id").alias("dst"), F.lit("met").alias("relationship_type"), F.col("first_seen_at").cast("timestamp").alias("at"))
    return graph.entity_timeline(rows, met, 8).withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("""WITH m AS (SELECT lower(trim(entity_type)) AS t, coalesce(trim(normalised_value), '') AS v, occurrence_count AS n, source_types AS s FROM entity_registry
  UNION ALL SELECT lower(trim(e.entity_type)), coalesce(trim(e.normalised_value), ''), 1, ['insight:' || coalesce(mention_type, 'unknown')] FROM entity_insight_links l JOIN entity_registry e ON e.id = l.entity_id),
u AS (SELECT t, v, string_agg(DISTINCT x, ',' ORDER BY x) AS s FROM (SELECT t, v, unnest(s) AS x FROM m) GROUP BY 1, 2)
SELECT m.t AS entity_type, m.v AS value, CAST(sum(m.n) AS BIGINT) AS occurrence_count, coalesce(any_value(u.s), '') AS source_types FROM m LEFT JOIN u ON u.t = m.t AND u.v = m.v GROUP BY 1, 2""")
def upsert_accumulate(spark: SparkSession, sf: str) -> DataFrame:
    """The registry by type and normalised value, and every mention of an insight added to it as a sighting."""
    kind, value = F.lower(F.trim("entity_type")).alias("entity_type"), F.coalesce(F.trim("normalised_value"), F.lit("")).alias("value")
    reg = table(spark, sf, "entity_registry")
    base = reg.select(kind, value, "occurrence_count", F.coalesce("source_types", F.array().cast("array<string>")).alias("source_types"), "first_seen_at", "last_seen_at")
    links = table(spark, sf, "entity_insight_links").where("entity_id is not null").select(F.col("entity_id").alias("id"), F.concat(F.lit("insight:"), F.coalesce("mention_type", F.lit("unknown"))).alias("source"), "created_at")
    seen = mutations.sightings(links.join(reg.select("id", kind, value), "id"), ["entity_type", "value"], "source", "created_at")
    out = mutations.upsert_accumulate(base, seen, ["entity_type", "value"])
    return out.select("entity_type", "value", "occurrence_count", F.array_join("source_types", ",").alias("source_types"))


@query()
def chunk_time(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events in chunks of a month, small ones merged."""
    out = chunking.chunk_by_time(table(spark, sf, "events"), "user_id", "ts", months=1, least=20)
    return out.select("user_id", "time_chunk", _iso("first_ts"), _iso("last_ts"), "messages")


# mutations ---------------------------------------------------------------------------------------
@query("""SELECT id, status, CAST(chunk_count AS BIGINT) AS chunk_count FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC) AS r FROM (
  SELECT id, status, chunk_count, 1 AS v FROM (SELECT DISTINCT ON (id) * FROM ingested_documents) UNION ALL SELECT document_id, 'chunked', count(*), 2 FROM (SELECT DISTINCT ON (id) * FROM document_chunks) GROUP BY 1)) WHERE r = 1""")
def upsert_replace(spark: SparkSession, sf: str) -> DataFrame:
    base = _docs(spark, sf).select("id", "status", "chunk_count", F.lit(1).alias("v"))
    batch = _chunks(spark, sf).groupBy(F.col("document_id").alias("id")).agg(F.lit("chunked").alias("status"), F.count("*").alias("chunk_count"), F.lit(2).alias("v"))
    return mutations.upsert_replace(base, batch, ["id"], F.col("v")).drop("v")


@query("""SELECT e.id, CASE WHEN m.id IS NOT NULL THEN 'linked' ELSE e.notes END AS notes, CASE WHEN m.id IS NOT NULL THEN TRUE ELSE e.confirmed END AS confirmed FROM entity_registry e LEFT JOIN (SELECT DISTINCT merged_into_id AS id FROM entity_registry WHERE merged_into_id IS NOT NULL) m ON m.id = e.id""")
def partial_update(spark: SparkSession, sf: str) -> DataFrame:
    reg = table(spark, sf, "entity_registry").select("id", "notes", "confirmed", "merged_into_id")
    patch = reg.where("merged_into_id is not null").select(F.col("merged_into_id").alias("id")).distinct().select("id", F.lit("linked").alias("notes"), F.lit(True).alias("confirmed"))
    return mutations.partial_update(reg.select("id", "notes", "confirmed"), patch, ["id"])


@query("""SELECT id, CASE WHEN error_message IS NOT NULL THEN 'rejected' ELSE status END AS status FROM (SELECT DISTINCT ON (id) * FROM ingested_documents)""")
def soft_delete(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf)
    return mutations.soft_delete(docs.select("id", "status"), docs.where("error_message is not null").select("id"), ["id"], "status")


@query("""WITH g AS (SELECT DISTINCT id FROM ingested_documents WHERE error_message IS NOT NULL) SELECT DISTINCT id, document_id FROM document_chunks WHERE document_id NOT IN (SELECT id FROM g) OR document_id IS NULL""")
def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf)
    gone = docs.where("error_message is not null").select("id")
    return mutations.cascade_delete(docs, _chunks(spark, sf), gone, "id", "document_id")[1].select("id", "document_id")


@query("""WITH d AS (SELECT DISTINCT ON (id) * FROM ingested_documents), c AS (SELECT document_id, count(DISTINCT id) AS n FROM document_chunks GROUP BY 1), p AS (SELECT document_id, count(DISTINCT id) AS n FROM parsed_content GROUP BY 1)
SELECT d.id, coalesce(c.n, 0) AS chunks, coalesce(p.n, 0) AS parsed FROM d LEFT JOIN c ON c.document_id = d.id LEFT JOIN p ON p.document_id = d.id""")
def recount(spark: SparkSession, sf: str) -> DataFrame:
    parsed = stats.repeated_once(table(spark, sf, "parsed_content"))
    return mutations.recount(_docs(spark, sf).select("id"), "id", {"chunks": (_chunks(spark, sf), "document_id"), "parsed": (parsed, "document_id")})


@query("""SELECT 'unique id' AS rule, CAST(coalesce(sum(c), 0) AS BIGINT) AS n FROM (SELECT count(*) AS c FROM document_chunks GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'end after start', count(*) FROM document_chunks WHERE NOT coalesce(end_char >= start_char, FALSE)""")
def check_violations(spark: SparkSession, sf: str) -> DataFrame:
    return mutations.violations(table(spark, sf, "document_chunks"), ["id"], {"end after start": F.col("end_char") >= F.col("start_char")})


# filters, pages, searches ------------------------------------------------------------------------
@query(f"""WITH {V.INSIGHTS} SELECT id, status, significance FROM insights WHERE status <> 'merged' AND significance >= 0.5 AND insight_type = 'pattern' ORDER BY significance DESC, id LIMIT 25 OFFSET 10""")
def filt_insights(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of a list; the page size is the feature."""
    rows = V.insights(spark, sf).where("status <> 'merged' and significance >= 0.5 and insight_type = 'pattern'")
    return rows.orderBy(F.desc("significance"), "id").offset(10).limit(25).select("id", "status", "significance")


@query(f"""WITH {V.INSIGHTS} SELECT id FROM insights WHERE list_has_any(themes, ['email', 'chat']) AND created_at BETWEEN TIMESTAMPTZ '2025-02-01 00:00:00+00' AND TIMESTAMPTZ '2025-06-01 00:00:00+00'""")
def filt_tags(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.insights(spark, sf).where(F.arrays_overlap("themes", F.array(F.lit("email"), F.lit("chat"))))
    return rows.where(F.col("created_at").between(F.lit("2025-02-01").cast("timestamp"), F.lit("2025-06-01").cast("timestamp"))).select("id")


@query("SELECT id, raw_value FROM entity_registry WHERE lower(raw_value) LIKE '%son%'")
def search_ci(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "entity_registry").where(F.lower("raw_value").contains("son")).select("id", "raw_value")


@query("SELECT min(id) AS id FROM entity_registry WHERE lower(raw_value) = 'mehmet gisezsen' OR lower(normalised_value) = 'mehmet gisezsen' OR lower(display_name) = 'mehmet gisezsen'")
def find_ci(spark: SparkSession, sf: str) -> DataFrame:
    any_of = [F.lower(c) == "mehmet gisezsen" for c in ("raw_value", "normalised_value", "display_name")]
    return table(spark, sf, "entity_registry").where(any_of[0] | any_of[1] | any_of[2]).agg(F.min("id").alias("id"))


@query("SELECT DISTINCT case_id FROM cost_logs WHERE case_id IS NOT NULL")
def distinct_cases(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "cost_logs").where("case_id is not null").select("case_id").distinct()


@query(f"""WITH {V.INSIGHTS}, r AS (SELECT id, CASE WHEN len(regexp_extract_all(summary, '[^\\s\\p{{Z}}]+')) < 50 THEN 'words < 50' END AS a, CASE WHEN created_at < TIMESTAMPTZ '2025-02-01 00:00:00+00' THEN 'before 2025-02-01' END AS b, CASE WHEN NOT contains(lower(summary), 'the') THEN 'no keyword match' END AS c FROM insights)
SELECT id, coalesce(c, b, a) AS reason FROM r""")
def preflight_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Why an item is left out, null if it is not; of several reasons the last filter's holds."""
    rows = V.insights(spark, sf)
    words = F.when(T.word_count(F.col("summary")) < 50, "words < 50")
    early = F.when(F.col("created_at") < F.lit("2025-02-01").cast("timestamp"), "before 2025-02-01")
    keyword = F.when(~F.lower("summary").contains("the"), "no keyword match")
    return rows.select("id", F.coalesce(keyword, early, words).alias("reason"))


@query(f"""WITH {V.INSIGHTS} SELECT id, CASE WHEN id % 3 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS sentiment FROM insights""")
def emotion_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    return V.insights(spark, sf).select("id", stats.emotion_sentiment(F.col("emotional_tags")).alias("sentiment"))


_members = f"""WITH {V.INSIGHTS}, m AS (SELECT DISTINCT 'theme:' || unnest(themes) AS cluster, id FROM insights UNION SELECT 'case:' || case_id, id FROM insights WHERE case_id IS NOT NULL),
n AS (SELECT cluster, count(*) AS n FROM m GROUP BY 1), s AS (SELECT x.cluster AS a, y.cluster AS b, count(*) AS shared FROM m x JOIN m y ON x.id = y.id AND x.cluster < y.cluster GROUP BY 1, 2)"""


def _clusters(spark, sf):
    rows = V.insights(spark, sf)
    return rows.select(F.explode(F.transform("themes", lambda t: F.concat(F.lit("theme:"), t))).alias("cluster"), "id").unionByName(rows.where("case_id is not null").select(F.concat(F.lit("case:"), "case_id").alias("cluster"), "id"))


@query(_members + """ SELECT a, b, shared, round(CAST(shared AS DOUBLE) / (na.n + nb.n - shared), 9) AS similarity FROM s JOIN n na ON na.cluster = a JOIN n nb ON nb.cluster = b WHERE CAST(shared AS DOUBLE) / (na.n + nb.n - shared) >= 0.05""")
def pattern_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.overlapping(_clusters(spark, sf), 0.05).withColumn("similarity", F.round("similarity", 9))


@query(_members + """ SELECT DISTINCT a, b FROM s WHERE split_part(a, ':', 1) = split_part(b, ':', 1)""")
def syntheses_related(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of one kind that share an insight; the insights stand for patterns."""
    rows = _clusters(spark, sf).groupBy(F.col("cluster").alias("id"), F.split("cluster", ":")[0].alias("kind")).agg(F.collect_set("id").alias("pattern_ids"))
    return patterns.related(rows)


@query(f"""WITH {V.INSIGHTS} SELECT 'pattern' AS source, id, confidence * 0.7 AS significance, CAST(0.4 AS DOUBLE) AS confidence FROM insights WHERE insight_type = 'pattern'""")
def emerging_themes(spark: SparkSession, sf: str) -> DataFrame:
    """Insights of the type pattern stand for patterns."""
    rows = V.insights(spark, sf)
    found = rows.where("insight_type = 'pattern'").select("id", "summary", F.col("confidence").alias("strength"))
    return patterns.emerging(found, rows).select("source", "id", "significance", "confidence")


@query(f"""WITH {V.INSIGHTS} SELECT 'insight' AS source, id, significance * 0.5 AS significance, CAST(0.3 AS DOUBLE) AS confidence FROM insights ORDER BY insights.significance DESC, id LIMIT 3""")
def emerging_insights(spark: SparkSession, sf: str) -> DataFrame:
    """What emerges while no pattern has been found yet: the three most significant insights."""
    rows = V.insights(spark, sf)
    none = spark.createDataFrame([], "id long, summary string, strength double")
    return patterns.emerging(none, rows).select("source", "id", "significance", "confidence")


@query(f"""WITH {V.INSIGHTS} SELECT status, count(*) AS n, round(avg(confidence), 6) AS mean, min(confidence) AS least, max(confidence) AS greatest, round(CAST(count(*) FILTER (confidence >= 0.5) AS DOUBLE) / count(*), 6) AS pass_rate FROM insights GROUP BY 1""")
def agg_critique_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Scores by status, and the share that passes 0.5."""
    out = V.insights(spark, sf).groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean"), F.min("confidence").alias("least"), F.max("confidence").alias("greatest"), F.count_if(F.col("confidence") >= 0.5).alias("ok"))
    return out.select("status", "n", "mean", "least", "greatest", F.round(F.col("ok") / F.col("n"), 6).alias("pass_rate"))


@query(f"""WITH {V.INSIGHTS} SELECT coalesce(case_id, 'none') AS case_id, count(*) AS n, count(*) FILTER (status = 'surfaced') AS verified, CAST(round(100.0 * count(*) FILTER (status = 'surfaced') / count(*), 1) AS DOUBLE) AS verified_rate FROM insights GROUP BY 1""")
def agg_findings_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = V.insights(spark, sf).groupBy(F.coalesce("case_id", F.lit("none")).alias("case_id")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "surfaced").alias("verified"))
    return out.withColumn("verified_rate", F.round(F.col("verified") * 100 / F.col("n"), 1))


@query("""SELECT event_id, event_type, user_id FROM events WHERE event_type IN ('purchase', 'error') AND ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00' ORDER BY ts DESC, event_id LIMIT 50""")
def filt_timeline(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").where(F.col("event_type").isin("purchase", "error") & (F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-12").cast("timestamp_ntz")))
    return rows.orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "event_type", "user_id")


@query("""WITH j AS (SELECT DISTINCT ON (id) id, file_size, ingested_at FROM ingested_documents WHERE status = 'pending') SELECT id FROM j ORDER BY file_size DESC, ingested_at, id LIMIT 10""")
def topk_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).where("status = 'pending'").orderBy(F.desc("file_size"), "ingested_at", "id").limit(10).select("id")
