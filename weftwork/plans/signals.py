"""Queries of the text signals over all documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.functions import lexicons as L
from weftwork.functions import signals as S
from weftwork.functions import text as T
from weftwork.session import spread, table


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text", "lang"))


def _pick(*columns: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        out = S.with_signals(_docs(spark, sf))
        arrays = {n for n, t in out.dtypes if t.startswith("array")}
        return out.select("doc_id", *[F.array_join(c, "|").alias(c) if c in arrays else c for c in columns])

    return query


def _values(name: str, expression, text: str = "text"):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        value = expression(F.coalesce(F.col(text), F.lit("")))
        return _docs(spark, sf).select("doc_id", F.array_join(value, "|").alias(name))

    return query


def t0_flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Signals by language: documents, words, mean sentence length, and how many have each flag."""
    out = S.with_signals(_docs(spark, sf))
    return out.groupBy(F.coalesce("lang", F.lit("?")).alias("lang")).agg(
        F.count("*").alias("documents"), F.sum("word_count").alias("words"), F.sum("sentence_count").alias("sentences"), F.sum("keyword_count").alias("keywords"),
        *[F.sum(F.col(f).cast("long")).alias(f) for f in ("high_emotion", "self_reflective", "narrative", "analytical")],
    )


def t0_people(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf).withColumn("p", S.people(F.coalesce("text", F.lit(""))))
    return docs.select("doc_id", F.explode("p").alias("p")).select("doc_id", F.col("p.name").alias("name"), F.col("p.confidence").alias("confidence"))


def t0_spans(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf).select("doc_id", *[S.spans_with_context(k)("text").alias(k) for k in ("dates", "times", "currency", "phones", "emails")])
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("spans")) for k in ("dates", "times", "currency", "phones", "emails")])).alias("k")
    return docs.select("doc_id", kinds).select("doc_id", "k.kind", F.explode("k.spans").alias("s")).select("doc_id", "kind", "s.raw", "s.normalised", "s.context")


def t0_summary(spark: SparkSession, sf: str) -> DataFrame:
    return S.summary(S.with_signals(_docs(spark, sf))).select("doc_id", "signal_summary")


def t0_json(spark: SparkSession, sf: str) -> DataFrame:
    """The signals as a JSON text and read back: the round trip keeps every value."""
    out = S.with_signals(_docs(spark, sf))
    columns = [c for c in out.columns if c not in ("doc_id", "text", "lang")]
    packed = out.select("doc_id", F.struct(*columns).alias("s")).withColumn("json", F.to_json("s"))
    kind = packed.schema["s"].dataType
    told = [F.get_json_object("json", f"$.{c}").alias(c) for c in ("word_count", "char_count", "question_count", "high_emotion")]
    return packed.withColumn("back", F.from_json("json", kind)).select("doc_id", *told, F.col("s").eqNullSafe(F.col("back")).alias("round_trip"))


def t0_low_confidence(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf).withColumn("p", S.low_confidence(S.people(F.coalesce("text", F.lit("")))))
    return docs.select("doc_id", F.explode("p.name").alias("name"))


QUERIES = {
    "t0_flagship": t0_flagship, "t0_counts": _pick("word_count", "char_count"), "t0_emotion": _pick("keywords_found", "categories", "keyword_count", "keyword_density"),
    "t0_punctuation": _pick("exclamations", "all_caps_words", "repeated_punctuation"), "t0_intensifiers": _pick("intensifiers", "hedges"), "t0_absolutes": _pick("absolutes"),
    "t0_questions": _pick("question_count", "question_density", "rhetorical_likely"), "t0_self_inquiry": _pick("self_inquiry"),
    "t0_temporal": _pick("past_refs", "present_refs", "future_refs", "habitual_refs"), "t0_structure": _pick("paragraph_count", "sentence_count", "avg_sentence_length", "longest_sentence", "speaker_changes"),
    "t0_flags": _pick("high_emotion", "self_reflective", "narrative", "analytical"),
    "t0_emails": _values("emails", S.emails), "t0_email_domains": _values("domains", S.email_domains), "t0_phones": _values("phones", S.phones), "t0_dates": _values("dates", S.dates),
    "t0_times": _values("times", S.times), "t0_currency": _values("amounts", S.currency), "t0_orgs": _values("organisations", S.organisations), "t0_addresses": _values("addresses", S.addresses),
    "t0_cities": _values("cities", S.cities), "t0_people": t0_people, "t0_spans": t0_spans, "t0_summary": t0_summary, "t0_json": t0_json, "t0_low_confidence": t0_low_confidence,
}


# SQL ---------------------------------------------------------------------------------------------
def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_array(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


BASE = r"""
WITH base AS (
  SELECT doc_id, lang, CASE WHEN text IS NULL OR NOT regexp_matches(text, '[^\s\p{Z}]') THEN '' ELSE text END AS t FROM documents),
b AS (SELECT doc_id, lang, t, lower(t) AS low, regexp_extract_all(t, '[^\s\p{Z}]+') AS words, list_distinct(regexp_extract_all(lower(t), '[\p{L}\p{N}_]+')) AS toks FROM base)
"""


def sql_whole(terms) -> str:
    single, phrases = [t for t in terms if " " not in t], [t for t in terms if " " in t]
    more = "".join(f", CASE WHEN contains(low, {q(p)}) THEN {q(p)} END" for p in phrases)
    return f"list_sort(list_filter(list_concat(list_intersect(toks, {sql_array(single)}), [NULL{more}]), lambda x: x IS NOT NULL))"


def sql_contained(terms) -> str:
    cases = ", ".join(f"CASE WHEN contains(low, {q(p.lower())}) THEN {q(p)} END" for p in terms)
    return f"list_sort(list_filter([{cases}], lambda x: x IS NOT NULL))"


def sql_all(pattern: str, group: int = 0, flags: str = "(?i)", text: str = "t") -> str:
    return f"regexp_extract_all({text}, {q(flags + pattern)}, {group})"


def sql_first(lists: list[str], cap: int, lower: bool = False) -> str:
    """Distinct without case in order of first appearance."""
    body = "list_concat(" + ", ".join(lists) + ")" if len(lists) > 1 else lists[0]
    value = "lower(trim(x))" if lower else "trim(x)"
    return (
        f"coalesce(array_to_string((SELECT list(v ORDER BY o) FROM (SELECT arg_min({value}, o) AS v, min(o) AS o FROM (SELECT unnest(l) AS x, generate_subscripts(l, 1) AS o FROM (SELECT {body} AS l)) GROUP BY lower(trim(x)) ORDER BY o LIMIT {cap})), '|'), '')"
    )


def sql_join(expression: str) -> str:
    return f"array_to_string({expression}, '|')"


def _temporal_sql(when: str) -> str:
    found = "list_concat(" + ", ".join(sql_all(p, 1 if "(" in p else 0) for p in L.TEMPORAL[when]) + ")"
    return f"list_sort(list_distinct({found}))[1:5]"


_keywords = sorted({k for ks in L.EMOTIONS.values() for k in ks})
_categories = ", ".join(f"CASE WHEN len({sql_whole(ks)}) > 0 THEN {q(c)} END" for c, ks in L.EMOTIONS.items())
_n = "greatest(len(words), 1)"
_questions = r"regexp_extract_all(t, '[^.!?]*\?')"
_inquiry = " + ".join(f"len({sql_all(p)})" for p in L.SELF_INQUIRY)
_speakers = " + ".join(f"len({sql_all(p, 0, '(?m)')})" for p in L.SPEAKERS)
_lengths = r"list_transform(list_filter(regexp_split_to_array(t, '[.!?]+'), lambda s: regexp_matches(s, '[^\s\p{Z}]')), lambda s: len(regexp_extract_all(s, '[^\s\p{Z}]+')))"
_paragraphs = r"len(list_filter(string_split(t, chr(10) || chr(10)), lambda p: regexp_matches(p, '[^\s\p{Z}]')))"
_exclaim, _caps = "len(regexp_extract_all(t, '!'))", r"len(list_filter(words, lambda w: regexp_matches(w, '^\p{Lu}{3,}$')))"
_flags = f"""
  (len({sql_whole(_keywords)}) >= 2 OR {_exclaim} >= 2 OR {_caps} >= 1 OR len({sql_whole(L.ABSOLUTES)}) >= 2) AS high_emotion,
  ({_inquiry} >= 1 OR CAST(len({_questions}) AS DOUBLE) / {_n} > 0.02) AS self_reflective,
  (len({_temporal_sql("past")}) >= 2 OR {_paragraphs} >= 3) AS narrative, (len({sql_contained(L.HEDGES)}) >= 2 AND len({_questions}) >= 2) AS analytical"""

ORACLES = {
    "t0_flagship": BASE + f""", f AS (SELECT lang, len(words) AS w, len({_lengths}) AS s, len({sql_whole(_keywords)}) AS k, {_flags} FROM b)
SELECT coalesce(lang, '?') AS lang, count(*) AS documents, CAST(sum(w) AS BIGINT) AS words, CAST(sum(s) AS BIGINT) AS sentences, CAST(sum(k) AS BIGINT) AS keywords,
  {', '.join(f'CAST(sum(CAST({c} AS INTEGER)) AS BIGINT) AS {c}' for c in ('high_emotion', 'self_reflective', 'narrative', 'analytical'))} FROM f GROUP BY 1""",
    "t0_counts": BASE + "SELECT doc_id, len(words) AS word_count, length(t) AS char_count FROM b",
    "t0_emotion": BASE + f"SELECT doc_id, {sql_join(sql_whole(_keywords))} AS keywords_found, {sql_join(f'list_sort(list_filter([{_categories}], lambda x: x IS NOT NULL))')} AS categories, len({sql_whole(_keywords)}) AS keyword_count, CAST(len({sql_whole(_keywords)}) AS DOUBLE) / {_n} AS keyword_density FROM b",
    "t0_punctuation": BASE + f"SELECT doc_id, {_exclaim} AS exclamations, {_caps} AS all_caps_words, len(regexp_extract_all(t, '[!?]{{2,}}')) AS repeated_punctuation FROM b",
    "t0_intensifiers": BASE + f"SELECT doc_id, {sql_join(sql_contained(L.INTENSIFIERS))} AS intensifiers, {sql_join(sql_contained(L.HEDGES))} AS hedges FROM b",
    "t0_absolutes": BASE + f"SELECT doc_id, {sql_join(sql_whole(L.ABSOLUTES))} AS absolutes FROM b",
    "t0_questions": BASE + rf"SELECT doc_id, len({_questions}) AS question_count, CAST(len({_questions}) AS DOUBLE) / {_n} AS question_density, len(list_filter({_questions}, lambda x: len(regexp_extract_all(x, '[^\s\p{{Z}}]+')) < 5 OR contains(lower(x), 'really') OR contains(lower(x), 'right?'))) AS rhetorical_likely FROM b",
    "t0_self_inquiry": BASE + f"SELECT doc_id, {_inquiry} AS self_inquiry FROM b",
    "t0_temporal": BASE + f"SELECT doc_id, {', '.join(f'{sql_join(_temporal_sql(w))} AS {w}_refs' for w in L.TEMPORAL)} FROM b",
    "t0_structure": BASE + f"SELECT doc_id, {_paragraphs} AS paragraph_count, len({_lengths}) AS sentence_count, CASE WHEN len({_lengths}) > 0 THEN round(CAST(list_sum({_lengths}) AS DOUBLE) / len({_lengths}), 1) ELSE 0.0 END AS avg_sentence_length, CAST(coalesce(list_max({_lengths}), 0) AS BIGINT) AS longest_sentence, {_speakers} AS speaker_changes FROM b",
    "t0_flags": BASE + f"SELECT doc_id, {_flags} FROM b",
    "t0_emails": BASE + f"SELECT doc_id, {sql_first([sql_all(L.EMAIL)], 20, True)} AS emails FROM b",
    "t0_email_domains": BASE + f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split({sql_first([sql_all(L.EMAIL)], 20, True)}, '|'), lambda e: split_part(e, '@', 2)), lambda x: x <> ''))), '|') AS domains FROM b",
    "t0_phones": BASE + "SELECT doc_id, " + sql_first(["list_transform(list_concat(" + ", ".join(sql_all(p, 0, "") for p in L.PHONES) + r"), lambda p: regexp_replace(p, '[\s\-()]', '', 'g'))"], 20) + " AS phones FROM b",
    "t0_json": BASE + f", f AS (SELECT doc_id, len(words) AS w, length(t) AS c, len({_questions}) AS k, {_flags} FROM b) SELECT doc_id, CAST(w AS VARCHAR) AS word_count, CAST(c AS VARCHAR) AS char_count, CAST(k AS VARCHAR) AS question_count, CAST(high_emotion AS VARCHAR) AS high_emotion, TRUE AS round_trip FROM f",
    "t0_summary": BASE + f""", f AS (SELECT doc_id, {sql_whole(_keywords)} AS k, list_sort(list_filter([{_categories}], lambda x: x IS NOT NULL)) AS g, {_flags}, {_temporal_sql("past")} AS p, {_exclaim} AS e, {sql_whole(L.ABSOLUTES)} AS a, {_inquiry} AS i FROM b),
l AS (SELECT doc_id, array_to_string(list_filter([CASE WHEN len(k) > 0 THEN '- Emotion keywords: ' || array_to_string(k[1:5], ', ') END, CASE WHEN len(g) > 0 THEN '- Emotion categories: ' || array_to_string(g[1:3], ', ') END,
  CASE WHEN high_emotion OR self_reflective OR narrative OR analytical THEN '- Flags: ' || array_to_string(list_filter([CASE WHEN high_emotion THEN 'high emotion' END, CASE WHEN self_reflective THEN 'self reflective' END, CASE WHEN narrative THEN 'narrative' END, CASE WHEN analytical THEN 'analytical' END], lambda x: x IS NOT NULL), ', ') END,
  CASE WHEN len(p) > 0 THEN '- Past references: ' || array_to_string(p[1:3], ', ') END, CASE WHEN e >= 2 THEN '- High exclamation count: ' || e END, CASE WHEN len(a) > 0 THEN '- Absolute statements: ' || array_to_string(a[1:3], ', ') END,
  CASE WHEN i >= 1 THEN '- Self-inquiry questions: ' || i END], lambda x: x IS NOT NULL), chr(10)) AS s FROM f)
SELECT doc_id, CASE WHEN s = '' THEN 'No significant signals detected.' ELSE s END AS signal_summary FROM l""",
    "t0_dates": BASE + f"SELECT doc_id, {sql_first([sql_all(p, 1) for p in L.DATES], 20)} AS dates FROM b",
    "t0_times": BASE + f"SELECT doc_id, {sql_first([sql_all(p, 1) for p in L.TIMES], 20, True)} AS times FROM b",
    "t0_currency": BASE + f"SELECT doc_id, {sql_first([sql_all(p, 1) for p in L.CURRENCY], 20)} AS amounts FROM b",
    "t0_orgs": BASE + f"SELECT doc_id, {sql_first([sql_all(p, 1, '') for p in L.ORGANISATIONS], 15)} AS organisations FROM b",
    "t0_addresses": BASE + f"SELECT doc_id, {sql_first([sql_all(p, 1) for p in L.ADDRESSES], 15)} AS addresses FROM b",
    "t0_cities": BASE + f"SELECT doc_id, {sql_join(f'list_sort(list_intersect(list_distinct(list_concat(list_transform({sql_all(L.CITY, 1)}, lambda c: lower(c)), list_transform({sql_all(L.CITY, 1)}, lambda c: lower(regexp_extract(c, chr(94) || chr(92) || chr(83) || chr(43)))))), {sql_array(L.CITIES)}))')} AS cities FROM b",
}
