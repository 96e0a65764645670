"""Queries of the general (core) data problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.operators import instants, rolling
from weftwork.session import table


def p4_instants(spark: SparkSession, sf: str) -> DataFrame:
    """Every dated row of both tables with its instant (null if its text names none); repeated rows once."""
    parts = []
    for src, column in (("parsed_content", "date"), ("ingested_documents", "doc_date")):
        parts.append(
            table(spark, sf, src).select(
                F.lit(src).alias("src"), F.col("id").alias("row_id"), F.col(column).alias("written"),
                F.get_json_object("metadata", "$.tz").alias("tz"), F.get_json_object("metadata", "$.locale").alias("locale"),
            )
        )
    rows = instants.normalise_instants(parts[0].unionByName(parts[1]), "written", "tz", "locale", "instant").distinct()
    return rows.withColumn("instant", F.date_format("instant", "yyyy-MM-dd HH:mm:ss"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = p4_instants(spark, sf).where(F.col("instant").isNotNull())
    return rows.select("src", "row_id", F.col("instant").alias("utc")).distinct()


def p6_rolling(spark: SparkSession, sf: str) -> DataFrame:
    """Totals and daily averages of each day of each case and feature, and the version of the state that says so."""
    return rolling.rolling_costs(table(spark, sf, "cost_logs")).withColumn("day", F.col("day").cast("string"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    found = rolling.spikes(*rolling.rolling_state(table(spark, sf, "cost_logs")))
    return found.select("case_id", "feature", F.date_format("day", "yyyy-MM-dd").alias("day"))


QUERIES = {"p4_found": p4_found, "p4_instants": p4_instants, "p6_found": p6_found, "p6_rolling": p6_rolling}

# Of rows under one id the one loaded last holds; days within 30 of a record that came late, or was changed late, have version 2.
_P6 = """
WITH said AS (
  SELECT id, case_id, lower(trim(coalesce(feature, ''))) AS feature, CAST(created_at AT TIME ZONE 'UTC' AS DATE) AS day, CAST(coalesce(loaded_at, created_at) AT TIME ZONE 'UTC' AS DATE) AS load_day,
         coalesce(CAST(round(total_cost * 1000000) AS BIGINT), 0) AS amount
  FROM cost_logs WHERE case_id IS NOT NULL AND created_at IS NOT NULL),
one AS (SELECT id, max((load_day, amount, case_id, feature, day)) AS l, max((load_day, amount, case_id, feature, day)) FILTER (load_day - day <= 1) AS f FROM said GROUP BY id),
final AS (SELECT l[3] AS case_id, l[4] AS feature, l[5] AS day, l[2] AS amount FROM one),
late AS (SELECT case_id, feature, day FROM (
  SELECT l[3] AS case_id, l[4] AS feature, l[5] AS day, f, l FROM one UNION ALL SELECT f[3], f[4], f[5], f, l FROM one WHERE f IS NOT NULL) WHERE f IS NULL OR (f[2], f[3], f[4], f[5]) <> (l[2], l[3], l[4], l[5])),
daily AS (SELECT case_id, feature, day, CAST(sum(amount) AS BIGINT) AS amount FROM final GROUP BY ALL),
spans AS (SELECT case_id, feature, min(day) AS first_day, max(day) AS last_day FROM daily GROUP BY ALL),
spine AS (SELECT case_id, feature, first_day, CAST(unnest(generate_series(first_day, last_day, INTERVAL 1 DAY)) AS DATE) AS day FROM spans),
marked AS (SELECT DISTINCT case_id, feature, CAST(unnest(generate_series(day, day + INTERVAL 29 DAY, INTERVAL 1 DAY)) AS DATE) AS day, 2 AS version FROM late),
dense AS (SELECT s.case_id, s.feature, s.day, CAST(s.day - s.first_day + 1 AS INTEGER) AS day_no, coalesce(d.amount, 0) AS amount, coalesce(m.version, 1) AS version
          FROM spine s LEFT JOIN daily d USING (case_id, feature, day) LEFT JOIN marked m USING (case_id, feature, day)),
state AS (
  SELECT case_id, feature, day, day_no, amount, version,
         CAST(sum(amount) OVER (PARTITION BY case_id, feature ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS total_7,
         CAST(sum(amount) OVER (PARTITION BY case_id, feature ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS BIGINT) AS total_30
  FROM dense)
"""

# One branch a family of formats, each with its own pattern; zones as in the tz database, by two probes of their offset a day to either side.
_MON = "coalesce(nullif(list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(strip_accents(substring(m.mon, 1, 3)))), 0), CASE lower(substring(m.mon, 1, 3)) WHEN 'mai' THEN 5 WHEN 'okt' THEN 10 WHEN 'dez' THEN 12 WHEN 'mär' THEN 3 END)"


def _family(pattern: str, names: str, y: str = "m.y", mo: str = "m.mo", d: str = "m.d", off: str = "''", abbr: str = "''", zone: str = "''", ap: str = "''", s: str = "m.s") -> str:
    listed = ", ".join(f"'{n}'" for n in names.split())
    return f"""SELECT src, row_id, written, tz, locale, {y} AS y, CAST({mo} AS VARCHAR) AS mo, CAST({d} AS VARCHAR) AS d, m.h AS h, m.mi AS mi, {s} AS s, lower({ap}) AS ap, {off} AS off, {abbr} AS abbr, {zone} AS zone
FROM (SELECT *, regexp_extract(written, '^\\s*{pattern}\\s*$', [{listed}]) AS m FROM r WHERE regexp_matches(written, '^\\s*{pattern}\\s*$'))"""


_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?(?:\s*([AaPp])[Mm])?(?: Uhr)?"
_PLUS = r"\s*([Zz]|[+-]\d{2}(?::?\d{2})?)?(?:\s*\(?([A-Z]{2,5})\)?)?"
_FAMILIES = [
    _family(r"(\d{4})-(\d{1,2})-(\d{1,2})(?:T|\s+)" + _CLOCK + _PLUS, "y mo d h mi s ap off abbr", off="m.off", abbr="m.abbr", ap="m.ap"),
    _family(r"(?:;?TZID=([A-Za-z_/]+):)?(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})?(Z)?", "zone y mo d h mi s off", off="m.off", zone="m.zone"),
    _family(r"(\d{4})/(\d{1,2})/(\d{1,2}) (\d{1,2})[.](\d{2})(?:[.](\d{2}))?", "y mo d h mi s"),
    _family(r"(?:\p{L}+, )?(\d{1,2})[.]? (\p{L}+)[.]? (\d{4}),? " + _CLOCK + _PLUS, "d mon y h mi s ap off abbr", mo=_MON, off="m.off", abbr="m.abbr", ap="m.ap"),
    _family(r"(\p{L}+) (\d{1,2}), (\d{4}) at " + _CLOCK, "mon d y h mi s ap", mo=_MON, ap="m.ap"),
    _family(r"(\d{1,2})[.](\d{1,2})[.](\d{4}) " + _CLOCK, "d mo y h mi s ap", ap="m.ap"),
    _family(r"(\d{1,2})/(\d{1,2})/(\d{4}|\d{2}),? " + _CLOCK, "mo d y h mi s ap", mo="CASE WHEN locale = 'en_US' THEN m.mo ELSE m.d END", d="CASE WHEN locale = 'en_US' THEN m.d ELSE m.mo END", ap="m.ap"),
]
_P4 = (
    """
WITH r AS (
  SELECT DISTINCT 'parsed_content' AS src, id AS row_id, date AS written, json_extract_string(metadata, '$.tz') AS tz, json_extract_string(metadata, '$.locale') AS locale FROM parsed_content
  UNION SELECT DISTINCT 'ingested_documents', id, doc_date, json_extract_string(metadata, '$.tz'), json_extract_string(metadata, '$.locale') FROM ingested_documents),
parts AS (
"""
    + "\nUNION ALL\n".join(_FAMILIES)
    + """),
abbreviations AS (SELECT * FROM (VALUES ('America/Los_Angeles', 'PST', -28800), ('America/Los_Angeles', 'PDT', -25200), ('America/New_York', 'EST', -18000), ('America/New_York', 'EDT', -14400),
  ('Australia/Adelaide', 'ACST', 34200), ('Australia/Adelaide', 'ACDT', 37800), ('Australia/Sydney', 'AEST', 36000), ('Australia/Sydney', 'AEDT', 39600), ('Europe/London', 'GMT', 0), ('Europe/London', 'BST', 3600),
  ('Europe/Berlin', 'CET', 3600), ('Europe/Berlin', 'CEST', 7200), ('Asia/Kolkata', 'IST', 19800), ('UTC', 'UTC', 0)) v(z, a, o)),
clock AS (SELECT *, coalesce(nullif(zone, ''), nullif(trim(tz), ''), 'UTC') AS zn, CAST(h AS INTEGER) AS hour,
  CASE WHEN ap = '' THEN CAST(h AS INTEGER) WHEN CAST(h AS INTEGER) BETWEEN 1 AND 12 THEN CAST(h AS INTEGER) % 12 + CASE ap WHEN 'p' THEN 12 ELSE 0 END END AS h24 FROM parts),
walls AS (SELECT *, CASE WHEN h24 <= 23 THEN epoch(TRY_CAST(CASE WHEN length(y) = 2 THEN '20' ELSE '' END || y || '-' || lpad(mo, 2, '0') || '-' || lpad(d, 2, '0') || ' ' || lpad(CAST(h24 AS VARCHAR), 2, '0') || ':' || mi || ':' || coalesce(nullif(s, ''), '00') AS TIMESTAMP)) END AS w FROM clock),
fixed AS (SELECT walls.*, CASE WHEN lower(off) = 'z' THEN 0 WHEN off <> '' THEN CASE WHEN off LIKE '-%' THEN -1 ELSE 1 END * (CAST(substring(off, 2, 2) AS INTEGER) * 3600 + coalesce(TRY_CAST(substring(replace(off, ':', ''), 4, 2) AS INTEGER), 0) * 60) ELSE o END AS f
  FROM walls LEFT JOIN abbreviations ON z = zn AND a = abbr WHERE w IS NOT NULL),
probed AS (SELECT *, epoch(to_timestamp(w - 86400) AT TIME ZONE zn) - (w - 86400) AS before, epoch(to_timestamp(w + 86400) AT TIME ZONE zn) - (w + 86400) AS after FROM fixed),
met AS (SELECT *, epoch(to_timestamp(w - before) AT TIME ZONE zn) = w AS by_before, epoch(to_timestamp(w - after) AT TIME ZONE zn) = w AS by_after FROM probed),
found AS (SELECT src, row_id, written, tz, locale, CASE WHEN f IS NOT NULL THEN w - f WHEN by_before OR NOT by_after THEN w - before ELSE w - after END AS e FROM met
  UNION ALL SELECT src, row_id, written, tz, locale, CASE WHEN length(trim(written)) <= 11 THEN CAST(trim(written) AS BIGINT) ELSE CAST(trim(written) AS BIGINT) // 1000 END FROM r WHERE regexp_matches(written, '^\\s*\\d{9,14}\\s*$'))
"""
)

ORACLES = {
    "p4_found": _P4 + "SELECT DISTINCT src, row_id, strftime(to_timestamp(e) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS utc FROM found",
    "p4_instants": _P4 + "SELECT r.src, r.row_id, r.written, r.tz, r.locale, strftime(to_timestamp(e) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS instant FROM r LEFT JOIN found f ON f.src = r.src AND f.row_id = r.row_id AND f.written IS NOT DISTINCT FROM r.written AND f.tz IS NOT DISTINCT FROM r.tz AND f.locale IS NOT DISTINCT FROM r.locale",
    "p6_found": _P6 + "SELECT case_id, feature, strftime(day, '%Y-%m-%d') AS day FROM state WHERE day_no >= 30 AND 15 * total_7 > 7 * total_30",
    "p6_rolling": _P6 + "SELECT case_id, feature, CAST(day AS VARCHAR) AS day, day_no, amount, total_7, total_30, CAST(version AS INTEGER) AS version, total_7 / 1e6::DOUBLE / 7::DOUBLE AS avg_7, total_30 / 1e6::DOUBLE / 30::DOUBLE AS avg_30 FROM state",
}
