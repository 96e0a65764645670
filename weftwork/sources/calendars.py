"""Calendars and address books: property files whose blocks are cut and read with regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.functions import text as T
from weftwork.operators.instants import normalise_instants


def _blocks(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(path, ordinal, block) of each BEGIN:kind … END:kind, continued lines joined."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace(F.regexp_replace("value", r"\r\n?", "\n"), r"\n[ \t]", "").alias("v"))
    return rows.select("path", F.posexplode(F.regexp_extract_all("v", F.lit(rf"(?s)BEGIN:{kind}\n(.*?)END:{kind}"), F.lit(1))).alias("ordinal", "block"))


def _unescape(value: Column) -> Column:
    out = F.regexp_replace(value, r"\\[nN]", "\n")
    return F.regexp_replace(out, r"\\([,;\\])", "$1")


def _value(name: str) -> Column:
    return F.nullif(_unescape(F.regexp_extract("block", rf"(?m)^{name}(?:;[^:\n]*)?:(.*)$", 1)), F.lit(""))


def _values(name: str) -> Column:
    return F.transform(F.regexp_extract_all("block", F.lit(rf"(?m)^{name}(?:;[^:\n]*)?:(.*)$"), F.lit(1)), lambda v: _unescape(v))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """(path, ordinal, uid, summary, location, description, status, rule, attendees, all_day, starts_at, ends_at); times in UTC, a day alone at its start."""
    rows = _blocks(spark, path, "VEVENT").select(
        "path", "ordinal", _value("UID").alias("uid"), _value("SUMMARY").alias("summary"), _value("LOCATION").alias("location"), _value("DESCRIPTION").alias("description"),
        F.coalesce(_value("STATUS"), F.lit("CONFIRMED")).alias("status"), F.nullif(F.regexp_extract("block", r"(?m)^RRULE:.*FREQ=([A-Z]+)", 1), F.lit("")).alias("rule"),
        F.transform(_values("ATTENDEE"), lambda a: F.regexp_replace(a, "(?i)^mailto:", "")).alias("attendees"), *[_value(n).alias(n) for n in ("DTSTART", "DTEND")],
        *[F.nullif(F.regexp_extract("block", rf"(?m)^{n};[^:\n]*TZID=\"?([^:;\"\n]+)", 1), F.lit("")).alias(f"{n}_tz") for n in ("DTSTART", "DTEND")],
    )
    for name, out in (("DTSTART", "starts_at"), ("DTEND", "ends_at")):
        rows = normalise_instants(rows.withColumn("_locale", F.lit(None).cast("string")), name, f"{name}_tz", "_locale", out).drop("_locale")
        rows = rows.withColumn(out, F.coalesce(out, F.to_timestamp(F.try_to_date(name, "yyyyMMdd"))))
    return rows.withColumn("all_day", F.col("DTSTART").rlike(r"^\d{8}$")).drop("DTSTART", "DTEND", "DTSTART_tz", "DTEND_tz")


def events_summary(events: DataFrame) -> DataFrame:
    """(path, events, first_at, last_at, recurring, all_day, cancelled, locations, attendees)."""
    people = events.select("path", F.explode("attendees").alias("a")).groupBy("path").agg(F.count_distinct("a").alias("attendees"))
    out = events.groupBy("path").agg(
        F.count("*").alias("events"), F.min("starts_at").alias("first_at"), F.max("starts_at").alias("last_at"), F.count("rule").alias("recurring"), F.count_if("all_day").alias("all_day"),
        F.count_if(F.col("status") == "CANCELLED").alias("cancelled"), F.count_distinct("location").alias("locations"),
    )
    return out.join(people, "path", "left").withColumn("attendees", F.coalesce("attendees", F.lit(0)))


def read_contacts(spark: SparkSession, path: str) -> DataFrame:
    """(path, ordinal, name, family, given, phones, emails, organisation, title, note, birthday, categories)."""
    parts = F.split(F.coalesce(_value("N"), F.lit("")), ";")
    return _blocks(spark, path, "VCARD").select(
        "path", "ordinal", _value("FN").alias("name"), F.nullif(F.get(parts, F.lit(0)), F.lit("")).alias("family"), F.nullif(F.get(parts, F.lit(1)), F.lit("")).alias("given"),
        F.transform(_values("TEL"), lambda t: T.normalise_phone(t)).alias("phones"), F.transform(_values("EMAIL"), lambda e: F.lower(F.trim(e))).alias("emails"), F.split(_value("ORG"), ";")[0].alias("organisation"),
        _value("TITLE").alias("title"), _value("NOTE").alias("note"), _value("BDAY").alias("birthday"), F.split(_value("CATEGORIES"), ",").alias("categories"),
    )


def contacts_summary(contacts: DataFrame, k: int = 10) -> DataFrame:
    """(domain, n): the ``k`` most frequent mail domains."""
    domains = contacts.select(F.explode("emails").alias("e")).select(F.substring_index("e", "@", -1).alias("domain"))
    return domains.groupBy("domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(k)
