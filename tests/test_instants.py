"""Instants against a plain parser over whole tables, and edge cases by hand."""

import datetime as dt
import json
import re
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from weftwork.operators.instants import FORMATS, compiled, days_from_civil, normalise_instants, zone_abbreviations
from weftwork.plans.general import p4_found
from weftwork.session import table

MONTHS = "January February March April May June July August September October November December".split()
GERMAN = dict(zip("Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(), MONTHS))


def wall(day, clock, zone):
    """The earlier of two offsets; a skipped time with the offset before the change (fold 0 does both)."""
    return dt.datetime.combine(day, clock, tzinfo=ZoneInfo(zone)).astimezone(dt.timezone.utc)


def plain(text, tz, locale):
    if text is None:
        return None
    text, zone = text.strip(), tz or "UTC"
    if re.fullmatch(r"\d{10}", text):
        return dt.datetime.fromtimestamp(int(text), dt.timezone.utc)
    if re.fullmatch(r"\d{13}", text):
        return dt.datetime.fromtimestamp(int(text) // 1000, dt.timezone.utc)
    m = re.fullmatch(r"TZID=([^:]+):(\d{8}T\d{6})", text)
    if m:
        zone, text = m[1], m[2]
    abbreviation = re.search(r" ([A-Z]{2,5})$", text)
    if abbreviation and abbreviation[1] not in ("AM", "PM"):
        naive = dt.datetime.strptime(text[: abbreviation.start()], "%d %b %Y %I:%M:%S %p")
        for fold in (0, 1):
            at = naive.replace(tzinfo=ZoneInfo(zone), fold=fold)
            if at.tzname() == abbreviation[1]:
                return at.astimezone(dt.timezone.utc)
        offset = {(z, a): o for z, a, o in zone_abbreviations()}[zone, abbreviation[1]]
        return (naive - dt.timedelta(seconds=offset)).replace(tzinfo=dt.timezone.utc)
    text = re.sub(r" \([A-Z]+\)$", "", text)
    text = re.sub(r"^(\d+)\. (\w+) (\d{4}), (.*) Uhr$", lambda m: f"{m[1]} {GERMAN[m[2]]} {m[3]} {m[4]}", text).removesuffix(" Uhr")
    text = re.sub(r"(\.\d+)?Z$", "+0000", text)
    text = re.sub(r"([+-]\d\d)$", r"\g<1>00", text) if re.search(r":\d\d\.\d+[+-]\d\d$", text) else text
    text = re.sub(r"(:\d\d)\.\d+", r"\1", text)
    slash = ["%m/%d/%Y, %H:%M", "%m/%d/%y, %I:%M %p"] if locale == "en_US" else ["%d/%m/%Y, %H:%M", "%d/%m/%y, %I:%M %p"]
    for f in ["%Y-%m-%dT%H:%M:%S%z", "%Y%m%dT%H%M%S%z", "%Y-%m-%d %H:%M:%S%z", "%a, %d %b %Y %H:%M:%S %z", "%d %b %Y %H:%M %z", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M", "%Y/%m/%d %H.%M.%S", "%Y%m%dT%H%M%S", "%B %d, %Y at %I:%M %p", "%d %B %Y %H:%M", "%d.%m.%Y %H:%M", *slash]:
        try:
            at = dt.datetime.strptime(text, f)
        except ValueError:
            continue
        return at.astimezone(dt.timezone.utc) if at.tzinfo else wall(at.date(), at.time(), zone)
    return None


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_whole_tables_against_plain_parser(spark, size):
    sf = f"/root/testdata/{size}"
    found = {(r.src, r.row_id, r.utc) for r in p4_found(spark, sf).collect()}
    wanted = set()
    for src, column in (("parsed_content", "date"), ("ingested_documents", "doc_date")):
        for r in table(spark, sf, src).select("id", column, "metadata").collect():
            meta = json.loads(r.metadata or "{}")
            at = plain(r[column], meta.get("tz"), meta.get("locale"))
            if at:
                wanted.add((src, r.id, at.strftime("%Y-%m-%d %H:%M:%S")))
    assert found == wanted


def one(spark, *rows):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, date string, tz string, locale string")
    out = normalise_instants(df).withColumn("u", F.date_format("instant", "yyyy-MM-dd HH:mm:ss")).orderBy("id")
    return [r.u for r in out.collect()]


def test_clock_changes(spark):
    assert one(
        spark,
        ("2024-03-10 02:30:00", "America/New_York", None),  # skipped: offset before the change
        ("2024-11-03 01:30:00", "America/New_York", None),  # twice: the first
        ("3 Nov 2024 01:30:00 AM EST", "America/New_York", None),  # twice, but the abbreviation tells
        ("2024-10-27 02:30:00", "Europe/Berlin", None),
        ("2024-03-31 02:30:00", "Europe/Berlin", None),
    ) == ["2024-03-10 07:30:00", "2024-11-03 05:30:00", "2024-11-03 06:30:00", "2024-10-27 00:30:00", "2024-03-31 01:30:00"]


def test_ranges_and_no_times(spark):
    bad = ["2024-02-30 10:00:00", "2023-02-29 10:00:00", "2024-13-01 10:00:00", "2024-01-01 24:00:00", "2024-01-01 10:60:00", "0000-00-00 00:00:00", "13:00", "2024-01-01", "June 2022", "", "  ", None, "13/13/2024, 10:00", "1/2/24, 13:00 PM", "Foo 3, 2024 at 1:00 pm"]
    assert one(spark, *[(b, None, None) for b in bad]) == [None] * len(bad)
    assert one(spark, ("2024-02-29 10:00:00", None, None)) == ["2024-02-29 10:00:00"]


def test_locale_zone_and_precision(spark):
    assert one(
        spark,
        ("03/04/2024, 10:00", None, "en_US"), ("03/04/2024, 10:00", None, None), ("3/4/24, 12:05 AM", "UTC", "en_US"), ("3/4/24, 12:05 PM", "UTC", "en_GB"),
        ("2024-01-01 10:00:00", "No/Such_Zone", None), ("2024-01-01 10:00:00", " ", None), ("1700000000", "Asia/Kolkata", None), ("1700000000999", None, None),
        ("2024-01-01T10:00:00.999+0530", None, None), (" TZID=Asia/Kolkata:20240101T100000 ", "America/New_York", None), ("1 Jan 2024 10:00:00 AM XYZ", "Asia/Kolkata", None),
    ) == [
        "2024-03-04 10:00:00", "2024-04-03 10:00:00", "2024-03-04 00:05:00", "2024-04-03 12:05:00", "2024-01-01 10:00:00", "2024-01-01 10:00:00", "2023-11-14 22:13:20", "2023-11-14 22:13:20",
        "2024-01-01 04:30:00", "2024-01-01 04:30:00", "2024-01-01 04:30:00",
    ]


def test_other_columns_stay(spark):
    df = spark.createDataFrame([("2024-01-01 10:00", None, None, "old", 1, "x")], "date string, tz string, locale string, instant string, _y int, `a.b` string")
    df = df.withColumnRenamed("a.b", "a b")
    out = normalise_instants(df)
    assert out.columns == ["date", "tz", "locale", "_y", "a b", "instant"] and out.first()["_y"] == 1
    assert normalise_instants(df.limit(0)).count() == 0
    assert normalise_instants(df.unionAll(df)).count() == 2


def test_very_long_text_and_names(spark):
    assert one(spark, ("2024-01-01 " * 50_000, None, None)) == [None]
    assert compiled()[0].count("(?<y") == len(FORMATS) - 1  # all but the one of plain numbers


def test_day_arithmetic(spark):
    days = spark.range(-800_000, 800_000, 997).select("id", F.date_from_unix_date(F.col("id").cast("int")).alias("d"))
    assert days.where(F.col("id") != days_from_civil(F.year("d").cast("long"), F.month("d").cast("long"), F.dayofmonth("d").cast("long"))).count() == 0


WRITTEN = {
    "2024-03-05 10:22 PM": "2024-03-06 06:22:00", "2024-03-05 12:00 AM": "2024-03-05 08:00:00", "2024-03-05 20:22 PM": None, "2022/01/16 8:35 PM": "2022-01-17 04:35:00",
    "Tue Mar  5 10:22:01 2024": "2024-03-05 18:22:01", "Tue Mar  5 10:22:01 PST 2024": "2024-03-05 18:22:01", "Tue Mar  5 10:22:01 +0100 2024": "2024-03-05 09:22:01",
    "Tue Mar 05 2024 10:22:01 GMT+0100 (CET)": "2024-03-05 09:22:01", "Tue Mar 05 2024 10:22:01 GMT+0100 (Central European Standard Time)": "2024-03-05 09:22:01",
    "5 Mar 24 10:22:01 +0100": "2024-03-05 09:22:01", "5-Mar-2024 10:22": "2024-03-05 18:22:00", "5 de marzo de 2024 10:22": "2024-03-05 18:22:00", "03-05-2024 10:22": "2024-05-03 17:22:00",
    "10.3.24, 2:57 pm": "2024-03-10 21:57:00", "9/3/24, 3:22 PM": "2024-03-09 23:22:00", "1754997796725123": "2025-08-12 11:23:16", "1754997796725123456": "2025-08-12 11:23:16", "2024-03-05": None,
}


def test_written_forms(spark):
    df = spark.createDataFrame([(w, "America/Los_Angeles", None) for w in WRITTEN], "date string, tz string, locale string")
    got = {r["date"]: None if r["instant"] is None else str(r["instant"]) for r in normalise_instants(df).collect()}
    assert got == WRITTEN
