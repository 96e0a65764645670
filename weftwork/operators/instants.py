"""Normalising timestamps of mixed formats, precisions and zones to UTC.

All formats are compiled into one regex alternation with named groups. One
pass of it over a value yields every component (a single ``regexp_replace``
writes the named groups side by side), the calendar ranges are validated, and
the instant is put together by integer day arithmetic. All of it stays in the
JVM; there is no Python in the plan.
"""

from __future__ import annotations

import datetime as dt
import zoneinfo
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Month names as they are written in English, German, French and Spanish.
MONTHS = {
    1: ["january", "jan", "januar", "jänner", "janvier", "enero"],
    2: ["february", "feb", "februar", "février", "fevrier", "febrero"],
    3: ["march", "mar", "märz", "maerz", "mrz", "mars", "marzo"],
    4: ["april", "apr", "avril", "abril"],
    5: ["may", "mai", "mayo"],
    6: ["june", "jun", "juni", "juin", "junio"],
    7: ["july", "jul", "juli", "juillet", "julio"],
    8: ["august", "aug", "août", "aout", "agosto"],
    9: ["september", "sep", "sept", "septembre", "septiembre"],
    10: ["october", "oct", "oktober", "okt", "octobre", "octubre"],
    11: ["november", "nov", "novembre", "noviembre"],
    12: ["december", "dec", "dezember", "dez", "décembre", "decembre", "diciembre"],
}

#: Components, in the order in which the single pass writes them.
PARTS = ["y", "mo", "mon", "d", "h", "mi", "s", "ap", "off", "abbr", "zone", "sl", "num"]

# Blanks of any kind, the narrow ones that phones write before AM and PM too.
_S = r"[\s\p{{Z}}]"
_TIME = rf"(?<h{{k}}>\d{{{{1,2}}}}):(?<mi{{k}}>\d{{{{2}}}})(?::(?<s{{k}}>\d{{{{2}}}})(?:[.,]\d+)?)?(?:{_S}*(?<ap{{k}}>[AaPp])\.?[Mm]\b\.?)?(?:{_S}*Uhr)?"
_OFF = r"(?:GMT|UTC)?(?<off{k}>[Zz]|[+-]\d{{2}}(?::?\d{{2}})?)"
# AM and PM are no zones; what else stands in brackets is a zone's full name and says nothing that the offset does not
_ABBR = rf"(?:{_S}*\(?(?<abbr{{k}}>(?!(?:AM|PM)\b)[A-Z]{{{{2,5}}}})\)?)?(?:{_S}*\([^()]*\))?"
_ZONE = rf"(?:{_S}*{_OFF})?{_ABBR}"
_DAYNAME = rf"(?:\p{{{{L}}}}{{{{2,10}}}}\.?,?{_S}+)?"
_MONTH = r"(?<mon{k}>\p{{L}}{{3,10}})\.?"
_YEAR = r"(?<y{k}>\d{{4}}|\d{{2}})"
_DAY = r"(?<d{k}>\d{{1,2}})(?:\.|st|nd|rd|th)?"

#: One entry a family of formats; {k} numbers the groups, as names must be unique.
FORMATS = [
    # 2024-02-11T07:11:47Z, 2022-01-11 08:44:11.219389+00, 2023-06-01T01:58, 2024-10-23 05:53:18, 2024-03-05 10:22 PM
    rf"(?<y{{k}}>\d{{{{4}}}})-(?<mo{{k}}>\d{{{{1,2}}}})-(?<d{{k}}>\d{{{{1,2}}}})(?:[Tt]|,?{_S}+){_TIME}{_ZONE}",
    # 20240207T214027Z, TZID=Asia/Kolkata:20220908T224932
    rf"(?:;?TZID=(?<zone{{k}}>[A-Za-z0-9_+\-/]+):)?(?<y{{k}}>\d{{{{4}}}})(?<mo{{k}}>\d{{{{2}}}})(?<d{{k}}>\d{{{{2}}}})[Tt](?<h{{k}}>\d{{{{2}}}})(?<mi{{k}}>\d{{{{2}}}})(?<s{{k}}>\d{{{{2}}}})?(?:{_OFF})?",
    # 2022/01/16 20.35.54, 2022/01/16 8:35 PM
    rf"(?<y{{k}}>\d{{{{4}}}})/(?<mo{{k}}>\d{{{{1,2}}}})/(?<d{{k}}>\d{{{{1,2}}}}),?{_S}+(?<h{{k}}>\d{{{{1,2}}}})[.:](?<mi{{k}}>\d{{{{2}}}})(?:[.:](?<s{{k}}>\d{{{{2}}}})(?:,\d+)?)?(?:{_S}*(?<ap{{k}}>[AaPp])\.?[Mm]\b\.?)?{_ZONE}",
    # Sun, 07 Apr 2024 02:08:22 +1000; 5 Mar 24 10:22:01 +0100; 29 May 2022 02:42:01 PM ACST; 11 Apr 2023 09:57 +0000 (UTC); 20. Januar 2023, 09:56 Uhr; 5-Mar-2024 10:22
    rf"{_DAYNAME}{_DAY}(?:{_S}+|-)(?:de{_S}+)?{_MONTH},?(?:{_S}+|-)(?:de{_S}+)?{_YEAR},?{_S}+(?:(?:at|um|à|a las){_S}+)?{_TIME}{_ZONE}",
    # January 13, 2024 at 7:16 am; Tue Mar 05 2024 10:22:01 GMT+0100 (CET)
    rf"{_DAYNAME}{_MONTH}{_S}+(?<d{{k}}>\d{{{{1,2}}}})(?:st|nd|rd|th)?,?{_S}+(?<y{{k}}>\d{{{{4}}}}),?{_S}+(?:at{_S}+)?{_TIME}{_ZONE}",
    # Tue Mar  5 10:22:01 2024, with the zone before the year or after it
    rf"{_DAYNAME}{_MONTH}{_S}+(?<d{{k}}>\d{{{{1,2}}}}){_S}+(?<h{{k}}>\d{{{{1,2}}}}):(?<mi{{k}}>\d{{{{2}}}})(?::(?<s{{k}}>\d{{{{2}}}}))?(?:{_S}+(?<abbrb{{k}}>(?!(?:AM|PM)\b)[A-Z]{{{{2,5}}}}))?(?:{_S}+(?<offb{{k}}>[+-]\d{{{{4}}}}))?{_S}+(?<y{{k}}>\d{{{{4}}}}){_ZONE}",
    # 10.03.2024 02:57 Uhr, 10.3.24, 2:57 PM
    rf"(?<d{{k}}>\d{{{{1,2}}}})\.(?<mo{{k}}>\d{{{{1,2}}}})\.{_YEAR},?{_S}+(?:um{_S}+)?{_TIME}{_ZONE}",
    # 05/04/2022, 22:51; 9/15/23, 9:38 AM; 03-05-2024 10:22: which of the two is the month, the locale says
    rf"(?<mo{{k}}>\d{{{{1,2}}}})(?<sl{{k}}>[/-])(?<d{{k}}>\d{{{{1,2}}}})\k<sl{{k}}>{_YEAR},?{_S}+(?:at{_S}+)?{_TIME}{_ZONE}",
    # 1672253502, 1754997796725, 1754997796725123
    r"(?<num{k}>-?\d{{9,19}})(?:\.\d+)?",
]


def compiled() -> tuple[str, str]:
    """The alternation, and the replacement that writes every component once.

    The result starts with a mark, so a value that no format takes (which
    ``regexp_replace`` leaves alone) is told from one that was taken.
    """
    bodies = [f.format(k=k) for k, f in enumerate(FORMATS)]
    pattern = r"^[\s\p{Z}]*(?:" + "|".join(bodies) + r")[\s\p{Z}]*$"
    cells = []
    for part in PARTS:
        # a component that two places of one family may hold has a second group, marked b
        named = [f"{name}{k}" for k, body in enumerate(bodies) for name in (part, part + "b") if f"(?<{name}{k}>" in body]
        cells.append("".join("${%s}" % n for n in named))
    return pattern, "\u0002" + "\u0001".join(cells)


@lru_cache(maxsize=1)
def zone_abbreviations() -> tuple[tuple[str, str, int], ...]:
    """(zone, abbreviation, offset in seconds) of the tz database, years 2000 to 2037, the latest meaning of each."""
    found: dict[tuple[str, str], int] = {}
    for zone in sorted(zoneinfo.available_timezones()):
        info = zoneinfo.ZoneInfo(zone)
        for year in range(2000, 2038):
            for month in (1, 4, 7, 10):
                at = dt.datetime(year, month, 1, tzinfo=info)
                name = at.tzname() or ""
                if name.isalpha():
                    found[zone, name] = int(at.utcoffset().total_seconds())
    return tuple((z, a, o) for (z, a), o in sorted(found.items()))


def _zones(spark: SparkSession) -> DataFrame:
    """The table of abbreviations; its size is that of the tz database (a few thousand short rows), whatever the input."""
    return spark.createDataFrame(list(zone_abbreviations()), "_z string, _a string, _abbr_off int")


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, in integer arithmetic."""
    yy = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(yy / 400)
    yoe = yy - era * 400
    doy = F.floor((F.lit(153) * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    doe = yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy
    return (era * 146097 + doe - 719468).cast("long")


def _month_number(name: Column) -> Column:
    out = F.lit(None).cast("int")
    for number, names in MONTHS.items():
        out = F.when(name.isin(names), number).otherwise(out)
    return out


def normalise_instants(df: DataFrame, text: str = "date", tz: str = "tz", locale: str = "locale", out: str = "instant") -> DataFrame:
    """``df`` with a timestamp column ``out``: the UTC instant that ``text`` names, or null.

    * No time of day, no valid date (month 13, 31 April, 25:00, 13:00 PM), no
      known format, null or blank text: null.
    * An offset in the text holds; else a zone named in the text; else an
      abbreviation, read as one of zone ``tz``; else ``tz`` itself; else UTC.
      An unknown zone name counts as missing, an abbreviation that the zone
      does not have as not written.
    * A wall time that occurs twice is the first one; one that is skipped is
      read with the offset before the change.
    * Numbers alone: up to 11 digits are seconds since 1970, 12 to 14
      milliseconds, 15 to 17 microseconds, 18 and 19 nanoseconds.
    * Slashes or dashes with the year last: month first for locale ``en_US``,
      else day first. Two-digit years are 20xx. Fractions of a second are cut off.
    * AM and PM count in every format with a colon in its time; 13:00 PM is no time.

    Every other column stays as it is, whatever its name; ``out`` replaces a
    column of that name. Rows are neither dropped nor merged.
    """
    spark, pattern_replacement = df.sparkSession, compiled()
    pattern, replacement = pattern_replacement
    keep = [c for c in df.columns if c != out]
    row = df.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row") if keep else F.struct(F.lit(1).alias("_none")).alias("_row"),
        F.regexp_replace(F.col(f"`{text}`"), pattern, replacement).alias("_x"),
        F.nullif(F.trim(F.col(f"`{tz}`")), F.lit("")).alias("_meta_tz"),
        F.col(f"`{locale}`").alias("_loc"),
    )
    cells = F.split(F.when(F.col("_x").startswith("\u0002"), F.expr("substr(_x, 2)")), "\u0001", -1)
    row = row.select("_row", "_meta_tz", "_loc", cells.alias("_c"))
    cell = lambda part: F.nullif(F.col("_c")[PARTS.index(part)], F.lit(""))
    row = row.select(
        "_row",
        *[cell(p).try_cast("int").alias(f"_{p}") for p in ("y", "mo", "d", "h", "mi", "s")],
        F.lower(cell("mon")).alias("_mon"),
        F.lower(cell("ap")).alias("_ap"),
        cell("off").alias("_off"),
        cell("abbr").alias("_abbr"),
        F.coalesce(cell("zone"), F.col("_meta_tz"), F.lit("UTC")).alias("_zone"),
        cell("num").alias("_num"),
        (cell("sl").isNotNull() & (F.coalesce(F.col("_loc"), F.lit("")) != "en_US")).alias("_dayfirst"),
    )
    first = F.coalesce(F.col("_mo"), _month_number(F.col("_mon")))
    mo = F.when(F.col("_dayfirst"), F.col("_d")).otherwise(first)
    d = F.when(F.col("_dayfirst"), first).otherwise(F.col("_d"))
    h12 = F.when(F.col("_h").between(1, 12), F.col("_h") % 12 + F.when(F.col("_ap") == "p", 12).otherwise(0))
    row = row.select(
        "_row", "_off", "_abbr", "_zone", "_num",
        F.when(F.col("_y") < 100, F.col("_y") + 2000).otherwise(F.col("_y")).cast("long").alias("_y"),
        mo.cast("long").alias("_mo"), d.cast("long").alias("_d"),
        F.when(F.col("_ap").isNotNull(), h12).otherwise(F.col("_h")).cast("long").alias("_h"),
        F.col("_mi").cast("long").alias("_mi"), F.coalesce(F.col("_s"), F.lit(0)).cast("long").alias("_s"),
    )
    leap = (F.col("_y") % 4 == 0) & ((F.col("_y") % 100 != 0) | (F.col("_y") % 400 == 0))
    length = F.when(F.col("_mo").isin(4, 6, 9, 11), 30).when(F.col("_mo") == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    valid = (
        F.col("_y").between(1, 9999) & F.col("_mo").between(1, 12) & F.col("_d").between(1, length)
        & F.col("_h").between(0, 23) & F.col("_mi").between(0, 59) & F.col("_s").between(0, 59)
    )
    wall = days_from_civil(F.col("_y"), F.col("_mo"), F.col("_d")) * 86400 + F.col("_h") * 3600 + F.col("_mi") * 60 + F.col("_s")
    digits = F.regexp_replace(F.col("_off"), "[:+-]", "")
    offset = F.when(F.lower("_off") == "z", 0).otherwise(
        (F.substring(digits, 1, 2).try_cast("int") * 3600 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0)) * 60)
        * F.when(F.col("_off").startswith("-"), -1).otherwise(1)
    )
    number, written = F.col("_num").try_cast("long"), F.length(F.regexp_replace("_num", "-", ""))
    whole = lambda unit: F.round((number - F.pmod(number, F.lit(unit))) / unit).cast("long")
    row = row.select(
        "_row", "_zone",
        F.when(F.col("_off").isNull(), F.col("_abbr")).alias("_abbr"),
        F.when(valid, wall).alias("_wall"),
        F.when(F.col("_off").isNotNull(), offset).alias("_offset"),
        F.when(written <= 11, number).when(written <= 14, whole(10**3)).when(written <= 17, whole(10**6)).otherwise(whole(10**9)).alias("_epoch"),
    )
    zones = _zones(spark)
    known = zones.select(F.col("_z").alias("_kz")).distinct()
    row = (
        row.join(F.broadcast(zones), (F.col("_zone") == F.col("_z")) & (F.col("_abbr") == F.col("_a")), "left")
        .join(F.broadcast(known), F.col("_zone") == F.col("_kz"), "left")
    )
    fixed = F.coalesce(F.col("_offset"), F.col("_abbr_off"))
    zone = F.coalesce(F.col("_kz"), F.lit("UTC"))
    # the wall time as if it were UTC, moved by the zone's rules: both engines of java.time take the earlier of two offsets
    by_zone = F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds("_wall"), zone))
    epoch = F.coalesce(F.col("_epoch"), F.when(fixed.isNotNull(), F.col("_wall") - fixed).otherwise(by_zone))
    return row.select(*[F.col("_row")[c].alias(c) for c in keep], F.timestamp_seconds(epoch).alias(out))
