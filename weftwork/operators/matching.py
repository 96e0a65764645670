"""Joins beyond plain equality: mentions, intervals, first and latest rows, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftwork.functions import text as T


def mentions(texts: DataFrame, key: str, text: str, names: DataFrame, name_key: str, name: str) -> DataFrame:
    """(key, name_key): which texts contain which names, without case, at word boundaries.

    Not a nested loop: a name can stand only where its first word does, so
    the texts' distinct words are joined with the names' first words, and
    the candidates are verified. Null and blank names match nothing.
    """
    tidy = names.select(name_key, F.lower(F.trim(name)).alias("_name")).where("_name <> ''").select(name_key, "_name", F.element_at(T.tokens(F.col("_name")), 1).alias("_first")).where("_first is not null")
    low = texts.where(F.col(text).isNotNull()).select(key, F.lower(text).alias("_low"))
    words = low.select(key, F.explode(F.array_distinct(T.tokens(F.col("_low")))).alias("_first"))
    # words and names meet without the texts, which are joined to the candidates only, once a text
    met = words.join(tidy.distinct(), "_first").groupBy(key).agg(F.collect_set(F.struct(name_key, "_name")).alias("_met"))
    framed = lambda c: F.concat(F.lit(" "), F.regexp_replace(c, r"[^\p{L}\p{N}_]", " "), F.lit(" "))
    rows = met.join(low, key).select(key, framed(F.col("_low")).alias("_text"), "_met")
    held = F.filter("_met", lambda m: F.contains(F.col("_text"), framed(m["_name"])))
    return rows.select(key, F.explode(held).alias("_m")).select(key, F.col(f"_m.{name_key}").alias(name_key)).distinct()


def during(points: DataFrame, at: str, spans: DataFrame, start: str, end: str, bucket_days: int = 30) -> DataFrame:
    """Points joined with the spans that hold them: start <= at and (end is null or at <= end).

    An equi-join on buckets of days, so neither side is compared with all of
    the other; a span goes to each bucket it touches, an open one up to the
    last bucket of the points.
    """
    bucket = lambda c: F.floor(F.unix_date(F.to_date(c)) / bucket_days)
    last = points.agg(F.max(bucket(F.col(at))).alias("last")).first()["last"]  # one number
    last = F.lit(last).cast("long")
    right = spans.where(bucket(F.col(start)) <= last)
    until = F.least(F.coalesce(bucket(F.col(end)), last), last)
    right = right.where(until >= bucket(F.col(start))).withColumn("_b", F.explode(F.sequence(bucket(F.col(start)), until)))
    left = points.withColumn("_b", bucket(F.col(at)))
    return left.join(right, "_b").where((F.col(start) <= F.col(at)) & (F.col(end).isNull() | (F.col(at) <= F.col(end)))).drop("_b")


def first_by(children: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """(key, value) of the first child in order: what a correlated subquery with a limit of one gives, as one aggregation."""
    return children.groupBy(key).agg(F.min(F.struct(*order, value)).alias("_f")).select(key, F.col(f"_f.{value}").alias(value))


def latest_each(df: DataFrame, by: list[str], order: list) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")


def resolve(found: DataFrame, registry: DataFrame) -> DataFrame:
    """Entities found in texts (entity_type, value) with what a prompt may say of them.

    known: whether the registry confirms it; shown: the placeholder if it is
    to be anonymised, else the display name, else the value. Of several registered ones the first by id holds.
    """
    types = F.lower(F.trim("entity_type"))
    reg = registry.where("confirmed").select(types.alias("entity_type"), F.lower(F.trim("normalised_value")).alias("_v"), "display_name", "anonymise_in_prompts", "placeholder_name", "id")
    reg = reg.groupBy("entity_type", "_v").agg(F.min_by(F.struct("display_name", "anonymise_in_prompts", "placeholder_name"), "id").alias("_r"))
    joined = found.withColumn("_v", F.lower(F.trim("value"))).join(reg, ["entity_type", "_v"], "left")
    shown = F.when(F.col("_r.anonymise_in_prompts"), F.coalesce("_r.placeholder_name", F.concat(F.lit("["), F.upper("entity_type"), F.lit("]")))).otherwise(F.coalesce("_r.display_name", "value"))
    return joined.select(*found.columns, F.col("_r").isNotNull().alias("known"), shown.alias("shown"))
