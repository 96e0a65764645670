"""Aggregations: counts by several dimensions in one pass, rollups, periods, profiles, top values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts_by(df: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """(dimension, value, n): counts by each of several dimensions, in one pass and one shuffle; null values count as unknown."""
    parts = F.array(*[F.struct(F.lit(k).alias("dimension"), F.coalesce(v.cast("string"), F.lit("unknown")).alias("value")) for k, v in dimensions.items()])
    return df.select(F.explode(parts).alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


def repeated_once(df: DataFrame, key: str = "id") -> DataFrame:
    """Rows repeated whole under one id once."""
    return df.dropDuplicates([key])


def rollup_costs(costs: DataFrame) -> DataFrame:
    """(provider, feature, calls, input_tokens, output_tokens, cost_millionths, failed): totals, by provider and by feature, in one pass of grouping sets."""
    rows = costs.select(
        "provider", F.lower(F.trim("feature")).alias("feature"), "input_tokens", "output_tokens", F.round(F.col("total_cost") * 1_000_000).cast("long").alias("m"), "success"
    )
    grouped = rows.groupingSets([["provider"], ["feature"], []], "provider", "feature")
    return grouped.agg(
        F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("m").alias("cost_millionths"),
        F.sum(F.when(~F.col("success"), 1).otherwise(0)).alias("failed"), F.grouping_id().cast("long").alias("level"),
    )


def daily_costs(costs: DataFrame) -> DataFrame:
    """(day, provider, feature, calls, tokens, cost_millionths, latency_sum, latency_n, failed)."""
    return costs.groupBy(F.to_date("created_at").cast("string").alias("day"), "provider", F.lower(F.trim("feature")).alias("feature")).agg(
        F.count("*").alias("calls"), F.sum("total_tokens").alias("tokens"), F.sum(F.round(F.col("total_cost") * 1_000_000).cast("long")).alias("cost_millionths"),
        F.sum("latency_ms").alias("latency_sum"), F.count("latency_ms").alias("latency_n"), F.count_if(~F.col("success")).alias("failed"),
    )


def period_usage(costs: DataFrame, at: Column, limit: int) -> DataFrame:
    """(user_id, used_1, used_7, used_30, remaining): tokens of successful calls in the days before ``at``, and what is left of the daily limit."""
    age = F.datediff(at, F.to_date("created_at"))
    used = [F.sum(F.when(F.col("success") & (age >= 0) & (age < d), F.col("total_tokens")).otherwise(0)).alias(f"used_{d}") for d in (1, 7, 30)]
    return costs.groupBy("user_id").agg(*used).withColumn("remaining", F.greatest(F.lit(0), F.lit(limit) - F.col("used_1")))


def daily_summary(events: DataFrame, ts: str, kind: str, days: int | None = None) -> DataFrame:
    """(day, n, kinds): events a day and the different kinds, sorted; of the last ``days`` days that have any, or of all."""
    daily = events.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set(kind)), ",").alias("kinds"))
    return daily.orderBy(F.desc("day")).limit(days) if days else daily


def sentiment_label(score: Column) -> Column:
    return F.when(score < -0.3, "negative").when(score > 0.3, "positive").when(F.abs(score) < 0.1, "neutral").otherwise("mixed")


def sentiment_summary(rows: DataFrame, entity: str, score: str, ts: str) -> DataFrame:
    """One row an entity: count, mean, least, greatest, counts by label, first and last time, and the trend (mean over 0.3: positive, under -0.3: negative)."""
    label = sentiment_label(F.col(score))
    counted = [F.count_if(label == x).alias(x) for x in ("positive", "negative", "neutral", "mixed")]
    out = rows.groupBy(entity).agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.min(score).alias("least"), F.max(score).alias("greatest"), *counted, F.min(ts).alias("first_at"), F.max(ts).alias("last_at"))
    return out.withColumn("trend", F.when(F.col("mean") > 0.3, "positive").when(F.col("mean") < -0.3, "negative").otherwise("stable"))


def emotion_sentiment(tags: Column) -> Column:
    """(positive - negative) / (positive + negative) of the tags, null without either."""
    from weftwork.functions import lexicons as L
    from weftwork.functions.text import lit_array

    low = F.transform(tags, lambda t: F.lower(t))
    count = lambda names: F.size(F.filter(low, lambda t: t.isin(names)))
    pos, neg = count(L.POSITIVE_EMOTIONS), count(L.NEGATIVE_EMOTIONS)
    return F.when(pos + neg > 0, (pos - neg) / (pos + neg))


def top_values(df: DataFrame, value: Column, k: int) -> DataFrame:
    """(value, n): the ``k`` most frequent values, ties by value; blank and null ones left out."""
    counted = df.select(F.trim(value.cast("string")).alias("value")).where("value <> ''").groupBy("value").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "value").limit(k)


def first_of_each(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group in a total order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).withColumnRenamed("_r", "position")


def column_profile(df: DataFrame) -> DataFrame:
    """(column, rows, non_empty, distinct_values, numeric, dates): of each column, in one pass over the table. A date begins with yyyy-MM-dd, a number may carry a currency sign."""
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")).alias("v")) for c in df.columns])
    cells = df.select(F.explode(parts).alias("p")).select("p.column", "p.v")
    number = F.regexp_replace("v", r"[$,€£ ]", "").rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    date = F.col("v").rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$") & F.substring("v", 1, 10).try_cast("date").isNotNull()
    return cells.groupBy("column").agg(
        F.count("*").alias("rows"), F.count("v").alias("non_empty"), F.count_distinct("v").alias("distinct_values"), F.count_if(number).alias("numeric"), F.count_if(date).alias("dates")
    )


def compare_groups(df: DataFrame, group: str, left: str, right: str, kind: str, value: str) -> DataFrame:
    """(kind, n_left, n_right, mean_left, mean_right, delta): two runs side by side, by one conditional aggregation."""
    of = lambda g: F.col(group) == g
    out = df.where(F.col(group).isin(left, right)).groupBy(kind).agg(
        F.count_if(of(left)).alias("n_left"), F.count_if(of(right)).alias("n_right"), F.avg(F.when(of(left), F.col(value))).alias("mean_left"), F.avg(F.when(of(right), F.col(value))).alias("mean_right")
    )
    return out.withColumn("delta", F.col("n_right") - F.col("n_left"))
