"""Reading structured replies of a language model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.functions import text as T

REPLY = (
    "insights array<struct<summary:string,significance:double,confidence:double,insight_type:string,themes:array<string>,emotional_tags:array<string>,"
    "patterns:array<string>,supporting_excerpt:string,entities_mentioned:array<string>>>"
)


def parse_insights(df: DataFrame, reply: str, min_confidence: float = 0.3, min_significance: float = 0.2) -> DataFrame:
    """The rows of ``df`` once for each insight its reply holds: ordinal and the insight's fields.

    Code fences are taken off, what is no JSON or has no insights gives no
    row, and missing fields get defaults (0.5, 0.5, observation, empty lists).
    Insights without a summary or under either threshold are left out.
    """
    parsed = F.from_json(T.strip_fences(F.col(reply)), REPLY)
    rows = df.withColumn("_insights", parsed["insights"]).select(*[F.col(c) for c in df.columns], F.posexplode("_insights").alias("ordinal", "i"))
    trimmed = F.transform(F.coalesce("i.themes", F.array().cast("array<string>")), lambda t: F.trim(t))
    rows = rows.select(
        *df.columns, "ordinal", F.col("i.summary").alias("summary"), F.coalesce("i.significance", F.lit(0.5)).alias("significance"), F.coalesce("i.confidence", F.lit(0.5)).alias("confidence"),
        F.coalesce("i.insight_type", F.lit("observation")).alias("insight_type"), trimmed.alias("themes"),
        *[F.coalesce(f"i.{c}", F.array().cast("array<string>")).alias(c) for c in ("emotional_tags", "patterns", "entities_mentioned")], F.col("i.supporting_excerpt").alias("excerpt"),
    )
    return rows.where((F.trim("summary") != "") & (F.col("confidence") >= min_confidence) & (F.col("significance") >= min_significance))
