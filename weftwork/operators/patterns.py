"""Patterns over insights: overlap, merging, relations, and themes that emerge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlapping(members: DataFrame, least: float = 0.5) -> DataFrame:
    """(a, b, shared, similarity): clusters a < b of ``members`` (cluster, id) whose ids have a Jaccard similarity of at least ``least``.

    Counted by an equi-join on the id; an id is in few clusters.
    """
    once = members.select("cluster", "id").distinct()
    sizes = once.groupBy("cluster").agg(F.count("*").alias("n"))
    a, b = once.withColumnRenamed("cluster", "a"), once.withColumnRenamed("cluster", "b")
    shared = a.join(b, "id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    joined = shared.join(sizes.withColumnsRenamed({"cluster": "a", "n": "n_a"}), "a").join(sizes.withColumnsRenamed({"cluster": "b", "n": "n_b"}), "b")
    similarity = F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))
    return joined.select("a", "b", "shared", similarity.alias("similarity")).where(F.col("similarity") >= least)


def merged(a: str, b: str) -> dict:
    """Columns of two overlapping patterns (struct columns) made one: ids united, strength 0.1 over their mean, the longer summary."""
    of = lambda s, c: F.col(f"{s}.{c}")
    return {
        "insight_ids": F.array_union(of(a, "insight_ids"), of(b, "insight_ids")), "strength": F.least(F.lit(1.0), (of(a, "strength") + of(b, "strength")) / 2 + 0.1),
        "summary": F.when(F.length(of(a, "summary")) >= F.length(of(b, "summary")), of(a, "summary")).otherwise(of(b, "summary")),
    }


def related(syntheses: DataFrame) -> DataFrame:
    """(a, b): syntheses (id, kind, pattern_ids) of one kind that share a pattern, a < b."""
    rows = syntheses.select("id", "kind", F.explode("pattern_ids").alias("p")).distinct()
    a, b = rows.withColumnRenamed("id", "a"), rows.withColumnRenamed("id", "b")
    return a.join(b, ["kind", "p"]).where("a < b").select("a", "b").distinct()


def emerging(patterns: DataFrame, insights: DataFrame, k: int = 3) -> DataFrame:
    """(source, id, summary, significance, confidence): patterns as themes of 0.7 of their strength, or, without any, the ``k`` most significant insights at half."""
    of_patterns = patterns.select(F.lit("pattern").alias("source"), "id", "summary", (F.col("strength") * 0.7).alias("significance"), F.lit(0.4).alias("confidence"))
    top = insights.orderBy(F.desc("significance"), "id").limit(k).select(F.lit("insight").alias("source"), "id", "summary", (F.col("significance") * 0.5).alias("significance"), F.lit(0.3).alias("confidence"))
    return of_patterns if patterns.limit(1).count() else top


def common_themes(insights: DataFrame, least: int = 3) -> DataFrame:
    """(theme, n, cluster_key): themes of at least ``least`` insights, and the themes that all of them have, sorted, as the cluster's key.

    A theme is common to a cluster if it meets the cluster's own theme as often
    as that occurs: one self-join on the insight, whose list of themes is short.
    """
    rows = insights.select("id", F.explode(F.array_distinct(F.transform("themes", lambda t: F.lower(F.trim(t))))).alias("theme"))
    sizes = rows.groupBy("theme").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    met = rows.join(rows.withColumnRenamed("theme", "other"), "id").groupBy("theme", "other").agg(F.count("*").alias("k"))
    common = met.join(sizes, "theme").where("k = n").groupBy("theme", "n").agg(F.array_join(F.array_sort(F.collect_list("other")), ",").alias("cluster_key"))
    return common.select("theme", "n", "cluster_key")
