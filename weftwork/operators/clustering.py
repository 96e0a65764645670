"""Clusters of insights by theme, period and entity, and their combination."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.operators import matching


def cluster_id(strategy: str, key: Column) -> Column:
    return F.concat(F.lit("cluster_"), F.substring(F.sha2(F.concat_ws("|", F.lit(strategy), key), 256), 1, 12))


def theme_counts(insights: DataFrame) -> DataFrame:
    """(theme, n, first_id): insights a theme, without case and outer blanks."""
    rows = insights.select("id", F.explode(F.array_distinct(F.transform("themes", lambda t: F.lower(F.trim(t))))).alias("theme"))
    return rows.where("theme <> ''").groupBy("theme").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def by_theme(insights: DataFrame, least: int = 3) -> DataFrame:
    """(id, theme): each insight in one cluster. Themes by number of insights (ties: by first insight) take what is not yet taken, if it is ``least`` or more.

    The greedy order is a chain, but it depends on the number of insights of
    each set of themes only. So insights are first counted by their set of
    themes; the chain runs over those counts, one row a different set, and
    its result is joined back.
    """
    sets = F.array_sort(F.array_distinct(F.filter(F.transform("themes", lambda t: F.lower(F.trim(t))), lambda t: t != "")))
    rows = insights.select("id", sets.alias("themes")).where(F.size("themes") > 0)
    counted = rows.groupBy("themes").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))

    def greedy(table: pd.DataFrame) -> pd.DataFrame:
        holders: dict[str, list[int]] = {}
        for i, themes in enumerate(table["themes"]):
            for t in themes:
                holders.setdefault(t, []).append(i)
        n, first = table["n"].tolist(), table["first_id"].tolist()
        order = sorted(holders, key=lambda t: (-sum(n[i] for i in holders[t]), min(first[i] for i in holders[t]), t))
        taken: dict[int, str] = {}
        for t in order:
            free = [i for i in holders[t] if i not in taken]
            if sum(n[i] for i in free) >= least:
                taken.update(dict.fromkeys(free, t))
        return pd.DataFrame({"themes": [table["themes"][i] for i in taken], "theme": list(taken.values())})

    chosen = counted.groupBy(F.lit("all").alias("_all")).applyInPandas(greedy, "themes array<string>, theme string")
    return rows.join(chosen, "themes").select("id", "theme")


def period_key(at: Column, window_days: int) -> Column:
    """2024-Q1, 2024-05 or 2024-W07 (calendar year with the ISO week, so 2024-12-30 is in 2024-W01), by the window's length."""
    year = F.date_format(at, "yyyy")
    if window_days >= 90:
        return F.concat(year, F.lit("-Q"), F.quarter(at).cast("string"))
    if window_days >= 28:
        return F.date_format(at, "yyyy-MM")
    return F.concat(year, F.lit("-W"), F.lpad(F.weekofyear(at).cast("string"), 2, "0"))


def by_time(insights: DataFrame, at: str = "created_at", window_days: int = 30, least: int = 3, top: int = 5) -> DataFrame:
    """(period, n, mean_significance, first_at, last_at, themes): periods with at least ``least`` insights and their ``top`` themes."""
    rows = insights.where(F.col(at).isNotNull()).withColumn("period", period_key(F.col(at), window_days))
    periods = rows.groupBy("period").agg(F.count("*").alias("n"), F.avg("significance").alias("mean_significance"), F.min(at).alias("first_at"), F.max(at).alias("last_at")).where(F.col("n") >= least)
    themes = rows.select("period", F.explode("themes").alias("t")).groupBy("period", "t").agg(F.count("*").alias("c"))
    ranked = themes.withColumn("r", F.row_number().over(Window.partitionBy("period").orderBy(F.desc("c"), "t"))).where(F.col("r") <= top)
    listed = ranked.groupBy("period").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "t"))), lambda x: x["t"]), "|").alias("themes"))
    return periods.join(listed, "period", "left")


def by_entity(insights: DataFrame, entities: DataFrame, least: int = 3) -> DataFrame:
    """(entity_id, id): insights whose summary mentions a confirmed person, of persons with at least ``least``; an insight may be in several."""
    persons = entities.where(F.col("confirmed") & (F.lower(F.trim("entity_type")) == "person")).select(F.col("id").alias("entity_id"), "raw_value")
    met = matching.mentions(insights, "id", "summary", persons, "entity_id", "raw_value")
    enough = met.groupBy("entity_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return met.join(enough.select("entity_id"), "entity_id").select("entity_id", "id")


def combine(members: DataFrame, weights: DataFrame, overlap: float = 0.5) -> DataFrame:
    """(cluster): the accepted ones of clusters ``members`` (cluster, id), best score first, if less than ``overlap`` of them is in accepted ones already.

    score is size times the mean significance of ``weights`` (id,
    significance). Like ``by_theme`` the chain runs over counts: insights are
    counted by the set of clusters they are in.
    """
    signature = members.groupBy("id").agg(F.array_sort(F.collect_set("cluster")).alias("clusters"))
    counted = signature.groupBy("clusters").agg(F.count("*").alias("n"))
    scores = members.join(weights, "id").groupBy("cluster").agg((F.count("*") * F.avg("significance")).alias("score"))
    table = counted.select("clusters", "n", F.lit(None).cast("string").alias("cluster"), F.lit(None).cast("double").alias("score"))
    table = table.unionByName(scores.select(F.lit(None).cast("array<string>").alias("clusters"), F.lit(None).cast("long").alias("n"), "cluster", "score"))

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        sets = [(set(c), int(n)) for c, n in zip(rows["clusters"], rows["n"]) if c is not None]
        order = rows.dropna(subset=["cluster"]).sort_values(["score", "cluster"], ascending=[False, True])["cluster"]
        accepted: set[str] = set()
        for c in order:
            size = sum(n for s, n in sets if c in s)
            shared = sum(n for s, n in sets if c in s and s & accepted)
            if shared < overlap * size:
                accepted.add(c)
        return pd.DataFrame({"cluster": sorted(accepted)})

    return table.groupBy(F.lit("all").alias("_all")).applyInPandas(greedy, "cluster string")


def link_loose(insights: DataFrame, patterns: DataFrame) -> DataFrame:
    """(id, pattern_id, shared): each insight with the pattern whose summary has most of its themes as words; ties to the first pattern."""
    from weftwork.functions import text as T

    themes = insights.select("id", F.explode(F.array_distinct(F.transform("themes", lambda t: F.lower(F.trim(t))))).alias("w"))
    words = patterns.select(F.col("id").alias("pattern_id"), F.explode(F.array_distinct(T.words(F.lower("summary")))).alias("w"))
    counted = themes.join(words, "w").groupBy("id", "pattern_id").agg(F.count("*").alias("shared"))
    return counted.groupBy("id").agg(F.max_by(F.struct("pattern_id", "shared"), F.struct("shared", -F.col("pattern_id"))).alias("m")).select("id", "m.pattern_id", "m.shared")
