"""Changes to tables as set operations: a table and a batch of changes in, the new table out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_replace(base: DataFrame, batch: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key by ``order`` (total within a key), from both tables: later rows replace earlier ones."""
    both = base.unionByName(batch)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))
    return both.withColumn("_r", rank).where("_r = 1").drop("_r")


def upsert_accumulate(base: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Sightings added to a registry: (keys, occurrence_count, source_types, first_seen_at, last_seen_at), both sides alike.

    Counts add up, sources are united, times stretched; one aggregation, map-side combined.
    """
    both = base.unionByName(batch)
    return both.groupBy(*keys).agg(
        F.sum("occurrence_count").alias("occurrence_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("source_types")))).alias("source_types"),
        F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"),
    )


def sightings(rows: DataFrame, keys: list[str], source: str, ts: str) -> DataFrame:
    """Single sightings in the form of ``upsert_accumulate``."""
    return rows.select(*keys, F.lit(1).cast("long").alias("occurrence_count"), F.array(F.col(source)).alias("source_types"), F.col(ts).alias("first_seen_at"), F.col(ts).alias("last_seen_at"))


def partial_update(base: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` with the non-null values of ``patch`` (one row a key) in place of its own."""
    changed = [c for c in patch.columns if c not in keys]
    joined = base.join(patch.select(*keys, *[F.col(c).alias(f"_p_{c}") for c in changed]), keys, "left")
    return joined.select(*[F.coalesce(f"_p_{c}", c).alias(c) if c in changed else F.col(c) for c in base.columns])


def soft_delete(base: DataFrame, gone: DataFrame, keys: list[str], status: str, value: str = "rejected") -> DataFrame:
    marked = base.join(gone.select(*keys).distinct().withColumn("_gone", F.lit(True)), keys, "left")
    return marked.withColumn(status, F.when(F.col("_gone"), value).otherwise(F.col(status))).select(*base.columns)


def hard_delete(base: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(gone.select(*keys).distinct(), keys, "left_anti")


def cascade_delete(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, foreign: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children without those of ``gone``."""
    kept = hard_delete(parents, gone, [key])
    lost = gone.select(F.col(key).alias(foreign)).distinct()
    return kept, children.join(lost, foreign, "left_anti").select(*children.columns)


def recount(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """``parents`` with a counter recomputed from each child table: name -> (table, its foreign key)."""
    out = parents
    for name, (table, foreign) in children.items():
        counts = table.groupBy(F.col(foreign).alias(key)).agg(F.count("*").alias(f"_n_{name}"))
        out = out.join(counts, key, "left").withColumn(name, F.coalesce(f"_n_{name}", F.lit(0))).drop(f"_n_{name}")
    return out


def violations(df: DataFrame, unique: list[str] = (), checks: dict[str, Column] | None = None) -> DataFrame:
    """(rule, n): how many rows break a uniqueness or a check; Spark does not enforce constraints."""
    parts = []
    if unique:
        parts.append(df.groupBy(*unique).count().where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n")).select(F.lit("unique " + ", ".join(unique)).alias("rule"), "n"))
    for name, ok in (checks or {}).items():
        parts.append(df.agg(F.count_if(~F.coalesce(ok, F.lit(False))).alias("n")).select(F.lit(name).alias("rule"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
