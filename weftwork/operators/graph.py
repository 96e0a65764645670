"""The entity graph: co-occurrence, relationships, neighbourhoods, paths, lineage, timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.session import durable

# relationship -> what it is seen from the other end
INVERSE = {
    "manages": "managed_by", "managed_by": "manages", "reports_to": "manages", "employed_by": "employs", "employs": "employed_by", "succeeded_by": "preceded_by", "preceded_by": "succeeded_by",
}


def co_occurrences(links: DataFrame, entity: str, source: str) -> DataFrame:
    """(entity_a_id, entity_b_id, count): all pairs a < b of entities of one source, counted over sources; repeated links count once."""
    once = links.where(F.col(entity).isNotNull() & F.col(source).isNotNull()).select(F.col(entity).alias("e"), F.col(source).alias("s")).distinct()
    a, b = once.withColumnRenamed("e", "entity_a_id"), once.withColumnRenamed("e", "entity_b_id")
    return a.join(b, "s").where("entity_a_id < entity_b_id").groupBy("entity_a_id", "entity_b_id").agg(F.count("*").alias("count"))


def undirected(pairs: DataFrame, weight: str = "count") -> DataFrame:
    """(src, dst, weight), every pair both ways; repeated and turned pairs united by the greatest weight."""
    both = pairs.select(F.col("entity_a_id").alias("src"), F.col("entity_b_id").alias("dst"), F.col(weight).alias("weight"))
    both = both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return both.where("src is not null and dst is not null and src <> dst").groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def neighbours(edges: DataFrame, entity: int, least: int = 1, k: int = 20) -> DataFrame:
    """The ``k`` heaviest neighbours of one entity; the filter comes before everything else."""
    return edges.where((F.col("src") == entity) & (F.col("weight") >= least)).select("dst", "weight").orderBy(F.desc("weight"), "dst").limit(k)


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def accumulate_relationships(seen: DataFrame, keys: list[str], strength: str, order: str) -> DataFrame:
    """One row a relationship: strength of its first sighting plus 0.1 a repetition, at most 1, and the number of sightings."""
    grouped = seen.groupBy(*keys).agg(F.min_by(strength, order).alias("_first"), F.count("*").alias("occurrence_count"))
    return grouped.withColumn("strength", F.least(F.lit(1.0), F.col("_first") + 0.1 * (F.col("occurrence_count") - 1))).drop("_first")


def with_inverses(relationships: DataFrame, kind: str = "relationship_type") -> DataFrame:
    """Directed relationships and, of those with an inverse, that one too."""
    table = F.create_map(*[F.lit(x) for pair in INVERSE.items() for x in pair])
    turned = relationships.withColumn(kind, table[F.col(kind)]).where(F.col(kind).isNotNull())
    turned = turned.withColumns({"src": F.col("dst"), "dst": F.col("src")}).select(*relationships.columns)
    return relationships.unionByName(turned)


def relationships_of(relationships: DataFrame, entity: int, direction: str = "both", least: float = 0.0, kind: str | None = None) -> DataFrame:
    out, into = F.col("src") == entity, F.col("dst") == entity
    rows = relationships.where({"out": out, "in": into, "both": out | into}[direction] & (F.col("strength") >= least))
    return (rows.where(F.col("relationship_type") == kind) if kind else rows).orderBy(F.desc("strength"), "src", "dst")


def network(edges: DataFrame, entity: int, depth: int = 1, least: float = 0.2) -> DataFrame:
    """(src, dst, weight): edges of at least ``least`` among the entities within ``depth`` steps of one entity."""
    strong = edges.where(F.col("weight") >= least)
    reached = strong.where(F.col("src") == entity).select("dst").unionByName(edges.sparkSession.range(1).select(F.lit(entity).cast(edges.schema["src"].dataType).alias("dst"))).distinct()
    for _ in range(depth - 1):
        reached = reached.unionByName(strong.join(reached.select(F.col("dst").alias("src")), "src").select("dst")).distinct()
    return strong.join(reached.select(F.col("dst").alias("src")), "src").join(reached, "dst").where("src < dst").select("src", "dst", "weight")


def shortest_path(edges: DataFrame, start: int, goal: int, most: int = 4) -> DataFrame:
    """(length, path): a shortest path of at most ``most`` edges, or no row. Of equal ones the one whose edges are heaviest, first to last, then by ids.

    One join a step with the frontier; an entity keeps its best path only and
    is left out of later frontiers, so the frontier never holds an entity
    twice. Steps are written out, so a lost executor costs one step.
    """
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType
    seen = spark.range(1).select(F.lit(start).cast(kind).alias("node"), F.array(F.lit(start).cast(kind)).alias("path"), F.array().cast("array<double>").alias("order"))
    frontier = seen
    for _ in range(most):
        if seen.where(F.col("node") == goal).limit(1).count():
            break
        step = frontier.join(edges, F.col("node") == F.col("src")).select(
            F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), F.concat("order", F.array(-F.col("weight").cast("double"))).alias("order")
        )
        step = step.join(seen.select("node"), "node", "left_anti").groupBy("node").agg(F.min(F.struct("order", "path")).alias("b")).select("node", "b.path", "b.order")
        frontier = durable(step, "path-frontier")
        seen = durable(seen.unionByName(frontier), "path-seen")
    return seen.where(F.col("node") == goal).select((F.size("path") - 1).cast("long").alias("length"), "path")


def lineage(rows: DataFrame, key: str, parent: str, rounds: int = 40) -> DataFrame:
    """(key, root, steps): where each row's chain of parents ends. Chains are followed by doubling; a cycle ends in an error."""
    at = rows.select(key, F.col(parent).alias("up"), F.when(F.col(parent).isNotNull(), 1).otherwise(0).cast("long").alias("steps"))
    for _ in range(rounds):
        above = at.select(F.col(key).alias("up"), F.col("up").alias("_up"), F.col("steps").alias("_steps"))
        new = durable(
            at.join(above, "up", "left").select(key, F.when(F.col("_up").isNotNull(), F.col("_up")).otherwise(F.col("up")).alias("up"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.col("_up").isNotNull().alias("moved")),
            "lineage",
        )
        moved = new.where("moved").limit(1).count()
        at = new.drop("moved")
        if not moved:
            return at.select(key, F.coalesce("up", key).alias("root"), "steps")
    raise RuntimeError("a chain of parents has no end")


def entity_timeline(sentiment: DataFrame, relationships: DataFrame, entity: int, k: int = 100) -> DataFrame:
    """(at, kind, detail): an entity's sentiment records and outgoing relationships, latest first."""
    a = sentiment.where(F.col("entity_id") == entity).select("at", F.lit("sentiment").alias("kind"), F.col("label").alias("detail"))
    b = relationships.where(F.col("src") == entity).select("at", F.lit("relationship").alias("kind"), F.concat(F.col("relationship_type"), F.lit(":"), F.col("dst").cast("string")).alias("detail"))
    return a.unionByName(b).orderBy(F.desc("at"), "kind", "detail").limit(k)
