"""Items that appear together: counts and lift of pairs, by heavy-light decomposition."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.session import durable

#: Rows of one block of the bit matrix; an insight is never divided.
BLOCK_ROWS = 200_000
#: An item is heavy if it holds more than this part of all links, so there are fewer than HEAVY of them at any size.
HEAVY = 256


def popcount_pairs(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one block: a bit matrix, items by baskets, and the popcounts of its rows' conjunctions."""
    items, item = np.unique(rows["item"].to_numpy(), return_inverse=True)
    baskets, basket = np.unique(rows["basket"].to_numpy(), return_inverse=True)
    words = (len(baskets) + 63) // 64
    bits = np.zeros((len(items), words), dtype=np.uint64)
    np.bitwise_or.at(bits, (item, basket // 64), np.uint64(1) << (basket % 64).astype(np.uint64))
    found = []
    for i in range(len(items) - 1):
        shared = np.bitwise_count(bits[i] & bits[i + 1 :]).sum(axis=1, dtype=np.int64)
        j = np.flatnonzero(shared)
        found.append(pd.DataFrame({"a": items[i], "b": items[i + 1 + j], "shared": shared[j]}))
    return pd.concat(found) if found else pd.DataFrame({"a": items[:0], "b": items[:0], "shared": np.zeros(0, dtype=np.int64)})


def co_occurrence(links: DataFrame, item: str = "entity_id", basket: str = "insight_id", min_shared: int = 1, heavy: int = HEAVY) -> DataFrame:
    """(a, b, shared, baskets_a, baskets_b, n, lift) of each pair a < b with at least ``min_shared`` baskets in common.

    Links without item or basket are ignored throughout, repeated links count
    once; n is the number of baskets left and lift is
    shared * n / (baskets_a * baskets_b). Items in fewer than ``min_shared``
    baskets can't reach it and are left out before pairs are made; no pair
    that reaches it is lost. Empty links: no rows.

    * Heavy items (more than 1/``heavy`` of all links each, so fewer than
      ``heavy``): bit matrices over blocks of baskets, popcounts summed.
    * Light items: pairs counted by hash, by a join on the basket, which
      streams and which adaptive execution can split; no basket is collected.
    * Mixed: the basket's light items probe its heavy list (under ``heavy`` long).
    """
    once = links.where(F.col(item).isNotNull() & F.col(basket).isNotNull()).select(F.col(item).alias("item"), F.col(basket).cast("string").alias("basket"))
    once = durable(once.distinct(), "p7-links")
    degrees = durable(once.groupBy("item").agg(F.count("*").alias("degree")), "p7-degrees")
    total = degrees.agg(F.coalesce(F.sum("degree"), F.lit(0)).alias("links")).first()["links"]
    n = once.agg(F.count_distinct("basket").alias("n")).first()["n"]
    frequent = degrees.where(F.col("degree") >= min_shared)
    is_heavy = F.col("degree") * heavy > F.lit(total)
    # by its bound, fewer than `heavy` rows
    heavy_items = frequent.where(is_heavy).select("item")
    heavy_links = once.join(F.broadcast(heavy_items), "item")
    light_links = once.join(frequent.where(~is_heavy).select("item"), "item")
    blocks = max(1, -(-total // BLOCK_ROWS))
    item_type = once.schema["item"].dataType.simpleString()
    heavy_pairs = (
        heavy_links.select("item", "basket", F.pmod(F.xxhash64("basket"), F.lit(blocks)).alias("block"))
        .groupBy("block").applyInPandas(popcount_pairs, f"a {item_type}, b {item_type}, shared long")
    )
    left, right = light_links.select("basket", F.col("item").alias("a")), light_links.select("basket", F.col("item").alias("b"))
    light_pairs = left.join(right, "basket").where(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.count("*").alias("shared"))
    lists = heavy_links.groupBy("basket").agg(F.collect_list("item").alias("heavies"))
    mixed_pairs = (
        light_links.join(lists, "basket").select("item", F.explode("heavies").alias("heavy"))
        .groupBy("item", "heavy").agg(F.count("*").alias("shared"))
        .select(F.least("item", "heavy").alias("a"), F.greatest("item", "heavy").alias("b"), "shared")
    )
    summed = heavy_pairs.groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    pairs = summed.unionByName(light_pairs).unionByName(mixed_pairs).where(F.col("shared") >= min_shared)
    lift = F.col("shared").cast("double") * F.lit(n) / (F.col("baskets_a") * F.col("baskets_b"))
    return (
        pairs.join(degrees.select(F.col("item").alias("a"), F.col("degree").alias("baskets_a")), "a")
        .join(degrees.select(F.col("item").alias("b"), F.col("degree").alias("baskets_b")), "b")
        .select("a", "b", "shared", "baskets_a", "baskets_b", F.lit(n).cast("long").alias("n"), lift.alias("lift"))
    )


def attracted(pairs: DataFrame, min_shared: int = 5, min_lift: int = 4) -> DataFrame:
    """Pairs with at least ``min_shared`` baskets and a lift of at least ``min_lift``, decided in integers."""
    exact = F.col("shared") * F.col("n") >= F.lit(min_lift) * F.col("baskets_a") * F.col("baskets_b")
    return pairs.where((F.col("shared") >= min_shared) & exact)


def with_sources(pairs: DataFrame, links: DataFrame, item: str = "entity_id", basket: str = "insight_id", prefix: str = "insight:") -> DataFrame:
    """``pairs`` in the form of entity_co_occurrences: entity_a_id, entity_b_id, count, source_ids_json, lift.

    Each pair's baskets are found from its rarer item, by two equi-joins.
    """
    once = links.where(F.col(item).isNotNull() & F.col(basket).isNotNull()).select(F.col(item).alias("item"), F.col(basket).cast("string").alias("basket")).distinct()
    rare_first = pairs.select("a", "b", "shared", "lift", F.when(F.col("baskets_a") <= F.col("baskets_b"), F.col("a")).otherwise(F.col("b")).alias("item"))
    other = F.when(F.col("item") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("item")
    probed = rare_first.join(once, "item").select("a", "b", "shared", "lift", other, "basket")
    met = probed.join(once, ["item", "basket"])
    grouped = met.groupBy("a", "b", "shared", "lift").agg(F.sort_array(F.collect_list(F.concat(F.lit(prefix), "basket"))).alias("ids"))
    return grouped.select(
        F.col("a").alias("entity_a_id"), F.col("b").alias("entity_b_id"), F.col("shared").alias("count"), F.to_json("ids").alias("source_ids_json"), "lift"
    )


def all_with_sources(links: DataFrame, item: str = "entity_id", basket: str = "insight_id", prefix: str = "insight:") -> DataFrame:
    """Every pair that shares a basket, in the form of ``with_sources``.

    Each shared basket of each pair is a part of the result, so the lists are
    collected from a join on the basket; probing from the rarer items, as for
    few pairs, would meet many baskets that a pair does not share.
    """
    once = links.where(F.col(item).isNotNull() & F.col(basket).isNotNull()).select(F.col(item).alias("item"), F.col(basket).cast("string").alias("basket")).distinct()
    left, right = once.select("basket", F.col("item").alias("a")), once.select("basket", F.col("item").alias("b"))
    ids = F.to_json(F.sort_array(F.collect_list(F.concat(F.lit(prefix), "basket"))))
    sources = left.join(right, "basket").where(F.col("a") < F.col("b")).groupBy("a", "b").agg(ids.alias("source_ids_json"))
    return co_occurrence(links, item, basket).join(sources, ["a", "b"]).select(
        F.col("a").alias("entity_a_id"), F.col("b").alias("entity_b_id"), F.col("shared").alias("count"), "source_ids_json", "lift"
    )
