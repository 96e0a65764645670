"""Mixing sources to target weights, by cube-method balanced sampling.

Every record of a source is used floor(r) times, r being the source's target
tokens over its tokens, and once more with probability r - floor(r). Which
ones, the cube method decides: the vector of inclusion probabilities is moved
through the null space of the balancing constraints (documents and tokens of
the source), a few records at a time, until each is 0 or 1 but for two a
block. The two left of each block make the next, smaller round, and a landing
problem of a few records a source is solved by trying all outcomes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.session import durable

BLOCK = 20_000  #: records of one flight, by hash of their id; bounds the memory of a task
LANDING = 14  #: records a source that the landing decides on, by trying all outcomes
DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_counts(records: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(key, *keep, tokens): tokens of each text in the ranks file ``tokenizer``, which every executor must find at that path; a null text has 0."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            out = batch.drop(columns="_text")
            out["tokens"] = [0 if t is None else len(encoding.encode_ordinary(t)) for t in batch["_text"]]
            yield out

    rows = records.select(key, *keep, F.col(text).alias("_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text"] + ["tokens long"])
    return rows.mapInPandas(count, schema)


def flight(p: np.ndarray, tokens: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Moves probabilities to 0 or 1, keeping their sum and their token sum, until fewer than three fractions are left.

    Three fractional records at a time leave one direction in the null space
    of the two constraints; a step along it, in either sense with odds that
    keep expectations, settles at least one of them.
    """
    p = p.astype(float).tolist()
    t = tokens.astype(float).tolist()
    draws = iter(random.random(2 * len(p) + 8).tolist())
    active: list[int] = []
    for i in range(len(p)):
        if not 1e-9 < p[i] < 1 - 1e-9:
            p[i] = float(round(p[i]))
            continue
        active.append(i)
        while len(active) == 3:
            a, b, c = active
            u = (t[b] - t[c], t[c] - t[a], t[a] - t[b])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = down = float("inf")
            for k, v in zip(active, u):
                if v > 0:
                    up, down = min(up, (1 - p[k]) / v), min(down, p[k] / v)
                elif v < 0:
                    up, down = min(up, p[k] / -v), min(down, (1 - p[k]) / -v)
            step = up if next(draws) < down / (up + down) else -down
            for k, v in zip(active, u):
                p[k] = p[k] + step * v
                if p[k] < 1e-9 or p[k] > 1 - 1e-9:
                    p[k] = float(round(p[k]))
            left = [k for k in active if 0 < p[k] < 1]
            active = left if len(left) < 3 else left[:2]
    return np.array(p)


def landing(p: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """0 or 1 for the few fractions left (LANDING at most): of all outcomes whose count is nearest to the expected, the one whose token sum is."""
    free = np.flatnonzero((p > 0) & (p < 1))
    outcomes = (np.arange(1 << len(free))[:, None] >> np.arange(len(free))) & 1
    counts = np.abs(outcomes.sum(axis=1) - p[free].sum())
    near = np.flatnonzero(counts <= counts.min() + 1e-6)
    x = p.copy()
    x[free] = outcomes[near[np.argmin(np.abs((outcomes[near] - p[free]) @ tokens[free]))]]
    return x


def plan(totals: pd.DataFrame, targets: pd.DataFrame, total_tokens: int | None = None) -> pd.DataFrame:
    """source, target_share, max_repeats, tokens, records, wanted, rate: how often each source's records are used.

    Without ``total_tokens`` the mix is as large as the caps allow with all
    present sources at their shares (renormalised over them: an absent source
    can't contribute). With it, a source whose cap is too low contributes what
    it can, and the report shows the shortfall. Not distributed: one row a
    source.
    """
    rows = targets.merge(totals, on="source", how="left").fillna({"tokens": 0, "records": 0})
    present = rows["tokens"] > 0
    share = np.where(present, rows["target_share"], 0.0)
    share = share / share.sum() if share.sum() > 0 else share
    cap = rows["tokens"] * rows["max_repeats"]
    usable = present & (share > 0)
    size = total_tokens if total_tokens is not None else float((cap[usable] / share[usable]).min()) if usable.any() else 0.0
    rows["wanted"] = np.minimum(share * size, cap)
    rows["rate"] = np.where(present, rows["wanted"] / rows["tokens"].where(present, 1), 0.0)
    return rows


def _flier(seed: int, round_no: int, last: bool):
    def fly(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id", ignore_index=True)
        key = [seed, round_no, len(rows), int(rows["tokens"].sum()) & 0x7FFFFFFF]
        rows = rows.iloc[np.random.default_rng(key).permutation(len(rows))]
        rows = rows.reset_index(drop=True)
        tokens, p = rows["tokens"].to_numpy(float), rows["p"].to_numpy(float)
        # the last block keeps a few records out of the flight, so that the landing has sums to choose from
        held = LANDING - 2 if last else 0
        p[held:] = flight(p[held:], tokens[held:], np.random.default_rng([*key, 1]))
        rows["p"] = landing(p, tokens) if last else p
        return rows.drop(columns="block")

    return fly


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 11, tokenizer: str = DEFAULT_TOKENIZER, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares): chosen (source, doc_id, tokens, repeats) with repeats of at least 1; shares, a row a target source, with the actual ones.

    Sources are compared without case and outer blanks. Records of sources
    without a target, and those without a token, are never chosen. No record
    is used more than its source's max_repeats times. Ids are taken as unique;
    equal inputs and seed give equal results at any partitioning. Empty
    tables: no chosen rows, shares of 0.
    """
    spark = documents.sparkSession
    source = F.lower(F.trim("source")).alias("source")
    wanted = targets.select(source, F.col("target_share").cast("double"), F.col("max_repeats").cast("long")).where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    # as many rows as the mix has sources
    goals = wanted.toPandas()
    counted = token_counts(documents.where(F.col("text").isNotNull()).withColumn("source", source), "doc_id", "text", ("source",), tokenizer)
    counted = durable(counted.where("tokens > 0").join(F.broadcast(wanted.select("source")), "source", "left_semi"), "p9-tokens")
    totals = counted.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("records")).toPandas()
    planned = plan(totals, goals, total_tokens)
    rates = spark.createDataFrame([(r.source, float(np.floor(r.rate + 1e-12)), float(max(0.0, r.rate - np.floor(r.rate + 1e-12)))) for r in planned.itertuples()], "source string, whole double, part double")
    rated = counted.join(F.broadcast(rates), "source")
    left = rated.where("part > 0").select("source", "doc_id", "tokens", F.col("part").alias("p"))
    settled, round_no = [], 0
    size = int(max(totals["records"], default=0))
    while True:
        blocks = max(1, -(-size // block))

        kind = left.schema["doc_id"].dataType.simpleString()
        hashed = left.withColumn("block", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(round_no)), F.lit(blocks)))
        moved = durable(hashed.groupBy("source", "block").applyInPandas(_flier(seed, round_no, blocks == 1), f"source string, doc_id {kind}, tokens long, p double"), "p9-flight")
        settled.append(moved.where("p = 0 or p = 1"))
        if blocks == 1:
            break
        left, size, round_no = moved.where("p > 0 and p < 1"), 2 * blocks, round_no + 1
    extra = settled[0]
    for more in settled[1:]:
        extra = extra.unionByName(more)
    chosen = rated.join(extra.where("p = 1").select("doc_id", F.lit(1).alias("more")), "doc_id", "left")
    chosen = chosen.select("source", "doc_id", "tokens", (F.col("whole") + F.coalesce("more", F.lit(0))).cast("long").alias("repeats")).where("repeats > 0")
    used = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("used_tokens"), F.count("*").alias("used_records"), F.max("repeats").alias("most_repeats"))
    all_used = used.agg(F.coalesce(F.sum("used_tokens"), F.lit(0)).alias("all_tokens"))
    report = spark.createDataFrame([(r.source, float(r.target_share), int(r.max_repeats), int(r.tokens), int(r.records)) for r in planned.itertuples()], "source string, target_share double, max_repeats long, tokens long, records long")
    shares = report.join(used, "source", "left").join(F.broadcast(all_used)).select(
        "source", "target_share", "max_repeats", "tokens", "records", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("used_tokens", "used_records", "most_repeats")],
        F.when(F.col("all_tokens") > 0, F.coalesce("used_tokens", F.lit(0)) / F.col("all_tokens")).otherwise(F.lit(0.0)).alias("actual_share"),
    )
    return chosen, shares
