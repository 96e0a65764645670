"""Lexical similarity of insights: score, best match, merging, and the ordered fold of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from weftwork.functions import text as T
from weftwork.session import durable

THEMES, WORDS = 0.6, 0.4
#: Rows of a block, new and existing; meetings of light words counted at a time; a word is heavy if more than one in so many pairs of a block share it.
NEW_ROWS, OLD_ROWS, MEETINGS, HEAVY = 16384, 4096, 1 << 22, 128


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays that hold each value once; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def bags(df: DataFrame, themes: str = "themes", summary: str = "summary") -> DataFrame:
    """``df`` with _themes and _words, lower case, each value once."""
    low = F.transform(F.coalesce(themes, F.array().cast("array<string>")), lambda t: F.lower(t))
    words = F.array_remove(F.array_distinct(F.split(F.lower(F.coalesce(summary, F.lit(""))), r"[\s\p{Z}]+")), "")  # those of T.words, cheaper
    return df.withColumns({"_themes": F.array_distinct(low), "_words": words})


def score(a: str, b: str) -> Column:
    return F.lit(THEMES) * jaccard(F.col(f"{a}._themes"), F.col(f"{b}._themes")) + F.lit(WORDS) * jaccard(F.col(f"{a}._words"), F.col(f"{b}._words"))


def _theme_pairs(new: DataFrame, existing: DataFrame, need: float) -> DataFrame:
    """(_themes, _b, _tj, _m, _n): sets of themes of both sides, with how many rows have them, of a Jaccard similarity of at least ``need`` > 0.

    Sets are joined on their rarest themes only (prefix filtering): with n
    themes any but the ceil(n * need) - 1 most frequent ones must serve.
    """
    frequency = existing.select(F.explode("_themes").alias("t")).groupBy("t").agg(F.count("*").alias("n"))

    def prefix(sets: DataFrame) -> DataFrame:
        ranked = sets.select("_themes", F.explode("_themes").alias("t")).join(frequency, "t", "left")
        whole = ranked.groupBy("_themes").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "t"))).alias("r"))
        keep = F.slice("r", F.lit(1), F.greatest(F.lit(1), (F.size("r") - F.ceil(F.size("r") * F.lit(need) - 1e-9) + 1).cast("int")))
        return whole.select("_themes", F.explode(F.transform(keep, lambda x: x["t"])).alias("_t"))

    pairs = prefix(new).join(prefix(existing).withColumnRenamed("_themes", "_b"), "_t").select("_themes", "_b").distinct()
    pairs = pairs.join(new, "_themes").join(existing.withColumnRenamed("_themes", "_b"), "_b")
    return pairs.withColumn("_tj", jaccard(F.col("_themes"), F.col("_b"))).where(F.col("_tj") >= need - 1e-9)


def _shared(q: tuple[np.ndarray, np.ndarray], e: tuple[np.ndarray, np.ndarray], shape: tuple[int, int], n: int) -> np.ndarray:
    """How many of ``n`` words each row of q shares with each of e, both given as (row, word) of every word.

    Words that many rows of both hold are counted by a product of matrices,
    the others pair by pair.
    """
    (q_row, q_word), (e_row, e_word) = q, e
    in_q, in_e = np.bincount(q_word, minlength=n), np.bincount(e_word, minlength=n)
    heavy = in_q * in_e * HEAVY > shape[0] * shape[1]
    out = np.zeros(shape, np.float32)
    columns = np.flatnonzero(heavy)
    for at in range(0, len(columns), 1024):
        part = columns[at : at + 1024]
        place = np.full(n, -1)
        place[part] = np.arange(len(part))
        a, b = np.zeros((shape[0], len(part)), np.float32), np.zeros((len(part), shape[1]), np.float32)
        x, y = place[q_word], place[e_word]
        a[q_row[x >= 0], x[x >= 0]] = 1
        b[y[y >= 0], e_row[y >= 0]] = 1
        out += a @ b
    # light words: each occurrence in e meets the rows of q that hold the word, some millions of meetings at a time
    order = np.argsort(q_word, kind="stable")
    rows, begin = q_row[order], np.cumsum(in_q) - in_q
    light = ~heavy[e_word]
    e_row, e_word = e_row[light], e_word[light]
    ends = np.cumsum(in_q[e_word])
    at, flat = 0, out.reshape(-1)
    while at < len(e_word):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MEETINGS, "right")))
        times = in_q[e_word[at:upto]]
        first = np.repeat(begin[e_word[at:upto]] - (np.cumsum(times) - times), times)
        cells = rows[first + np.arange(len(first))] * shape[1] + np.repeat(e_row[at:upto], times)
        flat += np.bincount(cells, minlength=len(flat))
        at = upto
    return out


def _best_of_block(q: pa.Table, e: pa.Table, threshold: float) -> Iterator[tuple]:
    """(key, match, score) of the rows of ``q`` that have a match in ``e``, which is sorted by key."""
    e_key, e_words = e["_key"].to_numpy(), e["_words"].combine_chunks()
    e_size = e_words.value_lengths().to_numpy()
    for at in range(0, q.num_rows, 512):
        part = q.slice(at, 512)
        key, words = part["_key"].to_numpy(), part["_words"].combine_chunks()
        size = words.value_lengths().to_numpy()
        known = words.flatten().dictionary_encode()
        found = pc.fill_null(pc.index_in(e_words.flatten(), known.dictionary), -1).to_numpy()
        e_row = np.repeat(np.arange(len(e_key)), e_size)
        both = _shared(
            (np.repeat(np.arange(len(key)), size), known.indices.to_numpy()), (e_row[found >= 0], found[found >= 0]), (len(key), len(e_key)), len(known.dictionary)
        ).astype(np.float64)
        score = THEMES * part["_tj"].to_numpy()[:, None] + WORDS * (both / np.maximum(size[:, None] + e_size[None, :] - both, 1))
        score[key[:, None] == e_key[None, :]] = -1
        best = score.argmax(1)
        top = score[np.arange(len(key)), best]
        hit = top >= threshold
        yield key[hit], e_key[best[hit]], top[hit]


def _blocks(table: pa.Table) -> dict[tuple, pa.Table]:
    """The rows of each block, in order of the key."""
    table = table.sort_by([("_set", "ascending"), ("_i", "ascending"), ("_j", "ascending"), ("_key", "ascending")])
    names = np.stack([table[c].to_numpy() for c in ("_set", "_i", "_j")])
    at = [0, *(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(0)) + 1).tolist(), table.num_rows]
    return {tuple(names[:, a].tolist()): table.slice(a, b - a) for a, b in zip(at, at[1:]) if b > a}


def _by_blocks(new: DataFrame, existing: DataFrame, pairs: DataFrame, key: str, threshold: float) -> DataFrame:
    """(key, match, score) of the best match in every block of rows whose sets of themes are a pair.

    All rows of such sets are compared, so the work is that of counting
    shared words; blocks of bounded numbers of rows on both sides keep it
    in matrices and divide sets that very many rows have. Each existing row
    moves once for 16,384 new ones.
    """
    pairs = durable(pairs, "theme-pairs")
    sets = pairs.groupBy("_b").agg(F.ceil(F.sum("_m") / NEW_ROWS).alias("_is"), F.ceil(F.max("_n") / OLD_ROWS).alias("_js"), F.max("_n").alias("_n"))
    sets = durable(sets.withColumn("_set", F.monotonically_increasing_id()), "theme-sets")
    rows = sets.agg(F.coalesce(F.sum(F.col("_n") * F.col("_is")), F.lit(0)).alias("n")).first()["n"]
    bucket = F.pmod(F.xxhash64("_set", "_i", "_j"), F.lit(max(64, rows // OLD_ROWS))).alias("_bucket")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("_key"), F.col(n))
    places = pairs.join(sets.drop("_n"), "_b").select("_themes", "_tj", *[F.col(c).alias(c) for c in ("_set", "_is", "_js")])  # columns of their own: sets is joined on both sides
    q = new.select(F.col(key).alias("_key"), "_themes", "_words").join(places, "_themes").withColumn("_i", own("_is")).withColumn("_j", each("_js"))
    e = existing.select(F.col(key).alias("_key"), F.col("_themes").alias("_b"), "_words").join(sets, "_b").withColumn("_j", own("_js")).withColumn("_i", each("_is"))
    q, e = q.select(bucket, "_set", "_i", "_j", "_key", "_tj", "_words"), e.select(bucket, "_set", "_i", "_j", "_key", "_words")
    k, m = (df.schema[key].dataType for df in (new, existing))
    types = pa.schema([(key, to_arrow_type(k)), ("match", to_arrow_type(m)), ("score", pa.float64())])

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        olds, out = _blocks(right), []
        for name, rows in _blocks(left).items():
            if name in olds:
                out += _best_of_block(rows, olds[name], threshold)
        columns = [np.concatenate(c) for c in zip(*out)] if out else [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types.types)], schema=types)

    return q.groupBy("_bucket").cogroup(e.groupBy("_bucket")).applyInArrow(best, f"`{key}` {k.simpleString()}, match {m.simpleString()}, score double")


def _of_equal_words(new: DataFrame, existing: DataFrame, key: str, threshold: float) -> DataFrame:
    """(key, match, score) of rows with the very same words: at most two existing rows for a new one and a set of themes."""
    # no word has a blank; never null and not filtered on, or the words would be taken once more for the filter
    digest = F.coalesce(F.unhex(F.sha2(F.array_join(F.sort_array("_words"), " "), 256)), F.lit(b"")).alias("_d")
    new, existing = (df.where(~T.is_blank(F.col("summary"))) for df in (new, existing))
    q = new.select(key, "_themes", digest)
    e = existing.select(F.col(key).alias("match"), F.col("_themes").alias("_b"), digest)
    # the least id, and the next one for the row that has the least itself
    e = e.withColumn("_r", F.dense_rank().over(Window.partitionBy("_d", "_b").orderBy("match"))).where("_r <= 2").drop("_r")
    value = F.lit(THEMES) * jaccard(F.col("_themes"), F.col("_b")) + F.lit(WORDS) * F.lit(1.0)
    return q.join(e, "_d").where(F.col(key) != F.col("match")).select(key, "match", value.alias("score")).where(F.col("score") >= threshold)


def best_match(new: DataFrame, existing: DataFrame, key: str = "id", threshold: float = 0.7) -> DataFrame:
    """(key, match, score): of each row of ``new`` the existing row of greatest score, at least ``threshold`` > 0.4; ties to the smaller key.

    A score of 0.7 needs a theme similarity of (0.7 - 0.4) / 0.6 = 0.5, so
    one theme in common at least, and the less alike the themes, the more
    alike the words must be. Rows with the very same words are joined on
    them. What is left are sets of themes that are alike enough for other
    words to do, most often equal ones: their rows are compared in blocks.
    Neither way loses a match.
    """
    left, right = (bags(df.where(F.col(key).isNotNull())).withColumn("_themes", F.sort_array("_themes")) for df in (new, existing))
    sets = [durable(df.groupBy("_themes").agg(F.count("*").alias(n)), "themes") for df, n in ((left, "_m"), (right, "_n"))]
    pairs = _theme_pairs(*sets, (threshold - WORDS) / THEMES)
    pairs = pairs.where(F.lit(THEMES) * F.col("_tj") + F.lit(WORDS) > threshold + 1e-9)  # else only equal words do
    scored = _by_blocks(left, right, pairs, key, threshold).unionByName(_of_equal_words(left, right, key, threshold))
    return scored.groupBy(key).agg(F.max_by(F.struct("match", "score"), F.struct("score", -F.col("match"))).alias("m")).select(key, "m.match", "m.score")


def merged(original: str, new: str) -> dict[str, Column]:
    """Columns of an insight after ``new`` is merged into ``original`` (both struct columns)."""
    o, n = (lambda c: F.col(f"{original}.{c}")), (lambda c: F.col(f"{new}.{c}"))
    mean = lambda c: (o(c) + n(c)) / 2
    return {
        "themes": F.array_union(o("themes"), n("themes")), "significance": F.least(F.lit(1.0), mean("significance") + 0.05), "confidence": F.least(F.lit(1.0), mean("confidence") + 0.1),
        "summary": o("summary"), "insight_type": o("insight_type"),
        "excerpt": F.when(F.coalesce(o("excerpt"), F.lit("")) != "", o("excerpt")).otherwise(n("excerpt")),
    }


def _similar(a: dict, b: dict) -> float:
    def j(x: set, y: set) -> float:
        return len(x & y) / len(x | y) if x | y else 0.0

    return THEMES * j(a["t"], b["t"]) + WORDS * j(set(a["summary"].lower().split()), set(b["summary"].lower().split()))


def save_fold(batch: DataFrame, component: str, threshold: float = 0.7) -> DataFrame:
    """The batch saved in order of (created_at, id): each insight is merged into the most similar earlier one, or created.

    Order matters, so each component of similar insights (``component``, from
    any lossless blocking) is folded by itself; components are independent
    as long as merging does not make two of them similar.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        for r in rows.sort_values(["created_at", "id"]).to_dict("records"):
            r["t"] = {x.lower() for x in r["themes"]}
            scores = [_similar(r, k) for k in kept]
            best = max(range(len(kept)), key=lambda i: (scores[i], -i), default=None)
            if best is not None and scores[best] >= threshold:
                k = kept[best]
                k["themes"] = sorted(set(k["themes"]) | set(r["themes"]))
                k["t"] |= r["t"]
                k["significance"] = min(1.0, (k["significance"] + r["significance"]) / 2 + 0.05)
                k["confidence"] = min(1.0, (k["confidence"] + r["confidence"]) / 2 + 0.1)
                k["merged"] += 1
            else:
                kept.append({**r, "themes": sorted(r["themes"]), "merged": 0})
        return pd.DataFrame([{c: k[c] for c in ("id", "summary", "themes", "significance", "confidence", "merged")} for k in kept])

    return batch.select("id", "summary", "themes", "significance", "confidence", "created_at", component).groupBy(component).applyInPandas(
        fold, "id long, summary string, themes array<string>, significance double, confidence double, merged long"
    )
