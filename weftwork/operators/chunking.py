"""Fixed-size chunking of texts, and time chunking of message streams.

Where a chunk ends depends on where the one before it ended, so a text is
cut in one Arrow UDF call; the chunks are exploded in the JVM.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


@dataclass(frozen=True)
class Sizes:
    """Characters of a chunk, of its overlap, how far its end may move back to a boundary, and of context to either side."""

    chunk: int = 8000
    overlap: int = 800
    back_off: int = 500
    context: int = 200


CHUNKS = "array<struct<chunk_index:int,content:string,start_char:int,end_char:int,preceding_context:string,following_context:string,tokens:int>>"
#: Boundaries by preference: paragraph, sentence, line, word.
BOUNDARIES = [re.compile(p) for p in (r"\n\n", r"[.!?]\s+", r"\n", r"\s+")]


def _end(text: str, start: int, s: Sizes) -> int:
    end = start + s.chunk
    if end >= len(text):
        return len(text)
    low = max(start + 1, end - s.back_off)
    for pattern in BOUNDARIES:
        last = None
        for last in pattern.finditer(text, low, end):
            pass
        if last:
            return last.end()
    return end


def cut(text: str, s: Sizes) -> list[dict]:
    """Chunks that cover the text; the last one ends at its end, and none is the mere overlap of the last."""
    out, start = [], 0
    while text and text.strip():
        end = _end(text, start, s)
        content = text[start:end].strip()
        out.append({
            "chunk_index": len(out), "content": content, "start_char": start, "end_char": end, "preceding_context": text[max(0, start - s.context) : start],
            "following_context": text[end : end + s.context], "tokens": len(content) // 4,
        })
        if end >= len(text):
            break
        start = max(start + 1, end - s.overlap)
    return out


def chunk(df: DataFrame, text: str = "text", sizes: Sizes = Sizes()) -> DataFrame:
    """A row a chunk with the columns of ``df``; null and blank texts give none. Columns with a chunk column's name give way to it."""

    @pandas_udf(CHUNKS)
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cut(t or "", sizes))

    made = {"chunk_index", "content", "start_char", "end_char", "preceding_context", "following_context", "tokens"}
    keep = [c for c in df.columns if c not in made]
    return df.withColumn("_chunks", split(text)).select(*keep, F.explode("_chunks").alias("_c")).select(*keep, "_c.*")


def chunk_pages(df: DataFrame, pages: str = "pages", sizes: Sizes = Sizes()) -> DataFrame:
    """Chunks of texts that come in pages (joined by line ends), with the number of the page each begins on, from 1."""
    joined = df.withColumn("_text", F.array_join(pages, "\n", ""))
    starts = F.transform(F.sequence(F.lit(1), F.size(pages)), lambda i: F.length(F.array_join(F.slice(F.col(pages), F.lit(1), i - 1), "\n", "")) + F.when(i > 1, 1).otherwise(0))
    chunks = chunk(joined.where(F.size(pages) > 0).withColumn("_starts", starts), "_text", sizes)
    return chunks.withColumn("page_number", F.greatest(F.lit(1), F.size(F.filter("_starts", lambda p: p <= F.col("start_char")))).cast("int")).drop("_text", "_starts")


def chunk_by_time(messages: DataFrame, key: str, ts: str, months: int = 6, least: int = 20) -> DataFrame:
    """(key, time_chunk, first_ts, last_ts, messages): chunks that begin with a message and end ``months`` months later, small ones merged into the next.

    The fold runs over days, not messages: a day's messages are counted
    first, so a conversation costs a task no more than its number of days,
    however many messages it has. Days are all the same month to the rule, so
    the result is that of single messages.
    """
    daily = messages.where(F.col(ts).isNotNull()).groupBy(key, F.to_date(ts).alias("_day")).agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    kind = messages.schema[key].dataType.simpleString()

    def fold(days: pd.DataFrame) -> pd.DataFrame:
        days = days.sort_values("_day", ignore_index=True)
        number, first, at = -1, None, []
        for d in days["first_ts"]:
            if first is None or (d.year - first.year) * 12 + d.month - first.month >= months:
                number, first = number + 1, d
            at.append(number)
        days["_raw"] = at
        open_at, held, merged = 0, 0, {}
        for k, n in days.groupby("_raw")["n"].sum().items():
            merged[k] = open_at
            held += n
            if held >= least:
                open_at, held = open_at + 1, 0
        days["time_chunk"] = days["_raw"].map(merged)
        return days.groupby([key, "time_chunk"], as_index=False).agg(first_ts=("first_ts", "min"), last_ts=("last_ts", "max"), messages=("n", "sum"))

    return daily.groupBy(key).applyInPandas(fold, f"{key} {kind}, time_chunk long, first_ts timestamp, last_ts timestamp, messages long")
