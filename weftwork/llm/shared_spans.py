"""Long exact spans shared between records, by content-defined chunking.

A coarse gear landmark opens a variable chunk that ends at the first fine
landmark at least MIN further on. Landmarks are window minima, so inside any
shared stretch of LEAST characters both records have one whole chunk in
common, whatever was inserted before it:

    LEAST - (WINDOW - 1) hashes depend on the stretch alone; those at least a
    window's width - 1 from either end are landmarks in both records or in
    neither; a coarse one comes within COARSE of the first, MIN further on a
    fine one comes within FINE.

Chunks are deduplicated by digest. Around the chunks that more than one text
has, all windows of LEAST characters are digested and compared the same way,
which is exact and finds the stretches to the character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftwork.llm import gear
from weftwork.session import durable

COARSE, FINE = 40, 8
#: Code points hashed at a time; a longer text is a batch of its own.
BATCH = 400_000


def min_chunk(least: int) -> int:
    """The largest least size of a chunk that a shared stretch of ``least`` characters always holds whole."""
    return least - (gear.WINDOW - 1) - 2 * (COARSE - 1) - 2 * (FINE - 1) - 1


def chunks_of(codes: np.ndarray, least: int, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and digest of each chunk of a batch of texts that lie side by side; ``bounds`` are their starts and the end.

    Windows that reach over a bound can only add landmarks near it, which the
    guarantee does not count on. No chunk reaches over a bound.
    """
    gears = gear.gear(codes)
    hashes = gear.rolling(gears)[gear.WINDOW - 1 :]
    coarse, fine = gear.landmarks(hashes, COARSE), gear.landmarks(hashes, FINE)
    at = np.searchsorted(fine, coarse + min_chunk(least))
    coarse, at = coarse[at < len(fine)], at[at < len(fine)]
    # position 0 of the hashes ends at code point WINDOW - 1; the chunk takes in the code points that made its landmark
    start, end = coarse, fine[at] + gear.WINDOW - 1
    inside = end <= bounds[np.searchsorted(bounds, start, "right")] if len(start) else np.zeros(0, bool)
    start, end = start[inside], end[inside]
    return start, end, gear.Digests(gears).of(start, end)


def _chunk_batches(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For batches of (id, text): ids, the row of each chunk, its start and end in the text, and its digest."""
    for batch in batches:
        sizes = np.cumsum(pc.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False))
        row = 0
        while row < len(batch):
            upto = max(row + 1, int(np.searchsorted(sizes, (sizes[row - 1] if row else 0) + BATCH, "right")))
            part = batch.slice(row, upto - row)
            bounds = np.r_[0, sizes[row:upto] - (sizes[row - 1] if row else 0)].astype(np.int64)
            start, end, digest = chunks_of(gear.code_points("".join(part.column(1).to_pylist())), least, bounds)
            owner = np.searchsorted(bounds, start, "right") - 1
            yield part.column(0), owner, start - bounds[owner], end - bounds[owner], digest
            row = upto


def shared_windows(documents: DataFrame, key: str = "doc_id", text: str = "text", least: int = 200) -> tuple[DataFrame, DataFrame]:
    """(classes, windows): classes (id, rep, copies, n_chars) of texts of at least ``least`` characters, by exact copy, and windows (rep, start), the first characters of all windows of ``least`` that another text has too.

    A text that occurs in several records is compared once. Digests meet in
    aggregations that keep two values a digest and are combined on the map
    side, so a passage that a third of all records hold is no larger a group
    than any other. Texts are shuffled once, and only for the second look.
    """
    if min_chunk(least) < gear.WINDOW:
        raise ValueError(f"least must be {least + gear.WINDOW - min_chunk(least)} or more")
    long = documents.where(F.length(text) >= least).select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = long.schema["id"].dataType.simpleString()
    named = long.select("id", F.unhex(F.md5("text")).alias("twin"), F.length("text").cast("long").alias("n_chars"))
    twins = named.groupBy("twin").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = durable(named.join(twins, "twin").select("id", "rep", "copies", "n_chars"), "p10-classes")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for twin, owner, _, _, digest in _chunk_batches(batches, least):
            yield pa.RecordBatch.from_arrays([twin.take(pa.array(owner)), pa.array(digest)], names=["twin", "digest"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, owner, start, end, digest in _chunk_batches(batches, least):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(digest)], names=["id", "start", "end", "digest"])

    # copies of one text have one twin, so only chunks of different texts count as common
    by_digest = long.select(F.xxhash64("text").alias("twin"), "text").mapInArrow(digests, "twin long, digest long").groupBy("digest")
    common = by_digest.agg(F.min("twin").alias("lo"), F.max("twin").alias("hi")).where(F.col("lo") != F.col("hi")).select("digest")
    reps = classes.where(F.col("id") == F.col("rep")).select("id")
    placed = long.mapInArrow(places, f"id {kind}, start int, end int, digest long")
    hits = placed.join(common, "digest").join(reps, "id").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("hits"))

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, columns, n = [], [], 0

        def out():
            counts = np.array([len(c[0]) for c in columns])
            every = pa.concat_arrays(ids).take(pa.array(np.repeat(np.arange(len(ids)), counts)))
            return pa.RecordBatch.from_arrays([every, *(pa.array(np.concatenate([c[k] for c in columns])) for k in range(3))], names=["rep", "start", "h1", "h2"])

        for batch in batches:
            for i in range(len(batch)):
                gears = gear.gear(gear.code_points(batch.column(1)[i].as_py()))
                size, spans = len(gears), batch.column(2)[i].values
                start, end = (spans.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                # a chunk [start, end) is in the windows that begin from end - least to start
                first, last = np.maximum(end - least, 0), np.minimum(start, size - least)
                fits = first <= last
                wanted = np.zeros(size + 2, dtype=np.int32)
                np.add.at(wanted, first[fits], 1)
                np.add.at(wanted, last[fits] + 1, -1)
                at = np.flatnonzero(np.cumsum(wanted)[:size])
                ids.append(batch.column(0).slice(i, 1))
                columns.append((at.astype(np.int32), gear.Digests(gears, 0).of(at, at + least), gear.Digests(gears, 1).of(at, at + least)))
                n += len(at)
                if n >= 200_000:
                    yield out()
                    ids, columns, n = [], [], 0
        if ids:
            yield out()

    widened = durable(long.join(hits, "id").select("id", "text", "hits").mapInArrow(widen, f"rep {kind}, start int, h1 long, h2 long"), "p10-windows")
    keys = widened.groupBy("h1", "h2").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where(F.col("lo") != F.col("hi")).select("h1", "h2")
    return classes, widened.join(keys, ["h1", "h2"]).select("rep", F.col("start").cast("long").alias("start"))


def shared_spans(documents: DataFrame, key: str = "doc_id", text: str = "text", least: int = 200) -> DataFrame:
    """(id, start_char, end_char): the stretches of at least ``least`` characters that stand verbatim in another record.

    Stretches that overlap or touch are joined. A text that has an exact copy
    is shared from end to end. Shorter, null and empty texts have none. Ids
    are taken as unique; offsets count code points, end_char is exclusive.
    """
    classes, windows = shared_windows(documents, key, text, least)
    order = Window.partitionBy("rep").orderBy("start")
    islands = (
        windows.withColumn("_new", F.when(F.col("start") > F.lag("start").over(order) + least, 1).otherwise(0))
        .withColumn("_island", F.sum("_new").over(order)).groupBy("rep", "_island")
        .agg(F.min("start").alias("start_char"), (F.max("start") + least).alias("end_char"))
    )
    copied = classes.where(F.col("copies") > 1).select("id", F.lit(0).cast("long").alias("start_char"), F.col("n_chars").alias("end_char"))
    single = classes.where(F.col("copies") == 1).drop("rep").join(islands.withColumnRenamed("rep", "id"), "id").select("id", "start_char", "end_char")
    return copied.unionByName(single)


def coverage(documents: DataFrame, key: str = "doc_id", text: str = "text", least: int = 200) -> DataFrame:
    """(id, n_chars, shared_chars, spans, share) of every record; records that share nothing have 0, a null text null n_chars."""
    spans = shared_spans(documents, key, text, least)
    sums = spans.groupBy("id").agg(F.sum(F.col("end_char") - F.col("start_char")).alias("shared_chars"), F.count("*").alias("spans"))
    all_of = documents.select(F.col(key).alias("id"), F.length(text).cast("long").alias("n_chars"))
    shared = F.coalesce("shared_chars", F.lit(0))
    return all_of.join(sums, "id", "left").select(
        "id", "n_chars", shared.alias("shared_chars"), F.coalesce("spans", F.lit(0)).alias("spans"), F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(F.lit(0.0)).alias("share")
    )
