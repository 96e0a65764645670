"""Structured Streaming: daily counts, inbox, time-limited deduplication, a job queue, a stateful case tracker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.session import shared_dir


def read_table_stream(spark: SparkSession, path: str, per_trigger: int = 4) -> DataFrame:
    """A Parquet table, a folder or a single file, as a stream of its files."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def daily_counts(events: DataFrame, ts: str, kind: str, late: str = "2 days") -> DataFrame:
    """(day, kind, n) by tumbling days; events later than the watermark are left out, as their day is closed."""
    stamped = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return stamped.groupBy(F.window("_ts", "1 day").alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "kind", "n")


def sliding_sums(events: DataFrame, ts: str, key: str, value: str, length: str = "7 days", slide: str = "1 day", late: str = "2 days") -> DataFrame:
    stamped = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return stamped.groupBy(F.window("_ts", length, slide).alias("w"), key).agg(F.sum(value).alias("total")).select(key, F.col("w.start").alias("start_at"), F.col("w.end").alias("end_at"), "total")


def once(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there and returns its result table, written to the shared folder batch by batch."""
    import uuid

    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/weftwork/stream-{name}-{uuid.uuid4().hex}"

    def save(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{at}/out")

    running = stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def unique_within(stream: DataFrame, key: str, ts: str, ttl: str = "24 hours") -> DataFrame:
    """The first of the rows with equal ``key`` within ``ttl`` of event time: a cache whose entries end."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


def inbox(spark: SparkSession, path: str, archive: str) -> DataFrame:
    """Text files as they arrive in a folder, (path, text, hash); read ones are moved to ``archive``."""
    raw = spark.readStream.format("text").option("wholetext", True).option("cleanSource", "archive").option("sourceArchiveDir", archive).load(path)
    return raw.select(F.input_file_name().alias("path"), F.col("value").alias("text"), F.sha2("value", 256).alias("hash"))


def run_queue(jobs: DataFrame, work: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame], None], checkpoint: str, retries: int = 3):
    """Starts a job queue: each batch in order of priority and arrival through ``work``, its rows to ``sink``.

    ``work`` returns rows with a boolean column ok; failed jobs run again, up
    to ``retries`` times, and come out with ok false after that.
    """

    def handle(batch: DataFrame, _: int) -> None:
        todo = batch.orderBy(F.desc("priority"), "queued_at", "id")
        for left in range(retries, 0, -1):
            done = work(todo).cache()
            sink((done if left == 1 else done.where("ok")).withColumn("attempt", F.lit(retries - left + 1)))
            failed = done.where("not ok").select(*batch.columns)
            more = failed.limit(1).count() and left > 1
            todo = batch.sparkSession.createDataFrame(failed.collect(), batch.schema) if more else None  # a batch's failures, not the queue
            done.unpersist()
            if not more:
                break

    return jobs.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


PROGRESS = "case_id string, events long, first_at timestamp, last_at timestamp, kinds string"


def track_cases(events: DataFrame, key: str, ts: str, kind: str, late: str = "1 day") -> DataFrame:
    """Running state of each case: number of events, first and last time, kinds seen; emitted on every change, dropped when idle for a week of event time."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, first, last, kinds = state.get if state.exists else (0, None, None, "")
        seen = set(filter(None, kinds.split(",")))
        for rows in batches:
            n += len(rows)
            first = min(filter(None, [first, rows[ts].min().to_pydatetime()]))
            last = max(filter(None, [last, rows[ts].max().to_pydatetime()]))
            seen |= set(rows[kind])
        state.update((n, first, last, ",".join(sorted(seen))))
        state.setTimeoutTimestamp(int(last.timestamp() * 1000) + 7 * 86_400_000)
        yield pd.DataFrame([(k[0], n, first, last, ",".join(sorted(seen)))], columns=["case_id", "events", "first_at", "last_at", "kinds"])

    stamped = events.select(F.col(key).cast("string").alias(key), F.col(ts).cast("timestamp").alias(ts), kind).withWatermark(ts, late)
    state = "events long, first_at timestamp, last_at timestamp, kinds string"
    return stamped.groupBy(key).applyInPandasWithState(step, PROGRESS, state, "update", GroupStateTimeout.EventTimeTimeout)
