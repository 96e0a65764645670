"""Streams run once over small tables."""

import datetime as dt

from pyspark.sql import functions as F

from weftwork.streaming import jobs


def test_daily_counts_equal_batch(spark, sf):
    counts = jobs.once(jobs.daily_counts(jobs.read_table_stream(spark, f"{sf}/events.parquet"), "ts", "event_type", "60 days"), "t")
    batch = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("kind")).count()
    assert {tuple(r) for r in counts.collect()} == {tuple(r) for r in batch.collect()}


def test_unique_within(spark, tmp_path):
    at = dt.datetime(2025, 1, 1)
    spark.createDataFrame([("a", at), ("a", at + dt.timedelta(hours=1)), ("b", at)], "h string, t timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    out = jobs.once(jobs.unique_within(jobs.read_table_stream(spark, str(tmp_path / "in")), "h", "t"), "u", "append")
    assert sorted(r.h for r in out.collect()) == ["a", "b"]


def test_inbox(spark, tmp_path):
    (tmp_path / "box").mkdir()
    (tmp_path / "box" / "a.txt").write_text("hello\nworld")
    out = jobs.once(jobs.inbox(spark, str(tmp_path / "box"), str(tmp_path / "done")), "i", "append")
    assert [r.text for r in out.collect()] == ["hello\nworld"]


def test_queue_retries(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, 5, 0), (3, 1, 9)], "id long, priority int, fails int").withColumn("queued_at", F.lit("2025-01-01").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "jobs"))
    seen = []

    def work(todo):
        return todo.withColumn("ok", F.col("fails") == 0)

    jobs.run_queue(jobs.read_table_stream(spark, str(tmp_path / "jobs")), work, lambda d: seen.extend(d.collect()), str(tmp_path / "cp"), 3).awaitTermination()
    assert sorted((r.id, r.ok, r.attempt) for r in seen) == [(1, True, 1), (2, True, 1), (3, False, 3)]


def test_case_tracker(spark, tmp_path):
    at = dt.datetime(2025, 1, 1)
    spark.createDataFrame([("c", at, "x"), ("c", at + dt.timedelta(hours=2), "y"), ("d", at, "x")], "k string, t timestamp, e string").coalesce(1).write.parquet(str(tmp_path / "ev"))
    out = jobs.once(jobs.track_cases(jobs.read_table_stream(spark, str(tmp_path / "ev")), "k", "t", "e"), "c", "update")
    assert {(r.case_id, r.events, r.kinds) for r in out.collect()} == {("c", 2, "x,y"), ("d", 1, "x")}
