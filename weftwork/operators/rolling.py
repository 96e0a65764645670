"""Trailing-period totals, kept as a versioned daily state.

``advance`` carries the state on by a span of days: yesterday's totals, plus
the arrivals, less the amounts of the days that leave the period. It reads
yesterday's rows and the amounts of the last 30 days, nothing older.
``correct`` takes late or corrected amounts: a correction of day d changes d to
d + 29 only, and those rows get the next version. ``rolling_costs`` runs the
history through both, a written block of the state a span.

The state holds the rows of keys with a record in the trailing 30 days. Of
keys that rest longer all totals are 0; ``dense_view`` shows their days.

Input is first reduced to one row an entity and day (map-side combined), so a
key that holds a third of all rows is no larger a window than any other: the
largest window is the number of days of a span.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftwork.session import durable

KEYS = ["case_id", "feature"]
PERIODS = (7, 30)
REACH = max(PERIODS)
#: Days that one call of ``advance`` takes in when a history is run through; a daily run takes in one.
SPAN_DAYS = 92
TOTALS = [f"total_{p}" for p in PERIODS]
STATE = "case_id string, feature string, day date, amount long, total_7 long, total_30 long, last_active date, version int"


def records(logs: DataFrame, grace_days: int = 1) -> DataFrame:
    """Cost records as changes: (case_id, feature, day, late, amount in millionths, n).

    Rows without case_id or created_at are left out; a null total_cost is 0; a
    null feature is the empty text. Of rows that differ under one id the one
    loaded last holds (then the greater amount). What was loaded within
    ``grace_days`` of its day is no correction (late is false); if a later row
    of the id says otherwise, the first is taken back (n = -1) and the other
    put in its place, both late. A null id is no identity: such rows count
    each, unless they are equal throughout.
    """
    rows = logs.where(F.col("case_id").isNotNull() & F.col("created_at").isNotNull()).select(
        F.col("id"), F.col("case_id"), F.lower(F.trim(F.coalesce(F.col("feature"), F.lit("")))).alias("feature"),
        F.to_date("created_at").alias("day"), F.coalesce(F.to_date("loaded_at"), F.to_date("created_at")).alias("load_day"),
        F.coalesce(F.round(F.col("total_cost") * 1_000_000).cast("long"), F.lit(0)).alias("amount"),
    )
    said = F.struct("load_day", "amount", "case_id", "feature", "day")
    in_time = F.datediff("load_day", "day") <= grace_days
    identity = F.coalesce(F.col("id").cast("string"), F.to_json(F.struct(*[F.col(c) for c in rows.columns])))
    one = rows.groupBy(identity.alias("_k")).agg(F.max(said).alias("last"), F.max(F.when(in_time, said)).alias("first"))
    changed = F.col("first").isNull() | (F.struct(*[f"first.{c}" for c in (*KEYS, "day", "amount")]) != F.struct(*[f"last.{c}" for c in (*KEYS, "day", "amount")]))
    change = lambda which, late, sign: F.struct(
        *[F.col(f"{which}.{c}").alias(c) for c in (*KEYS, "day")], F.lit(late).alias("late"), (F.col(f"{which}.amount") * sign).alias("amount"), F.lit(sign).cast("long").alias("n")
    )
    known = F.col("first").isNotNull()
    parts = F.array(F.when(known, change("first", False, 1)), F.when(known & changed, change("first", True, -1)), F.when(changed, change("last", True, 1)))
    return one.select(F.explode(F.array_compact(parts)).alias("c")).select("c.*")


def daily_amounts(changes: DataFrame) -> DataFrame:
    """(case_id, feature, day, late, amount, n): one row a key, day and lateness; n is the number of records, less those taken back."""
    return changes.groupBy(*KEYS, "day", "late").agg(F.sum("amount").alias("amount"), F.sum("n").alias("n"))


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE)


def _date(day) -> Column:
    return F.lit(str(day)).cast("date")


def advance(state: DataFrame, arrivals: DataFrame, first, last, version: int) -> DataFrame:
    """The state's rows of the days ``first`` to ``last``, from yesterday's rows, the arrivals (KEYS, day, amount) and the expiring amounts.

    Of ``state`` only the ``REACH`` days before ``first`` are read. Keys with a
    record in those days get a row for each day, active or not, and so do keys
    that arrive, from their first day on. An empty state begins a new one.
    """
    began, ended = _date(first), _date(last)
    zero = F.lit(0).cast("long")
    event = lambda day, amount, seven, thirty, active: [*KEYS, day.alias("day"), amount.alias("amount"), seven.alias("total_7"), thirty.alias("total_30"), active.alias("last_active")]
    never = F.lit(None).cast("date")
    yesterday = state.where((F.col("day") == F.date_sub(began, 1)) & (F.col("last_active") >= F.date_sub(began, REACH)))
    recent = state.where(F.col("day").between(F.date_sub(began, REACH), F.date_sub(began, 1)) & (F.col("amount") != 0)).select(*KEYS, "day", "amount")
    new = arrivals.where(F.col("day").between(began, ended)).select(*KEYS, "day", "amount")
    events = yesterday.select(event(F.col("day"), zero, F.col("total_7"), F.col("total_30"), F.col("last_active")))
    events = events.unionByName(new.select(event(F.col("day"), F.col("amount"), F.col("amount"), F.col("amount"), F.col("day"))))
    leaving = recent.unionByName(new).select(*KEYS, "amount", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.date_add("day", p).alias("on")) for p in PERIODS])).alias("x"))
    leaving = leaving.where(F.col("x.on").between(began, ended) & (F.col("amount") != 0))
    gone = lambda p: F.when(F.col("x.p") == p, -F.col("amount")).otherwise(zero)
    events = events.unionByName(leaving.select(event(F.col("x.on"), zero, gone(7), gone(30), never)))
    starts = yesterday.select(*KEYS, began.alias("day")).unionByName(new.select(*KEYS, "day")).groupBy(*KEYS).agg(F.min("day").alias("_from"))
    spine = starts.select(*KEYS, F.explode(F.sequence("_from", ended)).alias("day"))
    events = events.unionByName(spine.select(event(F.col("day"), zero, zero, zero, never)))
    moved = events.groupBy(*KEYS, "day").agg(*[F.sum(c).alias(c) for c in ("amount", *TOTALS)], F.max("last_active").alias("last_active"))
    so_far = Window.partitionBy(*KEYS).orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = moved.select(*KEYS, "day", "amount", *[F.sum(c).over(so_far).alias(c) for c in TOTALS], F.max("last_active").over(so_far).alias("last_active"), F.lit(version).alias("version"))
    return rows.where(F.col("day") >= began)


def changes_by_day(late: DataFrame, horizon) -> DataFrame:
    """What the late amounts (KEYS, day, amount, n) add to each day they reach, up to ``horizon``: (KEYS, day, amount, total_7, total_30, last_active)."""
    once = late.groupBy(*KEYS, "day").agg(F.sum("amount").alias("amount"), F.sum("n").alias("n"))
    spread = once.select(*KEYS, "day", "amount", "n", F.explode(F.sequence(F.lit(0), F.lit(REACH - 1))).alias("_off")).where(F.expr("date_add(day, _off)") <= _date(horizon))
    return spread.groupBy(*KEYS, F.expr("date_add(day, _off)").alias("day")).agg(
        F.sum(F.when(F.col("_off") == 0, F.col("amount")).otherwise(0)).alias("amount"),
        *[F.sum(F.when(F.col("_off") < p, F.col("amount")).otherwise(0)).alias(f"total_{p}") for p in PERIODS],
        F.max(F.when(F.col("n") > 0, F.expr("date_sub(date_add(day, _off), _off)"))).alias("last_active"),
    )


def correct(state: DataFrame, changes: DataFrame) -> DataFrame:
    """``state`` after ``changes`` (of ``changes_by_day``): touched rows get the next version, all others keep theirs; rows the state did not hold are made."""
    both = state.withColumn("_changed", F.lit(0)).unionByName(changes.select(*KEYS, "day", "amount", *TOTALS, "last_active", F.lit(None).cast("int").alias("version"), F.lit(1).alias("_changed")))
    return both.groupBy(*KEYS, "day").agg(
        *[F.sum(c).alias(c) for c in ("amount", *TOTALS)], F.max("last_active").alias("last_active"), (F.coalesce(F.max("version"), F.lit(1)) + F.max("_changed")).alias("version")
    )


def spans_of(daily: DataFrame) -> DataFrame:
    """(KEYS, first_day, last_day) of the days with any record left."""
    held = daily.groupBy(*KEYS, "day").agg(F.sum("n").alias("n")).where("n > 0")
    return held.groupBy(*KEYS).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def rolling_state(logs: DataFrame, grace_days: int = 1, span_days: int = SPAN_DAYS) -> tuple[DataFrame, DataFrame]:
    """(state, spans) of ``cost_logs``: what was loaded within ``grace_days`` of its day makes version 1, later loads are corrections to it."""
    spark = logs.sparkSession
    daily = durable(daily_amounts(records(logs, grace_days)), "p6-daily")
    arrivals, late = daily.where("not late"), daily.where("late")
    ends = daily.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    if ends["a"] is None:
        return empty_state(spark), spans_of(daily)
    blocks: list[tuple[dt.date, dt.date, DataFrame]] = []
    at = ends["a"]
    while at <= ends["b"]:
        until = min(at + dt.timedelta(days=span_days - 1), ends["b"])
        before = [b for a, z, b in blocks if z >= at - dt.timedelta(days=REACH)]
        known = before[0] if before else empty_state(spark)
        for b in before[1:]:
            known = known.unionByName(b)
        blocks.append((at, until, durable(advance(known, arrivals, at, until, 1), "p6-state")))
        at = until + dt.timedelta(days=1)
    state = blocks[0][2]
    for _, _, b in blocks[1:]:
        state = state.unionByName(b)
    return correct(state, changes_by_day(late, ends["b"])), spans_of(daily)


def dense_view(state: DataFrame, spans: DataFrame) -> DataFrame:
    """Every day of a key from its first to its last record: KEYS, day, day_no, amount, total_7, total_30, version, and the daily averages avg_7 and avg_30 in dollars."""
    days = spans.select(*KEYS, "first_day", F.explode(F.sequence("first_day", "last_day")).alias("day"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = days.join(state, [*KEYS, "day"], "left").select(
        *KEYS, "day", (F.datediff("day", "first_day") + 1).alias("day_no"), zero("amount").alias("amount"), *[zero(c).alias(c) for c in TOTALS], F.coalesce("version", F.lit(1)).alias("version")
    )
    return rows.withColumns({f"avg_{p}": F.col(f"total_{p}") / F.lit(1e6) / F.lit(float(p)) for p in PERIODS})


def rolling_costs(logs: DataFrame, grace_days: int = 1, span_days: int = SPAN_DAYS) -> DataFrame:
    """The dense view of the state over ``cost_logs``; empty logs give no rows."""
    return dense_view(*rolling_state(logs, grace_days, span_days))


def spikes(state: DataFrame, spans: DataFrame) -> DataFrame:
    """(KEYS, day) from a key's 30th day to its last on which the 7-day average is more than twice the 30-day average, exact in millionths.

    Rows that the state does not hold have totals of 0 and are no spikes.
    """
    high = state.where(F.col("total_7") * 15 > F.col("total_30") * 7).select(*KEYS, "day")
    return high.join(spans, KEYS).where((F.datediff("day", "first_day") >= 29) & (F.col("day") <= F.col("last_day"))).select(*KEYS, "day")
