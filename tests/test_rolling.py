"""Rolling totals against a plain loop; incremental steps against a rebuild; edge cases."""

import datetime as dt
import random

from pyspark.sql import functions as F

from weftwork.operators import rolling

LOG = "id long, case_id string, feature string, total_cost double, created_at timestamp, loaded_at timestamp"


def logs(spark, rows):
    return spark.createDataFrame(rows, LOG)


def day(n, hour=10):
    return dt.datetime(2025, 1, 1, hour) + dt.timedelta(days=n)


def plain(rows):
    once = {r[0]: r for r in rows}.values()
    amounts, out = {}, {}
    for _, case, feature, cost, at, _ in once:
        if case is not None:
            amounts.setdefault((case, (feature or "").strip().lower()), {}).setdefault(at.date(), 0)
            amounts[case, (feature or "").strip().lower()][at.date()] += round((cost or 0) * 1e6)
    for key, days in amounts.items():
        d = min(days)
        while d <= max(days):
            out[(*key, d)] = tuple(sum(days.get(d - dt.timedelta(days=k), 0) for k in range(p)) for p in (7, 30))
            d += dt.timedelta(days=1)
    return out


def collected(state):
    return {(r.case_id, r.feature, r.day): (r.total_7, r.total_30) for r in state.collect()}


def random_rows(seed, n=300):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        d = r.randrange(90)
        rows.append((i, r.choice(["a", "a", "a", "b", None]), r.choice(["x", " X", "y ", None]), r.choice([None, r.randrange(1000) / 1e6, 0.5]), day(d), day(d + r.choice([0, 0, 0, 5, 20]))))
    return rows + rows[:20]


def test_against_plain_loop(spark):
    for seed in (1, 2):
        rows = random_rows(seed)
        assert collected(rolling.rolling_costs(logs(spark, rows))) == plain(rows)


DAILY = "case_id string, feature string, day date, late boolean, amount long, n long"
START, END = dt.date(2025, 1, 1), dt.date(2025, 3, 31)


def run(spark, rows, span=7, until=END):
    """The first version of the state of daily amounts, ``span`` days a step."""
    daily = spark.createDataFrame([(c, f, d, False, a, 1) for c, f, d, a in rows], DAILY)
    state, at = rolling.empty_state(spark), START
    while at <= until:
        z = min(at + dt.timedelta(days=span - 1), until)
        state = rolling.durable(state.unionByName(rolling.advance(state, daily, at, z, 1)), "t")
        at = z + dt.timedelta(days=1)
    return state


def test_corrections_touch_their_dates_only(spark):
    told = [("a", "x", START, 5), ("a", "x", dt.date(2025, 3, 20), 7)]
    late = [("a", "x", dt.date(2025, 1, 10), 3), ("b", "x", dt.date(2025, 1, 4), 1), ("a", "x", dt.date(2025, 3, 25), 4)]
    base = run(spark, told, 45)
    changes = rolling.changes_by_day(spark.createDataFrame([(c, f, d, True, a, 1) for c, f, d, a in late], DAILY), END)
    state = rolling.correct(base, changes)
    rebuilt = collected(run(spark, told + late, 45))
    got = collected(state)
    assert {k: v for k, v in got.items() if any(v)} == {k: v for k, v in rebuilt.items() if any(v)}
    versions = {r.day: r.version for r in state.where("case_id = 'a'").collect()}
    assert versions[dt.date(2025, 1, 9)] == 1 and versions[dt.date(2025, 1, 10)] == 2 and versions[dt.date(2025, 2, 8)] == 2 and versions[dt.date(2025, 3, 24)] == 1 and versions[dt.date(2025, 3, 25)] == 2
    assert collected(rolling.correct(base, changes.limit(0))) == collected(base)


def test_steps_of_any_length_give_the_same_state(spark):
    rows = [("a", "x", START + dt.timedelta(days=k), k + 1) for k in range(0, 12, 3)] + [("a", "x", dt.date(2025, 2, 20), 9), ("b", "x", dt.date(2025, 1, 9), 4)]
    until = dt.date(2025, 2, 25)
    whole = collected(run(spark, rows, 90, until))
    for span in (10, 23):
        stepped = collected(run(spark, rows, span, until))
        assert {k: v for k, v in stepped.items() if any(v)} == {k: v for k, v in whole.items() if any(v)}
    daily = spark.createDataFrame([(c, f, d, False, a, 1) for c, f, d, a in rows], DAILY)
    state = run(spark, rows, 20, dt.date(2025, 2, 9))
    next_day = collected(rolling.advance(state, daily, dt.date(2025, 2, 10), dt.date(2025, 2, 10), 1))
    assert next_day == {k: v for k, v in whole.items() if k[2] == dt.date(2025, 2, 10) and any(v)}


def test_a_record_corrected_under_one_id(spark):
    rows = [(1, "a", "x", 1.0, day(0), day(0)), (1, "a", "x", 3.0, day(0), day(9)), (2, "a", "x", 1.0, day(2), day(2)), (2, "a", "y", 1.0, day(2), day(30)), (3, "a", "x", 1.0, day(5), day(5)), (3, "a", "x", 1.0, day(5), day(40))]
    got = {(r.feature, r.day): (r.total_7, r.version) for r in rolling.rolling_costs(logs(spark, rows)).collect()}
    first = dt.date(2025, 1, 1)
    assert got["x", first] == (3_000_000, 2) and got["x", first + dt.timedelta(days=2)] == (3_000_000, 2) and got["x", first + dt.timedelta(days=5)] == (4_000_000, 2)
    assert got["y", first + dt.timedelta(days=2)] == (1_000_000, 2) and max(d for f, d in got if f == "x") == first + dt.timedelta(days=5)


def test_edges(spark):
    empty = logs(spark, [])
    assert rolling.rolling_costs(empty).count() == 0
    tied = [(1, "a", "x", 1.0, day(0), day(0)), (1, "a", "x", 1.0, day(0), day(0)), (2, "a", "x", None, day(40), day(40)), (None, "a", "x", 1.0, day(1), day(1)), (None, "a", "x", 1.0, day(1), day(1))]
    state = rolling.rolling_costs(logs(spark, tied).withColumns({"amount": F.lit(9), "day": F.lit("x"), "version": F.lit("y")}))
    got = collected(state)
    assert len(got) == 41 and got["a", "x", dt.date(2025, 1, 2)] == (2_000_000, 2_000_000) and got["a", "x", dt.date(2025, 2, 10)] == (0, 0)


def test_spikes_are_exact(spark):
    state = spark.createDataFrame([("a", "x", dt.date(2025, 1, 30), 7, 15), ("a", "x", dt.date(2025, 1, 31), 8, 15), ("a", "x", dt.date(2025, 1, 29), 100, 100), ("a", "x", dt.date(2025, 2, 9), 9, 9)], "case_id string, feature string, day date, total_7 long, total_30 long")
    spans = spark.createDataFrame([("a", "x", START, dt.date(2025, 2, 1))], "case_id string, feature string, first_day date, last_day date")
    assert [r.day for r in rolling.spikes(state, spans).collect()] == [dt.date(2025, 1, 31)]
