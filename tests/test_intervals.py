"""Points in spans against all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import intervals


@pytest.mark.parametrize(("width", "levels", "most"), [(1.0, 16, 100_000), (7.0, 2, 5), (0.5, 0, 3), (1000.0, 3, 100_000)])
def test_equal_to_all_pairs(spark, width, levels, most):
    rng = random.Random(int(width * 10) + levels)
    points = [(i, rng.choice([None, *"aaab"]), rng.choice([None, rng.randrange(-50, 300), rng.random() * 300])) for i in range(150)] + [(900, "a", 17), (900, "a", 17)]
    spans = [(i, rng.choice([None, *"aab"]), b, None if rng.random() < 0.2 else b + rng.choice([0, 1, rng.randrange(200), rng.random(), -3])) for i in range(80) for b in [rng.choice([rng.randrange(-60, 320), rng.random() * 300])]] + [(99, "a", None, 5)]
    p = spark.createDataFrame([(i, k, None if t is None else float(t)) for i, k, t in points], "pid long, k string, at double")
    s = spark.createDataFrame([(i, k, None if a is None else float(a), None if b is None else float(b)) for i, k, a, b in spans], "sid long, k string, a double, b double")
    holds = lambda t, a, b: t is not None and a is not None and a <= t and (b is None or b > t)
    keyed = sorted((r.pid, r.sid) for r in intervals.points_in_spans(p, s, "at", "a", "b", ("k",), width, levels, most).collect())
    assert keyed == sorted((i, j) for i, k, t in points for j, q, a, b in spans if k is not None and k == q and holds(t, a, b)) and keyed
    free = sorted((r.pid, r.sid) for r in intervals.points_in_spans(p, s.drop("k"), "at", "a", "b", (), width, levels, most).collect())
    assert free == sorted((i, j) for i, _, t in points for j, _, a, b in spans if holds(t, a, b))


def test_empty_tables_and_long_spans(spark):
    p = spark.createDataFrame([(1, 5.0), (2, 1e9)], "pid long, at double")
    s = spark.createDataFrame([(1, 0.0, None), (2, -1e9, 2e9), (3, 6.0, 1e9)], "sid long, a double, b double")
    assert sorted((r.pid, r.sid) for r in intervals.points_in_spans(p, s, "at", "a", "b", width=1000.0).collect()) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert intervals.points_in_spans(p.limit(0), s, "at", "a", "b").count() == intervals.points_in_spans(p, s.limit(0), "at", "a", "b").count() == 0


def test_a_span_of_many_bins_is_few_rows(spark):
    s = spark.createDataFrame([(0, 0.0, 3000.0)], "sid long, a double, b double").withColumn("q", intervals._squares(intervals.F.lit(1).cast("long"), intervals.F.lit(2999).cast("long"), 16))
    squares = s.first().q
    assert len(squares) <= 2 * 12
    bins = sorted(b for q in squares for b in range(q.square << q.level, (q.square + 1) << q.level))
    assert bins == list(range(1, 3000))


def test_totals_in_spans_equal_the_pairs_without_making_them(spark):
    rng = random.Random(6)
    base = 1_700_000_000_000_000
    ps = [(i, base + rng.choice([rng.randrange(50), rng.randrange(5_000_000)])) for i in range(300)] + [(300, None)]
    ss = [(i, base - 10 + rng.choice([rng.randrange(80), rng.randrange(6_000_000)]), None if i % 9 == 0 else rng.choice([0, 1, 7, 2_000_000])) for i in range(200)] + [(200, None, 5)]
    p = spark.createDataFrame(ps, "pid long, t long").select("pid", F.timestamp_micros("t").alias("at"))
    s = spark.createDataFrame(ss, "sid long, t long, d long").select("sid", F.timestamp_micros("t").alias("a"), F.timestamp_micros(F.col("t") + F.col("d")).alias("b"))
    totals = {"n": (F.sum, F.lit(1)), "least": (F.min, F.col("pid")), "most": (F.max, F.col("pid")), "total": (F.sum, F.col("pid"))}
    want = []
    for sid, a, d in ss:
        xs = [i for i, t in ps if None not in (a, t) and a <= t and (d is None or t < a + d)]
        want += [(sid, len(xs), min(xs), max(xs), sum(xs))] if xs else []
    out = intervals.totals_in_spans(p, s, "at", "a", "b", ["sid"], totals)
    assert sorted(tuple(r) for r in out.collect()) == want
    assert intervals.totals_in_spans(p.limit(0), s, "at", "a", "b", ["sid"], totals).count() == 0


def test_query_of_points_in_spans_makes_no_pairs(spark, tmp_path, monkeypatch):
    from sparkloom.plans import registry

    rows = [(i, "2024-01-01 00:00:00", "signup" if i % 2 else "purchase") for i in range(40)]
    spark.createDataFrame(rows, "event_id long, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(intervals, "points_in_spans", None)  # the operator that gives all pairs
    out = registry.QUERIES["points_in_spans"](spark, str(tmp_path))
    assert {(r.n, r.first_id, r.total) for r in out.collect()} == {(20, 0, 380)}
