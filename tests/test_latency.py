"""Latencies in bounded memory against exact figures."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from sparkloom.operators import latency

BEGIN = dt.datetime(2026, 1, 1)


def test_sketches_stay_within_their_rank_error_and_size(spark):
    n = 400_000
    rows = spark.range(n).select(F.when(F.col("id") % 10 > 0, "hot").otherwise("cold").alias("route"), F.timestamp_seconds(1_767_225_600 + F.col("id") % 86_400).alias("at"), (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7.0).alias("ms"))
    sliced = latency.slices(rows, "at", "ms", ["route"], "1 hour").cache()
    assert sliced.count() == 48 and sliced.agg(F.max(F.length("sketch"))).first()[0] < 120_000
    values = defaultdict(list)
    for r in rows.select("route", "ms").collect():
        values[r.route].append(r.ms)
    for r in latency.merge(sliced, ["route"]).collect():
        x = np.sort(values[r.route])
        assert r.n == len(x) and abs(r.mean - x.mean()) < 0.01
        for q, told in zip(latency.QUANTILES, (r.p50, r.p95, r.p99), strict=True):
            below, upto = np.searchsorted(x, told, "left") / len(x), np.searchsorted(x, told, "right") / len(x)
            assert below - latency.rank_error() <= q <= upto + latency.rank_error()


def test_windows_are_sums_of_their_slices(spark):
    rng = random.Random(2)
    rows = [("a" if rng.random() < 0.7 else "b", BEGIN + dt.timedelta(minutes=rng.randrange(60 * 30)), None if rng.random() < 0.1 else float(rng.randrange(1000))) for _ in range(500)]
    df = spark.createDataFrame(rows, "k string, at timestamp, ms double")
    got = {(r.k, r.last): (r.n, r.total, r.p50) for r in latency.windows(latency.slices(df, "at", "ms", ["k"], "1 hour"), ["k"], 5, 3600).collect()}
    hour = lambda t: t.replace(minute=0)
    exp = {}
    for k, last in {(k, hour(t)) for k, t, v in rows if v is not None}:
        x = sorted(v for kk, t, v in rows if kk == k and v is not None and last - dt.timedelta(hours=4) <= hour(t) <= last)
        exp[k, last] = (len(x), sum(x), x[-(-len(x) // 2) - 1])  # few values: the sketch holds them all
    assert got == exp
    assert latency.merge(latency.slices(df.limit(0), "at", "ms", ["k"], "1 hour"), ["k"]).count() == 0


def test_last_values_in_batch_and_stream(spark, tmp_path):
    rng = random.Random(3)
    batches = [[(rng.choice("aab"), BEGIN + dt.timedelta(seconds=rng.randrange(5000)), b * 100 + i, float(rng.randrange(100))) for i in range(60)] for b in range(3)]
    schema = "key string, at timestamp, seq long, value double"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for b, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            q = latency.recent_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 25).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True)
            seen: dict = {}
            q.foreachBatch(lambda df, _, seen=seen: seen.update({r.key: r for r in df.collect()})).start().awaitTermination()
            all_rows = spark.createDataFrame([r for part in batches[: b + 1] for r in part], schema)
            for r in latency.recent_percentiles(all_rows, "at", "seq", "value", ["key"], 25).collect():
                s = seen[r.key]
                assert (s.n, s["mean"], s.p50, s.p95, s.p99) == (r.n, r["mean"], r.p50, r.p95, r.p99) and s.n <= 25
        assert sum(r.evicted for r in seen.values()) > 0
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_the_query_of_windows_broadcasts_windows_and_no_values(spark, tmp_path):
    from sparkloom.plans import registry

    rows = spark.range(3000).select("id", F.lit("view").alias("event_type"), F.timestamp_seconds(1_704_067_200 + F.col("id") * 60).cast("timestamp_ntz").alias("ts"), (F.col("id") % 7).cast("double").alias("value"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    out = registry.QUERIES["latency_windows"](spark, str(tmp_path))
    assert out.count() == 50 and out.where("not (p50_ok and p95_ok and p99_ok)").count() == 0
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan
