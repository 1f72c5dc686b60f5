"""Latencies in bounded memory: quantile sketches per time slice that are merged for any window, and the last values of each key.

A sketch of parameter ``k`` holds a few thousand values however many it has seen; the rank of a quantile that it tells differs from the true one by
``rank_error(k)`` at most, with 99 % confidence. Slices are aggregated map-side, so a hot route costs a sketch in each task; old windows are answered
from the slices without the values.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .measures import percentiles

K, LAST = 4000, 5000
QUANTILES = (0.5, 0.95, 0.99)


def rank_error(k: int = K) -> float:
    """Normalised rank error of a single quantile of a KLL sketch."""
    return 2.296 / k**0.9021


def slices(df: DataFrame, at: str, value: str, by: list[str], width: str, k: int = K) -> DataFrame:
    """by, slice (its start), n, total, sketch: one row for each key and time slice. Null values do not count."""
    v = F.col(value).cast("double")
    start = F.window(at, width)["start"].alias("slice")
    return df.where(v.isNotNull()).groupBy(*by, start).agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), F.call_function("kll_sketch_agg_double", v, F.lit(k)).alias("sketch"))


def merge(sliced: DataFrame, by: list[str], k: int = K, names: tuple[str, ...] = ("p50", "p95", "p99")) -> DataFrame:
    """by, n, total, mean and the quantiles of all slices of a key together."""
    whole = sliced.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.call_function("kll_merge_agg_double", F.col("sketch"), F.lit(k)).alias("sketch"))
    told = [F.call_function("kll_sketch_get_quantile_double", F.col("sketch"), F.lit(float(q))).alias(c) for q, c in zip(QUANTILES, names, strict=True)]
    return whole.select(*by, "n", "total", F.round(F.col("total") / F.col("n"), 3).alias("mean"), *told)


def windows(sliced: DataFrame, by: list[str], slices_each: int, width_s: int, k: int = K) -> DataFrame:
    """The same for every sliding window of ``slices_each`` slices of ``width_s`` seconds, named by its last slice: a slice goes to the windows that it lies in, so each is
    read ``slices_each`` times and no window holds more than its slices."""
    ahead = F.explode(F.transform(F.sequence(F.lit(0), F.lit(slices_each - 1)), lambda i: F.timestamp_seconds(F.unix_timestamp("slice") + i * width_s)))
    spread = sliced.withColumn("last", ahead)
    there = sliced.select(*by, F.col("slice").alias("last")).distinct()  # windows that end where nothing happened are not asked for
    return merge(spread.join(there, [*by, "last"]), [*by, "last"], k)


def recent(df: DataFrame, at: str, tie: str, by: list[str], most: int = LAST) -> DataFrame:
    """The last ``most`` rows of each key: each task keeps as many before the exchange."""
    w = Window.partitionBy(*by).orderBy(F.desc(at), F.desc(tie))
    return df.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)


def recent_percentiles(df: DataFrame, at: str, tie: str, value: str, by: list[str], most: int = LAST) -> DataFrame:
    """n, mean and exact percentiles of the last ``most`` rows of each key."""
    return percentiles(recent(df, at, tie, by, most), value, by)


class RecentProcessor(StatefulProcessor):
    """The last values of a key as state of a stream: what is older than the last ``most`` is evicted in the batch that brings newer ones."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("recent", "at array<timestamp>, seq array<long>, value array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = None
        if self.state.exists():
            at, seq, value = self.state.get()
            held = pd.DataFrame({"at": list(at), "seq": list(seq), "value": list(value)})
        evicted = 0
        for part in rows:
            part = part[["at", "seq", "value"]]
            held = part if held is None else pd.concat([held, part], ignore_index=True)
            if len(held) > self.most:
                evicted += len(held) - self.most
                held = held.sort_values(["at", "seq"]).tail(self.most)
        self.state.update((list(held["at"]), [int(x) for x in held["seq"]], [float(x) for x in held["value"]]))
        q = held["value"].quantile([0.5, 0.95, 0.99]).round(3).tolist()
        yield pd.DataFrame([(key[0], len(held), evicted, round(held["value"].mean(), 3), *q)], columns=["key", "n", "evicted", "mean", "p50", "p95", "p99"])

    def close(self) -> None:
        pass


def recent_stream(rows: DataFrame, most: int = LAST) -> DataFrame:
    """rows: key, at, seq, value as a stream. After each batch the figures of every key that it touched: key, n, evicted, mean, p50, p95, p99."""
    return rows.groupBy("key").transformWithStateInPandas(RecentProcessor(most), "key string, n long, evicted long, mean double, p50 double, p95 double, p99 double", outputMode="Update", timeMode="None")


def off_rank(below: Column, upto: Column, n: Column, q: float) -> Column:
    """How far the share of values that a told quantile claims lies from ``q``: 0 where ``q`` falls between the shares below it and up to it."""
    return F.greatest(below / n - q, q - upto / n, F.lit(0.0))
