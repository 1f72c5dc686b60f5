"""Stateful operators: a tagged LRU cache with expiry, token buckets, single flight, event-time windows.

State is kept per key by Structured Streaming (``transformWithStateInPandas``); the same step functions replay a bounded
log per key in batch (``applyInPandas``). Keys are cache shards or users, so state and replay spread over the cluster.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LRU_OUT = "shard string, seq long, outcome string, size int"


class Cache:
    """One shard: get, set, invalidate, invalidate_tag, clear."""

    def __init__(self, capacity: int):
        self.capacity, self.rows = capacity, OrderedDict()  # key -> (expires, tags)

    def step(self, op: str, key: str | None, tags: str | None, ttl: float | None, at: float) -> str:
        if op == "get":
            found = self.rows.get(key)
            if found is None:
                return "miss"
            if found[0] is not None and found[0] <= at:
                del self.rows[key]
                return "expired"
            self.rows.move_to_end(key)
            return "hit"
        if op == "set":
            self.rows.pop(key, None)
            self.rows[key] = (None if ttl is None or ttl != ttl else at + ttl, frozenset((tags or "").split(",")) - {""})
            if len(self.rows) > self.capacity:
                self.rows.popitem(last=False)
                return "evicted"
            return "set"
        if op == "invalidate":
            return "invalidated" if self.rows.pop(key, None) is not None else "absent"
        if op == "invalidate_tag":
            gone = [k for k, (_, t) in self.rows.items() if tags in t]
            for k in gone:
                del self.rows[k]
            return f"invalidated:{len(gone)}"
        self.rows.clear()
        return "cleared"


def _in_order(log: DataFrame, key: str, order: list[str], schema: str, begin, step) -> DataFrame:
    """Folds the rows of every key in order: each task gets its keys sorted, reads them batch by batch and holds one key's state
    only, however many rows a key has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in schema.split(", ")]
        now = state = None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                k = getattr(r, key)
                if state is None or k != now:
                    now, state = k, begin()
                out.append(step(state, r))
            yield pd.DataFrame(out, columns=names)

    return log.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def lru_replay(log: DataFrame, capacity: int) -> DataFrame:
    """Outcome of every operation of a log (shard, seq, op, key, tags, ttl, at), shard by shard in order of ``seq``."""

    def step(cache: Cache, r) -> tuple:
        return r.shard, r.seq, cache.step(r.op, r.key, r.tags, r.ttl, r.at), len(cache.rows)

    return _in_order(log, "shard", ["seq"], LRU_OUT, lambda: Cache(capacity), step)


class CacheProcessor(StatefulProcessor):
    """The same cache as a streaming operator, one state value per shard."""

    def __init__(self, capacity: int):
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("cache", "keys array<string>, expires array<double>, tags array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        cache = Cache(self.capacity)
        if self.state.exists():
            keys, expires, tags = self.state.get()
            cache.rows = OrderedDict((k, (e, frozenset(t.split(",")) - {""})) for k, e, t in zip(keys, expires, tags, strict=True))
        out = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            ttl = None if r.ttl is None or r.ttl != r.ttl else r.ttl
            out.append((key[0], r.seq, cache.step(r.op, r.key, r.tags, ttl, r.at), len(cache.rows)))
        self.state.update((list(cache.rows), [e for e, _ in cache.rows.values()], [",".join(sorted(t)) for _, t in cache.rows.values()]))
        yield pd.DataFrame(out, columns=["shard", "seq", "outcome", "size"])

    def close(self) -> None:
        pass


def lru_stream(log: DataFrame, capacity: int) -> DataFrame:
    return log.groupBy("shard").transformWithStateInPandas(CacheProcessor(capacity), LRU_OUT, outputMode="Append", timeMode="None")


def token_bucket(log: DataFrame, per_minute: float, burst: float | None = None) -> DataFrame:
    """(user, seq, allowed, wait): a bucket per user refills at rate/60 a second up to ``burst``."""
    size = max(5.0, per_minute / 4) if burst is None else burst

    def step(state: dict, r) -> tuple:
        level = min(size, state["level"] + (0.0 if state["last"] is None else (r.at - state["last"]) * per_minute / 60))
        ok = level >= 1
        state.update(level=level - ok, last=r.at)
        return r.user, r.seq, bool(ok), 0.0 if ok else (1 - level) * 60 / per_minute

    return _in_order(log, "user", ["at", "seq"], "user string, seq long, allowed boolean, wait double", lambda: {"level": size, "last": None}, step)


def single_flight(calls: DataFrame, key: str, at: str, tie: str, window_s: float) -> DataFrame:
    """(key, tie, flight, leader): within ``window_s`` of a leader's call, callers of its key share its result; the next later call leads
    again."""

    def step(state: dict, r) -> tuple:
        leads = state["since"] is None or getattr(r, at) - state["since"] > window_s
        if leads:
            state.update(since=getattr(r, at), flight=state["flight"] + 1)
        return getattr(r, key), getattr(r, tie), state["flight"], leads

    kinds = {f.name: f.dataType.simpleString() for f in calls.schema}
    schema = f"{key} {kinds[key]}, {tie} {kinds[tie]}, flight long, leader boolean"
    return _in_order(calls.select(key, tie, at), key, [at, tie], schema, lambda: {"since": None, "flight": 0}, step)


def windowed_counts(events: DataFrame, at: str, by: str, size: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts and sums per event-time window; late rows within the watermark still count. Batch or stream."""
    return (
        events.withWatermark(at, late).groupBy(F.window(at, size, slide), by)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")
    )


def sessions(events: DataFrame, at: str, by: str, gap: str, late: str) -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


def answer_tokens(answers: DataFrame, key: str) -> DataFrame:
    """The pieces in which an answer is streamed: each word with the white space after it."""
    return answers.select(key, F.posexplode(F.regexp_extract_all("answer", F.lit(r"\S+\s*"), F.lit(0))).alias("pos", "piece"))
