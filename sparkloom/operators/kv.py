"""Ordered key-value tables: rows (key, value, expires_at), and an operation log they are resolved from.

A table is a DataFrame; the clock is a parameter. Bytewise key order is Spark's string order. One write
of a DataFrame is the atomic unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def live(now: float) -> Column:
    return F.col("expires_at").isNull() | (F.col("expires_at") > now)


def point_get(kv: DataFrame, keys: DataFrame, now: float) -> DataFrame:
    """Live rows of the wanted keys; Catalyst picks the join by the sizes."""
    return kv.where(live(now)).join(keys.select("key").distinct(), "key")


def prefix_scan(kv: DataFrame, prefix: str, now: float, limit: int | None = None) -> DataFrame:
    rows = kv.where(F.col("key").startswith(prefix) & live(now)).orderBy("key")
    return rows if limit is None else rows.limit(limit)


def count_prefixes(kv: DataFrame, depth: int, now: float) -> DataFrame:
    return kv.where(live(now)).groupBy(F.substring_index("key", ":", depth).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


def applied(log: DataFrame) -> DataFrame:
    """The operations of batches that happen: one with a put without value does not happen at all."""
    bad = log.where((F.col("op") == "put") & F.col("value").isNull()).select("batch_id").distinct()
    return log.join(bad, "batch_id", "left_anti")


def resolve(log: DataFrame, now: float) -> DataFrame:
    """State after the log (batch_id, seq, op, key, value, ttl_s, at): the last operation on a key counts, a batch with a put
    without value does not happen at all, a put without ttl clears an earlier one."""
    last = (
        applied(log)
        .groupBy("key").agg(F.max_by(F.struct("op", "value", "ttl_s", "at"), "seq").alias("o"))
        .where("o.op = 'put'")
        .select("key", F.col("o.value").alias("value"), (F.col("o.at") + F.col("o.ttl_s")).alias("expires_at"))
    )
    return last.where(live(now))


def deleted(log: DataFrame) -> DataFrame:
    """For every delete of a batch that happens, whether a live key was there: the operation before it on its key was a put that hadn't expired."""
    w = Window.partitionBy("key").orderBy("seq")
    before = F.lag(F.struct("op", "ttl_s", "at")).over(w)
    return (
        applied(log).withColumn("b", before).where("op = 'delete'")
        .select("seq", "key", F.coalesce((F.col("b.op") == "put") & (F.col("b.ttl_s").isNull() | (F.col("b.at") + F.col("b.ttl_s") > F.col("at"))), F.lit(False)).alias("existed"))
    )


def purge(kv: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, one row with the number removed)."""
    return kv.where(live(now)), kv.agg(F.count_if(~live(now)).alias("purged"))


def snapshot(kv: DataFrame, path: str) -> DataFrame:
    kv.write.mode("errorifexists").parquet(path)
    return kv.sparkSession.read.schema(kv.schema).parquet(path)


def kind_of(key: Column) -> Column:
    """Record kind from the key grammar."""
    parts = F.split(key, ":")
    third = F.get(parts, F.lit(2))
    return (
        F.when(parts[0] == "patient", F.when(F.size(parts) == 2, F.lit("demographics")).when(third == "med", F.lit("medication")).otherwise(third))
        .otherwise(parts[0])
    )


def browsable(prefix: Column) -> Column:
    """Prefixes that may be listed from outside."""
    return (F.length(prefix) >= 3) & ~prefix.startswith("meta:") & ~prefix.startswith("doc:")


def data_version(global_version: Column, own_version: Column) -> Column:
    return F.coalesce(global_version, F.lit(0)) * 1_000_000 + F.coalesce(own_version, F.lit(0))
