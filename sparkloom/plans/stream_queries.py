"""Streams over the given tables, each run until it has read what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.shared import shared_dir
from ..streaming import serve
from .base import query, read


@query(
    "write_through_stream",
    """SELECT subject, CAST(sum(n) AS BIGINT) AS version, count(*) AS keys, round(sum(value), 2) AS total FROM (
      SELECT printf('P%06d', o_custkey) AS subject, strftime(o_orderdate, '%Y-%m-%d') AS d, count(*) AS n, max(o_totalprice) AS value FROM orders WHERE o_custkey % 3 > 0 GROUP BY ALL) GROUP BY subject""",
)
def write_through_stream(spark, d):
    """All orders as a stream of lab values of known subjects, written through: values, keys and versions of every subject."""
    orders = read(spark, d, "orders")
    pid = F.format_string("P%06d", "o_custkey").alias("patient_id")
    stream = spark.readStream.schema(orders.schema).parquet(f"{d}/orders.parque[t]")  # a pattern, since a stream reads folders
    labs = stream.select(pid, F.lit("fasting glucose").alias("lab"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_totalprice").alias("value"))
    store = serve.Store(spark, shared_dir(spark, "store"))
    serve.write_stream(labs, store, shared_dir(spark, "stream"), orders.where("o_custkey % 3 > 0").select(pid)).awaitTermination()
    rows = store.records()
    is_version = F.col("key").startswith(serve.VERSION)
    value = F.when(~is_version, F.get_json_object("value", "$.value").cast("double"))
    return rows.groupBy("subject").agg(F.max(F.when(is_version, F.col("value").cast("long"))).alias("version"), F.count_if(~is_version).alias("keys"), F.round(F.sum(value), 2).alias("total"))
