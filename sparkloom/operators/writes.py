"""Write-through of new values, and the semantic cache."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .records import lab_flag


def add_labs(kv: DataFrame, labs: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new key-value table, cache tags to drop, rejected rows). labs: patient_id, lab, date, value; known: patient_id.

    A value is flagged, put under its key, and raises the version of its patient by one per value."""
    there = labs.join(known.select("patient_id").distinct(), "patient_id", "left_semi")
    rejected = labs.join(known.select("patient_id").distinct(), "patient_id", "left_anti")
    slug = F.btrim(F.regexp_replace(F.lower("lab"), "[^a-z0-9]+", "_"), F.lit("_"))
    put = there.select(
        F.concat_ws(":", F.lit("patient"), "patient_id", F.lit("lab"), slug, "date").alias("key"),
        F.to_json(F.struct("date", lab_flag(F.col("lab"), F.col("value")).alias("flag"), "lab", "value")).alias("value"), F.lit(None).cast("double").alias("expires_at"),
    )
    bumps = there.groupBy(F.concat(F.lit("meta:version:"), "patient_id").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    old = kv.select("key", F.col("value").cast("long").alias("was"))
    versions = bumps.join(old, "key", "left").select("key", (F.coalesce("was", F.lit(0)) + F.col("n")).cast("string").alias("value"), F.lit(None).cast("double").alias("expires_at"))
    new = put.unionByName(versions)
    tags = there.select(F.concat(F.lit("patient:"), "patient_id").alias("tag")).distinct()
    return kv.join(new.select("key"), "key", "left_anti").unionByName(new), tags, rejected


def semantic_hits(asked: DataFrame, cached: DataFrame, least: float, block: int = 4096) -> DataFrame:
    """(qid, cached_id, score): the nearest cached question of the same bucket at ``least`` or more. An equi-join on the bucket,
    so a bucket (scope, version, options) never leaks into another.

    Cached questions are dealt in blocks of their bucket, so a hot bucket is many groups; a block is compared with the
    bucket's questions as one product of matrices and answers with one row for each at most."""
    sizes = cached.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    # One row for each bucket; hot buckets are skewed keys of these joins, which adaptive execution splits.
    dealt = cached.join(sizes, "bucket").select("bucket", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id", "embedding").toDF("bucket", "block", "id", "embedding")
    sent = asked.join(sizes, "bucket").select("bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "qid", "embedding").toDF("bucket", "block", "qid", "embedding")

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, questions: pa.Table) -> pa.Table:
        kept = pa.table([questions["qid"].slice(0, 0), rows["id"].slice(0, 0), pa.array([], pa.float64())], names=["qid", "cached_id", "score"])
        if rows.num_rows and questions.num_rows:
            rows = rows.sort_by("id")
            matrix = lambda t: np.array(t["embedding"].to_pylist(), dtype=np.float64)
            x, out = matrix(rows), []
            for at in range(0, questions.num_rows, 1024):
                part = questions.slice(at, 1024)
                scores = matrix(part) @ x.T
                near = scores.argmax(axis=1)  # the smallest id of equals
                top = scores[np.arange(len(near)), near]
                ok = np.flatnonzero(top >= least)
                out.append(pa.table([part["qid"].take(pa.array(ok)), rows["id"].take(pa.array(near[ok])), pa.array(top[ok])], names=["qid", "cached_id", "score"]))
            kept = pa.concat_tables(out)
        return kept

    kinds = f"qid {asked.schema['qid'].dataType.simpleString()}, cached_id {cached.schema['id'].dataType.simpleString()}, score double"
    found = dealt.groupBy("bucket", "block").cogroup(sent.groupBy("bucket", "block")).applyInArrow(run, kinds)
    best = F.max_by(F.struct("cached_id", "score"), F.struct("score", -F.col("cached_id")))
    return found.groupBy("qid").agg(best.alias("b")).select("qid", "b.cached_id", "b.score")
