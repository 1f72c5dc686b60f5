"""Fusing, reranking and diversifying ranked lists: rows (query, id, score, rank)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

RRF = 60


def rrf(lists: list[DataFrame], key: str, query_key: str, k: int, by_raw: bool = False) -> DataFrame:
    """Reciprocal rank fusion. ``score`` stays the raw score of the first list that has the row; the fused value decides who is among
    the k. ``by_raw`` then ranks them by raw score (the reference behaviour), else by fused value."""
    parts = [x.select(query_key, key, "score", "rank", F.lit(i).alias("list")) for i, x in enumerate(lists)]
    fused = (
        reduce(DataFrame.unionByName, parts).groupBy(query_key, key)
        .agg(F.sum(1.0 / (RRF + F.col("rank"))).alias("fused"), F.min_by("score", "list").alias("score"))
    )
    w = Window.partitionBy(query_key).orderBy(F.desc(F.round("fused", 12)), key)
    top = fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if by_raw:
        top = top.withColumn("rank", F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), key)))
    return top


def lexical_score(asked: Column, shared: Column, hits: Column, size: Column, titled: Column) -> Column:
    """0.6 overlap + 0.25 density + 0.15 if a question word stands in the section title: of the different question words and how many of them are there, how often, among how many words."""
    bonus = F.when(titled, 0.15).otherwise(0.0)
    return 0.6 * (shared / asked) + 0.25 * F.least(hits / F.sqrt(size + 1.0), F.lit(1.0)) + bonus


def rerank(rows: DataFrame, key: str, query_key: str, k: int, alpha: float = 0.5) -> DataFrame:
    """rows: query_key, key, score and question, section, text, or, counted before, ``asked``, ``shared``, ``hits``, ``size``, ``titled`` as in ``lexical_score``. Questions without words keep their order."""
    split = rows
    if "shared" not in rows.columns:
        q, body, section = F.col("_q"), F.col("_body"), F.col("_section")
        split = rows.withColumns({"_q": F.array_distinct(tokens(F.col("question"))), "_body": tokens(F.concat_ws(" ", "section", "text")), "_section": tokens(F.col("section"))})
        split = split.withColumns({
            "asked": F.size(q), "shared": F.size(F.array_intersect(q, body)), "hits": F.size(F.filter(body, lambda t: F.array_contains(q, t))), "size": F.size(body), "titled": F.arrays_overlap(section, q),
        }).drop("_q", "_body", "_section")
    lexical = lexical_score(*[F.col(c) for c in ("asked", "shared", "hits", "size", "titled")])
    split = split.withColumn("_lexical", F.when(F.col("asked") > 0, lexical)).drop("asked", "shared", "hits", "size", "titled")  # before the windows: these need no texts
    best = F.max("score").over(Window.partitionBy(query_key))
    split = split.withColumn("_max", F.when(F.coalesce(best, F.lit(0.0)) == 0, 1.0).otherwise(best))
    scored = split.withColumn("rerank_score", F.when(F.col("_lexical").isNotNull(), F.round(alpha * F.col("score") / F.col("_max") + (1 - alpha) * F.col("_lexical"), 6)))
    w = Window.partitionBy(query_key).orderBy(F.desc_nulls_last("rerank_score"), F.desc(F.round("score", 9)), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_lexical", "_max")


def keep_order(rows: DataFrame, query_key: str, k: int) -> DataFrame:
    """The reranker that changes nothing: the first k rows, numbered anew."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(query_key).orderBy("rank"))).where(F.col("rank") <= k)


def diversify(rows: DataFrame, key: str, query_key: str, namespace: str, k: int) -> DataFrame:
    """The best row of each namespace stays; the rest is filled by rank up to k; order by rank."""
    first = F.row_number().over(Window.partitionBy(query_key, namespace).orderBy("rank", key)) == 1
    chosen = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("_first"), "rank", key))
    kept = rows.withColumn("_first", first).withColumn("_n", chosen).where(F.col("_n") <= k).drop("_first", "_n")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(query_key).orderBy("rank", key)))


def in_scope(rows: DataFrame, patient: str, scope: Column) -> tuple[DataFrame, DataFrame]:
    """(rows of no patient or of the one in scope, one row with the number that leaked)."""
    ok = F.col(patient).isNull() | F.coalesce(F.col(patient) == scope, F.lit(False))
    return rows.where(ok), rows.agg(F.count_if(~ok).alias("leaks"))
