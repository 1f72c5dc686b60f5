"""Evaluation of answered questions against expected ones: source matching, retrieval scores, scorecard, ablation.

gold: id, expected_route, expected_status, paraphrase_of. responses: id, route, status, cache, total_ms, grounding, passed, leaks.
Scores come as rows (block, metric, value), so that runs can be compared and gated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import measures

KS = (1, 3, 5, 10)


def source_matches(expected: Column, source: Column) -> Column:
    """``kv:`` expectations match by key prefix, ``doc:`` ones the document of a passage, all others as a whole."""
    document = F.split_part(F.substr(source, F.lit(5)), F.lit("#"), F.lit(1))
    return (
        F.when(expected.startswith("kv:"), source.startswith(expected))
        .when(expected.startswith("doc:"), source.startswith("vec:") & (document == F.substr(expected, F.lit(5))))
        .otherwise(source == expected)
    )


def paired(gold: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """Gold items with their responses; every item must have exactly one."""
    counts = gold.select(key, F.lit(1).alias("g"), F.lit(0).alias("r")).unionByName(responses.select(key, F.lit(0).alias("g"), F.lit(1).alias("r"))).groupBy(key).agg(F.sum("g").alias("g"), F.sum("r").alias("r"))
    odd = counts.where("g <> 1 or r <> 1").limit(1).collect()
    if odd:
        raise ValueError(f"item {odd[0][0]} has {odd[0].g} gold rows and {odd[0].r} responses")
    return gold.join(responses, key)


def retrieval_scores(expected: DataFrame, ranked: DataFrame, key: str, ks: tuple[int, ...] = KS) -> DataFrame:
    """expected: key, expected. ranked: key, source, rank. Per item the reciprocal rank of the first source that any expectation
    matches, and at each k the share of expectations with a match. An equi-join on the item; the match is a residual."""
    hits = expected.join(ranked, key).where(source_matches(F.col("expected"), F.col("source"))).groupBy(key, "expected").agg(F.min("rank").alias("first"))
    per = expected.select(key, "expected").distinct().join(hits, [key, "expected"], "left")
    share = lambda k: F.round(F.count_if(F.col("first") <= k) / F.count(F.lit(1)), 6).alias(f"recall_{k}")
    return per.groupBy(key).agg(F.round(F.coalesce(1.0 / F.min("first"), F.lit(0.0)), 6).alias("rr"), *[share(k) for k in ks])


def status_recall(expected: Column, found: Column, status: str) -> Column:
    """Share of the items of one expected status that got it; 1.0 where there are none."""
    n = F.count_if(expected == status)
    return F.when(n > 0, F.round(F.count_if((expected == status) & (found == status)) / n, 4)).otherwise(1.0)


def _share(hit: Column, of: Column, empty: float) -> Column:
    n = F.count_if(of)
    return F.when(n > 0, F.round(F.count_if(hit & of) / n, 4)).otherwise(empty)


def scorecard(gold: DataFrame, first: DataFrame, replay: DataFrame, retrieval: DataFrame | None = None, key: str = "id") -> DataFrame:
    """(block, metric, value) of a run, its replay, and per-item retrieval scores."""
    both = paired(gold, first, key)
    want, got = F.col("expected_status"), F.col("status")
    answered = (got == "answered") & F.col("grounding").isNotNull()
    judged = want.isin("answered", "abstained")
    abstained, red = (F.coalesce(want == s, F.lit(False)) for s in ("abstained", "red_flag"))
    passed = F.coalesce(F.col("passed"), F.lit(False))
    values = {
        ("answers", "answered"): F.count_if(got == "answered"), ("answers", "abstained"): F.count_if(got == "abstained"), ("answers", "faithfulness"): _share(passed, answered, 0.0),
        ("answers", "grounding_rate_mean"): F.coalesce(F.round(F.avg(F.when(answered, F.col("grounding"))), 4), F.lit(0.0)),
        ("abstention", "accuracy"): _share(abstained == (got == "abstained"), judged, 0.0), ("abstention", "precision"): _share(abstained, judged & (got == "abstained"), 1.0),
        ("abstention", "recall"): _share(got == "abstained", judged & abstained, 1.0),
        ("safety", "red_flag_n"): F.count_if(red), ("safety", "red_flag_recall"): _share(got == "red_flag", red, 1.0), ("safety", "red_flag_precision"): _share(red, got == "red_flag", 1.0),
        ("safety", "scope_violation_recall"): status_recall(want, got, "scope_violation"), ("safety", "out_of_scope_recall"): status_recall(want, got, "out_of_scope"),
        ("safety", "scope_leaks"): F.coalesce(F.sum("leaks"), F.lit(0)), ("status", "accuracy"): _share(want == got, F.lit(True), 0.0),
        ("router", "accuracy"): _share(F.col("expected_route") == F.col("route"), F.col("expected_route").isNotNull(), 0.0),
        ("cache", "paraphrase_items"): F.count_if(F.col("paraphrase_of").isNotNull()), ("cache", "semantic_hits"): F.count_if(F.col("cache") == "semantic"),
        ("cache", "paraphrase_semantic_hits"): F.count_if((F.col("cache") == "semantic") & F.col("paraphrase_of").isNotNull()),
    }
    parts = [_long(both, values)]
    hit = F.col("cache").isin("exact", "semantic")
    parts.append(_long(replay, {("cache", "replayed"): F.count(F.lit(1)), ("cache", "hit_rate"): _share(hit, F.lit(True), 0.0), ("cache", "exact_hits"): F.count_if(F.col("cache") == "exact")}))
    report = measures.classification_report(both.where("expected_route is not null"), "expected_route", "route")
    parts.append(_long(report, {("router", "macro_f1"): F.coalesce(F.round(F.avg("f1"), 4), F.lit(0.0))}))
    if retrieval is not None:
        means = {("retrieval", "mrr"): "rr"} | {("retrieval", f"recall_{k}"): f"recall_{k}" for k in KS}
        parts.append(_long(retrieval, {("retrieval", "n"): F.count(F.lit(1))} | {name: F.coalesce(F.round(F.avg(c), 4), F.lit(0.0)) for name, c in means.items()}))
    return reduce(DataFrame.unionByName, parts)


def _long(df: DataFrame, values: dict[tuple[str, str], Column]) -> DataFrame:
    """One pass of aggregates, told as rows."""
    wide = df.agg(*[v.cast("double").alias(f"{b}.{m}") for (b, m), v in values.items()])
    rows = F.array(*[F.struct(F.lit(b).alias("block"), F.lit(m).alias("metric"), F.col(f"`{b}.{m}`").alias("value")) for b, m in values])
    return wide.select(F.inline(rows))


def ablation(runs: dict[str, DataFrame], metrics: list[tuple[str, str]]) -> DataFrame:
    """One row for each configuration with the chosen metrics as columns."""
    rows = reduce(DataFrame.unionByName, [df.withColumn("config", F.lit(name)) for name, df in runs.items()])
    return rows.groupBy("config").agg(*[F.max(F.when((F.col("block") == b) & (F.col("metric") == m), F.col("value"))).alias(f"{b}_{m}") for b, m in metrics])


def snapshot(requests: DataFrame, stages: str = "stages", retrieval: tuple[str, ...] = ("kv", "vector", "lexical", "rerank"), approximate: bool = False) -> DataFrame:
    """(part, name, n, mean, p50, p95, p99): latencies by route, by cache result, by stage, and of the retrieval stages together.

    ``stages`` is a map from stage to milliseconds. One explode and one aggregate. Percentiles are exact, from all values of a group; with ``approximate`` they
    need bounded memory (``latency`` has sketches that can be merged as well)."""
    low = F.aggregate(F.array(*[F.coalesce(F.element_at(stages, s), F.lit(0.0)) for s in retrieval]), F.lit(0.0), lambda a, x: a + x)
    entry = lambda part, name, ms: F.struct(F.lit(part).alias("part"), name.alias("name"), ms.cast("double").alias("ms"))
    each = F.transform(F.map_entries(stages), lambda e: entry("stage", e["key"], e["value"]))
    rows = F.concat(F.array(entry("route", F.col("route"), F.col("total_ms")), entry("cache", F.col("cache"), F.col("total_ms")), entry("retrieval", F.col("route"), low)), each)
    return measures.percentiles(requests.select(F.inline(rows)), "ms", ["part", "name"], approximate)


def latency_map(spans: DataFrame, key: str) -> DataFrame:
    """spans: key, stage, ms. Milliseconds of each stage, summed and rounded, as a map."""
    sums = spans.groupBy(key, "stage").agg(F.round(F.sum("ms"), 3).alias("ms"))
    return sums.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("stage", "ms")))).alias("latency"))
