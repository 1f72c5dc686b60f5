"""One object that holds the tables and answers batches: the entry points of the library.

Every call takes and gives DataFrames; a single request is a batch of one row. Embedders, rerankers and answerers are functions on
DataFrames, so another one takes their place by being passed in.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.embed import hashing_embedding
from .operators import fusion, ingest, kv, lexical, lifecycle, lookup, scoped, vectors

Embedder = Callable[[DataFrame, str, str], DataFrame]
Reranker = Callable[[DataFrame, str, str, int], DataFrame]


@dataclass
class KeyTable:
    """An ordered key-value table (key, value, expires_at) seen at a moment. Writing gives a new table."""

    rows: DataFrame
    now: float

    def get(self, keys: DataFrame) -> DataFrame:
        return kv.point_get(self.rows, keys, self.now)

    def scan(self, prefix: str, limit: int | None = None) -> DataFrame:
        return kv.prefix_scan(self.rows, prefix, self.now, limit)

    def browse(self, prefix: str, limit: int) -> DataFrame:
        """A scan from outside: short and internal prefixes give no rows."""
        return kv.prefix_scan(self.rows.where(kv.browsable(F.lit(prefix))), prefix, self.now, limit)

    def count(self, depth: int = 1) -> DataFrame:
        return kv.count_prefixes(self.rows, depth, self.now)

    def put(self, new: DataFrame) -> KeyTable:
        return KeyTable(self.rows.join(new.select("key"), "key", "left_anti").unionByName(new), self.now)

    def delete(self, keys: DataFrame) -> KeyTable:
        return KeyTable(self.rows.join(keys.select("key"), "key", "left_anti"), self.now)

    def purge(self) -> KeyTable:
        return KeyTable(kv.purge(self.rows, self.now)[0], self.now)

    def snapshot(self, path: str) -> DataFrame:
        return kv.snapshot(self.rows, path)


@dataclass
class VectorTable:
    """Vectors with their metadata (id, embedding, ...). Writing gives a new table."""

    rows: DataFrame
    key: str = "id"

    def upsert(self, new: DataFrame) -> VectorTable:
        return VectorTable(vectors.upsert(self.rows, new, self.key), self.key)

    def delete(self, ids: DataFrame | None = None, spec: dict | None = None) -> VectorTable:
        return VectorTable(vectors.delete(self.rows, ids, spec, self.key), self.key)

    def query(self, queries: DataFrame, k: int, spec: dict | None = None) -> DataFrame:
        return vectors.many_top_k(vectors.apply_filter(self.rows, spec), queries, k, self.key)

    def text_query(self, queries: DataFrame, k: int, text: str = "text") -> DataFrame:
        return lexical.bm25(self.rows, queries, self.key, "qid", k, text)

    def fetch(self, ids: list) -> DataFrame:
        return vectors.fetch(self.rows, ids, self.key)

    def count(self) -> int:
        return self.rows.count()


@dataclass
class Timer:
    """Wall-clock spans of the stages of a call, for ``evaluation.latency_map``."""

    spans: list[tuple[str, float, str]] = field(default_factory=list)

    @contextmanager
    def stage(self, name: str):
        began = time.perf_counter()
        try:
            yield
        except BaseException:
            self.spans.append((name, 1000 * (time.perf_counter() - began), "error"))
            raise
        self.spans.append((name, 1000 * (time.perf_counter() - began), "ok"))

    def skipped(self, name: str) -> None:
        self.spans.append((name, 0.0, "skipped"))


@dataclass
class Engine:
    """facts: subject, id, title, text. passages: id, namespace, title, text, embedding. records: key, value, expires_at."""

    spark: SparkSession
    facts: DataFrame
    passages: VectorTable
    records: KeyTable
    embed: Embedder
    rerank: Reranker
    today: dt.date

    def query(self, questions: DataFrame, k: int = 5, **rules) -> DataFrame:
        """Answers for (qid, query, scope); ``rules`` as in ``lifecycle.run_batch``."""
        return lifecycle.run_batch(questions, self.facts, self.passages.rows.drop("embedding"), self.today, k, **rules)

    def scoped_search(self, questions: DataFrame, k: int = 5, hybrid: bool = True, filters: dict[str, dict] | None = None) -> tuple[DataFrame, DataFrame]:
        """(hits, report) for (qid, text, scope, namespaces, drugs, start, stop), each question under its own filter. Asking for notes without a subject is refused."""
        if not questions.where(F.array_contains("namespaces", scoped.NOTES) & F.col("scope").isNull()).isEmpty():
            raise ValueError("searching patient_notes requires a scope")
        asked = questions.join(self.embed(questions.select("qid", "text"), "qid", "text"), "qid")
        rows = self.passages.rows
        for c, kind in (("owner", "string"), ("drug", "string"), ("date_num", "long")):
            rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast(kind))
        return scoped.retrieve(asked, rows, k, hybrid=hybrid, rerank=self.rerank, filters=filters)

    def search(self, questions: DataFrame, k: int = 5, spec: dict | None = None, hybrid: bool = True, reranked: bool = True) -> DataFrame:
        """The k best passages for (qid, text): by vectors and, if ``hybrid``, words, fused; then reranked."""
        over = 4 * k
        asked = self.embed(questions.select("qid", "text"), "qid", "text")
        found = self.passages.query(asked, over, spec)
        if hybrid:
            words = VectorTable(vectors.apply_filter(self.passages.rows, spec)).text_query(questions, over)
            found = fusion.rrf([found, words], "id", "qid", over, by_raw=True)
        rows = found.select("qid", "id", "score", "rank").join(self.passages.rows.select("id", "namespace", F.col("title").alias("section"), "text"), "id").join(questions.select("qid", F.col("text").alias("question")), "qid")
        return self.rerank(rows, "id", "qid", k) if reranked else fusion.keep_order(rows, "qid", k)

    def source(self, asked: DataFrame) -> DataFrame:
        """What source ids (source_id) name."""
        parts = F.transform(F.sort_array(F.collect_list(F.struct("id", "text"))), lambda x: x["text"])  # the passages of one document
        wanted = asked.where(F.col("source_id").startswith("vec:")).select(F.split_part(F.substr("source_id", F.lit(5)), F.lit("#"), F.lit(1)).alias("_doc")).distinct()
        rows = self.passages.rows.join(wanted, F.split_part("id", F.lit("#"), F.lit(1)) == F.col("_doc"), "left_semi")
        documents = rows.groupBy(F.split_part("id", F.lit("#"), F.lit(1)).alias("doc_id")).agg(F.array_join(parts, "\n").alias("text"))
        return lookup.resolve_sources(asked, self.records.rows, documents)

    def ingest(self, passages: DataFrame, rows: DataFrame) -> Engine:
        """The engine with passages (as in the table, without embedding) and key rows put in."""
        table = ingest.embed_upsert(self.passages.rows, passages, lambda x: self.embed(x, "id", "text"))
        return Engine(self.spark, self.facts, VectorTable(table), self.records.put(rows), self.embed, self.rerank, self.today)


def engine(spark: SparkSession, facts: DataFrame, passages: DataFrame, records: DataFrame, now: float, today: dt.date, embed: Embedder = hashing_embedding, rerank: Reranker = fusion.rerank) -> Engine:
    """Wires the tables; passages without embeddings are embedded."""
    rows = passages if "embedding" in passages.columns else passages.join(embed(passages.select("id", "text"), "id", "text"), "id")
    return Engine(spark, facts, VectorTable(rows), KeyTable(records, now), embed, rerank, today)
