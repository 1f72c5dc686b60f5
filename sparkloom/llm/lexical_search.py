"""Ranked lexical search: an Aho-Corasick scan of all documents for the terms of all items.

The terms of the items, each between two boundary bytes, are compiled to one automaton, which is broadcast. Texts are brought
to the same form (letters lowered, every byte that is part of no term becomes the boundary), so the automaton finds whole
terms only, and a scan of the text gives each term's frequency; no index of the documents is made or kept. The first scan adds up
document frequencies, the number of documents and their length; the second scores every document against every item that
shares a term with it and keeps the best of each task, of which a window takes the best of all.

The automaton must fit a worker, so items are dealt into lots of about ``LOT`` (item, term) pairs by a hash of their id. Each
lot has an automaton and two scans of its own; the number of documents and their lengths bound nothing.

Scores are 64-bit integers: a contribution is summed as two halves in doubles, both exact.

Defined results: a null or empty text has no terms and counts as no document; rows that share a document id are documents of
their own, and those without an id stand last among equal scores; rows that share an item id (null too) are one item with the
terms of all of them; an item without terms, or whose terms no document has, has no rows; empty tables give an empty
table; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, saved

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Ranks of each item; (item, term) pairs of one automaton; cells of one block of scores.
TOP, LOT, CELLS = 10, 100_000, 2_000_000
#: Letters lowered, digits and bytes beyond ASCII as they are, all else the boundary.
FORM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
second = itemgetter(1)


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """``item``, ``term`` and ``mult``, its occurrences in the item."""
    bare = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return items.select(F.col(key).cast("long").alias("item"), F.explode(F.regexp_extract_all(bare, F.lit(TERM), F.lit(0))).alias("term")).groupBy("item", "term").agg(F.count(F.lit(1)).alias("mult"))


def lots_of(terms: DataFrame, size: int = LOT) -> int:
    """Number of lots by hash in which no lot holds more than twice ``size`` pairs unless a single item does."""
    per_item = saved(terms.groupBy("item").agg(F.count(F.lit(1)).alias("n")), "items")
    total = per_item.agg(F.sum("n")).first()[0] or 0
    lots = max(1, -(-total // size))
    while lots < 2 * total:
        most = per_item.groupBy(F.pmod(F.xxhash64("item"), F.lit(lots)).alias("lot")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("m")).where(F.col("m") > 1).agg(F.max("n")).first()[0] or 0
        if most <= 2 * size:
            break
        lots *= 2
    return lots


class Lot:
    """The automaton of a lot's terms, and the items of each term."""

    def __init__(self, rows: list[tuple]):
        import ahocorasick

        self.items = sorted({r[0] for r in rows}, key=lambda i: (i is None, i or 0))
        place = {i: k for k, i in enumerate(self.items)}
        names = sorted({r[1] for r in rows})
        number = {t: k for k, t in enumerate(names)}
        # One character for each byte of UTF-8, so the automaton's alphabet has 256 letters.
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, t in enumerate(names):
            self.automaton.add_word(f" {t.encode().decode('latin-1')} ", k)
        if names:
            self.automaton.make_automaton()
        self.size = len(names)
        pairs = np.array(sorted((number[t], place[i], m) for i, t, m in rows), dtype=np.int64).reshape(-1, 3)
        self.at = np.searchsorted(pairs[:, 0], np.arange(self.size + 1))
        self.item, self.mult = pairs[:, 1].copy(), pairs[:, 2].copy()

    def scan(self, raw: bytes) -> tuple[int, dict[int, int]]:
        """Terms of a text with repeats, and the frequencies of the lot's terms in it."""
        formed = raw.translate(FORM)
        return len(formed.split()), Counter(map(second, self.automaton.iter(f" {formed.decode('latin-1')} ")))


def _raw(batch: pa.RecordBatch, k: int) -> Iterator[bytes]:
    for t in batch.column(k).cast(pa.binary()):
        yield t.as_py() or b""


def _counted(lot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Lot = lot.value
        df, n_docs, length = Counter(), 0, 0
        for batch in batches:
            for raw in _raw(batch, 0):
                n, found = held.scan(raw)
                n_docs += n > 0
                length += n
                df.update(found.keys())
        rows = [(-1, n_docs), (-2, length), *df.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64())], names=["term", "n"])

    return run


def corpus_counts(docs: DataFrame, text: str, lot) -> tuple[int, int, np.ndarray]:
    """Documents with a term, their length, and the document frequency of each term of the lot: one number for each term comes to the driver."""
    rows = docs.select(text).mapInArrow(_counted(lot), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(lot.value.size, dtype=np.int64)
    whole = {r.term: r.n for r in rows if r.term < 0}
    for r in rows:
        if r.term >= 0:
            df[r.term] = r.n
    return whole.get(-1, 0), whole.get(-2, 0), df


class Best:
    """The ``top`` highest scores of each item so far, ties by id, null ids last."""

    def __init__(self, top: int):
        self.top, self.parts, self.waiting, self.least = top, [], 0, {}

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        self.parts.append((item, score, doc, null))
        self.waiting += len(item)
        if self.waiting > 500_000:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        item, score, doc, null = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((doc, null, -score, item))
        item = item[order]
        begin = np.searchsorted(item, item)
        keep = order[np.arange(len(item)) - begin < self.top]
        self.parts = [tuple(x[keep] for x in (np.concatenate(y) for y in zip(*self.parts, strict=True)))]
        self.waiting = len(keep)
        return self.parts[0]


def _scored(lot, n_docs: int, length: int, weight: np.ndarray, top: int):
    def block(held: Lot, rows: list, best: Best) -> None:
        sizes = np.array([len(found) for *_, found in rows])
        term = np.fromiter((t for *_, found in rows for t in found), np.int64, sizes.sum())
        tf = np.fromiter((c for *_, found in rows for c in found.values()), np.int64, sizes.sum())
        m = np.repeat(np.array([25 + 75 * n * n_docs // length for _, n, _ in rows], dtype=np.int64), sizes)
        doc = np.repeat(np.arange(len(rows)), sizes)
        gain = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
        many = held.at[term + 1] - held.at[term]
        ends = np.cumsum(many)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - many, many) + np.repeat(held.at[term], many)
        cell = np.repeat(doc, many) * len(held.items) + held.item[at]
        part = np.repeat(gain, many) * held.mult[at]
        high, low = (np.bincount(cell, x, len(rows) * len(held.items)).astype(np.int64) for x in (part >> 26, part & (1 << 26) - 1))
        score = (high << 26) + low
        hit = np.flatnonzero(score)
        ids = [r[0] for r in rows]
        null = np.array([i is None for i in ids])
        ids = np.array([i or 0 for i in ids], dtype=np.int64)
        d = hit // len(held.items)
        best.add(hit % len(held.items), score[hit], ids[d], null[d])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Lot = lot.value
        best, rows, pairs = Best(top), [], 0
        for batch in batches:
            for doc, raw in zip(batch.column(0), _raw(batch, 1), strict=True):
                n, found = held.scan(raw)
                if found:
                    rows.append((doc.as_py(), n, found))
                    pairs += len(found)
                    if len(rows) * len(held.items) > CELLS or pairs > CELLS // 20:
                        block(held, rows, best)
                        rows, pairs = [], 0
        if rows:
            block(held, rows, best)
        if best.parts:
            item, score, doc, null = best.cut()
            names = pa.array(held.items, pa.int64())
            yield pa.RecordBatch.from_arrays([names.take(pa.array(item)), pa.array(doc, pa.int64(), mask=null), pa.array(score)], names=["item_id", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", top: int = TOP, lot_size: int = LOT) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id`` and ``score`` of the ``top`` documents of every item."""
    spark = docs.sparkSession
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    terms = saved(item_terms(items, item_key, item_text), "terms")
    lots, out = lots_of(terms, lot_size), None
    for k in range(lots):
        rows = [tuple(r) for r in terms.where(F.pmod(F.xxhash64("item"), F.lit(lots)) == k).collect()]
        if not rows and (k or lots > 1):
            continue
        lot = spark.sparkContext.broadcast(Lot(rows))
        n_docs, length, df = corpus_counts(texts, "text", lot) if rows else (0, 0, np.zeros(0))
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)
        best = texts.mapInArrow(_scored(lot, n_docs, max(length, 1), weight, top), "item_id long, doc_id long, score long") if length else spark.createDataFrame([], "item_id long, doc_id long, score long")
        out = best if out is None else out.union(best)
    if out is None:
        out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    from ..plans.base import spread
    from .common import table

    return search(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
whole AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS length FROM lengths),
found AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM found, whole GROUP BY term, n_docs),
mults AS (SELECT item_id, term, count(*) AS mult FROM asked GROUP BY item_id, term),
scores AS (
  SELECT item_id, doc_id, CAST(sum(mult * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // length)))) AS BIGINT) AS score
  FROM mults JOIN weights USING (term) JOIN found USING (term) JOIN lengths USING (doc_id), whole GROUP BY item_id, doc_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
