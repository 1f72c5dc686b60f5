"""Approximate nearest neighbours: a forest of hash-prefix trees.

Every vector is hashed once per tree to a string of ``BITS`` signs of random projections; a tree is the
sorted array of its strings. A query finds the longest prefix it shares with each array by bisection
(the variable-length match), and then ascends in all trees at once: the prefixes are shortened by one bit in every
tree until enough candidates stand below them. Those are scored exactly, in double precision.

For the inner product of vectors of any length each vector gets one more component, which brings all to
the length of the longest; queries get 0 there. Angles to a query then rank like inner products.

The forest is dealt out in blocks of vectors, each with all trees; a block's trees are built once, written down, and sent as they
are to each lot of queries; a block answers with its best for each query. What travels is a few bytes for each thousand pairs of a vector and a query. Every row is indexed. Of equal vectors only those with the least ids can be among the
nearest, so of a group of copies, however large, NEAREST + 1 rows go into the index, and equal queries are asked once.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor
do rows without id; of rows with one id the least vector counts; vectors of different lengths are not compared; ties
go to the smaller id; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

NEAREST, TREES, BITS = 20, 40, 32
#: Candidates that a query gathers in a block: this share of its vectors, and this many at least.
SHARE, LEAST = 0.48, 400
BLOCK, QUERIES = 8192, 8192
#: Queries of a lot that a block answers at a time.
STEP = 1024


def planes(dims: int, trees: int = TREES, bits: int = BITS) -> np.ndarray:
    """Projections of all trees, orthogonal in runs of up to ``dims``."""
    rng = np.random.default_rng(20)
    out = []
    while len(out) * dims < trees * bits:
        out.append(np.linalg.qr(rng.standard_normal((dims, dims)))[0])
    return np.concatenate(out, axis=1)[:, : trees * bits]


def strings(vectors: np.ndarray, projections: np.ndarray, bits: int = BITS) -> np.ndarray:
    """One string of bits per vector and tree, as an unsigned integer, first bit highest."""
    signs = (vectors @ projections > 0).reshape(len(vectors), -1, bits)
    return (signs.astype(np.uint64) << np.arange(bits - 1, -1, -1, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)


def build(vectors: np.ndarray, longest: float, trees: int = TREES, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted strings, numbers of the vectors in that order), a row for each tree."""
    x = vectors.astype(np.float64)
    lift = np.sqrt(np.maximum(longest**2 - (x**2).sum(axis=1), 0.0))
    marks = strings(np.column_stack([x, lift]), planes(x.shape[1] + 1, trees, bits), bits).astype(np.uint32)
    order = np.argsort(marks, axis=0, kind="stable")
    return np.ascontiguousarray(np.take_along_axis(marks, order, axis=0).T), np.ascontiguousarray(order.T.astype(np.int32))


class Forest:
    """One block's trees, built."""

    def __init__(self, dims: int, ordered: np.ndarray, order: np.ndarray, bits: int = BITS):
        self.bits, self.n, self.sorted, self.order = bits, order.shape[1], ordered, order.astype(np.intp)
        self.projections = planes(dims + 1, len(ordered), bits)

    def candidates(self, queries: np.ndarray, share: float = SHARE, least: int = LEAST):
        """For each query the numbers of the vectors gathered."""
        marks = strings(np.column_stack([queries, np.zeros(len(queries))]), self.projections, self.bits)
        wanted = min(self.n, max(least, math.ceil(share * self.n)))
        trees = len(self.sorted)
        # Descend: ranges of every prefix length in every tree; lengths from the whole string to none.
        lows = np.empty((self.bits + 1, trees, len(queries)), dtype=np.int64)
        highs = np.empty_like(lows)
        for cut in range(self.bits + 1):
            low = marks >> np.uint64(cut) << np.uint64(cut)
            high = low + np.uint64((1 << cut) - 1)
            for t in range(trees):
                lows[cut, t] = np.searchsorted(self.sorted[t], low[:, t].astype(np.uint32), side="left")
                highs[cut, t] = np.searchsorted(self.sorted[t], high[:, t].astype(np.uint32), side="right")
        widths = (highs - lows).sum(axis=1)
        seen = np.empty(self.n, dtype=bool)
        for q in range(len(queries)):
            # Ascend in all trees at once; trees overlap, so the first step worth counting is where the ranges add up to enough.
            cut = int(np.argmax(widths[:, q] >= wanted))
            seen[:] = False
            while True:
                for t in range(trees):
                    seen[self.order[t, lows[cut, t, q] : highs[cut, t, q]]] = True
                if cut == self.bits or np.count_nonzero(seen) >= wanted:
                    break
                cut += 1
            yield np.flatnonzero(seen)


BUILT = "dims int, block int, ids binary, vectors binary, sorted binary, ordered binary"
LOTS = "dims int, lot int, qids binary, asked binary"


def _matrix(t: pa.Table, dims: int) -> np.ndarray:
    """Vectors as they are stored, in single or double precision."""
    flat = t["vector"].combine_chunks().flatten()
    return np.asarray(flat, dtype=np.float32 if flat.type == pa.float32() else np.float64).reshape(-1, dims)


def _built(key: tuple[pa.Scalar, ...], points: pa.Table) -> pa.Table:
    dims, x = key[0].as_py(), _matrix(points, key[0].as_py())
    ordered, order = build(x, points["longest"][0].as_py())
    cols = [np.asarray(points["id"]), x, ordered, order]
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in cols]], names=["dims", "block", "ids", "vectors", "sorted", "ordered"])


def _lot(key: tuple[pa.Scalar, ...], queries: pa.Table) -> pa.Table:
    cols = [np.asarray(queries["qid"]), _matrix(queries, key[0].as_py()).astype(np.float64)]
    return pa.table([pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([c.tobytes()], pa.binary()) for c in cols], names=["dims", "lot", "qids", "asked"])


def _searched(key: tuple[pa.Scalar, ...], blocks: pa.Table, lots: pa.Table) -> pa.Table:
    """One block's best for the queries of one lot."""
    out_q, out_v, out_s = [], [], []
    if blocks.num_rows and lots.num_rows:
        dims = key[0].as_py()
        read = lambda t, c, kind: np.frombuffer(t[c][0].as_buffer(), dtype=kind)
        ids, names = read(blocks, "ids", np.int64), read(lots, "qids", np.int64)
        raw = blocks["vectors"][0].as_buffer()
        x = np.frombuffer(raw, dtype=np.float32 if len(raw) == 4 * dims * len(ids) else np.float64).reshape(-1, dims).astype(np.float64)
        asked = read(lots, "asked", np.float64).reshape(-1, dims)
        forest = Forest(dims, read(blocks, "sorted", np.uint32).reshape(-1, len(ids)), read(blocks, "ordered", np.int32).reshape(-1, len(ids)))
        for start in range(0, len(asked), STEP):
            some = asked[start : start + STEP]
            for q, near in enumerate(forest.candidates(some)):
                score = np.einsum("ij,j->i", x[near], some[q])
                k = min(NEAREST + 1, len(near))
                edge = np.partition(score, len(near) - k)[len(near) - k]
                best = np.flatnonzero(score >= edge)
                best = best[np.lexsort((ids[near[best]], -score[best]))[:k]]
                out_q.append(np.full(len(best), names[start + q]))
                out_v.append(ids[near[best]])
                out_s.append(score[best])
    flat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.empty(0, kind))
    return pa.table([flat(out_q, np.int64), flat(out_v, np.int64), flat(out_s, np.float64)], names=["qid", "id", "score"])


def search(vectors: DataFrame, queries, key: str = "vec_id", vector: str = "embedding", nearest: int = NEAREST) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` for the rows that the condition ``queries`` on ``key`` picks, against all others."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    usable = (
        vectors.where(F.col(key).isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0))
        .groupBy(F.col(key).cast("long").alias("id")).agg(F.min(vector).alias("vector"))
    )
    usable = saved(usable.withColumn("norm", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x))), "vectors")
    # The window keeps few rows of a group already before the exchange.
    copies = Window.partitionBy("vector").orderBy("id")
    points = saved(usable.withColumn("nth", F.row_number().over(copies)).where(F.col("nth") <= nearest + 1).drop("nth"), "points")
    n, longest = points.agg(F.count(F.lit(1)), F.max("norm")).first()
    asked = usable.where(queries(F.col("id"))).select("id", "vector")
    once = asked.groupBy("vector").agg(F.min("id").alias("qid"))
    blocks, lots = max(1, -(-n // BLOCK)), max(1, -(-asked.count() // QUERIES))
    dealt = points.select(F.size("vector").alias("dims"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "vector", F.lit(float(longest or 0)).alias("longest"))
    forest = saved(dealt.groupBy("dims", "block").applyInArrow(_built, BUILT), "forest")
    sent = once.select(F.size("vector").alias("dims"), F.pmod(F.xxhash64("qid"), F.lit(lots)).cast("int").alias("lot"), "qid", "vector")
    packed = saved(sent.groupBy("dims", "lot").applyInArrow(_lot, LOTS), "lots")
    pairs = lambda df, other, n: df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).groupBy("dims", "block", "lot")
    found = pairs(forest, "lot", lots).cogroup(pairs(packed, "block", blocks)).applyInArrow(_searched, "qid long, id long, score double")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    top = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= nearest + 1)
    listed = top.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("nth", "id", "score"))).alias("found"))
    members = asked.join(once.withColumnRenamed("vector", "_v"), F.col("vector") == F.col("_v")).select("id", "qid")
    own = F.slice(F.filter("found", lambda x: x["id"] != F.col("id")), 1, nearest)
    return (
        members.join(listed, "qid").select(F.col("id").alias("query_id"), F.posexplode(own).alias("pos", "hit"))
        .select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score"))
    )


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return search(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
