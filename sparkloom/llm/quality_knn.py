"""Quality classifier: similarity-weighted votes of the nearest labelled documents in a latent-semantic space.

Terms are byte pairs of the whole text, hashed to ``BUCKETS``, and three shares of repetition: words in
repeated three-word windows, repeated lines, and words that their window of ``WINDOW`` words had before. The
latent space (truncated SVD of the weighted term matrix) is fitted on at most ``SAMPLE`` labelled documents,
those with the least hash of their id among the rows whose crc32 of the id modulo 3 is not 1. The fitted projection and
the labelled vectors are broadcast; their size is bounded by SAMPLE, BUCKETS and DIMS alone. Every document
is then compared with all labelled vectors by exact blocked cosine products.

Defined results: null and empty texts have no terms, so all their cosines are 0 and they score the
share of label 1 in the sample; without usable labels every score is 0.5; a null id is not held out;
repeated rows are scored row by row; labels that are null or not 0 or 1 are not used, and of several
for an id the least counts; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import dup_lines, repeat_words

SAMPLE, BUCKETS, DIMS, NEIGHBOURS = 4096, 2048, 48, 15
#: Documents in a block of cosine products, and the power of the cosine that weights a vote.
BLOCK, POWER = 256, 8
EXTRA = 3
#: Words in a window of the third share.
WINDOW = 200

_code = np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
FOLD = ((_code ^ (_code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.intp)


def repeats(words: list[bytes]) -> float:
    """Mean share of words that their window had before; windows are of equal length, so the mean does not depend on the text's."""
    n = len(words)
    if n <= WINDOW:
        return 1 - len(set(words)) / n
    starts = [*range(0, n - WINDOW, WINDOW), n - WINDOW]  # the last window ends with the text
    return 1 - sum(len(set(words[i : i + WINDOW])) for i in starts) / (WINDOW * len(starts))


def terms(text: str | None) -> np.ndarray:
    """Square roots of the shares of byte pairs, then the shares of repetition."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(BUCKETS + EXTRA, dtype=np.float32)
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.int32)
    if len(b) < 2:
        return out
    out[:BUCKETS] = np.sqrt(np.bincount(FOLD[(b[:-1] << 8) | b[1:]], minlength=BUCKETS) / (len(b) - 1))
    words = raw.split()
    if words:
        out[BUCKETS] = repeat_words(words) / len(words)
        out[BUCKETS + 1] = dup_lines(text) / (text.count("\n") + 1)
        out[BUCKETS + 2] = repeats(words)
    return out


def fit(matrix: np.ndarray, labels: np.ndarray) -> dict:
    """Term weights, projection and normalised labelled vectors."""
    if not len(labels):
        return {"prior": 0.5, "labels": labels.astype(np.float32)}
    seen = (matrix[:, :BUCKETS] > 0).sum(axis=0)
    weight = np.concatenate([np.log((1 + len(matrix)) / (1 + seen)) + 0.2, np.full(EXTRA, 2.0)]).astype(np.float32)
    m = matrix * weight
    # Truncated SVD by subspace iteration from a fixed start.
    basis = np.random.default_rng(7).standard_normal((m.shape[1], DIMS + 16)).astype(np.float32)
    for _ in range(8):
        basis, _ = np.linalg.qr(m.T @ (m @ basis))
    _, _, turn = np.linalg.svd(m @ basis, full_matrices=False)
    project = (basis @ turn.T[:, :DIMS]).astype(np.float32)
    latent = m @ project
    norm = np.linalg.norm(latent, axis=1, keepdims=True)
    return {"prior": float(labels.mean()), "labels": labels.astype(np.float32), "weight": weight, "project": project, "latent": latent / np.where(norm > 0, norm, 1)}


def vote(model: dict, block: np.ndarray) -> np.ndarray:
    """Scores of a block of term rows."""
    labels = model["labels"]
    if not len(labels):
        return np.full(len(block), model["prior"])
    x = (block * model["weight"]) @ model["project"]
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    cosine = np.maximum((x / np.where(norm > 0, norm, 1)) @ model["latent"].T, 0.0).astype(np.float64)
    k = min(NEIGHBOURS, len(labels))
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    w = np.take_along_axis(cosine, near, axis=1) ** POWER
    total = w.sum(axis=1)
    return np.where(total > 0, (w * labels[near]).sum(axis=1) / np.where(total > 0, total, 1), model["prior"])


def fold_of(key: Column) -> Column:
    """crc32 of the id's decimal text, modulo 3."""
    return F.crc32(key.cast("string").cast("binary")) % 3


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> dict:
    spark = docs.sparkSession
    usable = labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")).where("_y in (0, 1)").where(fold_of(F.col("_k")) != 1)
    chosen = usable.groupBy("_k").agg(F.min("_y").alias("_y")).withColumn("_h", F.xxhash64("_k")).orderBy("_h", "_k").limit(sample)
    rows = docs.select(F.col(key).alias("_k"), text).join(F.broadcast(chosen), "_k").select("_h", "_k", "_y", text)  # at most `sample` ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([terms(t.as_py()).tobytes() for t in batch.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), made], names=["_h", "_k", "_y", "terms"])

    kind = docs.schema[key].dataType.simpleString()
    found = rows.mapInArrow(run, f"_h long, _k {kind}, _y int, terms binary").orderBy("_h", "_k", "terms").limit(sample).toArrow()
    matrix = np.array([np.frombuffer(t, dtype=np.float32) for t in found["terms"].to_pylist()]).reshape(-1, BUCKETS + EXTRA)
    return fit(matrix, np.array(found["_y"].to_pylist(), dtype=np.float64))


def score(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``score`` of every document; one pass without a shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [np.empty(0)]
            for i in range(0, batch.num_rows, BLOCK):
                scores.append(vote(sent.value, np.array([terms(t.as_py()) for t in batch.column(1)[i : i + BLOCK]])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores), pa.float64())], names=[key, "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double")


def query(spark, sf_dir: str) -> DataFrame:
    from ..plans.base import spread
    from .common import table

    docs = spread(table(spark, sf_dir, "documents"))
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", F.coalesce(fold_of(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
