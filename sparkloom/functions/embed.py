"""The hashing embedder: features hashed to dimensions with signs, weighted by 1 + ln(tf), normalised."""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import tokens

#: Weights of the kinds of features: words, padded trigrams of words of five letters or more, pairs of words.
WORD, TRIGRAM, PAIR = 1.0, 0.25, 0.7
_SEED = 42


def vector(words: list[str], dim: int, known: dict[str, np.ndarray]) -> np.ndarray:
    """The embedding of a list of words; ``known`` remembers the hashes of words and their trigrams."""
    import xxhash

    h = lambda s: xxhash.xxh64_intdigest(s, _SEED)
    out = np.zeros(dim)
    if words:
        counts, own = Counter(words), []
        for w in counts:
            mine = known.get(w)
            if mine is None:
                padded = f"#{w}#"
                grams = [h(f"c:{padded[i : i + 3]}") for i in range(len(w))] if len(w) >= 5 else []
                mine = known[w] = np.array([h(f"w:{w}"), *grams], dtype=np.uint64)
            own.append(mine)
        # A word stands once for all its places, the first of its hashes as a word, the others as trigrams.
        sizes, times = np.array([len(x) for x in own]), np.array(list(counts.values()), dtype=float)
        weights = np.repeat(TRIGRAM * times, sizes)
        weights[np.cumsum(sizes) - sizes] = WORD * times
        pairs = np.fromiter((h(f"b:{a}_{b}") for a, b in itertools.pairwise(words)), dtype=np.uint64, count=len(words) - 1)
        features, where = np.unique(np.concatenate([*own, pairs]), return_inverse=True)
        tf = np.bincount(where, np.concatenate([weights, np.full(len(pairs), PAIR)]))
        weight = np.where(tf >= 1, 1 + np.log(np.maximum(tf, 1)), tf)
        sign = np.where(features >> np.uint64(63), 1.0, -1.0)
        out = np.bincount((features % np.uint64(dim)).astype(np.intp), sign * weight, dim)
        norm = np.linalg.norm(out)
        out = out / norm if norm > 0 else out
    return out.astype(np.float32)


def hashing_embedding(docs: DataFrame, key: str, text: str, dim: int = 384) -> DataFrame:
    """(key, embedding array<float>). Hashes are XXH64 with Spark's seed, read as unsigned: the dimension is its remainder, the
    sign its top bit. Tokens come from the JVM; a document never leaves its task. A null text is embedded like an empty one."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        for batch in batches:
            if len(known) > 100_000:
                known.clear()
            made = [vector(w.split(" ") if w else [], dim, known) for w in batch.column(1).to_pylist()]
            flat = pa.array(np.concatenate(made) if made else np.empty(0, np.float32))
            offsets = pa.array(np.arange(0, (len(made) + 1) * dim, dim, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], names=[key, "embedding"])

    # Tokens hold no blanks: a joined text is taken apart in Python faster than a list of strings is read from Arrow.
    return docs.select(key, F.array_join(tokens(F.col(text)), " ").alias("words")).mapInArrow(run, f"`{key}` {kind}, embedding array<float>")
