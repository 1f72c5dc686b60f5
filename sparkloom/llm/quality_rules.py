"""Quality rules: word, line and symbol counts, and zstandard compression bands.

A text is compressed whole and in overlapping chunks of ``CHUNK`` bytes, or of half the text if that is less, but of ``LEAST`` bytes
at least; the last chunk ends with the text, so every byte is in one. Compressed size over raw size is small for repetitive text and large for
random text. What is normal depends on the length, so the limits of texts and of chunks are looked up by length; a text
outside its band is rejected, and so is one with ``CHUNK_SHARE`` or more of its chunks outside theirs, which half a text of noise or filler
reaches wherever it stands. A text of ``LEAST`` bytes or fewer is its own only chunk.

Defined results: a null text has no words and fails the base rule; an empty text likewise;
repeated rows are judged row by row; other columns of the input are not touched; an empty
table gives an empty result. Texts of any length are read whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK, LEAST = 4096, 128
LEVEL = 3
#: (raw bytes from, least ratio, greatest ratio) for whole texts.
WHOLE_BANDS = ((0, 0.10, 1.30), (128, 0.25, 0.92), (512, 0.25, 0.80), (2048, 0.25, 0.72), (8192, 0.22, 0.66), (65536, 0.20, 0.62))
#: The same for one chunk. Chunks begin every quarter of a chunk; of half a text of noise at least one chunk in eight is all noise.
CHUNK_BANDS = ((128, 0.25, 0.98), (192, 0.20, 0.90), (256, 0.16, 0.86), (384, 0.14, 0.82), (512, 0.12, 0.78), (768, 0.12, 0.75), (1024, 0.12, 0.72), (4096, 0.12, 0.70))
CHUNK_SHARE = 1 / 8

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, ratio double, chunks_outside long, n_chunks long"


def repeat_words(words: list[bytes]) -> int:
    """Words that stand in a three-word window which the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: defaultdict = defaultdict()
    ids.default_factory = ids.__len__
    w = np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=n)
    v = len(ids)
    if v == n:
        return 0
    pairs = w[:-1] * v + w[1:]
    if v > 2_000_000:  # three factors would not fit 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:-1] * v + w[2:]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def dup_lines(text: str) -> int:
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0
    seen, again = set(), 0
    for line in lines:
        if line in seen:
            again += bool(line.strip(" \t\n\x0b\x0c\r"))
        else:
            seen.add(line)
    return again


def limits(table: tuple, length: int) -> tuple[float, float]:
    """Least and greatest ratio for a length."""
    return next((lo, hi) for least, lo, hi in reversed(table) if length >= least)


def bands(raw: bytes, compress) -> tuple[float, int, int, bool]:
    """Ratio of the whole, chunks outside their band, number of chunks, and whether the text is within its limits."""
    if not raw:
        return 0.0, 0, 0, True
    ratio = len(compress(raw)) / len(raw)
    low, high = limits(WHOLE_BANDS, len(raw))
    outside = n = 0
    if len(raw) > LEAST:
        long = max(min(CHUNK, len(raw) // 2), LEAST)
        least, most = limits(CHUNK_BANDS, long)
        for at in (*range(0, len(raw) - long, long // 4), len(raw) - long):
            n += 1
            outside += not least <= len(compress(raw[at : at + long])) / long <= most
    return ratio, outside, n, low <= ratio <= high and (not outside or outside < CHUNK_SHARE * n)


def measure(text: str | None, compress) -> tuple:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() parts at exactly the six ASCII blanks
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = dup_lines(text)
    repeated = repeat_words(words)
    failed = n < 50 or 100 * repeated > 50 * n
    ratio, outside, chunks, within = bands(raw, compress)
    kept = not failed and within
    return n, chars, symbols, lines, repeated, failed, kept, ratio, outside, chunks


def _scores(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False).compress
        for batch in batches:
            rows = [measure(t.as_py(), compress) for t in batch.column(1)]
            cols = list(zip(*rows, strict=True)) or [()] * 10
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                names=[key, *COUNTS, "base_failed", "kept", "ratio", "chunks_outside", "n_chunks"],
            )

    return run


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, the counts, ``base_failed``, ``kept`` and the compression figures."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(_scores(key), f"`{key}` {kind}, {SCHEMA}")


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text passes; every column as it was. No shuffle: rows are judged where they are."""
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False).compress
        for batch in batches:
            yield batch.filter(pa.array([measure(t.as_py(), compress)[6] for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    from ..plans.base import spread
    from .common import table

    return score(spread(table(spark, sf_dir, "documents"))).withColumn("ratio", F.round("ratio", 9))
