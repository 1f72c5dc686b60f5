"""Near-miss matching by sequence similarity.

Candidates come from a join: words of n and m letters whose similarity ``2 * matched / (n + m)`` is the cutoff or more differ by at most
``d = (1 - cutoff) * (n + m)`` deletions and insertions. Words that can lose their letters in few ways meet by what is left: both give the hashes of all that the deletions
and insertions leave, and only pairs with that many letters in common are proposed. The hashes of the words asked for make a bitmap of bounded size, behind which the other table's are
dropped where they are made, so few are shuffled. For long words: a deletion takes two of a word's letter pairs (with a mark at both ends), an insertion one, so of the pairs
in any one order, rarest first here, the first ``2 * deletions + insertions + 1`` of both words hold a common one, at places no more than d apart. Only these
meet, under the pair and the other word's length. What is proposed is compared exactly, in Arrow batches, for which Spark has no expression.
"""

from __future__ import annotations

import difflib
import functools
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import saved


#: Words of more letters, or that can lose theirs in more ways, meet by letter pairs.
LETTERS, WAYS = 20, 2000
#: Bits of the bitmap: as many for each hash, and a power of two at most.
_BITS_EACH, _BITS_MOST = 16, 29
_BASE = 0x9E3779B97F4A7C15
_SLOTS = 8 * 4096  # bits of one of Spark's bitmaps


def _lost(a: int, b: int, cutoff: float) -> int | None:
    """Letters that a word of a letters may lose at most to be near one of b, or null if none is near."""
    d = math.floor((1 - cutoff) * (a + b) + 1e-9)
    d -= (a + b - d) % 2
    return (d + a - b) // 2 if d >= abs(a - b) else None


def _few(a: int, b: int, cutoff: float) -> bool:
    """Whether words of a and b letters meet by what is left of them."""
    x, y = _lost(a, b, cutoff), _lost(b, a, cutoff)
    return max(a, b) <= LETTERS and x is not None and y is not None and math.comb(a, x) <= WAYS and math.comb(b, y) <= WAYS


@functools.cache
def _losses(a: int, cutoff: float) -> list[int]:
    """How many letters a word of a letters loses to the lengths that it meets by what is left."""
    return sorted({_lost(a, b, cutoff) for b in range(1, LETTERS + 1) if _few(a, b, cutoff)})


def _left(letters: np.ndarray, lost: int) -> np.ndarray:
    """Hashes of what is left of words (rows of code points) without any ``lost`` of their letters. Equal rests have equal hashes."""
    a = letters.shape[1]
    power = np.array([pow(_BASE, j, 1 << 64) for j in range(a)], dtype=np.uint64)
    sums = np.concatenate([np.zeros((len(letters), 1), np.uint64), np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * power, axis=1, dtype=np.uint64)], axis=1)
    ways = np.array(list(itertools.combinations(range(a), lost)), dtype=np.intp).reshape(math.comb(a, lost), lost)
    ends = np.concatenate([ways, np.full((len(ways), 1), a)], axis=1)
    h = sums[:, ends[:, 0]]
    for t in range(1, lost + 1):  # the letters behind t lost ones stand t places lower
        h = h + np.uint64(pow(_BASE, -t, 1 << 64)) * (sums[:, ends[:, t]] - sums[:, ends[:, t - 1] + 1])
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _rests(words: DataFrame, cutoff: float, kept: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """rest (hash), word, n, size (letters of the rest) of all rests by which a word meets others; those that ``kept`` is true for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = batch.column(0).to_pylist()
            by: dict[int, list[int]] = {}
            for i, x in enumerate(xs):
                if len(x) <= LETTERS:
                    by.setdefault(len(x), []).append(i)
            for n, which in by.items():
                for lost in _losses(n, cutoff):
                    lot = max(1, 500_000 // math.comb(n, lost))
                    for at in range(0, len(which), lot):
                        rows = np.array(which[at : at + lot])
                        letters = np.frombuffer("".join(xs[i] for i in rows).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(rows), n)
                        h = _left(letters, lost)
                        r, c = np.nonzero(kept(h)) if kept else (np.repeat(np.arange(len(rows)), h.shape[1]), np.tile(np.arange(h.shape[1]), len(rows)))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(h[r, c].view(np.int64)), batch.column(0).take(pa.array(rows[r])).cast(pa.string()), pa.array(np.full(len(r), n, np.int32)), pa.array(np.full(len(r), n - lost, np.int32))], names=["rest", "word", "n", "size"]
                        )

    return words.select("word").mapInArrow(run, "rest long, word string, n int, size int")


def among(rests: DataFrame, count: int) -> Callable[[np.ndarray], np.ndarray]:
    """A test of hashes that is true for all of the rests (a column of hashes) and for few others. Its bitmap has 64 MB at most and is sent to the tasks."""
    bits = min(max(math.ceil(math.log2(max(count, 1) * _BITS_EACH)), 15), _BITS_MOST)
    slot = F.shiftrightunsigned("rest", 64 - bits) + 1
    pieces = rests.groupBy(F.bitmap_bucket_number(slot).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    whole = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for piece, held in pieces.collect():
        whole[(piece - 1) * _SLOTS // 8 : piece * _SLOTS // 8] = np.frombuffer(held, dtype=np.uint8)
    sent = rests.sparkSession.sparkContext.broadcast(whole)

    def test(h: np.ndarray) -> np.ndarray:
        slots = h >> np.uint64(64 - bits)
        return (sent.value[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 == 1

    return test


def _by_rests(words: DataFrame, others: DataFrame, cutoff: float) -> DataFrame:
    """(word, other): pairs with as many letters in common as the cutoff asks for, of words that can lose theirs in few ways."""
    asked = saved(_rests(words, cutoff), "rests")
    known = _rests(others, cutoff, among(asked, asked.count())).select("rest", F.col("word").alias("other"), F.col("n").alias("m"))
    n, m = F.col("n"), F.col("m")
    return asked.join(known, "rest").where(2 * F.col("size") == n + m - _apart(n, m, cutoff)).select("word", "other").distinct()


def _apart(n: Column, m: Column, cutoff: float) -> Column:
    """Deletions and insertions at most between words of n and m letters; their number has the parity of n + m."""
    d = F.floor((1 - cutoff) * (n + m) + 1e-9)
    return d - (n + m - d) % 2


def _needed(n: Column, m: Column, d: Column) -> Column:
    """Length of the prefix of a word of n letters against one of m."""
    return 2 * ((d + n - m) / 2).cast("int") + ((d + m - n) / 2).cast("int") + 1


def _grams(words: DataFrame) -> DataFrame:
    """word, n, gram, at."""
    marked = F.concat(F.lit("\u0001"), F.col("word"), F.lit("\u0002"))
    pairs = F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substr(marked, i, F.lit(2)))
    return words.select("word", F.length("word").alias("n"), F.posexplode(pairs).alias("at", "gram"))


def _ordered(grams: DataFrame, often: DataFrame) -> DataFrame:
    """The same with ``nth``, the place of a pair among its word's, rarest first."""
    rated = grams.join(often, "gram", "left")
    one = F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram", "at")
    return rated.groupBy("word", "n").agg(F.array_sort(F.collect_list(one)).alias("g")).select("word", "n", F.posexplode("g").alias("nth", "x")).select("word", "n", (F.col("nth") + 1).alias("nth"), "x.gram", "x.at")


def _by_grams(words: DataFrame, others: DataFrame, cutoff: float) -> DataFrame:
    """(word, other): pairs that may reach the cutoff, of words that can lose their letters in many ways."""
    wide, narrow = (2 - cutoff) / cutoff, cutoff / (2 - cutoff)
    lengths = range(1, LETTERS + 1)
    few = [64 * a + b for a in lengths for b in lengths if _few(a, b, cutoff)]
    meets = lambda a, b: _lost(a, b, cutoff) is not None and not _few(a, b, cutoff)
    long = [a for a in lengths if any(meets(a, b) for b in range(1, math.ceil(LETTERS * wide) + 2))]
    many = (F.length("word") > LETTERS) | F.length("word").isin(*long)
    words, others = words.where(many), others.where(many)
    theirs = saved(_grams(others), "grams")
    often = saved(theirs.groupBy("gram").agg(F.count(F.lit(1)).alias("df")), "often")
    n, m = F.col("n"), F.col("m")
    asked = _ordered(_grams(words), often).withColumn("m", F.explode(F.sequence(F.greatest(F.ceil(n * narrow - 1e-9), F.lit(1)).cast("int"), F.floor(n * wide + 1e-9).cast("int")))).withColumn("d", _apart(n, m, cutoff))
    asked = asked.where((F.col("d") >= F.abs(n - m)) & (F.col("nth") <= _needed(n, m, F.col("d"))) & ((F.greatest(n, m) > LETTERS) | ~(64 * n + m).isin(*few)))
    # No partner asks for more of a word's pairs than the shortest one does.
    known = _ordered(theirs, often).where(F.col("nth") <= 4 * n * (1 - cutoff) / (2 - cutoff) + 2)
    known = known.select(F.col("word").alias("other"), F.col("n").alias("m"), "gram", F.col("nth").alias("other_nth"), F.col("at").alias("other_at"))
    met = asked.join(known, ["gram", "m"]).where((F.abs(F.col("at") - F.col("other_at")) <= F.col("d")) & (F.col("other_nth") <= _needed(m, n, F.col("d"))))
    # Insertions and deletions bound the edit distance: most pairs that are not near end here, in the JVM.
    return met.where(F.levenshtein("word", "other") <= F.col("d")).select("word", "other").distinct()


def candidates(words: DataFrame, others: DataFrame, cutoff: float) -> DataFrame:
    """(word, other): pairs of two tables of distinct words (word) that may reach the cutoff; every pair that does is among them, once."""
    words, others = saved(words, "words"), saved(others, "others")
    return _by_rests(words, others, cutoff).unionByName(_by_grams(words, others, cutoff))


def ratio(a: Column, b: Column, cutoff: float) -> Column:
    """Similarity of two words, or null below the cutoff."""

    @F.pandas_udf("double")
    def compare(a: pd.Series, b: pd.Series) -> pd.Series:
        out, last = [], None
        matcher = difflib.SequenceMatcher()
        for x, y in zip(a, b, strict=True):
            if x != last:
                matcher.set_seq2(x)
                last = x
            matcher.set_seq1(y)
            near = matcher.real_quick_ratio() >= cutoff and matcher.quick_ratio() >= cutoff
            r = matcher.ratio() if near else 0.0
            out.append(r if r >= cutoff else None)
        return pd.Series(out, dtype="float64")

    return compare(a, b)


def near_pairs(words: DataFrame, others: DataFrame, cutoff: float) -> DataFrame:
    """(word, other, ratio): all pairs of words (word) of two tables whose similarity is the cutoff or more."""
    pairs = candidates(words.where("word <> ''").select("word").distinct(), others.where("word <> ''").select("word").distinct(), cutoff)
    return pairs.withColumn("ratio", ratio(F.col("word"), F.col("other"), cutoff)).where("ratio is not null")


def near_names(asked: DataFrame, names: DataFrame, key: str, cutoff: float = 0.88, least: int = 6) -> DataFrame:
    """(key, word, name) of the words (key, word) of ``least`` letters or more that nearly spell a name (name) of one word and as many letters: the most
    similar one, of equally similar ones the last. Words that are names, or a part of them, are no near misses."""
    singles = names.where(~F.col("name").contains(" ") & (F.length("name") >= least)).select(F.col("name").alias("word")).distinct()
    parts = names.select(F.explode(F.split("name", "[^a-z]+")).alias("word")).distinct()
    left = asked.where(F.length("word") >= least).join(parts, "word", "left_anti")
    best = near_pairs(left, singles, cutoff).groupBy("word").agg(F.max(F.struct("ratio", "other")).alias("b"))
    return left.join(best, "word").select(key, "word", F.col("b.other").alias("name"))


def unknown_words(asked: DataFrame, vocabulary: DataFrame, key: str, cutoff: float = 0.85, least: int = 6) -> DataFrame:
    """(key, word) of long words that neither stand in the vocabulary (word) nor nearly do. An anti join takes out what is known."""
    vocabulary = saved(vocabulary.select("word"), "vocabulary")
    left = saved(asked.where(F.length("word") >= least).join(vocabulary, "word", "left_anti").select(key, "word"), "unknown")
    typos = near_pairs(left, vocabulary.where(F.length("word") >= int(least * cutoff / (2 - cutoff))), cutoff).select("word").distinct()
    return left.join(typos, "word", "left_anti").select(key, "word")
