"""Names of a catalogue table, of any size, found in texts by a join: leftmost, longest, without overlap.

Names and texts are cut into words with what stands between them. The hashes of whole names and of their first two words make a bitmap of bounded size. A text's words are looked up there
where the text is read, first two words and then, behind known ones, as many as names have; only what may be a name becomes a row and meets the
catalogue in one equi-join, which drops what is not. What is found is an interval of words; of overlapping ones the leftmost and then the longest stays, as an alternation of all names, longest first, would find
them. Nothing about the catalogue but the bitmap and the lengths of names is a constant of the plan or passes the driver.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fuzzy import among
from ..sources.shared import saved

LETTER = r"[\p{L}\p{N}_]"

#: Code points of the texts that are cut together, unless one text has more.
LOT = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_HEAD = np.uint64(0xA5A5A5A5A5A5A5A5)  # sets hashes of first words apart from those of whole names


@functools.cache
def _letters() -> np.ndarray:
    """Of every code point, whether it is a letter, a digit or an underscore."""
    return np.array([unicodedata.category(chr(i))[0] in "LN" for i in range(0x110000)]) | (np.arange(0x110000) == ord("_"))


@functools.lru_cache(2)
def _powers(base: int, size: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]), dtype=np.uint64)


class _Words:
    """The words of a lot of texts: where they start and end, the text of each and its number there. What stands before a text's first word counts as a word."""

    def __init__(self, texts: list[str]):
        self.whole = "\n" + "\n".join(texts) + "\n"
        code = np.frombuffer(self.whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _letters()[code]
        self.starts, self.ends = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1, np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
        size = 1 << len(code).bit_length()
        self.back = _powers(pow(_BASE, -1, 1 << 64), size)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((code.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, size)[: len(code)], dtype=np.uint64)])
        begins = np.cumsum([1, *(len(x) + 1 for x in texts)])
        first = np.searchsorted(self.starts, begins)
        self.text = np.repeat(np.arange(len(texts)), np.diff(first))
        self.stop = first[1:][self.text]  # the first word of the next text
        self.at = np.arange(len(self.starts)) - first[self.text] + ~letter[begins[self.text]]

    def hashes(self, w: np.ndarray, m: np.ndarray | int) -> np.ndarray:
        """Hashes of m words from word w on, with what stands between them. Equal strings have equal ones."""
        a, b = self.starts[w], self.ends[w + m - 1]
        h = (self.sums[b] - self.sums[a]) * self.back[a]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def _lots(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin = held = 0
    for i, x in enumerate(texts):
        if i > begin and held + len(x) > LOT:
            yield begin, i
            begin, held = i, 0
        held += len(x) + 1
    if begin < len(texts):
        yield begin, len(texts)


def _of_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rest, m: the hash and the number of words of each name, and the hash of the first two of more."""
    for batch in batches:
        surfaces = batch.column(0).to_pylist()
        for begin, end in _lots(surfaces):
            words = _Words(surfaces[begin:end])
            w = np.flatnonzero(words.at == 0)
            m = words.stop[w] - w
            long = m > 2
            rest = np.concatenate([words.hashes(w, m), words.hashes(w[long], 2) ^ _HEAD])
            yield pa.RecordBatch.from_arrays([pa.array(rest.view(np.int64)), pa.array(np.concatenate([m, m[long]]), pa.int32())], names=["rest", "m"])


def _spots(lengths: list[int], known: Callable[[np.ndarray], np.ndarray]) -> Callable:
    """_key, at, m, surface: the places of texts where a name may be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in _lots(texts):
                words = _Words(texts[begin:end])
                every = np.arange(len(words.starts))
                pairs = every[every + 2 <= words.stop]
                behind = pairs[known(words.hashes(pairs, 2) ^ _HEAD)] if lengths[-1] > 2 else pairs[:0]
                for m in lengths:
                    w = every if m == 1 else pairs if m == 2 else behind[behind + m <= words.stop[behind]]
                    w = w[known(words.hashes(w, m))]
                    surface = [words.whole[a:b] for a, b in zip(words.starts[w].tolist(), words.ends[w + m - 1].tolist(), strict=True)]
                    columns = [batch.column(0).take(pa.array(begin + words.text[w])), pa.array(words.at[w], pa.int32()), pa.array(np.full(len(w), m, np.int32)), pa.array(surface, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["_key", "at", "m", "surface"])

    return run


def _names(names: DataFrame) -> DataFrame:
    """kind, surface, canonical. A surface that names several things names the least; one that does not begin and end with a letter or digit has no word
    boundary and is never found."""
    return names.where(F.col("surface").rlike(f"^{LETTER}(.*{LETTER})?$")).groupBy("kind", "surface").agg(F.min("canonical").alias("canonical"))


def matches(texts: DataFrame, names: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, kind, surface, canonical, at, m): names (kind, surface, canonical) in texts with unique keys; ``at`` is the number of the first word, ``m`` the number of words. Texts and names
    are compared as they are, so both should be in one case. A null text holds nothing."""
    named = saved(_names(names), "names")
    rests = saved(named.select("surface").mapInArrow(_of_names, "rest long, m int"), "name_rests")
    count, lengths = rests.agg(F.count(F.lit(1)), F.array_sort(F.collect_set("m"))).first()
    schema = T.StructType([T.StructField("_key", texts.schema[key].dataType), T.StructField("at", T.IntegerType()), T.StructField("m", T.IntegerType()), T.StructField("surface", T.StringType())])
    read = texts.where(F.col(text).isNotNull()).select(key, F.make_valid_utf8(F.col(text)))
    spots = read.mapInArrow(_spots(lengths, among(rests, count)), schema) if lengths else texts.sparkSession.createDataFrame([], schema)
    return _leftmost_longest(spots.join(named, "surface")).withColumnRenamed("_key", key).select(key, "kind", "surface", "canonical", "at", "m")


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of intervals in order those that a scan from the left keeps; ``opens`` is true for one that overlaps none before it."""
    end = 0
    for batch in batches:
        kept = batch.column("opens").to_numpy(zero_copy_only=False).astype(bool)
        opens = kept.copy()
        at = batch.column("at").to_numpy()
        ends = at + batch.column("m").to_numpy()
        for i in np.flatnonzero(~opens).tolist():
            if i and opens[i - 1]:
                end = ends[i - 1]
            if at[i] >= end:
                kept[i], end = True, ends[i]
        if len(opens) and opens[-1]:
            end = ends[-1]
        yield batch.filter(pa.array(kept)).drop_columns(["opens"])


def _leftmost_longest(met: DataFrame) -> DataFrame:
    """Of overlapping intervals of one text and kind those that a scan from the left keeps. Of those that begin together only the longest can stay; what then overlaps none before it stays
    as it is, and only chains of overlapping ones are folded, row by row."""
    order = Window.partitionBy("_key", "kind").orderBy("at", F.desc("m"))
    reach = F.max(F.col("at") + F.col("m")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    longest = met.withColumns({"_before": F.lag("at").over(order), "_reach": reach}).where(F.col("_before").isNull() | (F.col("_before") < F.col("at")))
    rows = longest.withColumn("opens", F.col("_reach").isNull() | (F.col("at") >= F.col("_reach"))).select(*met.columns, "opens")
    return rows.sortWithinPartitions("_key", "kind", "at").mapInArrow(_folded, met.schema)


def mentioned(texts: DataFrame, names: DataFrame, key: str, text: str = "text", kinds: tuple[str, ...] = ("drugs", "labs", "conditions")) -> DataFrame:
    """(key, one column for each kind): the sorted canonical names that a text mentions, for texts that mention any."""
    found = matches(texts, names, key, text)
    return found.groupBy(key).agg(*[F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("canonical")))).alias(k) for k in kinds])


def with_catalogue(questions: DataFrame, names: DataFrame, key: str = "qid", text: str = "q", entities: str = "e") -> DataFrame:
    """Questions whose ``entities`` also hold what a catalogue names in ``text``. Equal texts are searched once."""
    texts = questions.select(F.xxhash64(text).alias("_h"), text).groupBy("_h", text).agg(F.lit(0)).select("_h", text)
    more = mentioned(texts, names, "_h", text)
    out = questions.withColumn("_h", F.xxhash64(text)).join(more, "_h", "left").drop("_h")
    e = F.col(entities)
    none = F.array().cast("array<string>")
    for kind in ("drugs", "labs", "conditions"):
        e = e.withField(kind, F.array_sort(F.array_union(F.col(f"{entities}.{kind}"), F.coalesce(kind, none))))
    return out.withColumn(entities, e).drop("drugs", "labs", "conditions")
