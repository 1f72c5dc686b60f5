"""Line dedup: lines that recur across documents go, except in the document with the largest id.

Every text is split at newlines and exploded by position; a line's key is the line without blanks at both ends and with A-Z
lowered. Keys of ``MIN_POINTS`` code points or more are hashed (two independent 64-bit hashes), distinct documents
are counted per hash, and lines over the threshold are dropped where the document is not the largest
holder. Texts are put together again by position.

Only hashes and positions travel, and counts are combined before the exchange; texts move once, to meet the list of
positions that they lose. Hashes over the threshold are written down before they are joined back, so a hash that
very many documents hold is a skewed join of two exchanges, which adaptive execution splits.

Defined results: null and empty texts are one empty line; rows that share an id are one document, and so are all rows with
a null id, which is below all others; so a line never goes from all its holders. An empty table gives an
empty table; columns other than key and text pass through unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, blanks_lit, saved, spare

MIN_POINTS, MIN_DOCS = 20, 3
ADDED = ("n_lines", "n_dropped", "kept_text")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dropped(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``k`` (a key of ``docs``), ``t`` (the hash of a text under it) and ``gone`` (the positions that it loses), where any are lost.

    ``t`` keeps the rows of one id apart, so no list holds more than the lines of one text."""
    line = F.btrim("line", blanks_lit())
    bare = F.translate(line, UPPER, LOWER)
    exploded = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("t"), F.posexplode(_lines(F.col(text))).alias("pos", "line"))
    # Used twice below; the texts are cut into lines once, and the hashes wait in the shared folder.
    held = saved(exploded.where(F.char_length(line) >= MIN_POINTS).select("k", "t", "pos", F.xxhash64(bare).alias("h"), F.xxhash64(F.lit(1), bare).alias("g")), "lines")
    holders = F.count_distinct("k") + F.max(F.col("k").isNull().cast("int"))
    often = saved(held.groupBy("h", "g").agg(holders.alias("n"), F.max("k").alias("last")).where(F.col("n") >= MIN_DOCS).select("h", "g", "last"), "often")
    return (
        held.join(often, ["h", "g"])
        .where(F.col("k").isNull() | (F.col("k") < F.col("last")))
        .groupBy("k", "t").agg(F.collect_set("pos").alias("gone"))
    )


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", added: tuple[str, str, str] = ADDED) -> DataFrame:
    """Every row of ``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``, or what ``added`` names them (in place of columns of these names)."""
    k, t, gone, lines = (spare(c, docs) for c in ("k", "t", "gone", "lines"))
    lost = dropped(docs, key, text).select(F.col("k").alias(k), F.col("t").alias(t), F.col("gone").alias(gone))
    joined = docs.join(lost, F.col(key).eqNullSafe(F.col(k)) & (F.xxhash64(text) == F.col(t)), "left").withColumn(lines, _lines(F.col(text)))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    kept = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    names = {a.lower() for a in added}
    return joined.select(
        *[F.col(c) for c in docs.columns if c.lower() not in names],
        F.size(lines).cast("long").alias(added[0]),
        F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long").alias(added[1]),
        F.when(F.col(gone).isNull(), F.coalesce(text, F.lit(""))).otherwise(kept).alias(added[2]),
    )


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
    translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
often AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT doc_id, pos, line, o.k IS NOT NULL AND doc_id <> o.last AS gone FROM keyed LEFT JOIN often o USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
