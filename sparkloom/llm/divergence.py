"""Source divergence audit: how far the sources of a language lie apart in their terms, and by which terms.

Occurrences and documents of each term are counted per (lang, source) where the texts are read. The kept terms of a language
(those in ``MIN_DOCS`` documents or more) are the columns of a matrix whose rows are its sources. Its columns are dealt into
tiles of about ``WIDTH`` terms by a hash, its rows into blocks of ``ROWS``; a tile with the rows of two blocks is one group, so a group
is bounded whatever a language or a source holds.

In a group the counts become a K-squared quadtree (K = 2): a node stands for a square of rows by columns, and only squares
with a count have a node. Two row squares over the same columns are descended together. Where both are empty, all pairs of
their rows get the price of two zero counts times the columns, without a look at them; where one is empty, its side counts as
zero and only the other's children lead the way. At the leaves the term's value is computed from the two counts. Sums over tiles
are exact integers.

Frequent terms stand first among the columns and sources with many words first among the rows, so empty squares are large.

Defined results: a null text, language or source is the empty string; every row is a document of its own, so repeated rows count
again; a document without terms still makes its group; a language without kept terms gives value 0 to all pairs and no terms; a
language of one source has no pairs; an empty table gives an empty table; other columns are not read. Texts of any length
are read whole, in pieces.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

MIN_DOCS, TOP = 10, 10
#: Terms of a tile, sources of a block, and entries of a task's counts before they leave it.
WIDTH, ROWS, ENTRIES = 512, 32, 400_000
#: Characters beyond ASCII are bytes from 0x80 on in UTF-8, so this is the contract's class of code points.
TERM, GAP = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")
UNIT = 1_000_000_000


def terms_of(raw: bytes, piece: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of about ``piece`` bytes of text."""
    raw = raw.lower()  # of bytes: A-Z only
    at = 0
    while at < len(raw):
        gap = GAP.search(raw, at + piece)
        end = gap.start() if gap else len(raw)
        yield TERM.findall(raw, at, end)
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict = defaultdict(lambda: (Counter(), Counter()))

    def leave() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, df) in seen.items():
            names = [b"", *n]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(names), pa.string()), pa.array([source] * len(names), pa.string()), pa.array(names, pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(df.__getitem__, n)], pa.int64())],
                names=["lang", "source", "term", "n", "df"],
            )
        seen.clear()

    for batch in batches:
        lang, source, text = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())
        for k in range(batch.num_rows):
            n, df = seen[lang[k] or "", source[k] or ""]
            own: set = set()
            for words in terms_of(text[k].as_py() or b""):
                n.update(words)
                own.update(words)
            df.update(own)
        if sum(len(n) for n, _ in seen.values()) > ENTRIES:
            yield from leave()
    yield from leave()


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` (occurrences) and ``df`` (documents); the empty term stands for the group itself."""
    read = docs.select(F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    return read.mapInArrow(_count, "lang string, source string, term string, n long, df long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def level(n: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (n + 2) / mass), divided in two steps so that 64 bits hold it."""
    whole, rest = np.divmod((n + 2) * 100_000, mass)
    return 1 + whole * 10_000 + rest * 10_000 // mass


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class Tree:
    """K-squared tree (K = 2) of a sparse matrix of counts: ``child[k][node]`` has the four children of a node of level k, -1 where a quadrant is empty."""

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, height: int):
        code = np.zeros(len(row), dtype=np.int64)
        for b in range(height):
            code |= (row >> b & 1) << 2 * b + 1 | (col >> b & 1) << 2 * b
        order = np.argsort(code, kind="stable")
        self.value, code = np.append(value[order], 0), code[order]  # node -1 reads 0
        self.child, above = [], np.zeros(min(1, len(code)), dtype=np.int64)
        for k in range(height):
            below = np.unique(code >> 2 * (height - 1 - k))
            kids = np.full((len(above) + 1, 4), -1, dtype=np.int64)  # and has no children
            kids[np.searchsorted(above, below >> 2), below & 3] = np.arange(len(below))
            self.child.append(kids)
            above = below
        self.root = 0 if len(code) else -1


def pair_sums(tree: Tree, height: int, mass: np.ndarray, width: int, split: int = 0) -> np.ndarray:
    """Sum of values over ``width`` columns for all pairs of rows g < h (with ``split``: g < split <= h) of a tree whose rows have ``mass``."""
    rows = len(mass)
    total, edges = np.zeros(rows * rows, dtype=np.int64), np.zeros((rows + 1, rows + 1), dtype=np.int64)
    g, h, c, a, b = (np.array([x], dtype=np.int64) for x in (0, 0, 0, tree.root, tree.root))
    for k in range(height + 1):
        size = 1 << height - k
        if k:
            quads = [(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)]
            kids = tree.child[k - 1]
            g, h, c, a, b = (np.concatenate(x) for x in zip(*[(2 * g + x, 2 * h + y, 2 * c + z, kids[a, 2 * x + z], kids[b, 2 * y + z]) for x, y, z in quads], strict=True))
        asked = (g <= h if size > 1 else g < h) & (h * size < rows) & (c * size < width)
        if split:
            asked &= (g * size < split) & ((h + 1) * size > split)
        g, h, c, a, b = (x[asked] for x in (g, h, c, a, b))
        empty = (a < 0) & (b < 0)
        if empty.any():  # a rectangle of pairs, all at once, in a table of differences
            cols = np.minimum(size, width - c[empty] * size)
            low, left = g[empty] * size, h[empty] * size
            high, right = np.minimum(low + size, rows), np.minimum(left + size, rows)
            for y, x, sign in ((low, left, 1), (low, right, -1), (high, left, -1), (high, right, 1)):
                np.add.at(edges, (y, x), sign * cols)
            g, h, c, a, b = (x[~empty] for x in (g, h, c, a, b))
    found = apart(level(tree.value[a], mass[g]), level(tree.value[b], mass[h]))
    np.add.at(total, g * rows + h, found)
    zeros = edges.cumsum(0).cumsum(1)[:rows, :rows]
    base = level(np.zeros(rows, dtype=np.int64), mass)
    return total.reshape(rows, rows) + zeros * apart(base[:, None], base[None, :])


def _tile(group: pd.DataFrame) -> pd.DataFrame:
    """Sums of one tile for the pairs of two blocks of rows. Rows with ``col`` -1 give the sources of the blocks, with the mass in ``n``."""
    head = group[group.col < 0].sort_values("row")
    names, mass, width = head.row.to_numpy(), head.n.to_numpy(), int(head.width.iloc[0])
    cells = group[group.col >= 0]
    i, j = int(group.i.iloc[0]), int(group.j.iloc[0])
    split = int((names < (i + 1) * ROWS).sum()) if i != j else 0
    if not width or len(names) < 2:
        value = np.zeros((len(names), len(names)), dtype=np.int64)
    else:
        height = int(max(width, len(names)) - 1).bit_length()
        tree = Tree(np.searchsorted(names, cells.row.to_numpy()), cells.col.to_numpy().astype(np.int64), cells.n.to_numpy(), height)
        value = pair_sums(tree, height, mass, width, split)
    g, h = np.nonzero(np.triu(np.ones_like(value), 1))
    if split:
        across = (g < split) & (h >= split)
        g, h = g[across], h[across]
    return pd.DataFrame({"lang": group.lang.iloc[0], "g": names[g], "h": names[h], "value": value[g, h]})


def _level(n: Column, mass: Column) -> Column:
    return (F.call_function("div", (n + 2).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)"), mass.cast("decimal(20,0)")) + 1).cast("long")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, width: int = WIDTH) -> DataFrame:
    """``lang``, ``source``, ``part`` (pair or term), ``item``, ``value`` and ``rank``."""
    counted = saved(counts(docs, text, lang, source), "counts")
    known = counted.where(F.col("term") != "").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("df").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term", "total")
    known = saved(known, "terms")
    langs = saved(known.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n")), "langs")  # of known size when it is joined
    tiled = known.join(langs, "lang").withColumn("tile", F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / width)))
    place = Window.partitionBy("lang", "tile").orderBy(F.col("total").desc(), "term")
    tiled = tiled.repartition("lang", "tile")  # else rows dealt by language already would stay so
    tiled = saved(tiled.withColumn("col", F.row_number().over(place) - 1), "tiled")
    cells = saved(counted.select("lang", "source", "term", "n").join(tiled, ["lang", "term"]), "cells")

    words = cells.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = counted.where(F.col("term") == "").select("lang", "source").join(words, ["lang", "source"], "left").join(langs.select("lang", "v"), "lang", "left")
    mass = (F.coalesce("group_n", F.lit(0)) + 2 * F.coalesce("v", F.lit(0))).cast("long")
    by_size = Window.partitionBy("lang").orderBy(F.col("group_n").desc_nulls_last(), "source")
    groups = saved(groups.select("lang", "source", mass.alias("mass"), (F.row_number().over(by_size) - 1).cast("long").alias("row")), "groups")

    # The pair of a group with the language: terms that stand out.
    rated = cells.join(groups, ["lang", "source"]).select("lang", "source", "row", "term", "tile", "col", "n", _level(F.col("n"), F.col("mass")).alias("p"), _level(F.col("total"), F.col("lang_n") + 2 * F.col("v")).alias("q"))
    rated = saved(rated, "rated")
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    gap = F.col("p") - F.col("q")
    outstanding = rated.where(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), F.call_function("div", gap * gap, F.col("p") + F.col("q")).alias("value"))
    outstanding = outstanding.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    # The pairs of groups: tiles of the matrix, with the sources of their rows at the head.
    widths = groups.select("lang").distinct().join(tiled.groupBy("lang", "tile").agg(F.count(F.lit(1)).alias("width")), "lang", "left")
    widths = widths.select("lang", F.coalesce("tile", F.lit(0)).alias("tile"), F.coalesce("width", F.lit(0)).alias("width"))
    head = groups.join(widths, "lang").select("lang", "tile", "row", F.lit(-1).alias("col"), F.col("mass").alias("n"), "width")
    body = rated.select("lang", "tile", "row", "col", "n", F.lit(None).cast("long").alias("width"))
    blocks = groups.groupBy("lang").agg(F.floor(F.max("row") / ROWS).alias("last"))
    block = F.floor(F.col("row") / ROWS)
    dealt = head.unionByName(body).join(F.broadcast(blocks), "lang").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    dealt = dealt.select("lang", "tile", F.least(block, "other").alias("i"), F.greatest(block, "other").alias("j"), "row", "col", "n", "width")
    sums = dealt.groupBy("lang", "tile", "i", "j").applyInPandas(_tile, "lang string, g long, h long, value long").groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    sums = saved(sums, "pairs")
    both = sums.select("lang", F.col("g").alias("row"), F.col("h").alias("partner"), "value").union(sums.select("lang", "h", "g", "value"))
    named = groups.select("lang", "source", "row")
    pairs = both.join(named, ["lang", "row"]).join(named.select("lang", F.col("row").alias("partner"), F.col("source").alias("item")), ["lang", "partner"])
    pairs = pairs.select("lang", "source", "item", "value").withColumn("rank", F.row_number().over(best))

    return pairs.withColumn("part", F.lit("pair")).unionByName(outstanding.withColumn("part", F.lit("term"))).select("lang", "source", "part", "item", "value", "rank")


def query(spark, sf_dir: str) -> DataFrame:
    from ..plans.base import spread
    from .common import table

    return audit(spread(table(spark, sf_dir, "documents").select("lang", "source", "text")))


ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
cells AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
masses AS (
  SELECT g.lang, g.source, coalesce((SELECT sum(n) FROM cells c WHERE c.lang = g.lang AND c.source = g.source), 0)::HUGEINT AS n, coalesce(l.v, 0) AS v
  FROM groups g LEFT JOIN langs l USING (lang)),
full_rows AS (
  SELECT m.lang, m.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (m.n + 2 * m.v) AS p, 1 + 1000000000::HUGEINT * (k.n + 2) // (l.n + 2 * l.v) AS q
  FROM masses m JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN cells c ON c.lang = m.lang AND c.source = m.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN full_rows x ON x.lang = a.lang AND x.source = a.source LEFT JOIN full_rows y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source),
found AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM full_rows WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
