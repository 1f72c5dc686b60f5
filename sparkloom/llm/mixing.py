"""Mixing sources to target weights, with a curriculum that changes over training.

How much. Sources in code-point order (null last) get the weights of ``WEIGHTS`` in turn and share all
words by weight. A source gives ``MOST`` times its own words at most; what that leaves over is shared
among the others by weight, until none is above.

Which. A source's documents stand in the order of a digest of their id. The mix takes that row whole,
again and again, and stops inside the document where the target is reached, so a source misses its
target by less than one word, and a document is taken MOST times at most.

When. Each source has a schedule: a piecewise linear rate over training time 0..1. Its integral, scaled
to the target, is the source's cumulative demand; a document copy that begins after c words of its source
is due when the demand reaches c, take j counting the words of the j passes before it. Inverting the integral
gives the training position. ``takes`` gives every copy its own and range-sorts the copies by it; ``mix`` has
one row per document, with the position of its first take.

A source with a third of all rows is no single window: its row is cut into buckets of the digest's first bits, about
``BUCKET`` rows each, word sums of whole buckets are added up first, and each bucket is ordered by itself. Sources may be many:
they are ranked range by range, and the level at which the mix is full is found by sums over all sources.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source; ids
may repeat or be null (rows with equal ids stand in the order of their texts' hash; equal rows are alike, so
reruns agree); other columns pass through, but for those named as an added one; an empty table gives an empty table. All sizes 0: all targets 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, spare, word_count

WEIGHTS, MOST = (5, 2, 1), 3
#: Knots (time, rate) per weight in turn: the heaviest fade out, the lightest fade in.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
#: Rows of a source, if it had all, in one window.
BUCKET = 1_000


def targets(sized: DataFrame, weights=WEIGHTS, most=MOST) -> DataFrame:
    """Per source of a table with ``src`` (null allowed) and ``size``: ``source_size``, ``target`` and ``turn``."""
    by_name = F.col("src").asc_nulls_last()
    ranged = saved(sized.groupBy("src").agg(F.sum("size").alias("source_size")).repartitionByRange(by_name).withColumn("range", F.spark_partition_id()), "sources")
    # One row for each range of sources, as many as the shuffle has partitions.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    turn = (F.row_number().over(Window.partitionBy("range").orderBy(by_name)) + F.col("ahead") - 1) % len(weights)
    sources = saved(
        ranged.join(F.broadcast(ahead), "range").withColumn("turn", turn.cast("int"))
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("turn") + 1))
        .select("src", "source_size", "turn", "weight", (F.col("source_size") * most).cast("double").alias("cap")), "sources",
    )
    # What full sources leave over is shared again among the others, until no further one is full; only sums come to the driver.
    level, full = 0.0, -1
    while True:
        is_full = F.lit(level) * F.col("weight") > F.col("cap")
        total, capped, sharing, now = sources.agg(
            F.sum("source_size").cast("double"), F.sum(F.when(is_full, F.col("cap")).otherwise(0.0)), F.sum(F.when(is_full, 0.0).otherwise(F.col("weight"))), F.sum(is_full.cast("long"))
        ).first()
        if now == full or not sharing:
            break
        level, full = (total - capped) / sharing, now
    share = F.lit(level) * F.col("weight")
    return sources.select("src", "source_size", F.when(share > F.col("cap"), F.col("cap")).otherwise(share).alias("target"), "turn")


def _due(share: Column, knots) -> Column:
    """The time at which the integral of the piecewise linear rate through ``knots`` has reached ``share`` of its whole."""
    pieces, area = [], 0.0
    for (t0, r0), (t1, r1) in zip(knots, knots[1:], strict=False):
        gain = (r0 + r1) / 2 * (t1 - t0)
        pieces.append((area, t0, t1, r0, (r1 - r0) / (t1 - t0)))
        area += gain
    due = F.lit(float(knots[-1][0]))
    for base, t0, t1, r0, slope in reversed(pieces):
        y = share * area - base
        # Of r0*dt + slope*dt^2/2 = y the root that also holds for slope 0.
        dt = 2 * y / (F.sqrt(F.greatest(F.lit(r0 * r0) + 2 * slope * y, F.lit(0.0))) + r0)
        inside = y <= (r0 + r0 + slope * (t1 - t0)) / 2 * (t1 - t0)
        due = F.when(inside, F.coalesce(F.lit(t0) + dt, F.lit(t0))).otherwise(due)
    return due


def _position(begin: Column, target: Column, turn: Column, schedules) -> Column:
    """Training time at which a copy that begins after ``begin`` words of its source is due."""
    share = F.when(target > 0, begin / target).otherwise(0.0)
    due = _due(share, schedules[-1])
    for k in range(len(schedules) - 1):
        due = F.when(turn % len(schedules) == k, _due(share, schedules[k])).otherwise(due)
    return due


class _Placed:
    """Every row of ``docs`` with its place in its source, under column names that no input column has."""

    def __init__(self, docs: DataFrame, key: str, text: str, source: str, size: str | None, weights, most):
        self.columns = docs.columns
        made = ("size", "src", "digest", "bucket", "tie", "inside", "s", "b", "ahead", "source_size", "target", "turn", "take")
        n = {c: spare(c, docs) for c in made}
        self.name = n
        words = word_count(F.col(text)) if size is None else F.col(size).cast("long")
        bits = max(0, min(40, (docs.count() // BUCKET).bit_length()))
        digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null")))
        bucket = F.shiftright(F.conv(F.substring(digest, 1, 10), 16, 10).cast("long"), 40 - bits)
        sized = docs.select(
            "*", words.alias(n["size"]), F.col(source).alias(n["src"]), digest.alias(n["digest"]), bucket.alias(n["bucket"]),
            (F.xxhash64(text) if size is None else words).alias(n["tie"]),
        )
        light = docs.select(F.col(source).alias("src"), bucket.alias("bucket"), words.alias("size")).groupBy("src", "bucket").agg(F.sum("size").alias("size"))
        light = saved(light, "buckets")
        goal = targets(light, weights, most).withColumnRenamed("src", "s")
        ahead = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = (
            light.withColumn("ahead", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
            .join(goal, F.col("src").eqNullSafe(F.col("s")))
            .select(F.col("src").alias(n["s"]), F.col("bucket").alias(n["b"]), *[F.col(c).alias(n[c]) for c in ("ahead", "source_size", "target", "turn")])
        )
        row = Window.partitionBy(n["src"], n["bucket"]).orderBy(n["digest"], n["tie"], n["size"])
        self.rows = (
            sized.withColumn(n["inside"], F.sum(n["size"]).over(row.rowsBetween(Window.unboundedPreceding, 0)) - F.col(n["size"]))
            .join(offsets, F.col(n["src"]).eqNullSafe(F.col(n["s"])) & (F.col(n["bucket"]) == F.col(n["b"])), "left")
        )
        self.size, self.source_size, self.target, self.turn = (F.col(n[c]) for c in ("size", "source_size", "target", "turn"))
        #: Words of its source before the row in one pass; whole passes; the row's words in the pass after those.
        self.start = F.col(n["ahead"]) + F.col(n["inside"])
        self.whole = F.when(self.source_size > 0, F.floor(F.floor(self.target) / self.source_size)).otherwise(0).cast("long")
        rest = F.floor(self.target).cast("long") - self.whole * self.source_size
        self.last = F.greatest(F.lit(0), F.least(self.size, rest - self.start)).cast("long")

    def others(self, added) -> list[str]:
        names = {c.lower() for c in added}
        return [c for c in self.columns if c.lower() not in names]


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", size: str | None = None, weights=WEIGHTS, most=MOST, schedules=SCHEDULES, range_sorted: bool = True) -> DataFrame:
    """Every row with ``size``, ``source_size``, ``target``, ``taken`` (words), ``copies`` (whole takes), ``part``
    (words of a last, partial take) and ``position`` (of its first take: 0..1 of the training run). ``size`` names a column with the words of
    every row, where they are known already; ``text`` is not read then."""
    p = _Placed(docs, key, text, source, size, weights, most)
    out = p.rows.select(
        *p.others(("size", "source_size", "target", "taken", "copies", "part", "position")),
        p.size.alias("size"), p.source_size.alias("source_size"), p.target.alias("target"),
        (p.whole * p.size + p.last).alias("taken"),
        (p.whole + F.when((p.last == p.size) & (p.size > 0), 1).otherwise(0)).alias("copies"),
        F.when(p.last < p.size, p.last).otherwise(F.lit(0)).cast("long").alias("part"),
        F.when(p.target > p.start, _position(p.start, p.target, p.turn, schedules)).alias("position"),
    )
    return out.orderBy(F.col("position").asc_nulls_last(), key) if range_sorted else out


def takes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, most=MOST, schedules=SCHEDULES, least: float = 0.0, described: bool = True) -> DataFrame:
    """One row per take, range-sorted by its own ``position``, with ``size``, ``source_size``, ``target``, ``take`` (from 0) and
    ``words`` (``size``, or less where the target is reached inside the document). Partial takes below ``least`` of the size are left out.
    Without ``described`` only the columns of ``docs``, in that order."""
    p = _Placed(docs, key, text, source, None, weights, most)
    n = p.whole + ((p.last > 0) & (p.last >= least * p.size)).cast("long")
    take = F.col(p.name["take"])
    position = _position(p.start + take * p.source_size, p.target, p.turn, schedules)
    exploded = p.rows.withColumn(p.name["take"], F.explode(F.when((p.size > 0) & (n > 0), F.sequence(F.lit(0).cast("long"), n - 1))))
    if not described:
        return exploded.orderBy(position, key, take).select(*docs.columns)
    words = F.when(take < p.whole, p.size).otherwise(p.last)
    return exploded.select(
        *p.others(("size", "source_size", "target", "take", "words", "position")),
        p.size.alias("size"), p.source_size.alias("source_size"), p.target.alias("target"), take.alias("take"), words.alias("words"), position.alias("position"),
    ).orderBy("position", key, "take")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    # The text is counted where it is read, once, and does not travel, since no column of the result needs it.
    docs = table(spark, sf_dir, "documents")
    sized = saved(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sized")
    return mix(sized, size="size").select("doc_id", "size", "source_size", "target", "taken", "copies", "part", F.round("position", 9).alias("position"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS digest FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn,
    [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM sized GROUP BY source),
caps AS (SELECT *, CAST(source_size * 3 AS DOUBLE) AS cap FROM sources),
levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lv,
    row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS nth
  FROM caps WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT min(nth) AS nth FROM levels WHERE lv * w <= cap),
goals AS (
  SELECT l.source, l.source_size, l.turn, CASE WHEN l.nth < c.nth THEN l.cap ELSE f.lv * l.w END AS target
  FROM levels l CROSS JOIN cut c JOIN levels f ON f.nth = c.nth),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, g.turn,
    CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.digest) AS BIGINT) - s.size AS start
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
whole AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(floor(target) / source_size) AS BIGINT) ELSE 0 END AS k,
    CASE WHEN target > 0 THEN start / target ELSE 0 END AS share, [1.5, 1.0, 0.5][turn + 1]::DOUBLE AS r, [-1.0, 0.0, 1.0][turn + 1]::DOUBLE AS slope FROM placed),
lasts AS (SELECT *, CAST(greatest(0, least(size, CAST(floor(target) AS BIGINT) - k * source_size - start)) AS BIGINT) AS last FROM whole)
SELECT doc_id, size, source_size, target, CAST(k * size + last AS BIGINT) AS taken,
  CAST(k + CASE WHEN last = size AND size > 0 THEN 1 ELSE 0 END AS BIGINT) AS copies, CASE WHEN last < size THEN last ELSE 0 END AS part,
  CASE WHEN target > start THEN round(CASE WHEN share <= 1 THEN 2 * share / (sqrt(greatest(r * r + 2 * slope * share, 0)) + r) ELSE 1 END, 9) END AS position
FROM lasts
"""
