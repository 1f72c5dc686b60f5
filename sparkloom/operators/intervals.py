"""Points in spans, where the keys that must be equal select little or there are none.

Time is cut into bins of one width. A span is checked in the bins where it begins and ends; the bins between are written as few squares of a binary
tree over all bins: at each level at most one to the left and one to the right. A point lies in one square of each level. So both meet in an equi-join by
square, a point and a span in at most one of them, and a span of a thousand bins is twenty rows and not a thousand. Squares that hold very many points
are salted: their points are dealt out, their spans go to every part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import saved

#: Points of a square in one part.
MOST = 100_000


def _squares(low: Column, high: Column, levels: int) -> Column:
    """array of (level, square): the bins low..high as squares that do not overlap."""
    parts = []
    for k in range(levels + 1):
        size = F.lit(1 << k).cast("long")
        a, b = F.ceil(low / size), F.floor((high + 1) / size) - 1
        one = lambda at, k=k: F.struct(F.lit(k).alias("level"), at.cast("long").alias("square"))
        parts += [F.when((a <= b) & (a % 2 != 0), one(a)), F.when((a <= b) & (b % 2 == 0), one(b))]
    # At the top all that is left is taken, odd or even.
    size = F.lit(1 << (levels + 1)).cast("long")
    a, b = F.ceil(low / size), F.floor((high + 1) / size) - 1
    top = F.when(a <= b, F.transform(F.sequence(a, b), lambda x: F.struct(F.lit(levels + 1).alias("level"), x.cast("long").alias("square")))).otherwise(F.array().cast("array<struct<level:int,square:bigint>>"))
    return F.concat(F.array_compact(F.array(*parts)), top)


def points_in_spans(points: DataFrame, spans: DataFrame, at: str, start: str, stop: str, keys: tuple[str, ...] = (), width: float = 86_400.0, levels: int = 16, most: int = MOST) -> DataFrame:
    """Every point with every span that holds at it: start <= at, and no stop or a later one; with equal ``keys`` if there are any. Moments are numbers
    (seconds) or timestamps; rows without a moment or a start meet nothing. Other column names must differ."""
    kinds = dict([*points.dtypes, *spans.dtypes])
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6 if kinds[c].startswith("timestamp") else F.col(c).cast("double")
    p = points.where(F.col(at).isNotNull()).withColumn("_bin", F.floor(seconds(at) / width).cast("long"))
    s = spans.where(F.col(start).isNotNull() & (F.col(stop).isNull() | (F.col(stop) > F.col(start)))).withColumn("_b0", F.floor(seconds(start) / width).cast("long")).withColumn("_b1", F.floor(seconds(stop) / width).cast("long"))
    last = p.agg(F.max("_bin")).first()[0]  # a span without an end goes as far as there are points
    if last is None:
        return points.limit(0).join(spans.drop(*keys), F.lit(True))
    open_end = F.coalesce("_b1", F.lit(last + 1))
    # Begin and end are looked at closely, at level -1; what lies between is inside.
    edges = F.array_distinct(F.array(*[F.struct(F.lit(-1).alias("level"), b.cast("long").alias("square")) for b in (F.col("_b0"), open_end)]))
    squared = s.withColumn("_q", F.explode(F.concat(edges, _squares(F.col("_b0") + 1, open_end - 1, levels)))).withColumns({"_level": F.col("_q.level"), "_square": F.col("_q.square")}).drop("_q", "_b0", "_b1")
    used = [r._level for r in squared.select("_level").distinct().collect()]  # of levels + 3 at most
    own = F.array(*[F.struct(F.lit(k).alias("level"), (F.col("_bin") if k < 1 else F.shiftright("_bin", k)).alias("square")) for k in used]) if used else F.array().cast("array<struct<level:int,square:bigint>>")
    placed = p.withColumn("_q", F.explode(own)).withColumns({"_level": F.col("_q.level"), "_square": F.col("_q.square")}).drop("_q", "_bin")
    on = [*keys, "_level", "_square"]
    sizes = saved(placed.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(*on, F.ceil(F.col("n") / most).cast("int").alias("_parts")), "squares")
    one = F.coalesce("_parts", F.lit(1))
    dealt = placed.join(sizes, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*points.columns), one)).drop("_parts")
    sent = squared.join(sizes, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("_parts")
    inside = (F.col("_level") >= 0) | ((F.col(start) <= F.col(at)) & (F.col(stop).isNull() | (F.col(stop) > F.col(at))))
    return dealt.join(sent, [*on, "_salt"]).where(inside).drop("_level", "_square", "_salt")


def totals_in_spans(points: DataFrame, spans: DataFrame, at: str, start: str, stop: str, by: list[str], totals: dict[str, tuple[Callable[[Column], Column], Column]]) -> DataFrame:
    """by, and for each of ``totals`` (name: function, column of the points) the total over all points in a span: start <= at, and no stop or a later one. The functions must
    merge their own results (sum, min, max; a sum of ones counts). Spans without points give no row.

    Pairs of points and spans are never rows: points are added up in the squares of a binary tree over microseconds, and a span reads at each level at most one square to the
    left and one to the right, so both sides grow by the depth of the tree, however long spans are and however many points they hold."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    p = points.where(F.col(at).isNotNull()).select(micros(at).alias("_at"), *[c.alias(name) for name, (_, c) in totals.items()])
    ends = p.agg(F.min("_at").alias("low"), F.max("_at").alias("high")).first()
    low, size = ends.low or 0, (ends.high or 0) - (ends.low or 0) + 1
    depth = size.bit_length()
    spark = points.sparkSession
    levels = F.broadcast(spark.range(depth + 1).select(F.col("id").cast("int").alias("_level")))
    squares = p.crossJoin(levels).groupBy("_level", F.expr(f"shiftright(_at - {low}L, _level)").alias("_square")).agg(*[f(F.col(name)).alias(name) for name, (f, _) in totals.items()])
    clip = lambda x: F.least(F.greatest(x - low, F.lit(0)), F.lit(size))
    s = spans.where(F.col(start).isNotNull()).select(*by, clip(micros(start)).alias("_a"), F.when(F.col(stop).isNull(), size).otherwise(clip(micros(stop))).alias("_b")).where("_a < _b")
    sides = F.broadcast(spark.range(2 * (depth + 1)).select(F.floor(F.col("id") / 2).cast("int").alias("_level"), (F.col("id") % 2 == 0).alias("_left")))
    # The first whole square at a level, and the one behind the last; an odd first and an even last one have no whole square above them.
    inner = s.crossJoin(sides).withColumns({"_from": F.expr("-shiftright(-_a, _level)"), "_to": F.expr("shiftright(_b, _level)")}).where("_from < _to and if(_left, _from, _to) % 2 = 1")
    asked = inner.select(*by, "_level", F.expr("if(_left, _from, _to - 1)").alias("_square"))
    return asked.join(squares, ["_level", "_square"]).groupBy(*by).agg(*[f(F.col(name)).alias(name) for name, (f, _) in totals.items()])
