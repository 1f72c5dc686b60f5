"""Connected components of a link table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, saved


def components(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """``edges`` has columns a and b of one orderable type; returns ``node`` and ``root``, the least node reachable.
    ``parts`` is the number of files that the tables of a round need at most; the links themselves are computed as they come.

    Every round is written to the shared folder, so a lost executor costs one round at most, and the
    driver sees only whether labels changed; earlier rounds are removed. Rounds grow with the diameter of the links.

    Null ends link nothing; repeated links and links of a node with itself add nothing; no links give no rows.
    """
    def kept(df: DataFrame, name: str) -> DataFrame:
        return saved(df if parts is None else df.coalesce(parts), name)

    # Written before both directions are read: a second computation may give other links for the same sets.
    edges = saved(edges.select("a", "b"), "edges")
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = kept(both.where("a != b").distinct(), "links")
    forget(edges)
    last = labels = kept(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")), "labels")
    while True:
        heard = (
            links.join(labels.select(F.col("node").alias("b"), "root"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        )
        moved = labels.join(heard, "node").select("node", F.col("root").alias("was"), F.least("root", "low").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        step = kept(
            moved.join(jump, "root", "left").select("node", "was", F.least("root", F.coalesce("next", "root")).alias("root")), "labels"
        )
        labels = step.select("node", "root")
        forget(last)  # the next round reads this one only
        last = step
        if step.where("root != was").isEmpty():
            forget(links)
            return labels
