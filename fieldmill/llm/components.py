"""Connected components of a table of links, without gathering links or nodes on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """id and component (its smallest member) of every end of links (a long, b long).

    In each round a node points to its smallest neighbour if that is smaller than itself; pointers
    are doubled until each leads to the end of its chain, the links are relabelled by these ends, and
    those inside a node are dropped, until none is left. Of two linked nodes at most one ends a chain,
    so rounds grow with the logarithm of the number of nodes, and doublings with that of the longest
    chain. Minima are taken before the shuffle, so a hub costs a row per task. Null ends, loops and
    repeated links change nothing; no links give no rows.
    """
    e = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    labels = cut(e.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component", F.col("id")))
    while not e.isEmpty():
        near = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("b"))
        ends = _ends(cut(near.select(F.col("a").alias("n"), F.least("a", "b").alias("p"))))
        labels = cut(labels.join(ends, F.col("component") == F.col("n"), "left").select("id", F.coalesce("p", "component").alias("component")))
        moved = e.join(ends.select(F.col("n").alias("a"), F.col("p").alias("pa")), "a").join(ends.select(F.col("n").alias("b"), F.col("p").alias("pb")), "b")
        e = cut(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).filter("a < b").distinct())
    return labels


def _ends(up: DataFrame) -> DataFrame:
    """n and the end p of its chain of pointers (n, p); p of an end is itself. A pointer to an end
    needs no further step, so only what isn't there yet is joined again."""
    while True:
        ends = up.filter("n = p").select(F.col("n").alias("q"), F.lit(True).alias("last"))
        told = cut(up.join(ends, F.col("p") == F.col("q"), "left").select("n", "p", F.coalesce("last", F.lit(False)).alias("last")))
        if told.filter("not last").isEmpty():
            return told.select("n", "p")
        up = cut(told.alias("x").join(told.alias("y"), F.col("x.p") == F.col("y.n")).select(F.col("x.n").alias("n"), F.col("y.p").alias("p")))
