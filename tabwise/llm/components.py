"""Connected components of a link table by alternating large and small stars, one shuffle join each."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import checkpoint_cut


def _star(edges: DataFrame, near: DataFrame) -> DataFrame:
    """Every node's neighbours in ``near`` (u, v) pointed at the smallest of them or the node itself."""
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return near.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long): the root is the smallest node it reaches.

    Loops, repeated and reversed links do no harm; links with a null are ignored; no link gives no
    row.  The table of links never leaves the executors; each round is checkpointed, and rounds go on
    until the links no longer change.
    """
    e = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = checkpoint_cut(e)
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(e, both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        starred = _star(large, large)
        small = starred.select(F.col("v").alias("u"), F.col("m").alias("v")).union(starred.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        e = checkpoint_cut(small)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
