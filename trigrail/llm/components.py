"""Connected components by alternating large-star and small-star rounds, each a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigrail.llm import store


def _pulled(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (large: the greater ones) move to the least of it and its neighbours (small: of the lesser ones)."""
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    if large:
        near = edges.union(back)
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return near.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least.hint("merge"), "a")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of edges (a, b longs): the smallest id of its component.

    Loops and repeated edges do no harm; nulls are left out. The rounds grow as the logarithm of the
    longest path; every round's edges are at most those of the last. A hub's edges meet its one row of
    least neighbours in a merge join, which adaptive execution can split and never broadcasts.
    """
    now = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    now = store.written(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last or not state[0]:
            break
        last = state
        stars = _pulled(_pulled(now, True).where("a <> b").distinct(), False).where("a <> b").distinct()
        new = store.written(stars, "edges")
        store.drop(now)
        now = new
    ids = now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component")
    return ids.unionByName(ids.select(F.col("component").alias("id"), "component").distinct())
