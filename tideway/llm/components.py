"""Connected components by alternating large and small stars, all as joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideway.llm.common import dropped, written


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a, b) with a > b.  A hub's neighbours are never gathered: its minimum is a partial
    aggregate and meets the edges again in a join, whose skew the planner splits."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if large:
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        hooked = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        hooked = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return hooked.filter("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): component is the smallest node reachable.

    Null ends are left out, loops and repeated edges do no harm; no edges give no rows.  Each round is written to the
    shared folder, so lineage stays short and a lost executor costs one round.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        facts = now.agg(F.count("*"), F.sum("b"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if facts == state or not facts[0]:
            break
        state, before = facts, now
        now = written(star(star(now, large=True), large=False), "edges")
        dropped(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())
