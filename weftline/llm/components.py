"""Connected components of an edge table by alternating large-star and small-star steps.

Each round is a few aggregations and joins; the edges stay distributed, and
only the sums that tell whether a round changed anything come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b").where(F.col("a") != F.col("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return (
        joined.select(F.col("m").alias("a"), F.col("v").alias("b"))
        .union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        .where(F.col("a") != F.col("b")).distinct()
    )


def _state(edges: DataFrame):
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node that it reaches) for every node of an edge.

    Null ends are ignored, and so are loops. Stops when a round changes no edge:
    then every edge leads from a root to a node.
    """
    clean = edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    now = settle(clean.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before = _state(now)
    while before[0]:
        now = settle(_small_star(_large_star(now)))
        after = _state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select("a", "a")).distinct()
