"""Connected components by alternating star contractions.

A large star links every larger neighbour of a node to the smallest node around
it, a small star does the same for the smaller ones; both keep components, and
in a number of steps that grows with the logarithm of the size each component
is a star around its smallest node. A hub's edges are aggregated before the
shuffle and joined by a join that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _is_stars(e: DataFrame) -> bool:
    """Whether every node has edges to one smaller node alone, which has none to a smaller
    one: then nothing is left to do."""
    inner = e.join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
    return inner.isEmpty() and e.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of links (u, v) that isn't
    the smallest of its own component; written to the shared folder."""
    now = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    mark = None
    while not _is_stars(now):
        then, now = now, written(_small_star(_large_star(now)), "links")
        last, mark = mark, _mark(now)
        forget(links.sparkSession, then)
        if last == mark:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
