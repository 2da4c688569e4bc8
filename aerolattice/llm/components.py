"""Connected components of a table of links, by alternating stars over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _least(links: DataFrame) -> DataFrame:
    """``links`` (u, v) with the least of u and all its v as m; the minimum is summed up before the shuffle."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return links.join(least, "u")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = _least(links)
    to_least = down.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return to_least.unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """The least member reachable from each end of ``links`` (u, v): rows (u, v) with v < u.

    Members that are the least of their component, or that no link names, have no row. Null ends and
    links of a member to itself count for nothing; repeated links are one. Each round is written to the
    shared folder; rounds grow with the logarithm of the longest path.
    """
    ordered = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    state, seen = written(ordered, "links"), None
    while True:
        now = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == now or not now.n:
            return state
        state, seen = written(_small_star(_large_star(state)), "links"), now


def forest_roots(parents: DataFrame) -> DataFrame:
    """The root of each ``u`` of ``parents``, which has one row (u, v) with v < u for each u: rows (u, v), v the root.

    Each round looks up the parent's parent, so that a path takes the logarithm of its length in rounds.
    """
    state, seen = written(parents.select("u", "v"), "parents"), None
    while True:
        now = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == now or not now.n:
            return state
        up = state.select(F.col("u").alias("v"), F.col("v").alias("w"))
        state, seen = written(state.join(up, "v", "left").select("u", F.coalesce("w", "v").alias("v")), "parents"), now
