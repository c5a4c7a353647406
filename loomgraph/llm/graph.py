"""Connected components over DataFrames of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "u_")
    return both.where("v > u").join(least, F.col("u") == F.col("u_")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least.withColumnRenamed("u", "u_"), F.col("u") == F.col("u_")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each ``u`` points at one ``v`` (always smaller) that points nowhere: then no step moves anything."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("points")), F.struct(F.col("v").alias("x"), F.lit(0).alias("points")))).alias("e")).select("e.*")
    per = ends.groupBy("x").agg(F.sum("points").alias("out"), F.min("points").alias("least"))
    return per.where("out > 1 or (out = 1 and least = 0)").isEmpty()


def components(links: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; the root is the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until stars are
    left; each round is written to the shared folder and the one before is deleted.
    Hubs are never gathered: minima are pre-aggregated and joined back, and Spark
    splits the joins of skewed keys.
    """
    edges = scratch.keep(links.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")), "edges")
    for _ in range(rounds):
        after = scratch.keep(_small_star(_large_star(edges)), "edges")
        scratch.drop(edges)
        edges = after
        if _are_stars(edges):
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v"), F.col("v")).distinct())
