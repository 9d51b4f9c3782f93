"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import materialize, release


def _big_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    pairs = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return pairs.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` of any ordered type to ``(node, component)``, component being the least node.

    Every round runs a large-star and a small-star step; both keep connectivity and shrink the edges to
    stars. Rounds end when the edge set stays as it is. Only counts reach the driver. Self loops, repeated
    edges and nulls are dropped; a node without an edge has no row; no edges give an empty table.
    """
    e = edges.select("u", "v").where("u is not null and v is not null and u <> v").distinct()
    e = materialize(_small_star(e), "cc")
    seen: tuple | None = None
    for _ in range(max_rounds):
        last, e = e, materialize(_small_star(_big_star(e)), "cc")
        release(last)
        # A star forest is reached when no centre is itself a leaf.
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
