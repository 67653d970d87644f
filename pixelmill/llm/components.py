"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is an aggregate and an equi-join that Spark can split when a vertex is hot; nothing is collected, and each
round's edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.shared import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` are (u, v). Links the larger (large star) or the smaller (small star) neighbours to the least one."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    if large:
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").groupBy("u", "v").agg(F.lit(1).alias("one")).select("u", "v")


def _settled(edges: DataFrame) -> bool:
    """Whether every vertex is either a centre or linked with one centre only."""
    ends = edges.select(F.col("u").alias("x"), "v").unionByName(edges.select(F.col("v").alias("x"), F.lit(None).cast("long").alias("v")))
    return ends.groupBy("x").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("down"), F.count("*").alias("ends")).where("low <> high or (down > 0 and down < ends)").isEmpty()


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(id, component) for every vertex of the edges (a, b); component is the least id reachable.

    Ids that have no edge are not in the result; edges with a null end and loops are ignored.
    """
    pairs = edges.where("a is not null and b is not null and a <> b")
    now = scratch.write(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}0")
    k = 0
    while not _settled(now):
        k += 1
        now = scratch.write(_star(_star(now, True), False), f"{name}{k}")
        scratch.drop(f"{name}{k - 1}")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
