"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a pre-aggregated minimum per node and a join, so a node with very many edges never forms a group in
one task; the edges of each round are written in the shared folder. No edges or components pass the driver.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("at")).agg(F.min("b").alias("least")).select("at", F.least("at", "least").alias("least"))
    moved = both.where(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("at"))
    return moved.select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy(F.col("a").alias("at")).agg(F.min("b").alias("least"))
    moved = edges.join(least, F.col("a") == F.col("at")).select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b")
    return moved.union(least.select("at", "least")).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free digest of the edges; equal marks of two rounds mean that nothing moved."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) for each node of edges(a, b), both bigint; isolated nodes have no edge and no row."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        now = written(_small_star(_large_star(now)), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())
