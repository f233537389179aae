"""Connected components of a graph of integer ids, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from melder.llm.common import written

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id that an edge (a, b) names; component is the smallest id reachable.

    Alternates the large-star and small-star steps: each vertex's larger neighbours, then its
    smaller ones, are hung below the smallest neighbour. A vertex's neighbourhood is only
    joined with its minimum, never gathered; minima are written before they are joined, so that
    adaptive execution sees two plain shuffles and may split a hub. Rounds are
    written to the shared folder; their number grows with the logarithm of the longest path.

    Null ends and loops are left out; repeated edges count once; no edges give an empty table.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    now = written(now, "edges")
    for _ in range(MAX_ROUNDS):
        if _settled(now):
            break
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "minima")
        large = written(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        low = written(large.groupBy("a").agg(F.min("b").alias("m")), "minima")
        hung = F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        now = written(large.join(low, "a").select(hung.alias("e")).select("e.*").where("a <> b").distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = now.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(roots)


def _settled(edges: DataFrame) -> bool:
    """Whether every vertex hangs below one root and no root hangs below another."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionAll(edges.select(F.col("b").alias("id"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    each = ends.groupBy("id").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return each.agg(F.count(F.when((F.col("below") > 1) | ((F.col("below") == 1) & (F.col("above") == 1)), 1)).alias("n")).first()["n"] == 0
