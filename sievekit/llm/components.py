"""Connected components of an edge table, on Spark (large-star / small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.llm._common import stash


def _star_large(e: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the least node it knows (no more rows than edges;
    the small star drops repeats)."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.where(F.col("b") > F.col("a")).join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b"))


def _star_small(e: DataFrame) -> DataFrame:
    """Each node hands itself and its smaller neighbours to the least of them."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, tag: str = "cc", rounds: int = 60) -> DataFrame:
    """``node, root``: every node of ``edges`` (columns a, b of any ordered type) with the
    least node of its component.

    Each round is two joins over the edge table, written to the checkpoint
    folder; a node with many neighbours is aggregated per task before it meets,
    and the join that follows is one Spark splits.  Ends when no edge moves, some
    log(n) rounds; self loops are dropped; no edges give no rows."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    e = stash(e, tag)
    seen = None
    for _ in range(rounds):
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or mark[0] == 0:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = tuple(mark)
        e = stash(_star_small(_star_large(e)), tag)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
