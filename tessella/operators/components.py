"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.sources.tables import cut, forget

def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges`` (``a``, ``b``), component = smallest node.

    Alternates large-star and small-star steps: every edge of a node is moved to the smallest
    node it has seen, until nothing changes (a logarithmic number of rounds in practice).
    Each step is a grouped minimum and a join, so no group is gathered anywhere and a hot
    node is a skewed join that Spark can split.  Rounds are cut by checkpoints; one that
    nothing reads any more is deleted.
    """
    now = cut(edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        # large star: the larger neighbours of a node are tied to its smallest neighbour
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        big = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: the smaller neighbours of a node, and itself, to the smallest
        least = big.groupBy("a").agg(F.min("b").alias("m"))
        small = big.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, now = now, cut(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        forget(last)
        before, state = state, _state(now)
        if before == state:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _state(edges: DataFrame) -> tuple:
    """Number of edges and an order-free digest of them."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(h), F.lit(0)), F.coalesce(F.sum(F.shiftright(h, 24)), F.lit(0))).first())
