"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import saved


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """`(node, root)` for every node of `edges(a, b)`; the root is the least node.

    Alternates large-star and small-star steps until nothing changes, which takes
    a logarithmic number of rounds also for long chains.  Each step takes the least
    neighbour by a partial aggregate and joins it back, so that a node with very
    many neighbours is split over tasks.  Every round is a written table; the
    driver sees two numbers a round.

    Self-edges only name their node.  An empty table gives an empty table.
    """
    edges = saved(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        name,
    )
    state = _state(edges)
    while True:
        large = _large_star(edges)
        small = saved(_small_star(large), name)
        after = _state(small)
        edges = small
        if after == state:
            break
        state = after
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.union(edges.select("v", "v")).distinct()


def _state(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(mixed.cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie every greater neighbour of a node to the least of its neighbourhood."""
    both = edges.union(edges.select("v", "u")).filter("u <> v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    alone = edges.filter("u = v")
    return joined.union(alone).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie a node and its lesser neighbours to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    near = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return near.union(own).distinct()
