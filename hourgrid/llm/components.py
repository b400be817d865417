"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.functions.storage import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours link to its least neighbour (itself included)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
    return both.join(least, F.col("a") == F.col("n")).filter("b > a").select(F.col("m").alias("a"), F.col("b")).filter("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours link to the least of them."""
    least = edges.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("m"))
    down = edges.join(least, F.col("b") == F.col("n")).select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
    return down.filter("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a < b): root is the least node
    that it reaches. The number of rounds grows with the logarithm of the longest chain;
    each round is a table in the shared folder, only counts come to the driver.
    """
    state = materialise(edges.select("a", "b").filter("a < b").distinct())
    before = None
    while True:
        n, mark = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if n == 0 or (n, mark) == before:
            break
        before = (n, mark)
        state = materialise(_small_star(_large_star(state)))
    # All edges are stars now: (root, node).
    return state.select(F.col("b").alias("node"), F.col("a").alias("root")).union(state.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
