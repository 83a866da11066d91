"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hibiki.session import write_out


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge; the root is the component's smallest node.

    ``edges``: columns a, b. Large-star and small-star steps alternate until nothing changes,
    about log(n) rounds. Each round is a written table; neighbourhoods are only ever reduced to
    their minimum before the shuffle, and joins with a hub are split by adaptive skew joins.
    """
    spark = edges.sparkSession
    now = write_out(edges.filter("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.selectExpr("b AS a", "a AS b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) m")
        large = (
            both.join(least, "a").filter("b > a").selectExpr("b AS a", "m AS b").distinct()
        )
        large = write_out(large, "edges")
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(smallest, "a").filter("b <> m").selectExpr("b AS a", "m AS b")
            .unionByName(smallest.selectExpr("a", "m AS b")).distinct()
        )
        now = write_out(small, "edges")
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.selectExpr("a AS node", "b AS root")
    return roots.unionByName(now.selectExpr("b AS node", "b AS root").distinct())


def _state(edges: DataFrame) -> tuple:
    """Number of edges and an order-free digest of them."""
    return tuple(edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    ).first())
