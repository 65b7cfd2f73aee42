"""Connected components of an undirected graph given as pairs (E5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, joinable, materialise

MOST_ROUNDS = 200


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of a pair, with the smallest node it is connected to.

    Each round every node hooks on to the neighbour (or itself) that comes
    first in an order drawn anew for that round, and the graph is contracted;
    as the order is random a constant share of the nodes of any component goes
    away in a round, whatever its shape. A hub is no hot spot: minima are
    combined before the shuffle, and joins on it are split by adaptive
    execution, and nothing that grows with the graph is broadcast. Rows with a null end are left out, loops give single nodes;
    no edges give no rows.
    """
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    nodes = materialise(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().withColumn("root", F.col("node")))
    live = materialise(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    for k in range(MOST_ROUNDS):
        n_live = live.count()
        if not n_live:
            break
        rank = lambda c: F.struct(F.xxhash64(F.lit(k), c).alias("h"), c.alias("v"))  # noqa: B023, E731
        both = live.union(live.select("b", "a"))
        hooks = both.groupBy(F.col("a").alias("u")).agg(F.min(rank(F.col("b"))).alias("m")).select("u", F.least("m", rank(F.col("u")))["v"].alias("v"))
        # an edge has two ends, which hook on once each
        hooks = materialise(hooks.where("u <> v"))
        old = nodes, live, hooks
        hooks = joinable(hooks, 2 * n_live)
        nodes = materialise(nodes.join(hooks, nodes.root == hooks.u, "left").select("node", F.coalesce("v", "root").alias("root")))
        x = live.join(hooks, live.a == hooks.u, "left").select(F.coalesce("v", "a").alias("a"), "b")
        y = x.join(hooks, x.b == hooks.u, "left").select("a", F.coalesce("v", "b").alias("b"))
        live = materialise(y.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        discard(*old)
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    least = nodes.groupBy("root").agg(F.min("node").alias("component"))
    return nodes.join(joinable(least, nodes.count()), "root").select("node", "component")
