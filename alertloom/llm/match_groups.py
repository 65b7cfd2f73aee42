"""Pairwise matches consolidated into groups (problem 2).

Low-diameter decomposition: every vertex draws an exponential shift; clusters
grow from the vertices whose start times come first and take in what they reach
before any other does. Clusters are contracted to super-vertices, the edges
between clusters are decomposed again, and the assignments of all levels are
composed. A level's clusters have a bounded radius, so long chains take a
number of levels that grows with the logarithm of their length only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialise

#: Rate of the exponential shifts: the share of edges that a level cuts, about.
BETA = 0.05
#: Steps that the clusters of one level grow, so many at a time.
STEPS, AT_ONCE = 6, 3
MOST_LEVELS = 100


def _shift(v: Column, level: int) -> Column:
    """An exponential number that depends on the vertex and the level only: a task that is run again draws it again."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(level), v), 11) + F.lit(1)) / F.lit(float(1 << 53) + 1)
    return -F.log(u) / F.lit(BETA)


def _grow(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """One step: every vertex joins the neighbouring cluster that reaches it first, if that is before its own start."""
    near = labels.select(F.col("v").alias("u"), (F.col("time") + 1).alias("time"), "center")
    reached = edges.join(near, "u").select(F.col("v").alias("w"), "time", "center")
    both = reached.unionByName(labels.select(F.col("v").alias("w"), "time", "center"))
    # numbers only, so that both sides of the shuffle aggregate by hash; times of two clusters never meet but for a chance of 2^-53
    return both.groupBy(F.col("w").alias("v")).agg(F.min("time").alias("time"), F.min_by("center", "time").alias("center"))


def decompose(edges: DataFrame, level: int) -> DataFrame:
    """(v, center) for symmetric distinct edges (u, v) without loops: one low-diameter decomposition."""
    labels = edges.select("v").distinct().select("v", (-_shift(F.col("v"), level)).alias("time"), F.col("v").alias("center"))
    for _ in range(0, STEPS, AT_ONCE):
        old = labels
        for _ in range(AT_ONCE):
            labels = _grow(labels, edges)
        labels = materialise(labels)
        discard(old)
    return labels.select("v", "center")


def group_ids(edges: DataFrame) -> DataFrame:
    """(node, root): every node of the pairs (a, b), with one node that stands for all it is connected to.

    Nodes are best numbers: these are cheap to compare and to aggregate.
    Pairs may stand repeatedly and in both directions; nulls are left out, a
    loop gives a group of one. A hub with a third of all pairs is no hot spot:
    minima are combined before the shuffle, and adaptive execution splits the
    hub's side of a join. No pairs give no rows.
    """
    pairs = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    live = materialise(pairs.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.where("a <> b").select("b", "a")).distinct())
    levels = []
    for level in range(MOST_LEVELS):
        if live.isEmpty():
            break
        centers = decompose(live, level)
        levels.append(centers)
        cu, cv = centers.select(F.col("v").alias("x"), F.col("center").alias("cu")), centers.select(F.col("v").alias("y"), F.col("center").alias("cv"))
        between = live.join(cu, live.u == cu.x).join(cv, live.v == cv.y)
        old, live = live, materialise(between.where("cu <> cv").select(F.col("cu").alias("u"), F.col("cv").alias("v")).distinct())
        discard(old)
    else:
        raise RuntimeError(f"the graph did not contract in {MOST_LEVELS} levels")
    # compose from the last level back, so that each join is with that level's vertices only
    whole: DataFrame | None = None
    for centers in reversed(levels):
        if whole is None:
            whole = centers
        else:
            up = whole.select(F.col("v").alias("c"), F.col("center").alias("top"))
            whole = materialise(centers.join(up, centers.center == up.c, "left").select("v", F.coalesce("top", "center").alias("center")))
    if whole is None:
        return nodes.select("node", F.col("node").alias("root"))
    return nodes.join(whole, nodes.node == whole.v, "left").select("node", F.coalesce("center", "node").alias("root"))


def _print(c: str) -> Column:
    """Sixteen bytes for a spelling, however long it is."""
    return F.unhex(F.md5(F.col(c).cast("binary")))


def linked_pairs(log: DataFrame) -> DataFrame:
    """(a, b): the pairs of spellings that are matches by their latest automatic merge or decision.

    Of events at the same time the one logged last counts. The two spellings
    come from any event of the pair that has both; a pair without any is left
    out, as are events without a pair.
    """
    own = log.where("pair_id IS NOT NULL")
    says = F.col("kind").isin("auto_merge", "review_decision")
    latest = own.groupBy("pair_id").agg(
        F.max(F.when(says, F.struct("ts", "log_seq", ((F.col("kind") == "auto_merge") | F.coalesce(F.col("decision") == "approve", F.lit(False))).alias("links")))).alias("last"),
        F.max(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.struct("a", "b"))).alias("names"),
    )
    return latest.where("last.links AND names IS NOT NULL").select("names.a", "names.b")


def company_graph(companies: DataFrame, log: DataFrame) -> DataFrame:
    """(a, b): the links between companies, by their ids, and spellings that are nobody's alias, by numbers beyond these.

    A spelling that is an alias stands for the smallest company that has it, and
    every other company with it is linked to that one; so spellings are read
    once, and only those that pass links on are nodes of their own.
    """
    aliases = companies.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.explode("known_aliases").alias("alias")).where("alias IS NOT NULL").select("id", _print("alias").alias("p"))
    homes = materialise(aliases.groupBy("p").agg(F.min("id").alias("home")))
    shared = aliases.join(homes, "p").where("id <> home").select(F.col("id").alias("a"), F.col("home").alias("b"))
    pairs = linked_pairs(log).where("a <> b").select(_print("a").alias("pa"), _print("b").alias("pb"))
    side = lambda x: homes.select(F.col("p").alias("p" + x), F.col("home").alias(x))
    housed = materialise(pairs.join(side("a"), "pa", "left").join(side("b"), "pb", "left"))
    # the other spellings get numbers that no company has
    ends = companies.agg(F.max("id").alias("most"), F.min("id").alias("least")).first()
    room = 1 << 62
    first = (ends["most"] or 0) + 1 if (ends["most"] or 0) < room else ends["least"] - room
    others = housed.where("a IS NULL").select(F.col("pa").alias("p")).union(housed.where("b IS NULL").select("pb")).distinct()
    others = materialise(others.select("p", (F.monotonically_increasing_id() + F.lit(first)).alias("n")))
    number = lambda x: others.select(F.col("p").alias("p" + x), F.col("n").alias("n" + x))
    linked = housed.join(number("a"), "pa", "left").join(number("b"), "pb", "left").select(F.coalesce("a", "na").alias("a"), F.coalesce("b", "nb").alias("b"))
    return shared.unionByName(linked).where("a <> b")


def company_groups(companies: DataFrame, log: DataFrame) -> DataFrame:
    """(id, group_id): companies that share their group with at least one other; ``group_id`` is its smallest id.

    Companies without aliases, or with none but their own, are in no group.
    """
    roots = group_ids(company_graph(companies, log))
    rows = materialise(companies.select(F.col("id").cast("long").alias("id")).distinct().join(roots, F.col("id") == F.col("node")).select("id", "root"))
    groups = rows.groupBy("root").agg(F.min("id").alias("group_id"), F.count("*").alias("n")).where("n > 1").select("root", "group_id")
    return rows.join(groups, "root").select("id", "group_id")
