"""Companies resolved from their spellings: blocking, scores, clusters, review, result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from ..functions.similarity import token_set, token_sort
from ..session import materialise
from .components import connected_components
from .dedupe import last_written
from .numbering import number_rows, number_within


def entities(records: DataFrame) -> DataFrame:
    """One row per distinct spelling that names a company: raw, name, norm, core, address, pins, state, records, first_month."""
    raws = records.where("manufacturer_raw IS NOT NULL").groupBy(F.col("manufacturer_raw").alias("raw")).agg(F.count("*").alias("records"), F.min("alert_month").alias("first_month"))
    clean = raws.withColumn("text", X.clean_text(F.col("raw"))).where(~X.no_company(F.col("text"))).withColumn("p", X.company_parts(F.col("text")))
    own = clean.withColumns({"name": F.col("p.name"), "norm": X.company_key(F.col("p.name")), "address": X.plain(F.col("p.address")), "pins": X.pins_of(F.col("raw")), "state": X.state(F.col("text"))["value"]})
    return own.withColumn("core", X.company_core(F.col("norm"))).select("raw", "name", "norm", "core", "address", "pins", "state", "records", "first_month")


def blocks(of: DataFrame, limit: int | None = V.LARGEST_BLOCK) -> DataFrame:
    """(kind, key, raw) of the blocks that are small enough to say anything; with no limit all of them."""
    keyed = of.select("raw", F.explode(X.blocking_keys(F.col("norm"), F.col("core"))).alias("k")).select("k.kind", "k.key", "raw").distinct()
    if limit is None:
        return keyed
    # counted by partial aggregates: a hot key is never gathered to find that it is too large
    small = keyed.groupBy("kind", "key").agg(F.count("*").alias("n")).where(F.col("n").between(2, limit)).select("kind", "key")
    return keyed.join(small, ["kind", "key"])


def skipped(of: DataFrame, limit: int = V.LARGEST_BLOCK) -> DataFrame:
    """F8: (kind, key, members, pairs) of the blocks that a limit leaves out."""
    sizes = blocks(of, None).groupBy("kind", "key").agg(F.count("*").alias("members"))
    return sizes.where(F.col("members") > limit).withColumn("pairs", F.expr("members * (members - 1) div 2"))


def candidate_pairs(keyed: DataFrame) -> DataFrame:
    """(a, b), a before b: spellings that share a block of any kind, each pair once."""
    a, b = keyed.withColumnRenamed("raw", "a"), keyed.withColumnRenamed("raw", "b")
    return a.join(b, ["kind", "key"]).where("a < b").select("a", "b").distinct()


def score(a: Column, b: Column, name_sim: Column, addr_sim: Column) -> Column:
    """struct(score, signals) of two entities' structs and the similarities of their names and addresses."""
    differ = a["state"] != b["state"]
    shared = F.array_intersect(a["pins"], b["pins"])
    pins = (F.size(a["pins"]) > 0) & (F.size(b["pins"]) > 0)
    unlike = addr_sim < V.UNLIKE_ADDRESS
    on = lambda condition, amount: F.when(condition, F.lit(amount)).otherwise(0.0)
    value = name_sim - on(differ, V.STATE_PENALTY) + on(pins & (F.size(shared) > 0), V.PIN_BONUS) - on(pins & (F.size(shared) == 0), V.PIN_PENALTY) - on(unlike, V.ADDRESS_PENALTY)
    signals = F.array_compact(F.array(
        F.when(differ, F.concat(F.lit("state_differs:"), a["state"], F.lit("|"), b["state"])),
        F.when(pins & (F.size(shared) > 0), F.concat(F.lit("pin_shared:"), F.array_join(shared, ","))),
        F.when(pins & (F.size(shared) == 0), F.concat(F.lit("pin_differs:"), F.array_join(a["pins"], ","), F.lit("|"), F.array_join(b["pins"], ","))),
        F.when(unlike, F.concat(F.lit("address_unlike:"), F.format_string("%.2f", addr_sim))),
    ))
    empty = (a["norm"] == "") | (b["norm"] == "")
    return F.struct(
        F.when(empty, F.lit(0.0)).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 4)).alias("score"),
        F.when(empty, F.lit(0.0)).otherwise(F.round(name_sim, 4)).alias("name_sim"),
        F.when(~empty, F.round(addr_sim, 4)).alias("addr_sim"),
        F.when(empty, F.array(F.lit("empty_name"))).otherwise(signals).alias("signals"),
    )


def scored_pairs(of: DataFrame, pairs: DataFrame, floor: float = V.SCORE_FLOOR) -> DataFrame:
    """(a, b, pair_id, score, name_sim, addr_sim, signals, tier) of the pairs that reach the floor."""
    side = lambda c: of.select(F.col("raw").alias(c), F.struct("norm", "address", "pins", "state").alias("e" + c))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    no_address = (F.col("ea.address") == "") | (F.col("eb.address") == "")
    # the name alone bounds the score: what cannot reach the floor needs no address ratio
    named = both.withColumn("n", token_sort("ea.norm", "eb.norm")).where(F.col("n") + V.PIN_BONUS >= floor)
    out = named.withColumn("s", score(F.col("ea"), F.col("eb"), F.col("n"), token_set(F.when(~no_address, F.col("ea.address")), F.when(~no_address, F.col("eb.address")))))
    return out.select("a", "b", X.pair_id(F.col("a"), F.col("b")).alias("pair_id"), "s.*", X.tier(F.col("s.score")).alias("tier")).where(F.col("score") >= floor)


def clusters(of: DataFrame, edges: DataFrame) -> DataFrame:
    """E5: (raw, cluster) of all entities; one without any edge is a cluster of its own."""
    own = of.select(F.col("raw").alias("a"), F.col("raw").alias("b"))
    found = connected_components(edges.select("a", "b").join(of.select(F.col("raw").alias("a")), "a", "left_semi").join(of.select(F.col("raw").alias("b")), "b", "left_semi").select("a", "b").unionByName(own))
    return found.select(F.col("node").alias("raw"), F.col("component").alias("cluster"))


def spanning_edges(scored: DataFrame, most_rounds: int = 60) -> DataFrame:
    """The edges (a, b) of the best forest, the highest score first, then by a and b.

    Each round every cluster takes its best outgoing edge; as the order of
    edges is total, the result is the one that taking them one by one gives.
    """
    rank = F.struct((-F.col("score")).alias("s"), F.col("a"), F.col("b"))
    live = materialise(scored.select("a", "b", F.col("a").alias("u"), F.col("b").alias("v"), rank.alias("r")))
    taken = None
    for _ in range(most_rounds):
        if live.isEmpty():
            break
        best = live.select("u", "r").union(live.select("v", "r")).groupBy("u").agg(F.min("r").alias("r")).select("r").distinct()
        picked = materialise(live.join(best, "r", "left_semi"))
        taken = picked.select("a", "b") if taken is None else taken.union(picked.select("a", "b"))
        comp = connected_components(picked.select(F.col("u").alias("a"), F.col("v").alias("b")))
        moved = live.join(comp.select(F.col("node").alias("u"), F.col("component").alias("cu")), "u", "left").join(comp.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v", "left")
        live = materialise(moved.select("a", "b", F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"), "r").where("u <> v"))
    return scored.select("a", "b").limit(0) if taken is None else taken.distinct()


def review_queue(of: DataFrame, scored: DataFrame, grouped: DataFrame) -> DataFrame:
    """One row per pair of clusters that the review band links: its best pair, how many support it, both sides' records."""
    root = lambda c: grouped.select(F.col("raw").alias(c), F.col("cluster").alias("r" + c))
    open_ = scored.where("tier = 'review'").join(root("a"), "a").join(root("b"), "b").where("ra <> rb")
    best = F.min(F.struct((-F.col("score")).alias("s"), "a", "b", "pair_id", "score", "name_sim", "addr_sim", "signals")).alias("x")
    pairs = open_.groupBy(F.least("ra", "rb").alias("cluster_a"), F.greatest("ra", "rb").alias("cluster_b")).agg(best, F.count("*").alias("supporting_pairs"))
    sums = grouped.join(of.select("raw", "records"), "raw").groupBy("cluster").agg(F.sum("records").alias("n"))
    size = lambda c: sums.select(F.col("cluster").alias("cluster_" + c), F.col("n").alias("records_" + c))
    out = pairs.join(size("a"), "cluster_a").join(size("b"), "cluster_b")
    return out.select("x.pair_id", "x.score", "x.name_sim", "x.addr_sim", "x.signals", "x.a", "x.b", "cluster_a", "cluster_b", "records_a", "records_b", "supporting_pairs")


def decisions(log: DataFrame) -> DataFrame:
    """The latest decision of each pair, by its place in the log."""
    own = log.where("kind = 'review_decision' AND pair_id IS NOT NULL").select("pair_id", "log_seq", "decision", "reviewer")
    return last_written(own, ["pair_id"], ["log_seq"])


def pending(queue: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of the queue without any decision."""
    return queue.join(decided, "pair_id", "left_anti")


def new_log_entries(spanning: DataFrame, log: DataFrame) -> DataFrame:
    """Automatic merges not yet logged with the same score."""
    return spanning.join(log.where("kind = 'auto_merge'").select("pair_id", "score").distinct(), ["pair_id", "score"], "left_anti")


def triage(queue: DataFrame) -> DataFrame:
    """(pair_id, score, bucket, place): reading order of a queue, by what kind of difference a pair has."""
    name = lambda c: X.company_key(X.company_parts(X.clean_text(F.col(c)))["name"])
    own = queue.withColumns({"na": name("a"), "nb": name("b")})
    same = (F.col("na") == F.col("nb")) & F.exists("signals", lambda s: F.startswith(s, F.lit("state_differs:")))
    bucket = F.when(same, "multi_plant").when(F.levenshtein("na", "nb", 2) >= 0, "near_typo").otherwise("other")
    placed = number_within(own.withColumn("bucket", bucket).select("pair_id", "score", "bucket", (-F.col("score")).alias("_low")), ["bucket"], ["_low", "pair_id"], "place")
    return placed.select("pair_id", "score", "bucket", F.col("place").cast("int").alias("place"))


def companies(of: DataFrame, grouped: DataFrame) -> DataFrame:
    """(cluster, canonical_name, known_aliases, address_raw, state, first_seen_month, total_flags) of each cluster.

    The name most records have is the company's; among equals one that isn't
    all capitals, then the longest, then the first. State and address are those
    of most spellings and of the spelling with the most records.
    """
    all_ = materialise(grouped.join(of, "raw"))
    shout = (F.col("name") == F.upper("name")) & (F.col("name") != F.lower("name"))
    names = all_.where("name <> ''").groupBy("cluster", "name").agg(F.sum("records").alias("n"))
    named = names.groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("n"), shout.alias("s"), (-F.length("name")).alias("l"), "name")).alias("x")).select("cluster", F.col("x.name").alias("canonical_name"))
    states = all_.where("state IS NOT NULL").groupBy("cluster", "state").agg(F.count("*").alias("n"), F.min("raw").alias("first"))
    stated = states.groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "state")).alias("x")).select("cluster", F.col("x.state").alias("state"))
    rest = all_.groupBy("cluster").agg(
        F.array_sort(F.collect_set("raw")).alias("known_aliases"),
        F.min(F.struct((-F.col("records")).alias("n"), (-F.length("raw")).alias("l"), "raw")).alias("x"),
        F.min("first_month").alias("first_seen_month"),
        F.sum("records").alias("total_flags"),
    )
    out = rest.join(named, "cluster", "left").join(stated, "cluster", "left")
    return out.select("cluster", F.coalesce("canonical_name", F.substring(F.col("known_aliases")[0], 1, 120)).alias("canonical_name"), "known_aliases", F.col("x.raw").alias("address_raw"), "state", "first_seen_month", "total_flags")


def numbered(of: DataFrame) -> DataFrame:
    """Ids 1 to N in order of name and address."""
    keyed = of.withColumn("_name", F.lower("canonical_name"))
    return number_rows(keyed, ["_name", "address_raw", "cluster"], "id").drop("_name")


def backfill(records: DataFrame, of: DataFrame) -> DataFrame:
    """Each record with the id of the company that has its spelling; placeholders keep none."""
    ids = of.select(F.col("id").alias("manufacturer_id"), F.explode("known_aliases").alias("manufacturer_raw"))
    return records.drop("manufacturer_id").join(ids, "manufacturer_raw", "left")


def apply_decisions(of: DataFrame, scored: DataFrame, queue: DataFrame, log: DataFrame) -> DataFrame:
    """The final clusters: automatic edges and approved pairs; what is undecided or rejected isn't merged."""
    approved = queue.join(decisions(log).where("decision = 'approve'"), "pair_id", "left_semi").select("a", "b")
    return clusters(of, scored.where("tier = 'auto'").select("a", "b").unionByName(approved))


def cohesion(of: DataFrame, grouped: DataFrame, worst: int = 15) -> DataFrame:
    """The clusters of several whose members are least alike: (cluster, weakest, size).

    A member's likeness to all others is bounded by comparing distinct
    normalised names only, of which a cluster has few.
    """
    names = grouped.join(of.select("raw", "norm"), "raw")
    sizes = names.groupBy("cluster").agg(F.count("*").alias("size")).where("size > 1")
    distinct = names.join(sizes, "cluster").select("cluster", "norm").distinct()
    a, b = distinct.withColumnRenamed("norm", "x"), distinct.withColumnRenamed("norm", "y")
    pairs = a.join(b, "cluster").where("x < y").withColumn("s", token_sort("x", "y"))
    low = pairs.groupBy("cluster").agg(F.min("s").alias("w"))
    out = sizes.join(low, "cluster", "left").select("cluster", F.round(F.coalesce("w", F.lit(1.0)), 3).alias("weakest"), "size")
    return out.orderBy("weakest", "cluster").limit(worst)
