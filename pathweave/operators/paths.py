"""Multi-hop joins over the edge table, for whole batches of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Higher scores first; ties by owner and content of hop 1, then of hop 2.
CORE_ORDER = [("score", False), *((c, True) for c in ("owner_1", "mid", "left_evidence", "owner_2", "target", "right_evidence"))]


def order_by(spec) -> list[Column]:
    return [F.col(c).asc() if up else F.col(c).desc() for c, up in spec]


def hop(edges: DataFrame, n: int) -> DataFrame:
    """Edges renamed for the n-th hop."""
    return edges.select(*(F.col(c).alias(f"{c}_{n}") for c in ("owner", "source", "relation", "target", "evidence", "score")))


def two_hop(edges: DataFrame, queries: DataFrame) -> DataFrame:
    """Source -r1-> mid -r2-> target across owners; the score is the sum. Queries are (query_id, source, relation_1, relation_2)."""
    q = queries.select("query_id", F.col("source").alias("q_source"), F.col("relation_1").alias("q_1"), F.col("relation_2").alias("q_2"))
    first = hop(edges, 1).join(q, (F.col("source_1") == F.col("q_source")) & (F.col("relation_1") == F.col("q_1")))
    both = first.join(hop(edges, 2), (F.col("target_1") == F.col("source_2")) & (F.col("q_2") == F.col("relation_2")))
    return both.select("query_id", F.col("target_1").alias("mid"), F.col("target_2").alias("target"), F.col("evidence_1").alias("left_evidence"), F.col("evidence_2").alias("right_evidence"), "owner_1", "owner_2", (F.col("score_1").cast("long") + F.col("score_2")).alias("score"))


def chain_queries(edges: DataFrame, relation_1: str, relation_2: str) -> DataFrame:
    """One query for each source of the first relation."""
    return edges.where(F.col("relation") == relation_1).select(F.col("source").alias("query_id"), "source", F.lit(relation_1).alias("relation_1"), F.lit(relation_2).alias("relation_2")).distinct()


def fixed_chain(edges: DataFrame, relation_1: str, relation_2: str) -> DataFrame:
    """The batch of all chains over two given relations: both filters prune the edge table's branches, and no query table is joined."""
    a, b = hop(edges.where(F.col("relation") == relation_1), 1), hop(edges.where(F.col("relation") == relation_2), 2)
    both = a.join(b, F.col("target_1") == F.col("source_2"))
    return both.select(F.col("source_1").alias("query_id"), F.col("target_1").alias("mid"), F.col("target_2").alias("target"), F.col("evidence_1").alias("left_evidence"), F.col("evidence_2").alias("right_evidence"), "owner_1", "owner_2", (F.col("score_1").cast("long") + F.col("score_2")).alias("score"))


def ranked(paths: DataFrame, k: int | None, order=CORE_ORDER, by: str = "query_id") -> DataFrame:
    """Adds rank (1 first) within each query; at most k rows of each."""
    out = paths.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order_by(order))))
    return out.where(F.col("rank") <= k) if k is not None else out


def terminal_dedup(paths: DataFrame, order=CORE_ORDER) -> DataFrame:
    """The best path of each (query, terminal)."""
    return paths.withColumn("_r", F.row_number().over(W.partitionBy("query_id", "target").orderBy(*order_by(order)))).where("_r = 1").drop("_r")


def padded_topk(paths: DataFrame, queries: DataFrame, k: int, order=CORE_ORDER) -> DataFrame:
    """L1: exactly k rows for each query; rows without a path are all zero with valid = 0."""
    best = ranked(paths, k, order).select("query_id", "rank", "left_evidence", "right_evidence", "score")
    slots = queries.select("query_id").distinct().withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(k))))
    out = slots.join(best, ["query_id", "rank"], "left")
    return out.select("query_id", "rank", F.col("score").isNotNull().cast("int").alias("valid"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("left_evidence", "right_evidence", "score")))


def within_owner(edges: DataFrame, relation_1: str, relation_2: str) -> DataFrame:
    """Both edges held by one owner."""
    return fixed_chain(edges, relation_1, relation_2).where("owner_1 = owner_2")


def meet_in_middle(left: DataFrame, right: DataFrame) -> DataFrame:
    """First hops forward from sources, second hops backward from known targets, met on the middle entity."""
    a = left.select("query_id", F.col("target").alias("mid"), F.col("evidence").alias("left_evidence"), F.col("score").alias("s1"))
    b = right.select("query_id", F.col("source").alias("mid"), F.col("evidence").alias("right_evidence"), F.col("score").alias("s2"))
    return a.join(b, ["query_id", "mid"]).select("query_id", "mid", "left_evidence", "right_evidence", (F.col("s1").cast("long") + F.col("s2")).alias("score"))


def expand(frontier: DataFrame, edges: DataFrame, relation: str, reverse: bool = False) -> DataFrame:
    """frontier(query_id, entity) one hop on, or back when ``reverse``."""
    here, there = ("target", "source") if reverse else ("source", "target")
    e = edges.where(F.col("relation") == relation).select(F.col(here).alias("entity"), F.col(there).alias("next")).distinct()
    return frontier.join(e, "entity").select("query_id", F.col("next").alias("entity")).distinct()


def chain(edges: DataFrame, relations: list[str], start: DataFrame) -> DataFrame:
    """N hops with every path kept. start(query_id, entity) -> query_id, path (array of entities), owners (array), score."""
    out = start.select("query_id", F.array("entity").alias("path"), F.array().cast("array<string>").alias("owners"), F.col("entity").alias("at"), F.lit(0).cast("long").alias("score"))
    for r in relations:
        e = edges.where(F.col("relation") == r).select(F.col("source").alias("at"), "target", "owner", F.col("score").alias("s"))
        out = out.join(e, "at").select("query_id", F.concat("path", F.array("target")).alias("path"), F.concat("owners", F.array("owner")).alias("owners"), F.col("target").alias("at"), (F.col("score") + F.col("s")).alias("score"))
    return out


def support(paths: DataFrame) -> DataFrame:
    """A5: how many hops of each path an owner supplies."""
    return paths.select("query_id", "path", F.explode("owners").alias("owner")).groupBy("query_id", "path", "owner").agg(F.count("*").alias("hops"))


def frontier_join(edges: DataFrame, relation_1: str, relation_2: str, token: Column) -> DataFrame:
    """Hops of different owners meet on a token of the display label. ``token`` is written over the column ``label``."""
    a = edges.where(F.col("relation") == relation_1).withColumn("label", F.col("target")).withColumn("token", token).select(F.col("source").alias("query_id"), F.col("owner").alias("owner_1"), "token")
    b = edges.where(F.col("relation") == relation_2).withColumn("label", F.col("source")).withColumn("token", token).select(F.col("owner").alias("owner_2"), "token", "target")
    return a.join(b, "token").where("owner_1 <> owner_2").select("query_id", "token", "owner_1", "owner_2", "target")


def orientation(at_source: Column, at_target: Column) -> Column:
    """The relation as seen from one of an edge's ends: as it is, inverse, or null."""
    from ..sources.graph import inverse_of

    return F.when(at_source, F.col("relation")).when(at_target, inverse_of(F.col("relation")))


def closure(pairs: DataFrame, child: str, parent: str, max_depth: int = 32) -> DataFrame:
    """Reflexive transitive closure (node, ancestor), found round by round: only the pairs that the last round added are
    joined again. Each round is written to the shared folder, so a round's plan does not hold those before it; stops at the fixpoint, raises beyond max_depth."""
    from ..streaming.store import shared

    direct = shared(pairs.select(F.col(child).alias("node"), F.col(parent).alias("ancestor")).distinct(), "closure-direct")
    nodes = direct.select("node").union(direct.select("ancestor")).distinct()
    fresh = shared(nodes.select("node", F.col("node").alias("ancestor")), "closure")
    found = fresh
    step = direct.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("next"))
    for _ in range(max_depth):
        reached = fresh.join(step, "ancestor").select("node", F.col("next").alias("ancestor")).distinct()
        fresh = shared(reached.join(found, ["node", "ancestor"], "left_anti"), "closure")
        if fresh.isEmpty():
            return found
        found = found.unionByName(fresh)
    raise ValueError("the taxonomy is deeper than max_depth")
