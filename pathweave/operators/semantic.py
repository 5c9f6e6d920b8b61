"""Semantic routing of labels to relations and entities by shared buckets, scores with fallbacks, target candidates, anchors, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.graph import INVERSE

#: Penalties where no routing was done, and where routing has none for a candidate.
RELATION_PENALTY, RELATION_FALLBACK = 0.25, 0.5
ENTITY_PENALTY, ENTITY_FALLBACK = 0.2, 0.45


def buckets_of(label: Column, kind: str, mode: str, dims: int = 128) -> Column:
    return {"relation": X.relation_buckets, "entity": X.entity_buckets}[kind](label, mode, dims)


def matches(labels: DataFrame, items: DataFrame, kind: str, mode: str, dims: int = 128) -> DataFrame:
    """(label, id, matched, buckets): items(party, id, label) that share a bucket with a label, how many buckets they share, and how many the label has.

    Buckets are computed once for each distinct label; a bucket that many items hold is one key of a join, split by adaptive execution.
    """
    asked = labels.select("label").distinct().withColumn("b", buckets_of(F.col("label"), kind, mode, dims))
    asked = asked.select("label", F.size("b").alias("buckets"), F.explode("b").alias("bucket"))
    held = items.select("label").distinct().select(F.col("label").alias("item_label"), F.explode(buckets_of(F.col("label"), kind, mode, dims)).alias("bucket"))
    index = held.join(items.select("id", F.col("label").alias("item_label")).distinct(), "item_label").select("bucket", "id").distinct()
    return asked.join(index, "bucket").groupBy("label", "id").agg(F.count("*").alias("matched"), F.first("buckets").alias("buckets"))


def count_penalties(found: DataFrame) -> DataFrame:
    """(label, id, penalty): the share of the label's buckets that the candidate lacks."""
    n = F.greatest(F.col("buckets"), F.lit(1))
    return found.select("label", "id", (1 - F.least(F.col("matched"), n) / n).alias("penalty"))


def distance_penalties(found: DataFrame, items: DataFrame, fallback: float, dims: int = 128) -> DataFrame:
    """(label, id, penalty): the least distance of the label's embedding to that of the candidate's label at any party; ``fallback``
    where no party has a label for it."""
    vector = lambda rows, c: rows.select(c).distinct().withColumn(f"{c}_v", X.hash_embedding(F.col(c), dims))
    shown = items.where("label IS NOT NULL").select("id", F.col("label").alias("item_label")).distinct()
    pairs = found.select("label", "id").join(shown, "id", "left")
    near = pairs.join(vector(found, "label"), "label").join(vector(shown, "item_label"), "item_label", "left")
    return near.groupBy("label", "id").agg(F.coalesce(F.min(X.l2_distance(F.col("label_v"), F.col("item_label_v"))), F.lit(fallback)).alias("penalty"))


def routed_score(candidates: DataFrame, exact: DataFrame, penalties: DataFrame | None, plain: float, fallback: float) -> DataFrame:
    """a score for each (label, id): 0 for the exact id of the label, else its penalty, ``fallback`` where routing has none, ``plain`` without routing."""
    out = candidates.select("label", "id").join(exact.select("label", F.col("id").alias("exact_id")), "label", "left")
    if penalties is None:
        other = F.lit(plain)
    else:
        out, other = out.join(penalties.select("label", "id", "penalty"), ["label", "id"], "left"), F.coalesce("penalty", F.lit(fallback))
    return out.select("label", "id", F.when(F.col("id") == F.col("exact_id"), 0.0).otherwise(other).alias("score"))


def relation_scores(candidates: DataFrame, exact: DataFrame, penalties: DataFrame | None = None) -> DataFrame:
    return routed_score(candidates, exact, penalties, RELATION_PENALTY, RELATION_FALLBACK)


def entity_scores(candidates: DataFrame, exact: DataFrame, penalties: DataFrame | None = None) -> DataFrame:
    """As for relations; a label that is no known entity costs nothing."""
    known = exact.select("label").distinct().withColumn("_known", F.lit(True))
    out = routed_score(candidates, exact, penalties, ENTITY_PENALTY, ENTITY_FALLBACK).join(known, "label", "left")
    return out.select("label", "id", F.when(F.col("_known"), F.col("score")).otherwise(0.0).alias("score"))


def target_candidates(targets: DataFrame, nodes: DataFrame, types: DataFrame, routed: DataFrame | None = None) -> DataFrame:
    """What each target(label) may be: for a known node(label, id) its id and those it is routed to; for a typed variable the members
    of types(type, id); one row without an id where nothing restricts it: a plain variable, or a type that has no member."""
    known = targets.join(nodes, "label").select("label", "id")
    if routed is not None:
        known = known.union(targets.join(nodes.select("label").distinct(), "label", "left_semi").join(routed.select("label", "id"), "label"))
    rest = targets.join(nodes, "label", "left_anti").withColumn("type", F.when(X.is_unknown(F.col("label")), X.canonical_type(X.unknown_type(F.col("label")))))
    typed = rest.join(types, "type").select("label", "id")
    some = known.union(typed).distinct()
    free = targets.select("label").distinct().join(some, "label", "left_anti").select("label", F.lit(None).cast("string").alias("id"))
    return some.union(free)


def anchors(chains: DataFrame, graph: DataFrame, topics: DataFrame) -> DataFrame:
    """(question_id, anchor, reason): the node of its own graph that a question starts from, without looking at answers.

    chains(question_id, mid, relation_1), graph(question_id, source, relation, target), topics(question_id, entity): the
    constant itself where it is a node; else the one topic that has an edge of the first relation in its direction.
    """
    nodes = graph.select("question_id", F.col("source").alias("node")).union(graph.select("question_id", "target")).distinct()
    inverse = F.col("relation_1").endswith(INVERSE)
    base = F.when(inverse, F.substring(F.col("relation_1"), F.lit(1), F.length("relation_1") - len(INVERSE))).otherwise(F.col("relation_1"))
    asked = chains.select("question_id", "mid", base.alias("relation"), inverse.alias("inverse"))
    direct = asked.join(nodes.withColumnRenamed("node", "mid"), ["question_id", "mid"], "left_semi").select("question_id", F.lit(True).alias("direct"))
    candidates = topics.select("question_id", F.col("entity").alias("node")).distinct().join(nodes, ["question_id", "node"], "left_semi")
    ends = graph.select("question_id", "relation", F.lit(False).alias("inverse"), F.col("source").alias("node")).union(graph.select("question_id", "relation", F.lit(True), F.col("target"))).distinct()
    carrying = candidates.join(asked.select("question_id", "relation", "inverse"), "question_id").join(ends, ["question_id", "relation", "inverse", "node"], "left_semi").select("question_id", "node").distinct()
    count = lambda rows, name: rows.groupBy("question_id").agg(F.count("*").alias(f"n_{name}"), F.min("node").alias(name))
    out = asked.join(direct, "question_id", "left").join(count(candidates, "topic"), "question_id", "left").join(count(carrying, "match"), "question_id", "left")
    n, m = F.coalesce("n_topic", F.lit(0)), F.coalesce("n_match", F.lit(0))
    cases = [
        (F.col("direct"), F.col("mid"), "anchor_mid_in_graph"), (n == 0, None, "no_topic_entity_in_graph"),
        (m == 1, F.col("match"), "unique_topic_entity_with_relation_1"), (m > 1, None, "ambiguous_topic_entities_with_relation_1"),
        (n == 1, F.col("topic"), "single_topic_entity_without_relation_1_edge"), (F.lit(True), None, "no_topic_entity_carries_relation_1"),
    ]
    anchor = reason = None
    for when, what, why in reversed(cases):
        what = F.lit(None).cast("string") if what is None else what
        anchor = F.when(when, what).otherwise(anchor) if anchor is not None else what
        reason = F.when(when, F.lit(why)).otherwise(reason) if reason is not None else F.lit(why)
    return out.select("question_id", anchor.alias("anchor"), reason.alias("reason"))


def evidence_of(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """ranked rows (query_id, rank, valid, left_evidence, right_evidence, score) with the edges that their handles name, left then right;
    padding and rows without a known handle go."""
    named = lambda side: edges.select(F.col("evidence").alias(f"{side}_evidence"), F.array("source", "relation", "target").alias(side))
    out = rows.where("valid = 1").join(named("left"), "left_evidence", "left").join(named("right"), "right_evidence", "left")
    found = F.filter(F.array("left", "right"), lambda e: e.isNotNull())
    return out.select("query_id", "rank", "score", found.alias("edges")).where(F.size("edges") > 0)
