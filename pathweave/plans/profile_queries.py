"""Registered queries: aggregates, windows, rankers over candidates, sets, checks, functions. Each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from ..operators import paths as P
from ..operators import tables as O
from ..sources import graph as G
from .graph_queries import order_paths, query, region_paths, rel
from .oracle import GRAPH, ORDER_PATHS, RANK, REGION_PATHS

# candidates: nations as reached by orders; each owner of the first hop is a party
_CAND = ORDER_PATHS + ", contributions AS (SELECT owner_1 AS party, target AS candidate, CAST(sum(score) AS DOUBLE) / 7 AS score, count(*) AS support FROM paths GROUP BY ALL)\n"


def contributions(s, d):
    return order_paths(s, d).groupBy(F.col("owner_1").alias("party"), F.col("target").alias("candidate")).agg((F.sum("score").cast("double") / 7).alias("score"), F.count("*").alias("support"))


_A1 = "presence AS presence, score_sum, support_sum, CAST(score_sum AS DOUBLE) / presence / 1000000 AS average"
_A1T = ", sums AS (SELECT candidate, count(*) AS presence, CAST(sum(CAST(round_even(score * 1000000, 0) AS BIGINT)) AS BIGINT) AS score_sum, CAST(sum(support) AS BIGINT) AS support_sum FROM contributions GROUP BY candidate)"


@query("A1_presence_sums", GRAPH + _CAND + _A1T + f"SELECT candidate, {_A1} FROM sums")
def a1(s, d):
    return O.presence_sums(contributions(s, d))


@query("L6_average_score", GRAPH + _CAND + _A1T + f"SELECT candidate, {_A1} FROM sums ORDER BY average, support_sum DESC, candidate LIMIT 10")
def l6(s, d):
    return O.average_score_topk(contributions(s, d), 10)


@query("A2_additive_merge", GRAPH + ORDER_PATHS + "SELECT target AS candidate, CAST(sum(score) AS BIGINT) AS score, CAST(count(*) AS BIGINT) AS support FROM paths GROUP BY target")
def a2(s, d):
    return O.additive_merge(order_paths(s, d).select(F.col("target").alias("candidate"), "score", F.lit(1).alias("support")))


@query("A3_min_merge", GRAPH + ORDER_PATHS + ", c AS (SELECT target AS candidate, owner_1 AS owner, score, left_evidence % 5 AS support FROM paths) SELECT candidate, owner, min(score) AS score, max(support) AS support FROM c WHERE score = (SELECT min(x.score) FROM c x WHERE x.candidate = c.candidate) GROUP BY candidate, owner")
def a3(s, d):
    return O.min_merge(order_paths(s, d).select(F.col("target").alias("candidate"), F.col("owner_1").alias("owner"), "score", (F.col("left_evidence") % 5).alias("support")))


@query("A4_target_support", GRAPH + "SELECT target, count(*) AS support, CAST(sum(score) AS BIGINT) AS score FROM edges WHERE relation = 'has_part' GROUP BY target")
def a4(s, d):
    return rel(G.edges(s, d), "has_part").groupBy("target").agg(F.count("*").alias("support"), F.sum("score").cast("long").alias("score"))


@query("A5_owner_support", GRAPH + REGION_PATHS + "SELECT query_id, mid, target, owner, count(*) AS hops FROM (SELECT query_id, mid, target, unnest([owner_1, owner_2]) AS owner FROM paths) GROUP BY ALL")
def a5(s, d):
    return region_paths(s, d).select("query_id", "mid", "target", F.explode(F.array("owner_1", "owner_2")).alias("owner")).groupBy("query_id", "mid", "target", "owner").agg(F.count("*").alias("hops"))


_AT = lambda q: f"min(CASE WHEN seen >= ceil(total * {q}) THEN fanout END)"


@query("A6_degree_profile", GRAPH + f", d AS (SELECT relation, fanout, count(*) AS keys FROM (SELECT source, relation, count(*) AS fanout FROM edges GROUP BY ALL) GROUP BY ALL), c AS (SELECT *, sum(keys) OVER (PARTITION BY relation ORDER BY fanout) AS seen, sum(keys) OVER (PARTITION BY relation) AS total FROM d) SELECT relation, CAST(sum(keys) AS BIGINT) AS keys, CAST(sum(keys * fanout) AS BIGINT) AS edges, max(fanout) AS max_fanout, {_AT(0.5)} AS p50, {_AT(0.95)} AS p95, {_AT(0.99)} AS p99 FROM c GROUP BY relation")
def a6(s, d):
    return O.degree_profile(G.edges(s, d))


@query("A7_bound_overflow", GRAPH + ", d AS (SELECT source, relation, count(*) AS n FROM edges GROUP BY ALL) SELECT relation, CAST(sum(CAST(n > 8 AS INTEGER)) AS BIGINT) AS keys_over, CAST(sum(greatest(0, n - 8)) AS BIGINT) AS edges_over, CAST(sum(least(8, n)) AS BIGINT) AS edges_kept FROM d GROUP BY relation")
def a7(s, d):
    return O.bound_overflow(G.edges(s, d), 8)


@query("A8_page_amplification", GRAPH + ", d AS (SELECT owner, source, relation, count(*) AS n FROM edges GROUP BY ALL) SELECT CAST(page_size AS INTEGER) AS page_size, CAST(sum(ceil(n / page_size)) AS BIGINT) AS pages, CAST(sum(n) AS BIGINT) AS edges, max(n) AS smallest_lossless FROM d, (SELECT unnest([1, 2, 4, 8, 16]) AS page_size) GROUP BY page_size")
def a8(s, d):
    return O.page_amplification(G.edges(s, d), [1, 2, 4, 8, 16])


@query("A9_bounded_collect", GRAPH + "SELECT source, relation, array_to_string(list(target ORDER BY target)[:4], ',') AS targets, greatest(0, count(*) - 4) AS overflow FROM (SELECT DISTINCT source, relation, target FROM edges) GROUP BY source, relation")
def a9(s, d):
    return O.bounded_collect(G.edges(s, d), 4).withColumn("targets", F.array_join("targets", ","))


@query("A10_federation_degree", GRAPH + "SELECT relation, count(*) AS violations FROM (SELECT source, relation FROM edges GROUP BY ALL HAVING count(*) > 8) GROUP BY relation")
def a10(s, d):
    return G.edges(s, d).groupBy("source", "relation").count().where("count > 8").groupBy("relation").agg(F.count("*").alias("violations"))


@query("A11_occupancy", GRAPH + "SELECT owner, relation, source, count(*) AS rows_held FROM edges GROUP BY ALL")
def a11(s, d):
    return G.edges(s, d).groupBy("owner", "relation", "source").agg(F.count("*").alias("rows_held"))


@query("A12_layout_report", GRAPH + ", d AS (SELECT owner, source, relation, count(*) AS n FROM edges GROUP BY ALL) SELECT owner, count(*) AS occupied, CAST(sum(ceil(n / 4)) AS BIGINT) AS pages, CAST(sum(n) AS BIGINT) AS edges, CAST(sum(ceil(n / 4)) * 4 AS DOUBLE) / sum(n) AS amplification FROM d GROUP BY owner")
def a12(s, d):
    k = G.edges(s, d).groupBy("owner", "source", "relation").agg(F.count("*").alias("n"))
    return k.groupBy("owner").agg(F.count("*").alias("occupied"), F.sum(F.ceil(F.col("n") / 4)).cast("long").alias("pages"), F.sum("n").cast("long").alias("edges"), ((F.sum(F.ceil(F.col("n") / 4)) * 4).cast("double") / F.sum("n")).alias("amplification"))


@query("A13_retention", GRAPH + ", k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner, source, relation ORDER BY target) AS r FROM edges) WHERE r <= 8) SELECT (SELECT count(*) FROM edges) AS before, (SELECT count(*) FROM k) AS kept, (SELECT count(*) FROM (SELECT source, relation, target FROM edges EXCEPT SELECT source, relation, target FROM k)) AS lost")
def a13(s, d):
    e = G.edges(s, d)
    flagged = e.withColumn("r", F.row_number().over(W.partitionBy("owner", "source", "relation").orderBy("target")))
    return flagged.agg(F.count("*").alias("before"), F.sum((F.col("r") <= 8).cast("int")).cast("long").alias("kept"), F.sum((F.col("r") > 8).cast("int")).cast("long").alias("lost"))


@query("A14_partition_stats", GRAPH + ", o AS (SELECT owner, count(*) AS edges, count(DISTINCT source || '|' || relation) AS keys FROM edges GROUP BY owner), k AS (SELECT count(*) AS spanning FROM (SELECT source, relation FROM edges GROUP BY ALL HAVING count(DISTINCT owner) > 1)) SELECT owner, o.edges, keys, spanning, CAST((SELECT max(edges) FROM o) AS DOUBLE) / (SELECT min(edges) FROM o) AS skew FROM o, k")
def a14(s, d):
    e = G.edges(s, d)
    keys = e.groupBy("source", "relation", "owner").agg(F.count("*").alias("n"))
    o = keys.groupBy("owner").agg(F.sum("n").cast("long").alias("edges"), F.count("*").alias("keys"))
    span = keys.groupBy("source", "relation").agg(F.count("*").alias("owners")).where("owners > 1").agg(F.count("*").alias("spanning"))
    skew = o.agg((F.max("edges").cast("double") / F.min("edges")).alias("skew"))
    # two one-row tables
    return o.join(F.broadcast(span)).join(F.broadcast(skew))


@query("A15_evidence_owners", GRAPH + ORDER_PATHS + "SELECT query_id, array_to_string(list_sort(list_distinct(list_concat(list(owner_1), list(owner_2)))), ',') AS owners, CAST(max(CAST(owner_1 <> owner_2 AS INTEGER)) AS INTEGER) AS crosses FROM paths GROUP BY query_id")
def a15(s, d):
    p = order_paths(s, d)
    return p.groupBy("query_id").agg(F.array_join(F.array_sort(F.array_distinct(F.concat(F.collect_set("owner_1"), F.collect_set("owner_2")))), ",").alias("owners"), F.max((F.col("owner_1") != F.col("owner_2")).cast("int")).alias("crosses"))


@query("A16_wilson", "WITH h AS (SELECT toxic, CAST(sum(quality) AS DOUBLE) AS hits, CAST(count(quality) AS DOUBLE) AS n FROM labels GROUP BY toxic) SELECT toxic, round(hits / n, 9) AS rate, round(greatest(0, (hits / n + 1.9208 / n - 1.96 * sqrt(hits / n * (1 - hits / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n)), 9) AS low, round(least(1, (hits / n + 1.9208 / n + 1.96 * sqrt(hits / n * (1 - hits / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n)), 9) AS high FROM h")
def a16(s, d):
    h = G.table(s, d, "labels").groupBy("toxic").agg(F.sum("quality").cast("double").alias("hits"), F.count("quality").cast("double").alias("n"))
    rate, low, high = O.wilson(F.col("hits"), F.col("n"))
    return h.select("toxic", F.round(rate, 9).alias("rate"), F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("A17_exact_match", GRAPH + ", r AS (SELECT source AS id, list_distinct(list(target)) AS got FROM edges WHERE relation = 'has_part' GROUP BY source), g AS (SELECT source AS id, list_distinct(list(target)) AS gold FROM edges WHERE relation = 'has_part' AND score > 3 GROUP BY source) SELECT count(*) AS n, CAST(sum(CAST(len(got) = len(gold) AND len(list_intersect(got, gold)) = len(gold) AS INTEGER)) AS BIGINT) AS exact, round(avg(len(list_intersect(got, gold)) / len(gold)), 9) AS coverage FROM r JOIN g USING (id)")
def a17(s, d):
    e = rel(G.edges(s, d), "has_part")
    return O.coverage(e.select(F.col("source").alias("id"), F.col("target").alias("answer"), F.lit(True).alias("got"), (F.col("score") > 3).alias("gold")))


@query("A18_latency", "SELECT event_type, round(avg(value), 6) AS mean, (list(value ORDER BY value))[CAST(round_even(0.5 * (count(value) - 1), 0) AS BIGINT) + 1] AS p50, (list(value ORDER BY value))[CAST(round_even(0.95 * (count(value) - 1), 0) AS BIGINT) + 1] AS p95 FROM events GROUP BY event_type")
def a18(s, d):
    """Rounded-rank percentiles by two windows, without an array of all values of a type."""
    e = G.table(s, d, "events").where("value IS NOT NULL").select("event_type", "value")
    e = e.groupBy("event_type", "value").agg(F.count("*").alias("c"))
    w = W.partitionBy("event_type").orderBy("value")
    e = e.withColumn("seen", F.sum("c").over(w)).withColumn("n", F.sum("c").over(W.partitionBy("event_type")))
    at = lambda q: F.min(F.when(F.col("seen") > F.bround(F.lit(q) * (F.col("n") - 1)), F.col("value")))
    return e.groupBy("event_type").agg(F.round(F.sum(F.col("value") * F.col("c")) / F.sum("c"), 6).alias("mean"), at(0.5).alias("p50"), at(0.95).alias("p95"))


@query("A19_run_table", GRAPH + "SELECT 'k' || k AS run, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(r <= k AS INTEGER)) AS BIGINT) AS kept FROM (SELECT row_number() OVER (PARTITION BY source ORDER BY target) AS r FROM edges WHERE relation = 'in_nation_inverse'), (SELECT unnest([4, 8]) AS k) GROUP BY k")
def a19(s, d):
    e = rel(G.edges(s, d), "in_nation_inverse").withColumn("r", F.row_number().over(W.partitionBy("source").orderBy("target")))
    one = lambda k: e.agg(F.lit(f"k{k}").alias("run"), F.count("*").alias("n"), F.sum((F.col("r") <= k).cast("int")).cast("long").alias("kept"))
    return one(4).unionByName(one(8))


@query("A20_bucket_load", GRAPH + f", k AS (SELECT DISTINCT owner, source, relation FROM edges), b AS (SELECT n AS buckets, owner, ('0x' || substr(sha256(source || '|' || relation), 1, 16))::UBIGINT % n AS b, count(*) AS load FROM k, (SELECT unnest([64, 256]) AS n) GROUP BY ALL) SELECT CAST(buckets AS INTEGER) AS buckets, max(load) AS max_load FROM b GROUP BY buckets")
def a20(s, d):
    k = G.edges(s, d).select("owner", "source", "relation").distinct()
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", "source", "relation"), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    k = k.select("owner", F.explode(F.array(F.lit(64), F.lit(256))).alias("buckets"), h.alias("h")).withColumn("b", (F.col("h") % F.col("buckets")).cast("int"))
    return k.groupBy("buckets", "owner", "b").agg(F.count("*").alias("load")).groupBy("buckets").agg(F.max("load").alias("max_load"))


@query("A21_capacity_bounds", GRAPH + ", d AS (SELECT owner, source, relation, count(*) AS n FROM edges GROUP BY ALL) SELECT owner, CAST(max(ceil(n / 4)) AS BIGINT) AS pages_per_key, CAST(sum(ceil(n / 4)) AS BIGINT) AS page_budget, max(n) AS frontier FROM d GROUP BY owner")
def a21(s, d):
    k = G.edges(s, d).groupBy("owner", "source", "relation").agg(F.count("*").alias("n"))
    return k.groupBy("owner").agg(F.max(F.ceil(F.col("n") / 4)).cast("long").alias("pages_per_key"), F.sum(F.ceil(F.col("n") / 4)).cast("long").alias("page_budget"), F.max("n").alias("frontier"))


@query("A22_type_blocks", GRAPH + ", t AS (SELECT split_part(source, ':', 1) AS type, count(DISTINCT source) AS entities, count(DISTINCT relation) AS relations FROM edges GROUP BY 1) SELECT type, entities, relations, entities * relations AS blocked_rows, CAST((SELECT sum(entities) FROM t) * (SELECT count(DISTINCT relation) FROM edges) AS BIGINT) AS dense_rows FROM t")
def a22(s, d):
    e = G.edges(s, d)
    t = e.groupBy(G.kind_of("source").alias("type")).agg(F.countDistinct("source").alias("entities"), F.countDistinct("relation").alias("relations"))
    all_ = e.agg((F.countDistinct("source") * F.countDistinct("relation")).alias("dense_rows"))
    return t.withColumn("blocked_rows", F.col("entities") * F.col("relations")).join(F.broadcast(all_))


@query("A23_histogram", "SELECT json_extract_string(props, '$.k') AS reason, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, reason LIMIT 20")
def a23(s, d):
    return G.table(s, d, "events").groupBy(F.get_json_object("props", "$.k").alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("reason")).limit(20)


@query("A24_bit_xor", "SELECT user_id, bit_xor(event_id) AS combined, count(*) AS shares FROM events GROUP BY user_id")
def a24(s, d):
    return G.table(s, d, "events").groupBy("user_id").agg(F.bit_xor("event_id").alias("combined"), F.count("*").alias("shares"))


@query("A25_additive_combine", "SELECT user_id, CAST(sum(CAST(event_id AS HUGEINT) * 2305843009213693950 % 2305843009213693951) % 2305843009213693951 AS BIGINT) AS secret FROM events GROUP BY user_id")
def a25(s, d):
    p = F.lit("2305843009213693951").cast("decimal(20,0)")
    share = ((p - 1) * F.col("event_id").cast("decimal(18,0)")) % p
    return G.table(s, d, "events").groupBy("user_id").agg((F.sum(share.cast("decimal(25,0)")) % p).cast("long").alias("secret"))


@query("A26_metric_rollup", "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, round(avg(n_chars), 6) AS mean, CAST(sum(CAST(text IS NULL AS INTEGER)) AS BIGINT) AS errors FROM documents GROUP BY lang")
def a26(s, d):
    t = G.table(s, d, "documents")
    return t.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 6).alias("mean"), F.sum(F.col("text").isNull().cast("int")).cast("long").alias("errors"))


@query("A27_answer_accuracy", GRAPH + "SELECT count(*) AS n, round(avg(CAST(score > 4 AS INTEGER)), 9) AS accuracy, round(avg(CASE WHEN evidence % 3 = 0 THEN CAST(score > 4 AS INTEGER) END), 9) AS given_hit FROM edges WHERE relation = 'in_nation'")
def a27(s, d):
    right = (F.col("score") > 4).cast("int")
    return rel(G.edges(s, d), "in_nation").agg(F.count("*").alias("n"), F.round(F.avg(right), 9).alias("accuracy"), F.round(F.avg(F.when(F.col("evidence") % 3 == 0, right)), 9).alias("given_hit"))


# ---- windows -----------------------------------------------------------------------------------------------------------


@query("W1_first_n", GRAPH + "SELECT owner, source, relation, target FROM (SELECT *, row_number() OVER (PARTITION BY owner, source, relation ORDER BY target) AS r FROM edges) WHERE r <= 3")
def w1(s, d):
    return O.first_n(G.edges(s, d), 3).select("owner", "source", "relation", "target")


@query("W2_pages", GRAPH + ", d AS (SELECT owner, source, relation, count(*) AS n FROM edges GROUP BY ALL) SELECT owner, source, relation, CAST(ceil(n / 4) AS BIGINT) AS page_count, CAST(1 + coalesce(sum(ceil(n / 4)) OVER (PARTITION BY owner ORDER BY source, relation ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS page_base FROM d")
def w2(s, d):
    return O.pages(G.edges(s, d), 4)


@query("W5_prefix_selection", GRAPH + "SELECT source, target FROM (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY owner, target) AS r FROM edges WHERE relation = 'in_nation_inverse') WHERE r = 3")
def w5(s, d):
    e = rel(G.edges(s, d), "in_nation_inverse")
    return e.withColumn("r", F.row_number().over(W.partitionBy("source").orderBy("owner", "target"))).where("r = 3").select("source", "target")


@query("W6_positional_score", GRAPH + "SELECT owner, source, CAST(1 + (dense_rank() OVER (PARTITION BY owner ORDER BY source) - 1) % 9 AS INTEGER) AS positional FROM edges WHERE relation = 'in_nation'")
def w6(s, d):
    return O.positional_scores(rel(G.edges(s, d), "in_nation")).select("owner", "source", "positional")


@query("W7_round_robin", GRAPH + ", x AS (SELECT source, relation, target, row_number() OVER (PARTITION BY relation ORDER BY evidence) AS rn FROM edges) SELECT source, relation, target FROM x ORDER BY rn, relation LIMIT 50")
def w7(s, d):
    x = G.edges(s, d).withColumn("rn", F.row_number().over(W.partitionBy("relation").orderBy("evidence"))).where("rn <= 50")
    return x.orderBy("rn", "relation").limit(50).select("source", "relation", "target")


@query("W8_contiguous_ids", GRAPH + ", e AS (SELECT DISTINCT split_part(source, ':', 1) AS type, source AS name FROM edges) SELECT type, name, row_number() OVER (ORDER BY type, name) AS id FROM e")
def w8(s, d):
    e = G.edges(s, d).select(G.kind_of("source").alias("type"), F.col("source").alias("name")).distinct()
    return O.contiguous_ids(e, ["type", "name"])


@query("W9_rank_in_universe", GRAPH + ", u AS (SELECT relation, row_number() OVER (ORDER BY relation) - 1 AS position FROM (SELECT DISTINCT relation FROM edges)) SELECT position, count(*) AS n FROM edges JOIN u USING (relation) GROUP BY position")
def w9(s, d):
    e = G.edges(s, d)
    u = O.contiguous_ids(e.select("relation").distinct(), ["relation"]).select("relation", (F.col("id") - 1).alias("position"))
    return e.join(u, "relation").groupBy("position").agg(F.count("*").alias("n"))


@query("W10_first_winner", GRAPH + "SELECT target, min_by(source, struct_pack(a := score, b := source)) AS winner FROM edges WHERE relation = 'in_nation' GROUP BY target")
def w10(s, d):
    return rel(G.edges(s, d), "in_nation").groupBy("target").agg(F.min_by("source", F.struct("score", "source")).alias("winner"))


# ---- rankers -----------------------------------------------------------------------------------------------------------

_MERGED = ORDER_PATHS + ", c AS (SELECT target AS candidate, CAST(sum(score) AS BIGINT) AS score, CAST(count(*) AS BIGINT) AS support FROM paths GROUP BY target)"


def merged(s, d):
    return O.additive_merge(order_paths(s, d).select(F.col("target").alias("candidate"), "score", F.lit(1).alias("support")))


@query("L2_low_score", GRAPH + _MERGED + " SELECT candidate, score, support FROM c ORDER BY score, support DESC, candidate LIMIT 7")
def l2(s, d):
    return O.low_score_topk(merged(s, d), 7)


@query("L3_first_k", GRAPH + "SELECT owner, source, target FROM edges WHERE relation = 'supplier_in_nation' ORDER BY owner, source, target LIMIT 9")
def l3(s, d):
    return rel(G.edges(s, d), "supplier_in_nation").orderBy("owner", "source", "target").limit(9).select("owner", "source", "target")


@query("L4_unranked_clip", GRAPH + REGION_PATHS + "SELECT query_id, mid, target FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY mid, target) AS r FROM paths) WHERE r <= 5")
def l4(s, d):
    return P.ranked(region_paths(s, d), 5, [("mid", True), ("target", True)]).select("query_id", "mid", "target")


@query("L5_support_first", GRAPH + _MERGED + " SELECT candidate, score, support FROM c WHERE support > 0 ORDER BY support DESC, score, candidate LIMIT 7")
def l5(s, d):
    return O.support_first_topk(merged(s, d), 7)


@query("L7_dedup_topk", GRAPH + REGION_PATHS + "SELECT mid, target, min(score) AS score FROM paths GROUP BY mid, target ORDER BY score, mid, target LIMIT 20")
def l7(s, d):
    return region_paths(s, d).groupBy("mid", "target").agg(F.min("score").alias("score")).orderBy("score", "mid", "target").limit(20)


@query("L8_degree_scorer", GRAPH + ", o AS (SELECT source, count(*) AS degree FROM edges GROUP BY source) SELECT e.source, e.target, degree FROM edges e JOIN o ON o.source = e.target WHERE relation = 'placed_by_inverse' ORDER BY degree, e.source, e.target LIMIT 25")
def l8(s, d):
    e = G.edges(s, d)
    o = e.groupBy(F.col("source").alias("target")).agg(F.count("*").alias("degree"))
    return rel(e, "placed_by_inverse").join(o, "target").orderBy("degree", "source", "target").limit(25).select("source", "target", "degree")


_L8 = ", o AS (SELECT source, count(*) AS degree FROM edges GROUP BY source), f AS (SELECT relation, count(*) AS selectivity FROM edges GROUP BY relation)"


@query("L8_selectivity_scorer", GRAPH + _L8 + ", p AS (SELECT a.source AS query_id, a.target AS mid, b.relation, b.target FROM edges a JOIN edges b ON a.target = b.source WHERE a.relation = 'in_region_inverse' AND b.relation IN ('in_nation_inverse', 'supplier_in_nation_inverse')) SELECT query_id, mid, relation, p.target, CAST(rank AS INTEGER) AS rank FROM (SELECT p.*, row_number() OVER (PARTITION BY query_id ORDER BY selectivity, degree, mid, relation, p.target) AS rank FROM p JOIN f USING (relation) JOIN o ON o.source = p.target) p WHERE rank <= 5")
def l8_selectivity(s, d):
    """Paths by how rare the second relation is, then by the degree of the end."""
    e = G.edges(s, d)
    first = rel(e, "in_region_inverse").select(F.col("source").alias("query_id"), F.col("target").alias("mid"))
    second = e.where("relation IN ('in_nation_inverse', 'supplier_in_nation_inverse')").select(F.col("source").alias("mid"), "relation", "target")
    degree = e.groupBy(F.col("source").alias("target")).agg(F.count("*").alias("degree"))
    rare = e.groupBy("relation").agg(F.count("*").alias("selectivity"))
    p = first.join(second, "mid").join(rare, "relation").join(degree, "target")
    return P.ranked(p, 5, [(c, True) for c in ("selectivity", "degree", "mid", "relation", "target")]).select("query_id", "mid", "relation", "target", "rank")


@query("L8_positional_scorer", GRAPH + ", a AS (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY target) - 1 AS i FROM edges WHERE relation = 'in_region_inverse'), b AS (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY target) - 1 AS j FROM edges WHERE relation = 'supplier_in_nation_inverse') SELECT query_id, mid, target, CAST(rank AS INTEGER) AS rank FROM (SELECT a.source AS query_id, a.target AS mid, b.target, row_number() OVER (PARTITION BY a.source ORDER BY (i * 31 + j) % 9 DESC, i * 31 + j, a.target, b.target) AS rank FROM a JOIN b ON a.target = b.source) WHERE rank <= 5")
def l8_positional(s, d):
    """Paths by the synthetic score of their position: 1 + position modulo 9, the highest first."""
    e = G.edges(s, d)
    at = lambda r, n: rel(e, r).select("source", "target", (F.row_number().over(W.partitionBy("source").orderBy("target")) - 1).alias(n))
    a = at("in_region_inverse", "i").select(F.col("source").alias("query_id"), F.col("target").alias("mid"), "i")
    p = a.join(at("supplier_in_nation_inverse", "j").withColumnRenamed("source", "mid"), "mid").withColumn("position", F.col("i") * 31 + F.col("j")).withColumn("late", F.col("position") % 9)
    return P.ranked(p, 5, [("late", False), ("position", True), ("mid", True), ("target", True)]).select("query_id", "mid", "target", "rank")


@query("L9_topk_sweep", GRAPH + REGION_PATHS + f", r AS (SELECT query_id, min(rank) AS best FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {RANK}) AS rank FROM paths) WHERE left_evidence % 7 = 0 AND right_evidence % 5 = 0 GROUP BY query_id) SELECT CAST(k AS INTEGER) AS k, count(*) AS n, CAST(sum(CAST(best <= k AS INTEGER)) AS BIGINT) AS hits FROM r, (SELECT unnest([4, 8, 16, 32]) AS k) GROUP BY k")
def l9(s, d):
    r = P.ranked(region_paths(s, d), None).where("left_evidence % 7 = 0 AND right_evidence % 5 = 0").groupBy("query_id").agg(F.min("rank").alias("best"))
    r = r.withColumn("k", F.explode(F.array(*map(F.lit, (4, 8, 16, 32)))))
    return r.groupBy("k").agg(F.count("*").alias("n"), F.sum((F.col("best") <= F.col("k")).cast("int")).cast("long").alias("hits"))


@query("L10_reveal", GRAPH + REGION_PATHS + f", t AS (SELECT query_id, left_evidence, row_number() OVER (PARTITION BY query_id ORDER BY {RANK}) AS rank FROM paths) SELECT query_id, CAST(rank AS INTEGER) AS rank, source, relation, target FROM t JOIN edges ON evidence = left_evidence WHERE rank <= 3")
def l10(s, d):
    t = P.ranked(region_paths(s, d), 3).select("query_id", "rank", F.col("left_evidence").alias("evidence"))
    return t.join(G.edges(s, d), "evidence").select("query_id", "rank", "source", "relation", "target")


# ---- sets and checks ---------------------------------------------------------------------------------------------------


@query("U1_owner_union", GRAPH + "SELECT owner, count(*) AS n FROM edges GROUP BY owner")
def u1(s, d):
    e = G.edges(s, d)
    parts = [e.where(F.col("owner") == f"o{i}") for i in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("owner").agg(F.count("*").alias("n"))


@query("U2_distinct_union", GRAPH + "SELECT count(*) AS n FROM (SELECT source FROM edges UNION SELECT target FROM edges)")
def u2(s, d):
    e = G.edges(s, d)
    return e.select("source").union(e.select("target")).distinct().agg(F.count("*").alias("n"))


@query("U3_set_ops", GRAPH + ", a AS (SELECT DISTINCT target AS x FROM edges WHERE relation = 'placed_by'), b AS (SELECT DISTINCT source AS x FROM edges WHERE relation = 'in_nation') SELECT (SELECT count(*) FROM (SELECT x FROM a INTERSECT SELECT x FROM b)) AS both_n, (SELECT count(*) FROM (SELECT x FROM b EXCEPT SELECT x FROM a)) AS only_b")
def u3(s, d):
    e = G.edges(s, d)
    a, b = rel(e, "placed_by").select(F.col("target").alias("x")), rel(e, "in_nation").select(F.col("source").alias("x"))
    return a.intersect(b).agg(F.count("*").alias("both_n")).join(b.subtract(a).agg(F.count("*").alias("only_b")))


@query("U4_page_pool", GRAPH + ", d AS (SELECT owner, CAST(sum(pages) AS BIGINT) AS pages FROM (SELECT owner, ceil(count(*) / 4) AS pages FROM edges GROUP BY owner, source, relation) GROUP BY owner) SELECT owner, pages, CAST(1 + coalesce(sum(pages) OVER (ORDER BY owner ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM d")
def u4(s, d):
    p = G.edges(s, d).groupBy("owner", "source", "relation").agg(F.ceil(F.count("*") / 4).alias("pages")).groupBy("owner").agg(F.sum("pages").cast("long").alias("pages"))
    # one row for each owner
    return p.withColumn("base", (1 + F.coalesce(F.sum("pages").over(W.orderBy("owner").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).cast("long"))


@query("V1_unknown_items", GRAPH + ", known AS (SELECT DISTINCT source AS e FROM edges WHERE source NOT LIKE 'event:%') SELECT target AS entity, count(*) AS n FROM edges WHERE target NOT IN (SELECT e FROM known) GROUP BY target")
def v1(s, d):
    e = G.edges(s, d)
    known = e.where("source NOT LIKE 'event:%'").select(F.col("source").alias("target"))
    return e.join(known, "target", "left_anti").groupBy(F.col("target").alias("entity")).agg(F.count("*").alias("n"))


@query("V2_value_ranges", GRAPH + "SELECT 'score' AS field, count(*) AS bad FROM edges WHERE score < 2 UNION ALL SELECT 'evidence', count(*) FROM edges WHERE evidence < 1 OR evidence >= 281474976710657")
def v2(s, d):
    e = G.edges(s, d)
    sums = e.agg(F.sum((F.col("score") < 2).cast("int")).cast("long").alias("score"), F.sum(((F.col("evidence") < 1) | (F.col("evidence") >= 281474976710657)).cast("int")).cast("long").alias("evidence"))
    return sums.selectExpr("stack(2, 'score', score, 'evidence', evidence) AS (field, bad)")


@query("V3_bound_violations", GRAPH + "SELECT owner, source, relation, count(*) AS fanout FROM edges GROUP BY ALL HAVING count(*) > 20")
def v3(s, d):
    return G.edges(s, d).groupBy("owner", "source", "relation").agg(F.count("*").alias("fanout")).where("fanout > 20")


@query("V4_duplicate_handles", GRAPH + "SELECT evidence % 1000003 AS handle, count(*) AS n FROM edges GROUP BY 1 HAVING count(*) > 1")
def v4(s, d):
    return G.edges(s, d).groupBy((F.col("evidence") % 1000003).alias("handle")).agg(F.count("*").alias("n")).where("n > 1")


@query("V5_referential_integrity", "SELECT count(*) AS dangling FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def v5(s, d):
    c = G.table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return G.table(s, d, "orders").join(c, "o_custkey", "left_anti").agg(F.count("*").alias("dangling"))


@query("V7_complete_groups", "SELECT conv_id, count(DISTINCT turn) AS turns, max(turn) AS last FROM conversations GROUP BY conv_id HAVING count(DISTINCT turn) <> max(turn) + 1")
def v7(s, d):
    return G.table(s, d, "conversations").groupBy("conv_id").agg(F.countDistinct("turn").alias("turns"), F.max("turn").alias("last")).where("turns <> last + 1")


@query("V8_path_evidence", GRAPH + ORDER_PATHS + "SELECT count(*) AS paths, CAST(sum(CAST(a.target <> b.source AS INTEGER)) AS BIGINT) AS broken FROM paths p JOIN edges a ON a.evidence = p.left_evidence JOIN edges b ON b.evidence = p.right_evidence")
def v8(s, d):
    e = G.edges(s, d)
    a = e.select(F.col("evidence").alias("left_evidence"), F.col("target").alias("t"))
    b = e.select(F.col("evidence").alias("right_evidence"), F.col("source").alias("u"))
    return order_paths(s, d).join(a, "left_evidence").join(b, "right_evidence").agg(F.count("*").alias("paths"), F.sum((F.col("t") != F.col("u")).cast("int")).cast("long").alias("broken"))


@query("V9_handle_ranges", GRAPH + ", r AS (SELECT owner, min(evidence) AS low, max(evidence) AS high FROM edges GROUP BY owner) SELECT owner, low, high, coalesce(high < lead(low) OVER (ORDER BY low), false) AS disjoint FROM r")
def v9(s, d):
    r = G.edges(s, d).groupBy("owner").agg(F.min("evidence").alias("low"), F.max("evidence").alias("high"))
    return r.withColumn("disjoint", F.coalesce(F.col("high") < F.lead("low").over(W.orderBy("low")), F.lit(False)))


@query("V11_contribution_checks", GRAPH + _CAND + "SELECT count(*) AS n, CAST(sum(CAST(party NOT IN ('o0', 'o1', 'o2') AS INTEGER)) AS BIGINT) AS unknown_party, count(*) - count(DISTINCT party || '|' || candidate) AS repeated FROM contributions")
def v11(s, d):
    c = contributions(s, d)
    return c.agg(F.count("*").alias("n"), F.sum((~F.col("party").isin("o0", "o1", "o2")).cast("int")).cast("long").alias("unknown_party"), (F.count("*") - F.countDistinct("party", "candidate")).alias("repeated"))


# ---- functions ---------------------------------------------------------------------------------------------------------


_PAD_KEY = b"graph key".ljust(64, b"\0")
_IN, _OUT = (bytes(b ^ m for b in _PAD_KEY).hex() for m in (0x36, 0x5C))


@query("F3_hmac_id", f"SELECT r_regionkey, sha256(unhex('{_OUT}') || unhex(sha256(unhex('{_IN}') || encode(r_name)))) AS id FROM region")
def f3(s, d):
    return G.table(s, d, "region").select("r_regionkey", X.hmac_sha256(b"graph key", F.col("r_name")).alias("id"))


@query("F4_projections", "SELECT p_partkey, substr(sha256(p_name), 1, 16) AS prefix, ('0x' || substr(sha256(p_name), 9, 8))::BIGINT AS limb FROM part")
def f4(s, d):
    h = F.sha2("p_name", 256)
    return G.table(s, d, "part").select("p_partkey", X.projection_64(h).alias("prefix"), X.limbs(h)[1].alias("limb"))


@query("F22_evidence_contains", "SELECT doc_id, contains(lower(text), 'license') OR contains(lower(text), 'rights') AS hit FROM documents")
def f22(s, d):
    return G.table(s, d, "documents").select("doc_id", X.evidence_contains(F.col("text"), F.array(F.lit("License"), F.lit("RIGHTS"))).alias("hit"))


@query("F24_reused_node", GRAPH + "SELECT a.source AS first, b.target AS last, count(*) AS paths, a.source = b.target AS reused FROM edges a JOIN edges b ON a.target = b.source WHERE a.relation = 'in_region' AND b.relation = 'in_region_inverse' GROUP BY ALL")
def f24(s, d):
    """Paths from nation to nation by their region: those that come back to where they began use a node twice."""
    p = P.fixed_chain(G.edges(s, d), "in_region", "in_region_inverse")
    each = p.select(F.col("query_id").alias("first"), F.col("target").alias("last"), X.reuses_node(F.array("query_id", "mid", "target")).alias("reused"))
    return each.groupBy("first", "last", "reused").agg(F.count("*").alias("paths"))


_JSON = """'{"evidence":' || evidence || ',"owner":"' || owner || '","relation":"' || relation || '","score":' || score || ',"source":"' || source || '","target":"' || target || '"}'"""


@query("F28_digest", GRAPH + f"SELECT relation, count(*) AS n, CAST(sum(('0x' || substr(sha256({_JSON}), 1, 15))::BIGINT::HUGEINT) % 2305843009213693951 AS BIGINT) AS digest FROM edges GROUP BY relation")
def f28(s, d):
    """A digest of every relation's edges as canonical JSON, whatever their order."""
    return O.table_digest(G.edges(s, d), ["relation"])


@query("R1_closure", "WITH RECURSIVE up AS (SELECT DISTINCT 'nation:' || n_nationkey AS child, 'region:' || n_regionkey AS parent FROM nation UNION SELECT DISTINCT 'region:' || n_regionkey, 'world' FROM nation), r AS (SELECT child AS node, child AS ancestor FROM up UNION SELECT parent, parent FROM up UNION SELECT r.node, up.parent FROM r JOIN up ON up.child = r.ancestor) SELECT node, ancestor FROM r")
def r1(s, d):
    n = G.table(s, d, "nation")
    up = n.select(F.concat(F.lit("nation:"), "n_nationkey").alias("child"), F.concat(F.lit("region:"), "n_regionkey").alias("parent")).union(n.select(F.concat(F.lit("region:"), "n_regionkey"), F.lit("world"))).distinct()
    return P.closure(up, "child", "parent")


# ---- sources -----------------------------------------------------------------------------------------------------------


@query("S10_nested_graph", GRAPH + "SELECT source, relation, array_to_string(list_sort(list_distinct(list(target))), ',') AS targets FROM edges WHERE relation = 'supplier_in_nation_inverse' GROUP BY source, relation")
def s10(s, d):
    return rel(G.edges(s, d), "supplier_in_nation_inverse").groupBy("source", "relation").agg(F.array_join(F.array_sort(F.collect_set("target")), ",").alias("targets"))


@query("S16_ring", "SELECT i + 1 AS evidence, 'e' || (i % 1000 + 1) AS source, 'r' || (i // 1000 + 1) AS relation, 'e' || ((i + 1) % 1000 + 1) AS target, 2 AS score, 'o' || (i % 3) AS owner FROM range(1600) t(i)")
def s16(s, d):
    from ..sources.readers import ring

    return ring(s, 1000, 1600, 3)


@query("S17_record_build", GRAPH + ", t AS (SELECT DISTINCT 'out:' || source AS key, target, relation FROM edges WHERE relation IN ('in_region', 'in_region_inverse')) SELECT key, array_to_string(list(relation || '>' || target ORDER BY relation || '>' || target)[:3], ',') AS record, greatest(0, count(*) - 3) AS overflow FROM t GROUP BY key")
def s17(s, d):
    e = G.edges(s, d).where("relation IN ('in_region', 'in_region_inverse')")
    t = e.select(F.concat(F.lit("out:"), "source").alias("source"), F.lit("").alias("relation"), F.concat_ws(">", "relation", "target").alias("target"))
    return O.bounded_collect(t, 3).select(F.col("source").alias("key"), F.array_join("targets", ",").alias("record"), "overflow")


@query("S18_record_fetch", GRAPH + "SELECT source AS key, count(*) AS n FROM edges WHERE source IN ('nation:1', 'region:1') GROUP BY source")
def s18(s, d):
    wanted = s.createDataFrame([("nation:1",), ("region:1",)], "source string")
    return G.edges(s, d).join(F.broadcast(wanted), "source", "left_semi").groupBy(F.col("source").alias("key")).agg(F.count("*").alias("n"))
