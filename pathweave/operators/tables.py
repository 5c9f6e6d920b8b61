"""Aggregates, windows, rankers, checks and profiles over the edge table and over candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SCALE = 1_000_000


def presence_sums(contributions: DataFrame) -> DataFrame:
    """A1: (party, candidate, score, support) -> presence, fixed-point score sum, support sum, average score."""
    out = contributions.groupBy("candidate").agg(F.count("*").alias("presence"), F.sum(F.bround(F.col("score") * SCALE).cast("long")).alias("score_sum"), F.sum("support").cast("long").alias("support_sum"))
    return out.withColumn("average", F.col("score_sum") / F.col("presence") / SCALE)


def additive_merge(candidates: DataFrame) -> DataFrame:
    """A2: duplicates add score and support."""
    return candidates.groupBy("candidate").agg(F.sum("score").cast("long").alias("score"), F.sum("support").cast("long").alias("support"))


def min_merge(candidates: DataFrame) -> DataFrame:
    """A3: the least score wins; of equal scores the largest support of each owner stays."""
    least = F.min("score").over(W.partitionBy("candidate"))
    return candidates.withColumn("_m", least).where("score = _m").groupBy("candidate", "owner").agg(F.min("score").alias("score"), F.max("support").alias("support"))


def degree_profile(edges: DataFrame) -> DataFrame:
    """Distribution of fanout over (source, relation), percentiles by nearest rank."""
    d = edges.groupBy("source", "relation").agg(F.count("*").alias("fanout")).groupBy("relation", "fanout").agg(F.count("*").alias("keys"))
    w = W.partitionBy("relation").orderBy("fanout")
    d = d.withColumn("seen", F.sum("keys").over(w)).withColumn("all", F.sum("keys").over(W.partitionBy("relation")))
    at = lambda q: F.min(F.when(F.col("seen") >= F.ceil(F.col("all") * q), F.col("fanout")))
    return d.groupBy("relation").agg(F.sum("keys").alias("keys"), F.sum(F.col("keys") * F.col("fanout")).alias("edges"), F.max("fanout").alias("max_fanout"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def bound_overflow(edges: DataFrame, bound: int) -> DataFrame:
    """What a fanout bound would lose."""
    d = edges.groupBy("source", "relation").agg(F.count("*").alias("n"))
    return d.groupBy("relation").agg(F.sum((F.col("n") > bound).cast("long")).alias("keys_over"), F.sum(F.greatest(F.lit(0), F.col("n") - bound)).cast("long").alias("edges_over"), F.sum(F.least(F.lit(bound), F.col("n"))).cast("long").alias("edges_kept"))


def page_amplification(edges: DataFrame, sizes: list[int]) -> DataFrame:
    """Pages and padding for each page size; the sweep is a short array on every key."""
    d = edges.groupBy("owner", "source", "relation").agg(F.count("*").alias("n"))
    d = d.select("n", F.explode(F.array(*map(F.lit, sizes))).alias("page_size"))
    return d.groupBy("page_size").agg(F.sum(F.ceil(F.col("n") / F.col("page_size"))).cast("long").alias("pages"), F.sum("n").cast("long").alias("edges"), F.max("n").cast("long").alias("smallest_lossless"))


def bounded_collect(edges: DataFrame, n: int) -> DataFrame:
    """The first n distinct targets of each key in order, and how many did not fit.

    Each task keeps at most n targets of a key before the exchange (a window group limit); the rest of a key is only counted.
    """
    t = edges.select("source", "relation", "target").distinct()
    first = t.withColumn("r", F.row_number().over(W.partitionBy("source", "relation").orderBy("target"))).where(F.col("r") <= n)
    kept = first.groupBy("source", "relation").agg(F.array_sort(F.collect_list("target")).alias("targets"))
    counts = t.groupBy("source", "relation").agg(F.count("*").alias("n"))
    return counts.join(kept, ["source", "relation"]).select("source", "relation", "targets", F.greatest(F.lit(0), F.col("n") - n).cast("long").alias("overflow"))


def first_n(edges: DataFrame, n: int, order=("target",)) -> DataFrame:
    """The first n edges of each (owner, source, relation)."""
    w = W.partitionBy("owner", "source", "relation").orderBy(*order)
    return edges.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)


def running_totals(rows: DataFrame, groups: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows before each row of its group, in a total order, without a group in one task.

    Rows go into ranges of (groups, order); the sums of each (group, range) are added up by a window over that small table,
    and within a range by a window of its own.
    """
    from ..streaming.store import shared

    ranged = rows.withColumn("_v", value.cast("long")).repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order).withColumn("_p", F.spark_partition_id())
    # the range of a row must be the same in both uses
    ranged = shared(ranged, "ranges")
    # one row for each range, and one more for each group that begins within one
    sums = ranged.groupBy(*groups, "_p").agg(F.sum("_v").alias("_n"))
    before = W.partitionBy(*groups).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*groups, "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = W.partitionBy(*groups, "_p").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = ranged.withColumn("_l", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    return local.join(offsets, [*groups, "_p"]).withColumn(name, F.col("_l") + F.col("_o")).drop("_p", "_v", "_l", "_o")


def pages(edges: DataFrame, size: int) -> DataFrame:
    """Slots and pages in key order; bases are running sums of pages over keys within an owner, page 0 reserved."""
    keys = edges.groupBy("owner", "source", "relation").agg(F.ceil(F.count("*") / size).cast("long").alias("page_count"))
    based = running_totals(keys, ["owner"], ["source", "relation"], F.col("page_count"), "before")
    return based.select("owner", "source", "relation", "page_count", (1 + F.col("before")).alias("page_base"))


def positional_scores(edges: DataFrame, cycle: int = 9) -> DataFrame:
    """1 + position of the source among its owner's sources, modulo ``cycle``."""
    places = running_totals(edges.select("owner", "source").distinct(), ["owner"], ["source"], F.lit(1), "place")
    return edges.join(places, ["owner", "source"]).withColumn("positional", (1 + F.col("place") % cycle).cast("int")).drop("place")


def contiguous_ids(rows: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """1, 2, 3 ... in a total order without bringing all rows to one task: ranges, their counts, then offsets."""
    return running_totals(rows.withColumn("_all", F.lit(0)), ["_all"], order, F.lit(1), name).withColumn(name, F.col(name) + 1).drop("_all")


def coverage(rows: DataFrame) -> DataFrame:
    """(id, answer, got, gold) -> how many ids have gold answers, how many got exactly these, and the mean share of gold answers got."""
    each = rows.groupBy("id", "answer").agg(F.max("got").alias("got"), F.max("gold").alias("gold"))
    count = lambda c: F.sum(c.cast("int"))
    x = each.groupBy("id").agg(count(F.col("got")).alias("n_got"), count(F.col("gold")).alias("n_gold"), count(F.col("got") & F.col("gold")).alias("both")).where("n_gold > 0 AND n_got > 0")
    exact = (F.col("n_got") == F.col("n_gold")) & (F.col("both") == F.col("n_gold"))
    return x.agg(F.count("*").alias("n"), F.sum(exact.cast("int")).cast("long").alias("exact"), F.round(F.avg(F.col("both") / F.col("n_gold")), 9).alias("coverage"))


def table_digest(rows: DataFrame, by: list[str]) -> DataFrame:
    """for each group its rows and the sum, modulo 2^61 - 1, of the first 15 digits of the SHA-256 of each row as canonical JSON:
    equal for equal rows in any order, and summed within tasks first."""
    h = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    prime = F.lit(str((1 << 61) - 1)).cast("decimal(20,0)")
    return rows.select(*by, h.alias("_h")).groupBy(*by).agg(F.count("*").alias("n"), (F.sum("_h") % prime).cast("long").alias("digest"))


def induced_subgraph(edges: DataFrame, nodes: int) -> DataFrame:
    """The edges (source, relation, target) among ``nodes`` chosen nodes. Nodes are taken by falling number of edges, then by name,
    each with all its neighbours, where these still fit; then by name alone.

    The choice is sequential, so it runs in the driver, over neighbour lists no longer than ``nodes`` that come one by one; what is held is the chosen set.
    """
    ends = edges.select(F.col("source").alias("node"), F.col("target").alias("other")).union(edges.select("target", "source"))
    degree = ends.groupBy("node").agg(F.count("*").alias("edges"))
    near = ends.distinct().withColumn("r", F.row_number().over(W.partitionBy("node").orderBy("other"))).where(F.col("r") <= nodes + 1)
    lists = near.groupBy("node").agg(F.collect_list("other").alias("near")).where(F.size("near") <= nodes)
    chosen: set[str] = set()
    for r in degree.join(lists, "node").orderBy(F.desc("edges"), "node").toLocalIterator():
        new = {r["node"], *r["near"]} - chosen
        if len(chosen) + len(new) <= nodes:
            chosen |= new
        if len(chosen) == nodes:
            break
    if len(chosen) < nodes:
        for r in degree.select("node").orderBy("node").limit(2 * nodes).toLocalIterator():
            if len(chosen) < nodes:
                chosen.add(r["node"])
    kept = edges.sparkSession.createDataFrame([(n,) for n in sorted(chosen)], "node string")
    for c in ("source", "target"):
        edges = edges.join(F.broadcast(kept), F.col(c) == F.col("node"), "left_semi")
    return edges.select("source", "relation", "target")


def low_score_topk(candidates: DataFrame, k: int) -> DataFrame:
    """L2."""
    return candidates.orderBy(F.asc("score"), F.desc("support"), F.asc("candidate")).limit(k)


def support_first_topk(candidates: DataFrame, k: int) -> DataFrame:
    """Candidates without support never appear."""
    return candidates.where("support > 0").orderBy(F.desc("support"), F.asc("score"), F.asc("candidate")).limit(k)


def average_score_topk(contributions: DataFrame, k: int) -> DataFrame:
    """L6."""
    return presence_sums(contributions).where("presence > 0").orderBy(F.asc("average"), F.desc("support_sum"), F.asc("candidate")).limit(k)


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column, Column]:
    """Rate and Wilson interval, clipped to [0, 1]."""
    p = hits / n
    middle, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return p, F.greatest(F.lit(0.0), (middle - half) / scale), F.least(F.lit(1.0), (middle + half) / scale)


def violations(edges: DataFrame, entities: DataFrame | None = None, max_fanout: int | None = None) -> DataFrame:
    """V1-V4 in one table (check, n): unknown items, bad values, fanout over a bound, repeated handles."""
    checks = [
        edges.where("source IS NULL OR relation IS NULL OR target IS NULL OR source = '' OR relation = '' OR target = ''").agg(F.lit("empty_label").alias("check"), F.count("*").alias("n")),
        edges.where("evidence IS NULL OR evidence < 1 OR score IS NULL OR score < 0").agg(F.lit("value_range").alias("check"), F.count("*").alias("n")),
        edges.groupBy("evidence").count().where("count > 1").agg(F.lit("repeated_handle").alias("check"), F.count("*").alias("n")),
    ]
    if entities is not None:
        used = edges.select(F.col("source").alias("entity")).union(edges.select("target"))
        checks.append(used.join(entities, "entity", "left_anti").distinct().agg(F.lit("unknown_entity").alias("check"), F.count("*").alias("n")))
    if max_fanout is not None:
        checks.append(edges.groupBy("owner", "source", "relation").count().where(F.col("count") > max_fanout).agg(F.lit("fanout").alias("check"), F.count("*").alias("n")))
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def enforce(edges: DataFrame, **bounds) -> None:
    """Raises unless every check finds nothing. An action: an unused assertion column would be pruned."""
    bad = [r for r in violations(edges, **bounds).collect() if r["n"]]
    if bad:
        raise ValueError("; ".join(f"{r['check']}: {r['n']}" for r in bad))
