"""Registered queries over sources and sinks: tables are written in the format that a reader takes, read back, and checked. Each with its SQL."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from ..operators import tables as O
from ..sources import graph as G
from ..sources import readers as R
from ..streaming.store import shared_dir
from .graph_queries import query, rel
from .oracle import GRAPH


def folder(s) -> str:
    return f"{shared_dir(s)}/source-{uuid.uuid4().hex}"


def lines(df, path: str) -> str:
    df.write.text(path)
    return path


@query("S1_owner_edges", GRAPH + "SELECT owner, source, relation, target, evidence, score FROM edges WHERE relation IN ('in_region', 'in_region_inverse')")
def s1(s, d):
    """One JSON array for each owner; the two relations have one edge for each nation."""
    e, root = G.edges(s, d).where("relation IN ('in_region', 'in_region_inverse')"), folder(s)
    paths = {}
    for o in ("o0", "o1", "o2"):
        own = e.where(F.col("owner") == o).drop("owner")
        paths[o] = lines(own.agg(F.to_json(F.collect_list(F.struct(*own.columns))).alias("value")), f"{root}/{o}")
    return R.owner_edges(s, paths).select("owner", "source", "relation", "target", "evidence", "score")


@query("S2_config", GRAPH + "SELECT relation AS name, row_number() OVER (ORDER BY relation) AS id FROM (SELECT DISTINCT relation FROM edges)")
def s2(s, d):
    r = O.contiguous_ids(G.edges(s, d).select("relation").distinct(), ["relation"])
    # as many relations as the ontology has
    relations = F.map_from_entries(F.collect_list(F.struct("relation", "id")))
    raw = r.agg(F.to_json(F.struct(F.array(F.lit("o0"), F.lit("o1")).alias("owners"), F.create_map(F.lit("a"), F.lit(1)).alias("entities"), relations.alias("relations"), F.lit(8).alias("fanout_per_owner"), F.lit(4).alias("top_k"))).alias("value"))
    return R.load_config(s, lines(raw.coalesce(1), folder(s)) + "/*.txt").dimension(s, "relations")


@query("S3_delimited_triples", GRAPH + "SELECT source, relation, target FROM edges WHERE relation IN ('supplier_in_nation', 'supplier_in_nation_inverse')")
def s3(s, d):
    e = rel(G.edges(s, d), "supplier_in_nation")
    return R.delimited_triples(s, lines(e.select(F.concat_ws("|", "source", "relation", "target")), folder(s)))


@query("S4_questions", "SELECT 'where is [' || s_name || ']' AS question, s_name AS topic, 'nation:' || s_nationkey || '|' || 'NATION_' || s_nationkey AS answers FROM supplier")
def s4(s, d):
    n = F.col("s_nationkey").cast("string")
    t = G.table(s, d, "supplier").select(F.concat(F.lit("where is ["), "s_name", F.lit("]\tnation:"), n, F.lit("|NATION_"), n))
    return R.questions_with_answers(s, lines(t, folder(s))).withColumn("answers", F.array_join("answers", "|"))


@query("S5_question_rows", "SELECT 'c' || c_custkey AS id, c_mktsegment AS split, 'which nation' AS question, 'nation:' || c_nationkey AS groundtruths, 'customer:' || c_custkey || '>in_nation>UNKNOWN nation 1' AS query_graph FROM customer WHERE c_mktsegment IN ('MACHINERY', 'BUILDING')")
def s5(s, d):
    k = F.col("c_custkey").cast("string")
    t = G.table(s, d, "customer").select(
        F.concat(F.lit("c"), k).alias("id"), F.col("c_mktsegment").alias("split"), F.lit("which nation").alias("question"), F.array(F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string"))).alias("groundtruths"),
        F.array(F.array(F.concat(F.lit("customer:"), k), F.lit("in_nation"), F.lit("UNKNOWN nation 1"))).alias("query_graph"),
    )
    path = folder(s)
    t.write.json(path)
    got = R.question_rows(s, path, ["MACHINERY", "BUILDING"])
    return got.select("id", "split", "question", F.array_join("groundtruths", "|").alias("groundtruths"), F.array_join(F.transform("query_graph", lambda e: F.array_join(e, ">")), "|").alias("query_graph"))


@query("S6_union_graph", GRAPH + "SELECT source, relation, target FROM edges WHERE (relation = 'placed_by' AND target IN (SELECT target FROM edges WHERE relation = 'placed_by' AND source < 'order:5')) OR (relation = 'placed_by_inverse' AND source IN (SELECT target FROM edges WHERE relation = 'placed_by' AND source < 'order:5'))")
def s6(s, d):
    """One subgraph for each customer, its orders; those of customers with an early order are united."""
    e = rel(G.edges(s, d), "placed_by")
    subgraphs = e.groupBy(F.col("target").alias("id")).agg(F.collect_list(F.array("source", "relation", "target")).alias("graph"))
    return R.union_graph(subgraphs, e.where("source < 'order:5'").select(F.col("target").alias("id")).distinct())


@query("S7_nested_kb", "SELECT 'n' || n_nationkey AS source, CASE WHEN n_nationkey % 2 = 1 THEN 'part_of_inverse' ELSE 'part_of' END AS relation, 'r' || n_regionkey AS target FROM nation")
def s7(s, d):
    n = G.table(s, d, "nation")
    relation = F.struct(F.lit("part_of").alias("predicate"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("object"), F.when(F.col("n_nationkey") % 2 == 1, "backward").otherwise("forward").alias("direction"))
    entity = F.struct(F.col("n_name").alias("name"), F.array(F.lit("nation")).alias("instanceOf"), F.array(relation).alias("relations"))
    # one nested document, as large as the table of nations
    kb = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), entity.alias("e")).agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("id", "e"))).alias("entities"))).alias("value"))
    return R.nested_kb(s.read.text(lines(kb, folder(s))))


@query("S8_formats", "SELECT format, count(*) AS n, CAST(sum(s_suppkey) AS BIGINT) AS keys, round(sum(s_acctbal), 2) AS balance FROM supplier, (SELECT unnest(['csv', 'json', 'jsonl', 'parquet', 'tsv']) AS format) GROUP BY format")
def s8(s, d):
    t, root, out = G.table(s, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), folder(s), None
    ddl = "s_suppkey long, s_name string, s_acctbal double"
    for kind in ("csv", "json", "jsonl", "parquet", "tsv"):
        path = f"{root}/rows.{kind}"
        w = t.write.option("header", True).option("sep", "\t" if kind == "tsv" else ",")
        getattr(w, {"tsv": "csv", "jsonl": "json"}.get(kind, kind))(path) if kind != "json" else lines(t.groupBy(F.pmod("s_suppkey", F.lit(64))).agg(F.to_json(F.collect_list(F.struct(*t.columns)))).drop("pmod(s_suppkey, 64)").repartition(64), path)
        rows = R.rows_of(s, path, ddl).select(F.lit(kind).alias("format"), "s_suppkey", "s_acctbal")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("format").agg(F.count("*").alias("n"), F.sum("s_suppkey").alias("keys"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


_PARTS = ", ".join(f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::BIGINT::HUGEINT)" for i in range(4))
_DIGEST = f"SELECT sha256(concat_ws(',', count(*), {_PARTS})) AS digest FROM (SELECT sha256('{{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}}') AS h FROM nation)"


@query("S12_snapshot_digest", _DIGEST)
def s12(s, d):
    n, path = G.table(s, d, "nation"), folder(s)
    n.write.parquet(path)
    return R.canonical_digest(s.read.schema(n.schema).parquet(path))


@query("S13_replicas", f"SELECT replica, digest FROM ({_DIGEST}), (SELECT unnest(['e1', 'e2', 'e3']) AS replica)")
def s13(s, d):
    n, out = G.table(s, d, "nation"), None
    for name, path in R.replicate(n, folder(s), ["e1", "e2", "e3"]).items():
        row = R.canonical_digest(s.read.schema(n.schema).parquet(path)).withColumn("replica", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query("S14_private_lines", "SELECT s_suppkey, s_name FROM supplier")
def s14(s, d):
    t, path = G.table(s, d, "supplier").select("s_suppkey", "s_name"), folder(s) + "/lines"
    R.write_private(t, path)
    return s.read.schema(t.schema).json(path)


@query("S15_resume", "SELECT c_custkey, c_name FROM customer")
def s15(s, d):
    """A run that stopped after every third customer, and its resumption."""
    t, path = G.table(s, d, "customer").select("c_custkey", "c_name"), folder(s)
    R.append_missing(t.where("c_custkey % 3 = 0"), path, "c_custkey")
    R.append_missing(t, path, "c_custkey")
    return s.read.schema(t.schema).parquet(path)


@query("S19_log_metrics", "SELECT user_id, max(value) AS seconds, CAST(max(event_id) AS DOUBLE) AS megabytes, CAST(count(*) AS DOUBLE) AS rounds FROM events WHERE value IS NOT NULL AND value >= 0 GROUP BY user_id")
def s19(s, d):
    """One log for each user: a timer line for each event, and one line of data and rounds."""
    e = G.table(s, d, "events").where("value IS NOT NULL AND value >= 0")
    timers = e.select("user_id", F.format_string("Time = %s seconds", F.col("value").cast("string")).alias("value"))
    ends = e.groupBy("user_id").agg(F.max("event_id").alias("m"), F.count("*").alias("n"))
    ends = ends.select("user_id", F.format_string("Data sent = %d MB in ~%d rounds (party 0)", "m", "n").alias("value"))
    # every line names its log: a folder for each user would take a file for each user and task
    logs = timers.unionByName(ends).select(F.concat(F.coalesce(F.col("user_id").cast("string"), F.lit("")), F.lit("\t"), "value"))
    log, line = (F.split("value", "\t", 2)[i] for i in range(2))
    return R.log_metrics(s.read.text(lines(logs, folder(s))).select(log.try_cast("long").alias("user_id"), line.alias("value")), ["user_id"])


@query("S20_share_decode", "SELECT 'c' || c_custkey AS query_id, CAST(1 AS INTEGER) AS rank, 'score' AS field, CAST(c_custkey * 7 + 5 AS BIGINT) AS value FROM customer")
def s20(s, d):
    """Three shares of a number whose sum wraps around the modulus."""
    k, p = F.col("c_custkey").cast("long"), (1 << 61) - 1
    shares = F.array(F.lit(p - 11) - k, k * 3 + 9, k * 5 + 7)
    t = G.table(s, d, "customer").select(F.concat(F.lit("c"), k.cast("string")).alias("query_id"), F.lit(1).alias("rank"), F.lit("score").alias("field"), F.posexplode(shares).alias("party", "value"))
    return R.combined_shares(t, 3)


@query("V6_owners_once", "SELECT * FROM (VALUES ('o1', 'repeated'), ('o2', 'unexpected'), ('o9', 'missing')) t(owner, state)")
def v6(s, d):
    return R.owners_once(G.edges(s, d), ["o0", "o1", "o1", "o9"])


@query("V10_topology", """WITH roles AS (SELECT 'data_party' AS kind, n_name AS id, 'a' || n_regionkey AS authority, 'https://' || n_name AS endpoint FROM nation
  UNION ALL SELECT 'evaluator', CASE WHEN r_regionkey = 0 THEN 'NATION_3' ELSE r_name END, 'x', 'local://' || r_regionkey FROM region WHERE r_regionkey < 2)
SELECT CASE WHEN count(DISTINCT kind) > 1 THEN 'id_in_two_kinds' ELSE 'repeated_id' END AS error, id FROM roles GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'too_few_members', 'aggregator' UNION ALL SELECT 'too_few_authorities', unnest(['aggregator', 'evaluator'])
UNION ALL SELECT 'local_endpoint', id FROM roles WHERE endpoint LIKE 'local://%'""")
def v10(s, d):
    parties = G.table(s, d, "nation").select(F.lit("data_party").alias("kind"), F.col("n_name").alias("id"), F.concat(F.lit("a"), F.col("n_regionkey").cast("string")).alias("authority"), F.concat(F.lit("https://"), "n_name").alias("endpoint"))
    evaluators = G.table(s, d, "region").where("r_regionkey < 2").select(F.lit("evaluator"), F.when(F.col("r_regionkey") == 0, "NATION_3").otherwise(F.col("r_name")), F.lit("x"), F.concat(F.lit("local://"), F.col("r_regionkey").cast("string")))
    return R.topology_errors(parties.union(evaluators))


# ---- query texts: each nation asks in one of several forms ------------------------------------------------------------------


def texts(s, d, value):
    return G.table(s, d, "nation").select("n_nationkey", value.alias("text"))


def parsed(rows, f, ddl: str):
    """``f`` of the column ``text``: query texts are short and public."""

    @F.pandas_udf(ddl)
    def apply(text):
        return text.map(f)

    return rows.select("n_nationkey", apply("text").alias("out"))


def _cases(*values):
    """By the nation's number; each value is a format with one place for it."""
    k, out = F.col("n_nationkey"), None
    for i, v in reversed(list(enumerate(values))):
        text = F.replace(F.lit(v), F.lit("%"), k.cast("string"))
        out = text if out is None else F.when(k % len(values) == i, text).otherwise(out)
    return out


def _sql_cases(*values) -> str:
    arms = " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else "replace('" + v.replace("'", "''") + "', '%', n_nationkey::VARCHAR)") for i, v in enumerate(values))
    return f"CASE n_nationkey % {len(values)} {arms} END"


_GRAPHS = (
    '[["n%", "r1", "UNKNOWN x"], ["UNKNOWN x", "r2", "UNKNOWN y"]]',
    '[["n%", "r1", "UNKNOWN x 1"], ["UNKNOWN a", "r2", "UNKNOWN x 1"]]',
    '[["UNKNOWN x", "r1", "n%"], ["UNKNOWN y", "r2", "UNKNOWN x"]]',
    '[["n%", "r1", "UNKNOWN x"], ["m", "r2", "UNKNOWN y"]]',
)


@query("F16_hops", f"SELECT n_nationkey, {_sql_cases('n%>r1>r2', 'n%>r1>r2_inverse', 'n%>r1_inverse>r2_inverse', 'none')} AS hops FROM nation")
def f16(s, d):
    def hops(text: str) -> str:
        from pathweave.plans.planner import graph_from_text, two_hops

        try:
            h = two_hops(graph_from_text(text))
        except ValueError:
            return "none"
        return ">".join((h.source, h.relation_1, h.relation_2))

    return parsed(texts(s, d, _cases(*_GRAPHS)), hops, "string").select("n_nationkey", F.col("out").alias("hops"))


@query("F17_walk", f"SELECT n_nationkey, {_sql_cases('n%>UNKNOWN x>UNKNOWN y', 'n%>UNKNOWN x 1>UNKNOWN a', 'n%>UNKNOWN x>UNKNOWN y', 'none')} AS walk FROM nation")
def f17(s, d):
    def walk(text: str) -> str:
        from pathweave.plans.planner import graph_from_text, plan_walk

        try:
            steps = plan_walk(graph_from_text(text))
        except ValueError:
            return "none"
        return ">".join([steps[0].start, *(x.end for x in steps)])

    return parsed(texts(s, d, _cases(*_GRAPHS)), walk, "string").select("n_nationkey", F.col("out").alias("walk"))


_SPARQL = (
    "SELECT ?x WHERE { ns:m.% ns:a.b ?y . ?y ns:c.d ?x . }", "SELECT ?x WHERE { ?y ns:a.b ns:m.% . ?x ns:c.d ?y . }", "SELECT ?x WHERE { ns:m.% ns:a.b ?x . }",
    "SELECT ?x WHERE { ns:m.% ns:a.b ?y . ?y ns:c.d ?x . } ORDER BY ?x LIMIT 1", "SELECT ?x WHERE { ns:m.% ns:a.b ?y . ns:m.z ns:c.d ?x . }",
)


@query("F18_sparql", f"SELECT n_nationkey, {_sql_cases('two_hop', 'two_hop', 'triples_1', 'unsupported_clause', 'not_a_chain')} AS kind FROM nation")
def f18(s, d):
    def kind(text: str) -> str:
        from pathweave.plans.planner import classify_sparql

        return classify_sparql(text)

    return parsed(texts(s, d, _cases(*_SPARQL)), kind, "string").select("n_nationkey", F.col("out").alias("kind"))


_ASKS = (
    "who directed the movies written by [N%]", "what genres are the films directed by [N%]", "which films have the same actor of [N%]", "when were the movies starred by [N%] released", "say something about [N%]",
    "the movies [N%] acted in have what languages",
)


@query("F20_template_relations", f"SELECT n_nationkey, {_sql_cases('written_by', 'directed_by', 'starred_actors', 'starred_actors', None, 'starred_actors')} AS relation_1, {_sql_cases('directed_by', 'has_genre', 'starred_actors', 'release_year', None, 'in_language')} AS relation_2 FROM nation")
def f20(s, d):
    from ..functions.text import template_relations

    return texts(s, d, _cases(*_ASKS)).select("n_nationkey", template_relations(F.col("text")).alias("r")).select("n_nationkey", "r.relation_1", "r.relation_2")


def _program(functions, directions=("forward", "forward"), dependencies=None) -> str:
    inputs = {"Find": ["n%"], "FilterConcept": ["c"], "What": []}
    steps, hop = [], iter(directions)
    for i, f in enumerate(functions):
        steps.append({"function": f, "inputs": ["r", next(hop)] if f == "Relate" else inputs[f], "dependencies": ([i - 1] if i else []) if dependencies is None else dependencies})
    return json.dumps(steps)


_CHAIN = ("Find", "Relate", "FilterConcept", "Relate", "FilterConcept", "What")
_PROGRAMS = (_program(_CHAIN), _program(_CHAIN, ("forward", "sideways")), _program(_CHAIN[:3] + ("What",)), _program(_CHAIN, dependencies=[]), "{}")


@query("F21_program_shape", f"SELECT n_nationkey, {_sql_cases('chain', 'bad_relation_direction', 'relate_count:1', 'not_single_dependency_chain', 'program_not_list')} AS verdict FROM nation")
def f21(s, d):
    def verdict(text: str) -> str:
        from pathweave.plans.planner import program_rejection

        return program_rejection(json.loads(text)) or "chain"

    return parsed(texts(s, d, _cases(*_PROGRAMS)), verdict, "string").select("n_nationkey", F.col("out").alias("verdict"))


_ANSWERS = ('Sure: [["n%", "r", "UNKNOWN x"]] as asked', "first [1, 2], then [('n%', 'r', 'UNKNOWN y'), ('a', 'b', 'c')].", "[__import__('os').getcwd()]", "no graph")


@query("F29_graph_of_text", f"SELECT n_nationkey, {_sql_cases('n% r UNKNOWN x', 'n% r UNKNOWN y|a b c', 'none', 'none')} AS graph FROM nation")
def f29(s, d):
    def graph(text: str) -> str:
        from pathweave.plans.planner import graph_from_text

        try:
            return "|".join(" ".join(t) for t in graph_from_text(text))
        except ValueError:
            return "none"

    return parsed(texts(s, d, _cases(*_ANSWERS)), graph, "string").select("n_nationkey", F.col("out").alias("graph"))


@query("P9_orientation", GRAPH + "SELECT source, relation, target, CASE WHEN split_part(source, ':', 1) = 'region' THEN relation WHEN split_part(target, ':', 1) = 'region' THEN CASE WHEN relation LIKE '%_inverse' THEN left(relation, -8) ELSE relation || '_inverse' END END AS seen FROM edges WHERE relation IN ('in_region', 'in_region_inverse', 'supplier_in_nation')")
def p9(s, d):
    """Edges as seen from the region at one of their ends."""
    from ..operators.paths import orientation

    e = G.edges(s, d).where("relation IN ('in_region', 'in_region_inverse', 'supplier_in_nation')")
    return e.select("source", "relation", "target", orientation(G.kind_of("source") == "region", G.kind_of("target") == "region").alias("seen"))


_REDUNDANT = ('[["UNKNOWN movie 1", "is a", "films"], ["n%", "r", "UNKNOWN movie 1"], ["n%", "r", "UNKNOWN movie 1"]]', '[["n%", "r", "UNKNOWN x"], ["UNKNOWN x", "r_inverse", "n%"]]', '[["UNKNOWN movie 1", "type", "people"], ["n%", "r", "UNKNOWN movie 1"]]')


@query("P19_simplified", f"SELECT n_nationkey, {_sql_cases('n% r UNKNOWN movie 1', 'n% r UNKNOWN x', 'UNKNOWN movie 1 type people|n% r UNKNOWN movie 1')} AS graph FROM nation")
def p19(s, d):
    def graph(text: str) -> str:
        from pathweave.plans.planner import graph_from_text, simplify

        return "|".join(" ".join(t) for t in simplify(graph_from_text(text)))

    return parsed(texts(s, d, _cases(*_REDUNDANT)), graph, "string").select("n_nationkey", F.col("out").alias("graph"))


@query("P23_induced_subgraph", None)
def p23(s, d):
    """Forty nodes around those with the most edges, and the edges among them."""
    from ..operators.tables import induced_subgraph

    return induced_subgraph(G.edges(s, d).where("relation IN ('in_region', 'supplier_in_nation', 'in_nation')").select("source", "relation", "target"), 40)
