"""The same graph in SQL, as the beginning of every oracle statement."""

_PARTS = [
    ("customer", "customer", "c_custkey", "in_nation", "nation", "c_nationkey"),
    ("supplier", "supplier", "s_suppkey", "supplier_in_nation", "nation", "s_nationkey"),
    ("nation", "nation", "n_nationkey", "in_region", "region", "n_regionkey"),
    ("orders", "order", "o_orderkey", "placed_by", "customer", "o_custkey"),
    ("lineitem", "order", "l_orderkey", "has_part", "part", "l_partkey"),
    ("lineitem", "order", "l_orderkey", "supplied_by", "supplier", "l_suppkey"),
    ("events", "user", "user_id", "performed", "event", "event_type"),
]
_ROWS = " UNION ALL ".join(f"SELECT DISTINCT '{k1}:' || {c1} AS source, '{rel}' AS relation, '{k2}:' || {c2} AS target FROM {name}" for name, k1, c1, rel, k2, c2 in _PARTS)


def bucket(expr: str, n: int) -> str:
    return f"(('0x' || substr(sha256({expr}), 1, 16))::UBIGINT % {n})"


GRAPH = f"""WITH triples AS ({_ROWS}),
both_ways AS (
  SELECT source, relation, target, source AS head, relation AS forward, target AS tail FROM triples
  UNION ALL
  SELECT target, relation || '_inverse', source, source, relation, target FROM triples),
handled AS (SELECT *, ('0x' || substr(sha256(source || '|' || relation || '|' || target), 1, 12))::BIGINT + 1 AS evidence FROM both_ways),
edges AS MATERIALIZED (
  SELECT 'o' || {bucket("head", 3)} AS owner, source, relation, target, evidence, CAST(1 + evidence % 9 AS INTEGER) AS score, head, forward, tail FROM handled)
"""

#: Two-hop queries: all regions to their customers, and all orders to their nations.
REGION_PATHS = """, paths AS (
  SELECT a.source AS query_id, a.target AS mid, b.target AS target, a.evidence AS left_evidence, b.evidence AS right_evidence,
         a.owner AS owner_1, b.owner AS owner_2, CAST(a.score + b.score AS BIGINT) AS score
  FROM edges a JOIN edges b ON a.target = b.source
  WHERE a.relation = 'in_region_inverse' AND b.relation = 'in_nation_inverse')
"""
ORDER_PATHS = REGION_PATHS.replace("in_region_inverse", "placed_by").replace("in_nation_inverse", "in_nation")
RANK = "score DESC, owner_1, mid, left_evidence, owner_2, target, right_evidence"
