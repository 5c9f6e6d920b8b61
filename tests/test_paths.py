"""Two-hop answers on a ten-query graph of three owners, against values worked out by hand, and against brute force."""

import random

import pytest

from pathweave.operators import paths as P
from pathweave.operators import tables as O
from pathweave.plans import planner as L
from pathweave.sources import graph as G

#: The edges of the small graph that answers are known for, and its best four paths of each query.
RT, DW, TW = "referred_to", "diagnosed_with", "treated_with"
ROWS = [
    ("a", "alice", RT, "bob", 5), ("a", "bob", DW, "cancer", 7), ("a", "bob", TW, "drug_x", 4), ("a", "carol", RT, "dave", 2), ("a", "dave", DW, "flu", 6),
    ("b", "alice", RT, "eve", 8), ("b", "eve", DW, "flu", 3), ("b", "eve", TW, "drug_y", 9), ("b", "bob", DW, "flu", 2), ("b", "carol", RT, "bob", 4),
    ("c", "alice", RT, "carol", 1), ("c", "alice", DW, "cancer", 10), ("c", "carol", DW, "flu", 5), ("c", "cancer", TW, "drug_x", 8), ("c", "flu", TW, "drug_y", 7), ("c", "dave", TW, "drug_x", 2),
]
QUERIES = [("q0", "alice", RT, DW), ("q1", "alice", RT, TW), ("q2", "carol", RT, DW), ("q3", "carol", RT, TW), ("q4", "alice", DW, TW), ("q5", "bob", DW, TW), ("q6", "dave", DW, TW), ("q7", "eve", DW, TW), ("q8", "bob", TW, DW), ("q9", "frank", RT, DW)]
TOP = {
    "q0": [("bob", "cancer", 12), ("eve", "flu", 11), ("bob", "flu", 7), ("carol", "flu", 6)], "q1": [("eve", "drug_y", 17), ("bob", "drug_x", 9)],
    "q2": [("bob", "cancer", 11), ("dave", "flu", 8), ("bob", "flu", 6)], "q3": [("bob", "drug_x", 8), ("dave", "drug_x", 4)], "q4": [("cancer", "drug_x", 18)],
    "q5": [("cancer", "drug_x", 15), ("flu", "drug_y", 9)], "q6": [("flu", "drug_y", 13)], "q7": [("flu", "drug_y", 10)], "q8": [], "q9": [],
}
DEDUP = {"q0": 2, "q1": 2, "q2": 2, "q3": 1, "q4": 1, "q5": 2, "q6": 1, "q7": 1, "q8": 0, "q9": 0}


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(o, s, r, t, 1000 + i, c) for i, (o, s, r, t, c) in enumerate(ROWS)], G.EDGE)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(QUERIES, G.QUERY)


def test_top_four(edges, queries):
    got = {}
    for r in P.ranked(P.two_hop(edges, queries), 4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["mid"], r["target"], r["score"]))
    assert got == {q: v for q, v in TOP.items() if v}


def test_terminal_dedup_and_padding(edges, queries):
    best = P.terminal_dedup(P.two_hop(edges, queries))
    rows = P.padded_topk(best, queries, 4).collect()
    assert len(rows) == 40
    for q, n in DEDUP.items():
        own = [r for r in rows if r["query_id"] == q]
        assert sorted(r["rank"] for r in own) == [1, 2, 3, 4] and sum(r["valid"] for r in own) == n
        assert all(r["score"] == r["left_evidence"] == r["right_evidence"] == 0 for r in own if not r["valid"])


def test_random_graphs_against_brute_force(spark):
    rng = random.Random(5)
    rows = list({(f"o{rng.randrange(3)}", f"n{rng.randrange(8)}", rng.choice("rs"), f"n{rng.randrange(8)}"): None for _ in range(60)})
    edges = [(*r, i + 1, rng.randrange(1, 9)) for i, r in enumerate(rows)]
    qs = [(f"n{i}{a}{b}", f"n{i}", a, b) for i in range(8) for a in "rs" for b in "rs"]
    want = {}
    for q, s, a, b in qs:
        found = [(-(x[5] + y[5]), x[0], x[3], x[4], y[0], y[3], y[4]) for x in edges if x[1] == s and x[2] == a for y in edges if y[1] == x[3] and y[2] == b]
        want[q] = [(f[2], f[5], -f[0]) for f in sorted(found)[:5]]
    got = {}
    for r in P.ranked(P.two_hop(spark.createDataFrame(edges, G.EDGE), spark.createDataFrame(qs, G.QUERY)), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["mid"], r["target"], r["score"]))
    assert got == {q: v for q, v in want.items() if v}


def test_checks_fail_closed(spark, edges):
    O.enforce(edges, max_fanout=2)
    with pytest.raises(ValueError, match="repeated_handle"):
        O.enforce(edges.union(edges.limit(1)))
    with pytest.raises(ValueError, match="fanout"):
        O.enforce(edges, max_fanout=0)
    with pytest.raises(ValueError, match="unknown_entity"):
        O.enforce(edges, entities=spark.createDataFrame([("alice",)], "entity string"))


def test_inverse_is_an_involution_and_owner_follows(spark):
    t = spark.createDataFrame([("a", "likes", "b")], "source string, relation string, target string")
    both = G.with_inverses(t)
    assert {tuple(r) for r in both.collect()} == {("a", "likes", "b"), ("b", "likes_inverse", "a")}
    assert {tuple(r) for r in G.with_inverses(both).distinct().collect()} == {tuple(r) for r in both.collect()}
    for strategy in ("subject", "edge", "relation_domain"):
        assert len({r["o"] for r in both.select(G.owner_by(strategy, 7).alias("o")).collect()}) == 1


def test_owner_hash_is_sha256_big_endian(spark):
    import hashlib

    got = spark.createDataFrame([("x",), ("Straße",)], "t string").select("t", G.hash_bucket(G.F.col("t"), 11).alias("b")).collect()
    assert all(r["b"] == int.from_bytes(hashlib.sha256(r["t"].encode()).digest()[:8], "big") % 11 for r in got)


def test_planner():
    walk = L.plan_walk([("UNKNOWN m 1", "has_genre", "UNKNOWN g 1"), ("Tom", "acted_in", "UNKNOWN m 1")])
    assert [(s.start, s.end, s.reverse) for s in walk] == [("Tom", "UNKNOWN m 1", False), ("UNKNOWN m 1", "UNKNOWN g 1", False)]
    assert L.two_hops([("UNKNOWN m", "starred", "Tom"), ("UNKNOWN m", "genre", "UNKNOWN g")]) == L.Hops("Tom", "starred_inverse", "genre")
    for bad in ([("UNKNOWN a", "r", "UNKNOWN b")], [("a", "r", "UNKNOWN b"), ("c", "r", "UNKNOWN d")], [("UNKNOWN b", "r", x) for x in "xyz"], []):
        with pytest.raises(ValueError):
            L.plan_walk(bad)
    assert L.simplify([("UNKNOWN movie 1", "is a", "films"), ("a", "r", "UNKNOWN movie 1"), ("UNKNOWN movie 1", "r_inverse", "a")]) == [("a", "r", "UNKNOWN movie 1")]


def test_pattern_with_cycle(edges):
    rows = L.match([("alice", RT, "UNKNOWN x"), ("UNKNOWN x", DW, "UNKNOWN y"), ("alice", DW, "UNKNOWN y")], edges).collect()
    assert [(r["v0"], r["v1"], r["score"]) for r in rows] == [("bob", "cancer", 22)]


def test_parsers():
    text = 'SELECT ?y WHERE { <http://e.org/tom> ns:film.actor ?x . ?x ns:film.genre ?y . FILTER(?x != ?y) }'
    assert L.classify_sparql(text) == "two_hop" and L.sparql_triples(text)[0] == ("tom", "film.actor", "?x")
    assert L.classify_sparql("SELECT ?x WHERE { ns:a ns:b ?x } LIMIT 3") == "unsupported_clause"
    assert L.graph_from_text('Sure: [["a", "r", "UNKNOWN x"]] done') == [("a", "r", "UNKNOWN x")]
    with pytest.raises(ValueError):
        L.graph_from_text("[__import__('os')]")
    assert not L.is_chain_program([{"function": "Find", "dependencies": []}])
    assert L.two_hops([("a", "r", "UNKNOWN x"), ("UNKNOWN x", "s", "b")]) == L.Hops("a", "r", "s")  # a constant at the far end


def test_pattern_parts_meet_late_or_fail(edges):
    # listed so that a product would come first if edges were taken as they stand
    graph = [("alice", RT, "UNKNOWN x"), ("carol", RT, "UNKNOWN y"), ("UNKNOWN x", DW, "UNKNOWN z"), ("UNKNOWN y", DW, "UNKNOWN z")]
    got = {(r["v0"], r["v1"], r["v2"]) for r in L.match(graph, edges).collect()}
    hop = lambda s, r: {t for _, a, b, t, _ in ROWS if (a, b) == (s, r)}
    assert got == {(x, y, z) for x in hop("alice", RT) for y in hop("carol", RT) for z in hop(x, DW) & hop(y, DW)}
    plan = L.match(graph, edges)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan
    with pytest.raises(ValueError, match="parts"):
        L.match([("UNKNOWN a", RT, "UNKNOWN b"), ("UNKNOWN c", DW, "UNKNOWN d")], edges)


def test_induced_subgraph_is_the_greedy_one(spark):
    rng = random.Random(4)
    rows = sorted({(f"n{rng.randrange(30)}", rng.choice("rs"), f"n{rng.randrange(30)}") for _ in range(60)})
    near, count = {}, {}
    for s, _, t in rows:
        for a, b in ((s, t), (t, s)):
            near.setdefault(a, set()).add(b)
            count[a] = count.get(a, 0) + 1
    chosen = set()
    for n in sorted(near, key=lambda n: (-count[n], n)):
        if len(chosen | {n} | near[n]) <= 12:
            chosen |= {n} | near[n]
    for n in sorted(near):
        if len(chosen) < 12:
            chosen.add(n)
    got = {tuple(r) for r in O.induced_subgraph(spark.createDataFrame(rows, "source string, relation string, target string"), 12).collect()}
    assert got == {r for r in rows if {r[0], r[2]} <= chosen}
