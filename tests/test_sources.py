import hashlib
import hmac
import json
import math
import re

import pytest

from pathweave.functions import text as X
from pathweave.operators import paths as P
from pathweave.operators import tables as O
from pathweave.sources import graph as G
from pathweave.sources import readers as R


def test_owner_edges_and_malformed_rows(spark, tmp_path):
    good = [{"source": "a", "relation": "r", "target": "b", "evidence": 1, "score": 2}]
    (tmp_path / "x.json").write_text(json.dumps(good))
    assert R.owner_edges(spark, {"x": str(tmp_path / "x.json")}).collect()[0]["owner"] == "x"
    (tmp_path / "y.json").write_text(json.dumps([{"source": "a", "relation": "r", "target": "b", "score": 2}]))
    with pytest.raises(Exception, match="malformed"):
        R.owner_edges(spark, {"y": str(tmp_path / "y.json")}).collect()


def test_text_readers(spark, tmp_path):
    (tmp_path / "kb.txt").write_text("a|r|b\na|r|b\nc|s|d\n")
    assert R.delimited_triples(spark, str(tmp_path / "kb.txt")).count() == 4
    (tmp_path / "qa.txt").write_text("who made [X Y]\tp|q\n")
    row = R.questions_with_answers(spark, str(tmp_path / "qa.txt")).collect()[0]
    assert (row["topic"], row["answers"]) == ("X Y", ["p", "q"])
    (tmp_path / "q.jsonl").write_text("\n".join(json.dumps({"id": i, "split": "dev", "question": "?"}) for i in ("1", "1")))
    with pytest.raises(ValueError, match="repeated"):
        R.question_rows(spark, str(tmp_path / "q.jsonl"), ["dev"])
    kb = {"entities": {"e": {"name": "E", "instanceOf": [], "relations": [{"predicate": "p", "object": "f", "direction": "backward"}]}}}
    got = R.nested_kb(spark.createDataFrame([(json.dumps(kb),)], "value string")).collect()
    assert [tuple(r) for r in got] == [("e", "p_inverse", "f")]
    with pytest.raises(ValueError):
        R.rows_of(spark, "x.pickle", "a int")


def test_union_graph_needs_every_id(spark):
    g = spark.createDataFrame([("1", [["a", "r", "b"]]), ("2", [["a", "r", "b"]])], "id string, graph array<array<string>>")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert R.union_graph(g, ids("1", "2")).count() == 2
    with pytest.raises(ValueError, match="no subgraph"):
        R.union_graph(g, ids("1", "3"))


def test_digest_ignores_order_and_resume_appends_once(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    assert R.canonical_digest(a).collect() == R.canonical_digest(a.orderBy("v", ascending=False).repartition(3)).collect()
    assert R.canonical_digest(a).collect() != R.canonical_digest(a.union(a)).collect()
    assert [R.append_missing(a, str(tmp_path / "out"), "id") for _ in range(2)] == [2, 0]


def test_shares_and_logs(spark):
    rows = [("q", 1, "score", p, v) for p, v in enumerate((5, (1 << 61) - 3, 7))]
    df = spark.createDataFrame(rows, "query_id string, rank int, field string, party int, value long")
    assert R.combined_shares(df, 3).collect()[0]["value"] == (5 + (1 << 61) - 3 + 7) % ((1 << 61) - 1)
    with pytest.raises(Exception, match="missing"):
        R.combined_shares(df.where("party < 2"), 3).collect()
    log = spark.createDataFrame([("Time = 1.5 seconds",), ("Data sent = 20.25 MB in ~7 rounds",)], "value string")
    assert tuple(R.log_metrics(log).collect()[0]) == (1.5, 20.25, 7.0)
    assert R.sparql_bindings(json.dumps({"results": {"bindings": [{"mid": {"value": "m"}, "answer": {"value": "a"}}] * 2}})) == [("m", "a")]


def test_functions(spark):
    one = spark.range(1)
    for key in (b"k", b"x" * 100):
        got = one.select(X.hmac_sha256(key, X.F.lit("Grüße"))).collect()[0][0]
        assert got == hmac.new(key, "Grüße".encode(), hashlib.sha256).hexdigest()
    modes = {m: one.select(X.is_unknown(X.F.lit("unknown x"), m)).collect()[0][0] for m in ("contains", "prefix", "prefix_upper", "prefix_lower")}
    assert modes == {"contains": False, "prefix": False, "prefix_upper": True, "prefix_lower": True}


def value(spark, c):
    return spark.range(1).select(c.alias("x")).collect()[0][0]


def test_normal_form_and_variables(spark):
    lit = X.F.lit
    assert value(spark, X.normalize_text(lit("\t A  b\x1c\nC  Straße \u3000"))) == "a b c strasse"
    types = {"UNKNOWN movie 1": "movie", "UNKNOWN": "", "the UNKNOWN big Film 22 ": "the big Film", "x 3": "x", "": "", "UNKNOWN a UNKNOWN b": "a UNKNOWN b"}
    assert {t: value(spark, X.unknown_type(lit(t))) for t in types} == types
    assert [value(spark, X.canonical_type(lit(t))) for t in (" People ", "Town")] == ["actor", "town"]


def test_buckets_worked_by_hand(spark):
    lit = X.F.lit
    want = {
        "people.person.place_of_birth": "fb:path:people.person.place_of_birth fb:domain:people fb:type:people.person fb:property:place_of_birth fb:type_property:person.place_of_birth "
        "tok:people tok:person tok:place tok:of tok:birth bigram:people:person bigram:person:place bigram:place:of bigram:of:birth",
        "film.starred": "fb:path:film.starred fb:domain:film fb:type:film.starred tok:film tok:starred alias:actor bigram:film:starred",
        "Acted in the Movie": "tok:acted tok:in tok:the tok:movie alias:actor bigram:acted:in bigram:in:the bigram:the:movie",
        "": "",
    }
    assert {t: " ".join(value(spark, X.relation_buckets(lit(t)))) for t in want} == want
    assert value(spark, X.entity_buckets(lit("The_Lord of the Rings the"))) == ["entity_bigram:lord:of", "entity_bigram:of:rings", "entity_tok:lord", "entity_tok:of", "entity_tok:rings"]
    got = value(spark, X.query_buckets(X.relation_buckets(lit("who starred in the film")), 5))
    assert got == ["alias:actor", "tok:film", "tok:starred", "bigram:in:the", "bigram:starred:in"]
    with pytest.raises(ValueError, match="mode"):
        X.relation_buckets(lit("x"), "fuzzy")


def test_embedding_is_the_signed_hash(spark):
    def embed(text, dims=128):
        words = re.findall("[a-z0-9]+", text.replace("_", " ").casefold())
        joined = "".join(words)
        out = [0.0] * dims
        for f in ["tok:" + w for w in words] + ["tri:" + joined[i : i + 3] for i in range(len(joined) - 2)] or ["empty"]:
            h = hashlib.sha256(f.encode()).digest()
            out[int.from_bytes(h[:4], "big") % dims] += 1 if h[4] & 1 else -1
        n = math.sqrt(sum(x * x for x in out))
        return [x / n for x in out] if n else out

    for text in ("Hello_World again", "a", "", "!!"):
        assert value(spark, X.hash_embedding(X.F.lit(text))) == pytest.approx(embed(text))


def test_bucket_hash_and_descriptors(spark):
    lit = X.F.lit
    for tag in (1, 123456789, (1 << 40) - 1):
        for bits in (0, 1, 20):
            want = ((tag * 0x9E3779B97F4A7C15) % (1 << 64)) >> (64 - bits) if bits else 0
            assert value(spark, X.bucket_of(lit(tag).cast("long"), 1 << bits)) == want
    packed = value(spark, X.pack_descriptor(lit(77).cast("long"), lit(3), 20))
    assert [value(spark, c) for c in X.unpack_descriptor(lit(packed).cast("long"), 20)] == [77, 3]
    with pytest.raises(Exception, match="40 bits"):
        value(spark, X.bucket_of(lit(1 << 40), 4))
    with pytest.raises(Exception, match="out of range"):
        value(spark, X.key_tag(lit(1), lit(9), 7))


def test_reused_nodes_and_templates(spark):
    arrays = lambda *x: X.F.array(*map(X.F.lit, x))
    assert [value(spark, X.reuses_node(arrays(*x))) for x in ("abc", "aba")] == [False, True]
    pair = lambda q: tuple(value(spark, X.template_relations(X.F.lit(q))) or ())
    assert pair("who directed the films acted by [Tom Hanks]") == ("starred_actors", "directed_by")
    assert pair("films that share directors with [X]") == ("directed_by", "directed_by")
    assert pair("hello [x]") == ()


def test_prepared_graph_is_the_graph_and_filters_reach_one_table(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    one = G.edges(spark, d).where("relation = 'in_region_inverse' AND source = 'region:0'")
    assert set(re.findall(r"(\w+)[.]parquet", plan(one))) == {"nation"} and "Exchange" not in plan(one)
    two = P.two_hop(e := G.edges(spark, d), P.chain_queries(e, "in_region_inverse", "in_nation_inverse"))
    assert set(re.findall(r"(\w+)[.]parquet", plan(two))) == {"nation", "customer"}
    plain = G.edges(spark, d)
    G.prepare(spark, d, f"file://{tmp_path}/graph")
    try:
        stored = G.edges(spark, d)
        assert stored.count() == plain.count() and plain.exceptAll(stored).isEmpty()
        assert "PartitionFilters: [isnotnull(relation" in plan(stored.where("relation = 'in_nation'"))
    finally:
        G.forget(spark, d)


def test_configuration(spark, tmp_path):
    raw = {"owners": ["a", "b"], "entities": {"x": 1}, "relations": {"r": 1, "s": 2}, "fanout_per_owner": 4, "top_k": 2}
    (tmp_path / "c.json").write_text(json.dumps(raw))
    assert [tuple(r) for r in R.load_config(spark, str(tmp_path / "c.json")).dimension(spark, "relations").collect()] == [("r", 1), ("s", 2)]
    for change in ({"owners": ["a", "a"]}, {"top_k": 0}, {"relations": {"r": 1, "s": 1}}, {"surplus": 1}, {"relation_fanout_per_owner": True}):
        with pytest.raises((ValueError, TypeError)):
            R.PublicConfig.of(raw | change)
    with pytest.raises(ValueError):
        R.PublicConfig.of([])


def test_replicas_and_private_lines(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    assert set(R.replicate(rows, f"file://{tmp_path}/r", ["a", "b"])) == {"a", "b"}
    with pytest.raises(ValueError):
        R.replicate(rows, f"file://{tmp_path}/q", ["a", "a"])
    R.write_private(rows, f"file://{tmp_path}/p")
    parts = list((tmp_path / "p").glob("part-*"))
    assert parts and all(f.stat().st_mode & 0o777 == 0o600 for f in parts) and [f.name for f in tmp_path.glob("p.*")] == []
    with pytest.raises(ValueError, match="exists"):
        R.write_private(rows, f"file://{tmp_path}/p")


def test_running_totals_split_hot_groups(spark):
    rows = spark.createDataFrame([("hot" if i % 10 else f"g{i}", i, i % 7) for i in range(300)], "g string, k int, v int").repartition(6)
    got = O.running_totals(rows, ["g"], ["k"], O.F.col("v"), "before").collect()
    assert all(r["before"] == sum(i % 7 for i in range(r["k"]) if ("hot" if i % 10 else f"g{i}") == r["g"]) for r in got) and len(got) == 300


def test_contiguous_ids_and_closure(spark):
    rows = spark.createDataFrame([(f"n{i:03d}",) for i in range(50)][::-1], "name string").repartition(5)
    assert [(r["name"], r["id"]) for r in O.contiguous_ids(rows, ["name"]).orderBy("id").collect()] == [(f"n{i:03d}", i + 1) for i in range(50)]
    up = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "child string, parent string")
    assert P.closure(up, "child", "parent").count() == 9 + 4


def test_generators(spark):
    assert R.ring(spark, 10, 25, 3).select("source").distinct().count() == 10
    assert R.skewed(spark, 20, 2, 5, 3).groupBy("source").count().where("count = 5").count() == 2
