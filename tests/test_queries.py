"""Every registered query of the graph engine against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from pathweave.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    value = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 6) if isinstance(v, (int, float)) else str(v)
    return sorted((tuple(map(value, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_routing_covers_every_twentieth_vector(spark, tmp_path):
    spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 200").write.parquet(f"{tmp_path}/embeddings.parquet")
    bands = {r["vec_id"]: set(r["bands"].split()) for r in QUERIES["F8_simhash"](spark, str(tmp_path)).collect()}
    v = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()}
    got = {(r["query_id"], r["vec_id"]): r["penalty"] for r in QUERIES["F12_routing"](spark, str(tmp_path)).collect()}
    assert set(got) == {(q, x) for q in v if q % 20 == 0 for x in v if bands[q] & bands[x]}
    assert all(abs(p - math.dist(v[q], v[x])) < 1e-6 for (q, x), p in got.items())
    assert len({q for q, _ in got}) == 10


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["F23_rows_to_evidence", "P18_handle_resolve"])
def test_a_handle_names_all_its_edges(spark, monkeypatch, name):
    """Handles of few bits, which edges of different relations share."""
    from pathweave.sources import graph

    handle, few = graph.evidence_handle(), 20011
    monkeypatch.setattr(graph, "evidence_handle", lambda: handle % few + 1)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    sql = ORACLE_SQL[name].replace("::BIGINT + 1 AS evidence", f"::BIGINT + 1) % {few} + 1 AS evidence").replace("*, ('0x'", "*, (('0x'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(sql).df()
    assert len(want) > 2000 and rows(got) == rows(want)


def test_routing_deals_no_pairs_and_leaves_out_what_has_no_vector(spark, tmp_path):
    vectors = [(i, [float((i * 7 + k * 3) % 11 - 5) for k in range(64)]) for i in range(60)] + [(80, None), (81, []), (100, [])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = QUERIES["F12_routing"](spark, str(tmp_path))
    assert rows(got.toPandas()) == rows(con.sql(ORACLE_SQL["F12_routing"]).df())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "hashpartitioning" not in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_logs_take_no_file_a_user(spark, tmp_path, monkeypatch):
    from pathweave.plans import source_queries

    monkeypatch.setattr(source_queries, "folder", lambda s: f"{tmp_path}/logs")
    assert QUERIES["S19_log_metrics"](spark, SF).count() > 0
    assert list(tmp_path.rglob("part-*")) and not list(tmp_path.rglob("user_id=*"))


def test_pairs_of_one_label_are_made_by_many_tasks(spark, tmp_path):
    spark.range(400).selectExpr("id AS p_partkey", "' One Name' AS p_name", "concat('b', id % 3) AS p_brand").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    got = QUERIES["J14_alignment"](spark, str(tmp_path))
    assert rows(got.toPandas()) == rows(con.sql(ORACLE_SQL["J14_alignment"]).df())
    assert sum(any(True for _ in part) for part in got.rdd.glom().collect() if part) > 1


def test_pairs_of_labels_pass_no_driver(spark, tmp_path, monkeypatch):
    from pathweave.plans import graph_queries

    monkeypatch.setattr(graph_queries, "CHUNK", 4)
    part = spark.range(600).selectExpr("id DIV 2 * 17 AS p_partkey", "CASE WHEN id % 50 = 7 THEN NULL WHEN id % 3 = 0 THEN ' One Name' WHEN id % 3 = 1 THEN 'one name ' ELSE concat('n', id) END AS p_name", "CASE WHEN id % 50 = 9 THEN NULL ELSE concat('b', id % 5) END AS p_brand")
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    got = QUERIES["J14_alignment"](spark, str(tmp_path))
    assert rows(got.toPandas()) == rows(con.sql(ORACLE_SQL["J14_alignment"]).df())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
