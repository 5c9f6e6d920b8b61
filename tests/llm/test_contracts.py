"""The registered queries on small tables: columns, folds, digests, and what SQL says."""

import hashlib
import math
import os
import random
import zlib

import numpy as np
import pytest

from pathweave.llm import common, decontaminate, language, pii, toxicity
from pathweave.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op2_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op3_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op4_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op5_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_personal_data": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op7_gif_columns": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op8_substring_index": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op9_pitman_yor": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
}


def fold(d, n):
    return zlib.crc32(str(d).encode()) % n


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    words = [a + b for a in ("ka", "lo", "mi", "ne", "tion", "ü") for b in ("ra", "st", "und", "er")]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 120))) for _ in range(60)]
    texts += [None, "", " \t\n", "12 34", texts[3], texts[3], texts[5] + " me@site.example.com or 10.0.0.1, +49 170 1234567, 4111 1111 1111 1111", "x" * 30_000, texts[7].replace(" ", "\n")]
    docs = [(i, t, ("en", "de", None)[i % 3], "src", len(t or "")) for i, t in enumerate(texts)]
    root = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").withColumn("node", common.F.lit(1)).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(0, texts[10][:150])], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, {d: t or "" for d, t, *_ in docs}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns_and_rows(spark, tables, name):
    root, texts = tables
    got = QUERIES[name](spark, root)
    kinds = dict(got.dtypes)
    for column in COLUMNS[name].split(", "):
        c, kind = column.split()
        assert kinds[c] == kind, (name, c, kinds[c])
    rows = got.collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    raw = {d: t.encode() for d, t in texts.items()}
    for r in rows:
        if "held_out" in kinds:
            assert r["held_out"] == (fold(r["doc_id"], 10 if name.startswith("op9") else 5) == 0)
        if name.startswith("op4"):
            assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in texts[r["doc_id"]])) and r["lang_pred"] in ("en", "de", "und")
        if "score" in kinds and not name.startswith("op9"):
            assert 0 <= r["score"] <= 1
        if "predicted" in kinds:
            assert r["predicted"] == int(r["score"] >= 0.5)
        if name.startswith("op7"):
            b = raw[r["doc_id"]]
            payload = b + b"\xff" * (-len(b) % 576 if b else 576)
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(b), len(payload), hashlib.sha256(payload).hexdigest())
            assert r["tail_crc32"] == zlib.crc32(payload[-32:])
        if name.startswith("op6"):
            base = [s for s in (r["spans"] or "").split(",") if s and not s.startswith("term:")]
            assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
            assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s.startswith(k + ":") for s in base) for k in pii.KINDS]
    if name.startswith("op6"):
        assert [r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for r in rows if "@" in texts[r["doc_id"]]] == [4]


def test_decontamination_query(spark, tables):
    root, texts = tables
    assert {r["doc_id"] for r in QUERIES["op10_decontamination"](spark, root).collect()} >= {10}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(tuple(r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


def test_features_of_short_texts_take_bounded_memory():
    import tracemalloc

    texts = [b"ab"] * 10_000
    tracemalloc.start()
    n = sum(len(language.gram_features(texts[part])) for part in language.few(texts))
    assert n == 10_000 and tracemalloc.get_traced_memory()[1] < 150 << 20
    tracemalloc.stop()


def test_sample_is_cut_exactly_and_does_not_depend_on_the_layout(spark):
    rows = [(i % 50 if i % 2 else i, f"l{i % 3}" if i % 7 else None, f"text {i}") for i in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, lang string, text string").where("lang IS NOT NULL")
    pick = lambda f: sorted(tuple(r) for r in language.sample_by_hash(f, "lang", 20, "s", ("doc_id", "text")).collect())
    got = pick(frame.repartition(7))
    assert got == pick(frame.repartition(2)) and {lang: sum(r[1] == lang for r in got) for lang in ("l0", "l1", "l2")} == dict.fromkeys(("l0", "l1", "l2"), 20)
    many = spark.createDataFrame([(i, f"l{i % 300}", f"text {i}") for i in range(900)], "doc_id long, lang string, text string")
    assert {r["lang"] for r in language.sample_by_hash(many, "lang", 20, "s", ("doc_id", "text"), total=600).collect()} == {f"l{i}" for i in range(300)}


def test_packed_arrays_come_back():
    rng = np.random.default_rng(1)
    for kind in (np.uint8, np.uint32, np.int32, np.int64, np.uint64):
        for n in (0, 1, 1000):
            a = rng.integers(0, 200, n).astype(kind)
            assert (common.unpacked(common.packed(a), kind) == a).all()
    top = np.sort(rng.integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    assert (common.risen(common.rising(top), np.uint64) == top).all()


def test_id_filter_keeps_all_that_may_match(spark):
    rows = spark.createDataFrame([(i if i % 10 else None, "t") for i in range(2000)], "doc_id long, text string")
    few = common.IdFilter(spark.createDataFrame([(i,) for i in range(1, 2000, 50)] + [(None,)], "id long"))
    kept, rest = few.rows(rows, "doc_id"), few.rows(rows, "doc_id", among=False)
    assert {r[0] for r in kept.collect()} >= set(range(1, 2000, 50)) and kept.count() < 60 and kept.count() + rest.count() == 2000
    assert common.IdFilter(rows.limit(0).select("doc_id")).rows(rows, "doc_id").count() == 0


def test_quads_in_linear_time():
    import time

    assert list(pii.dotted_quads("1.2.3.4.5.6.7.8 300.1.1.1 a1.1.1.1b 1.2.3")) == [(0, 7), (8, 15), (27, 34)]
    began = time.time()
    assert list(pii.dotted_quads("." + "1" * 300_000)) == [] and time.time() - began < 1


def test_terms_disclose_shared_parts(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(30)), 0) for i in range(300)]
    # every mailbox stands once; the name stands wherever the domain does
    rows += [(1000 + i, f"w1 w{i} Quendolan wrote from box{i}@rare.example.org w3 w{i + 9}", 0) for i in range(5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, node int").repartition(3)
    spans = {r["doc_id"]: r["terms"] for r in pii.detect(frame).collect()}
    text = {r[0]: r[1] for r in rows}
    found = {d: [text[d][s["start"] : s["end"]] for s in t or []] for d, t in spans.items()}
    assert all("Quendolan" in found[1000 + i] for i in range(5)) and not any(found[i] for i in range(300))


def test_distances_together_equal_those_one_by_one():
    rng = np.random.default_rng(4)
    items = [bytes(rng.integers(97, 101, rng.integers(1, 40)).astype(np.uint8)) for _ in range(80)]
    texts = [bytes(rng.integers(97, 101, rng.integers(0, 60)).astype(np.uint8)) or b"z" for _ in items]
    best, end = decontaminate.least_distances(items, texts)
    assert [decontaminate.least_distance(i, t) for i, t in zip(items, texts, strict=True)] == list(zip(best.tolist(), end.tolist(), strict=True))


def test_scores_do_not_move_with_the_share_of_the_sample():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    text = lambda toxic: " ".join(rng.choices(words, k=30) + (["vileword"] if toxic and rng.random() < 0.8 else [])).encode()
    y = np.array([1] * 100 + [0] * 100)
    x = [toxicity.features(text(t)) for t in y]
    even = toxicity.fit(x, y, np.ones(200))
    rare = toxicity.fit(x, y, np.where(y == 1, 0.1, 1.9))
    plain = text(0)
    assert rare.score(plain) < even.score(plain) < 0.5 and math.isfinite(rare.score(b"")) and even.score(b"vileword here") > 0.5


def test_index_is_opened_again_and_compacted(spark, tmp_path):
    from pathweave.llm.substring_index import FingerprintIndex, classes_of

    batch = lambda *rows: spark.createDataFrame(rows, FingerprintIndex.schema)
    root = f"file://{tmp_path}/index"
    first = FingerprintIndex.open(spark, root)
    first.append(batch((1, 10, 5, 1), (2, 20, 6, 1)))
    again = FingerprintIndex.open(spark, root)
    fresh = again.append(batch((1, 10, 9, 1), (3, 30, 9, 2)))
    assert {tuple(r) for r in classes_of(again, fresh).collect()} == {(1, 10, 5, 1), (3, 30, 9, 1)}
    again.compact()
    last = FingerprintIndex.open(spark, root)
    assert {k: len(v) for k, v in last.levels.items()} == {1: 1}
    assert {tuple(r) for r in last.runs()[0].collect()} == {(1, 10, 5, 2), (2, 20, 6, 1), (3, 30, 9, 2)}


def test_lexicon_votes_without_support():
    y = np.array([1, 1] + [0] * 60)
    x = [toxicity.features(t) for t in [b"you idiot there", b"an idiot again"] + [f"plain words {i}".encode() for i in range(60)]]
    assert toxicity.fit(x, y, np.ones(62)).score(b"that idiot") > toxicity.fit(x, y, np.ones(62)).score(b"plain words")
