"""Operators for training data against brute force on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from pathweave.llm import decontaminate, gif, jaccard, language, packing, pii, pitman_yor, substring_index, suffix_dedup, toxicity

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "stra") for b in ("ne", "ru", "", "tion") for c in ("s", "", "der")]


def words(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [words(rng, rng.randint(1, 260)) for _ in range(40)]
    out = base + [base[3], base[3], base[5] + " " + base[6], base[7].replace(" ", "  \n", 3), None, "", "   ", "abc" * 120, "Ünï 日本語 " * 30]
    near = base[10].split()
    if len(near) > 5:
        near[2] = "changed"
    out += [" ".join(near), words(rng, 4000)]
    table = [(i * 3, t, "en", "s", 0) for i, t in enumerate(out)]
    return [*table, table[4], (None, base[1], None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    # columns that clash with the operators' own names ride along
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.selectExpr("*", "1 AS anchor", "'x' AS tag", "2 AS n", "3 AS chunk", "4 AS length", "5 AS node", "6 AS score").repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect() if r["doc_id"] is not None}


def distinct(rows):
    return {d: (t or "") for d, t, *_ in rows if d is not None}


def test_substring_index_removes_what_brute_force_removes(docs, rows, empty):
    texts = distinct(rows)
    split = {d: t.encode().split() for d, t in texts.items()}
    first = {}
    for d in sorted(split):
        for p in range(len(split[d]) - 49):
            first.setdefault(tuple(split[d][p : p + 50]), d)
    got = by_id(substring_index.remove_repeats(docs))
    assert len(got) == len(texts)
    for d, w in split.items():
        gone = [False] * len(w)
        for p in range(len(w) - 49):
            if first[tuple(w[p : p + 50])] < d:
                gone[p : p + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (got[d]["n_words"], got[d]["n_removed"], got[d]["kept_sha256"]) == (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    assert substring_index.remove_repeats(empty).count() == 0


def brute_bytes(texts):
    raw = {d: t.encode() for d, t in texts.items()}
    first, out = {}, {}
    for d in sorted(raw):
        for p in range(len(raw[d]) - 99):
            first.setdefault(raw[d][p : p + 100], (d, p))
    for d, w in raw.items():
        gone = bytearray(len(w))
        for p in range(len(w) - 99):
            if first[w[p : p + 100]] < (d, p):
                gone[p : p + 100] = b"\1" * 100
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[d] = (len(w), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2])
def test_suffix_dedup_removes_what_brute_force_removes(docs, rows, empty, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)  # the way for hot anchors must give the same
    got = by_id(suffix_dedup.remove_repeats(docs))
    for d, want in brute_bytes(distinct(rows)).items():
        assert (got[d]["n_bytes"], got[d]["n_removed"], got[d]["n_spans"], got[d]["kept_sha256"]) == want
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_loser_tree_merges_and_tells_common_prefixes():
    rng = random.Random(1)
    for _ in range(200):
        runs = [sorted(bytes(rng.choices(b"ab", k=rng.randint(0, 6))) for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(1, 9))]
        shared = [[suffix_dedup.common_prefix(a, b, 0) for a, b in zip([b"", *r], r)] for r in runs]
        got = [(runs[s][i], h) for s, i, h in suffix_dedup.LoserTree(runs, shared)]
        assert [g for g, _ in got] == sorted(x for r in runs for x in r)
        assert all(suffix_dedup.common_prefix(a, b, 0) == h for (a, _), (b, h) in zip(got, got[1:]))


def brute_components(texts, k, percent):
    sets = {}
    for d, t in texts.items():
        w = t.encode().lower().split()
        n = min(k, len(w))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("crowd", [jaccard.CROWD, 2])
def test_jaccard_components(spark, crowd, monkeypatch, empty):
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    monkeypatch.setattr(jaccard, "COMMON_FROM", 3)
    rng = random.Random(8)
    base = words(rng, 60).split()
    rows = []
    for i in range(30):  # a drifting chain: neighbours link, ends do not
        base[rng.randrange(60)] = f"new{i}"
        rows.append((100 - i, " ".join(base)))
    rows += [(200 + i, words(rng, rng.randint(1, 40))) for i in range(20)] + [(300, "one two"), (301, "One  TWO"), (302, None), (303, ""), (300, "one two"), (None, "one two")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccard.near_duplicates(frame, 4, 85).collect()
    assert len(got) == len(rows)
    want = brute_components({d: t or "" for d, t in rows if d is not None}, 4, 85)
    assert all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert jaccard.near_duplicates(empty).count() == 0


def test_packing_is_whole_and_tight(docs, rows, empty):
    path = packing.default_tokenizer()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    got = packing.pack(docs, path, capacity=64).toPandas()
    texts = distinct(rows)
    for d, own in got[got.doc_id.notna()].drop_duplicates(["doc_id", "piece"]).groupby("doc_id"):
        ids = np.array([*plain.encode(texts[d], add_special_tokens=False).ids, 0], "<u4")
        own = own.sort_values("piece")
        assert own.length.sum() == len(ids) and (len(own) == 1 or (own.length.iloc[1:] == 64).all())
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in zip(own.start, own.length, own.ids_crc32, strict=True))
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset.to_numpy() == np.cumsum(s.length) - s.length).all() and s.length.sum() <= 64
    assert got.sequence_id.nunique() <= 1.05 * -(-got.length.sum() // 64)
    assert packing.pack(empty, path).count() == 0


def test_workers_hold_no_encoder_between_tasks(spark):
    frame = spark.createDataFrame([(i, f"word{i} <|endoftext|> other") for i in range(40)], "doc_id long, text string").repartition(8)
    assert packing.cut(frame, packing.default_tokenizer()).count() == 40

    def encoders(batches):
        import gc

        import pyarrow as pa

        n = sum(type(x).__name__ == "Encoder" for x in gc.get_objects())
        for _ in batches:
            pass
        yield pa.RecordBatch.from_pydict({"n": [n]})

    assert not any(r["n"] for r in spark.range(8).repartition(8).mapInArrow(encoders, "n long").collect())


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(2)
    counts = np.bincount(rng.integers(1, 101, 5000), minlength=101)
    used = np.zeros(101, int)
    sequences = 0
    for pattern, times in packing.plan(counts, 100):
        assert sum(pattern) <= 100
        sequences += times
        for a in pattern:
            used[a] += times
    assert (used == counts).all() and sequences <= 1.02 * (np.arange(101) * counts).sum() / 100 + 1


def test_encoder_equals_tokenizer():
    path = packing.default_tokenizer()
    texts = ["", " ", "  a", "a  b", "x \n y", "a<|endoftext|> b", "it's  don't\n\n\nfoo ", "日本語 テスト", "a" * 200 + " " + "b" * 300, "\x1c a", "t　 x"]
    fast, slow = packing.Encoder(path), packing.Encoder(path, ranks=False)
    want = [np.array(e.ids, "<u4").tobytes() for e in fast.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert fast.ranks is not None and fast.encode(texts) == want == slow.encode(texts)


def test_gif_round_trip_and_rules(docs, rows):
    rng = random.Random(4)
    for n in (576, 576 * 70, 576 * 200):
        data = bytes(rng.choices(range(rng.choice((2, 30, 256))), k=n))
        assert b"".join(f.indices.tobytes() for f in gif.decode_gif(gif.encode_payload(data))) == data
    # two frames of 2 x 1: the second, transparent in its right pixel, restores to the first
    head = b"GIF89a" + bytes([2, 0, 1, 0, 0x80, 0, 0]) + bytes([255, 0, 0, 0, 0, 255])
    control = lambda disposal, flag, index: b"\x21\xf9\x04" + bytes([disposal << 2 | flag, 5, 0, index, 0])
    image = lambda a, b: b"\x2c\0\0\0\0\2\0\1\0\0\x02" + bytes([2, 4 | a << 3 | (b & 3) << 6, b >> 2 | 5 << 1, 0])
    frames = [f.screen.copy() for f in gif.decode_gif(head + control(1, 0, 0) + image(0, 1) + control(3, 1, 1) + image(1, 1) + control(0, 1, 0) + image(1, 0) + b"\x3b")]
    red, blue = [255, 0, 0, 255], [0, 0, 255, 255]
    assert frames[0].tolist() == [[red, blue]] and frames[1].tolist() == [[red, blue]] and frames[2].tolist() == [[blue, blue]]
    got = by_id(gif.decode_column(gif.text_to_gif(docs)))
    for d, t in distinct(rows).items():
        raw = t.encode()
        raw += b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (got[d]["payload_bytes"], got[d]["payload_sha256"], got[d]["tail_crc32"], got[d]["error"]) == (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), None)
    bad = docs.sparkSession.createDataFrame([(1, 0, None), (2, 0, b"GIF89a"), (3, 0, b"no")], "doc_id long, n_bytes long, gif binary")
    assert all(r["error"] and not r["frames"] for r in gif.decode_column(bad).collect())


def test_language_model_separates_and_handles_letterless(spark, empty):
    rng = random.Random(6)
    sound = {"aa": "abcde", "bb": "efghi", "cc": "ijklm"}
    rows = [(i, "".join(rng.choice(s + " ") for _ in range(200)), lang) for i, (lang, s) in enumerate(list(sound.items()) * 60)]
    rows += [(1000, None, "aa"), (1001, "12 !?", "bb"), (1002, "", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = by_id(language.identify(frame, language.train(frame)))
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in rows[:180]) >= 178
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert {r["lang_pred"] for r in language.identify(frame, None).collect()} == {"und"} and language.train(empty) is None
    codes = language.codewords(4)
    assert codes.shape == (4, 7) and min((codes[i] != codes[j]).sum() for i in range(4) for j in range(i)) == 4


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(7)
    rows, marks = [], []
    for i in range(900):
        w = words(rng, 60).split()
        toxic = i % 6 == 0
        for _ in range(3 if toxic else 0):
            w[rng.randrange(60)] = rng.choice(["grolk", "snarb", "vexil" + rng.choice(["en", "os", "ita"])])
        rows.append((i, " ".join(w)))
        marks.append((i, int(toxic), 1))
    docs = spark.createDataFrame([*rows, (5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([*marks, marks[0], (7000, 1, 1), (8000, None, 0)], "doc_id long, toxic int, quality int")
    got = by_id(toxicity.score(docs, toxicity.train(docs, labels)))
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i]["score"] >= 0.5) == (i % 6 == 0) for i in held) >= 0.97 * len(held)
    assert got[5000]["score"] == got[5001]["score"] < 0.5
    assert toxicity.train(docs, labels.where("toxic = 0")).score(b"grolk") < 0.5


def test_label_model_damps_copies():
    rng = np.random.default_rng(3)
    y = rng.random(2000) < 0.3
    votes = np.stack([rng.random(2000) < np.where(y, 0.8, 0.02) for _ in range(4)], axis=1).astype(np.float32)
    model = toxicity.fit_label_model(np.hstack([votes, votes[:, :1], votes[:, :1]]), 0.3)
    assert ((model.posterior(np.hstack([votes, votes[:, :1], votes[:, :1]])) > 0.5) == y).mean() > 0.9
    assert model.damping[4] < 0.6 < model.damping[1]


def test_base_spans_equal_plain_patterns():
    rng = random.Random(9)
    patterns = [("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True), ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m.split("."))), ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 16 <= len(re.sub(r"\D", "", m)) <= 19 and pii.luhn(re.sub(r"\D", "", m))), ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 8 <= len(re.sub(r"\D", "", m)) <= 15)]
    for _ in range(4000):
        text = "".join(rng.choice(["a", "b.", "@", "é", " ", "-", "+", "1", "25", "0.", "4111 1111 1111 1111", "10.0.0.1", "+1 (262) 555", "x@y.z", "%"]) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == [(k, m.start(), m.end()) for k, p, ok in patterns for m in p.finditer(text) if ok(m.group())], text


def test_terms_that_disclose_go_and_common_ones_stay(spark, empty):
    rows = [(i, f"filler{i} words{i} about Zanzibar common contact bob@example.com please{i}") for i in range(6)] + [(i, f"plain text number{i} common words here") for i in range(10, 80)] + [(None, "call +1 (262) 555-7240 now"), (99, None), (98, ""), (0, "another text under the same id")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS base", "2 AS terms")
    out = [(r["doc_id"], r["text"]) for r in pii.sanitise(frame).collect()]
    assert sorted(map(repr, out)) == sorted(map(repr, [(i, f"filler{i} words{i} <TERM> <TERM> common <TERM> <EMAIL> please{i}") for i in range(6)] + rows[6:76] + [(None, "call <PHONE> now"), *rows[77:]]))
    assert pii.detect(empty).count() == 0


def test_pitman_yor_counts_and_probabilities(docs, rows, empty):
    import math
    from collections import Counter

    from pathweave.llm.common import fold

    got = pitman_yor.score(docs, fold("doc_id", 10) != 0).collect()
    assert len(got) == len(rows)
    held = lambda d: d is None or zlib.crc32(str(d).encode()) % 10 == 0
    token = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(x for d, t, *_ in rows if not held(d) for x in token(t))
    n, v = sum(c.values()), len(c)
    want = {d: (len(token(t)), sum(c[x] > 0 for x in token(t)), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in token(t))) for d, t, *_ in rows}
    for r in got:
        m = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == m[:3] and abs(r["base_score"] - m[3]) < 1e-6 * abs(m[3]) and r["score"] < 0
    assert pitman_yor.score(empty, fold("doc_id", 10) != 0).count() == 0


def test_byte_restaurants_sum_to_one():
    rng = np.random.default_rng(0)
    spelled = [bytes(rng.integers(97, 102, rng.integers(1, 6)).astype(np.uint8)) for _ in range(400)]
    g, _ = pitman_yor.grams(spelled)
    keys, counts = np.unique(g, return_counts=True)
    customers = np.zeros((256, 256))
    np.add.at(customers, ((keys >> 24).astype(int), (keys & 255).astype(int)), 1)
    p1 = pitman_yor.top_model(customers, 1)
    assert np.allclose(p1[list(range(97, 102))].sum(axis=1), 1)
    context = keys[5] >> np.uint32(8) << np.uint32(8)
    p, _, _ = pitman_yor.lower_model(keys, counts, context | np.arange(256, dtype=np.uint32), p1, 3)
    assert abs((10.0**p).sum() - 1) < 1e-6


def test_least_distance_and_decontamination(spark, empty):
    def plain(p, t):
        row = [0] * (len(t) + 1)
        for i in range(1, len(p) + 1):
            new = [i] + [0] * len(t)
            for j in range(1, len(t) + 1):
                new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p[i - 1] != t[j - 1]))
            row = new
        return min(row)

    rng = random.Random(2)
    for _ in range(400):
        p, t = bytes(rng.choices(b"abc", k=rng.randint(1, 9))), bytes(rng.choices(b"abc", k=rng.randint(0, 15)))
        assert decontaminate.least_distance(p, t)[0] == plain(p, t)
    items = [(i, " ".join("".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(25))) for i in range(12)]
    draw = np.random.default_rng(1)
    docs, want = [], set()
    for i, t in items:
        for share in (0, 0.05, 0.1):
            docs.append((len(docs), words(rng, 30) + "\n" + decontaminate.edited(t.encode(), int(share * len(t)), draw).decode("latin1") + " " + words(rng, 30)))
            want.add((docs[-1][0], i))
    docs += [(len(docs) + i, words(rng, 100)) for i in range(20)] + [(900, None), (901, ""), (None, items[0][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (50, None), (None, "x"), (51, " ")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(frame, bench).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and {w for w in want if w[0] % 3 == 0} <= got
    assert decontaminate.matches(frame, bench.limit(0)).count() == 0 and decontaminate.matches(empty, bench).count() == 0


def test_pipeline_keeps_clean_rows_and_drops_the_rest(spark, tmp_path):
    import corpus_pipeline as C

    rng = random.Random(12)
    item = words(rng, 30)
    rows = [(i, words(rng, 80), "en", "s", 1) for i in range(20)]
    rows += [(100, rows[0][1], "en", "s", 1), (101, "123 456", "en", "s", 1), (102, None, None, None, None), (103, words(rng, 20) + " " + item, "en", "s", 1), (104, words(rng, 30) + " me@x.org", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in C.STAGES[:4]:
        docs = C.materialise(stage(spark, docs, str(tmp_path)), name)
        assert tuple(docs.columns) == C.COLUMNS
        seen.append({r["doc_id"] for r in docs.collect()})
    clean = set(range(20))
    assert seen == [clean | {100, 103, 104}, clean | {103, 104}, clean | {104}, clean | {104}]
    assert docs.where("doc_id = 104").collect()[0]["text"].endswith("<EMAIL>")
    assert {r["doc_id"] for r in C.run(spark, str(tmp_path)).collect()} == clean | {104}


def test_pitman_yor_knows_word_order(spark):
    rng = random.Random(21)
    names = [f"{a}{i}" for i in range(40) for a in ("ka", "lo")]
    follow = {w: rng.sample(names, 2) for w in names}

    def chain(n):
        out = [rng.choice(names)]
        while len(out) < n:
            out.append(rng.choice(follow[out[-1]]))
        return out

    texts = [chain(60) for _ in range(300)]
    shuffled = [rng.sample(t, len(t)) for t in texts[250:]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts + shuffled)]
    frame = spark.createDataFrame([*rows, (900, None)], "doc_id long, text string").repartition(3)
    from pyspark.sql import functions as F

    got = by_id(pitman_yor.score(frame, F.col("doc_id") < 250))
    for i in range(250, 300):
        assert got[i]["base_score"] == pytest.approx(got[i + 50]["base_score"]) and got[i]["score"] > got[i + 50]["score"] + 20
        assert got[i]["score"] > got[i]["base_score"] + 20
    assert got[900]["n_tokens"] == 1 and got[900]["score"] < 0


def test_pair_restaurants_sum_to_one():
    rng = np.random.default_rng(5)
    base = rng.dirichlet(np.ones(50))
    key = (np.repeat(np.arange(6), 50) << 32 | np.tile(np.arange(50), 6)).astype(np.uint64)
    count = rng.poisson(1.0, len(key)).astype(np.int64)
    hot = np.array([2, 5], np.uint64)
    held = np.array([count[100:150].sum(), count[250:].sum()], float)
    model = pitman_yor.PairRange(key, count, np.tile(base, 6), 0.6, 1, hot, held, np.array([40.0, 45.0]))
    p = model.predict(model.hot_totals())
    assert np.allclose(p.reshape(6, 50).sum(axis=1), 1)


def test_decontamination_recall_at_the_threshold(spark):
    rng, draw = random.Random(31), np.random.default_rng(9)
    items = [(i, " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(rng.randint(20, 60)))) for i in range(60)]
    docs, exact = [], []
    for share in (0.15, 0.2):
        for i, t in items:
            docs.append((len(docs), words(rng, 30) + " " + decontaminate.edited(t.encode(), int(share * len(t)), draw).decode("latin1") + " " + words(rng, 30), i))
    # without spaces, inside running text, and with spaces moved
    han = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(40))
    around = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(60)) for _ in range(2)]
    exact += [(900, around[0] + han + around[1], 100), (901, words(rng, 20) + items[1][1].replace(" ", "", 5) + words(rng, 20), 1)]
    frame = spark.createDataFrame([(d, t) for d, t, _ in docs + exact], "doc_id long, text string")
    bench = spark.createDataFrame([*items, (100, han), (101, "abcd")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(frame, bench).collect()}
    assert {(d, i) for d, _, i in exact} <= got
    for part in (docs[:60], docs[60:]):
        assert sum((d, i) in got for d, _, i in part) >= 0.95 * len(part)


def test_terms_with_inner_punctuation_are_counted_whole(spark):
    rows = [(i, f"one{i} (Acct-4471), x@example.com two{i}") for i in range(3)] + [(10 + i, f"acct plain{i}") for i in range(300)] + [(500 + i, f"other{i}") for i in range(3000)]
    out = by_id(pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [out[i]["text"] for i in range(3)] == [f"one{i} (<TERM>), <EMAIL> two{i}" for i in range(3)]
    assert len(pii.quick_hashes(b"(O'Neil), -- a/b")) == 2 and pii.quick_hashes(b"(O'Neil),")[0] == pii.quick_hashes(b"o'neil")[0]


def test_disclosing_terms_count_and_go_in_whole_documents(spark):
    fill = lambda i, k: " ".join(f"f{i}x{k}x{j}" for j in range(30))
    rows = [(i, f"Éric Bob, wrote {fill(i, 0)} mail bob@example.com {fill(i, 1)} signed Bob") for i in range(3)]
    rows += [(10 + i, f"wrote mail signed number{i}") for i in range(300)]
    out = by_id(pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [out[i]["text"] for i in range(3)] == [f"<TERM> <TERM>, wrote {fill(i, 0)} mail <EMAIL> {fill(i, 1)} signed <TERM>" for i in range(3)]


def test_terms_too_common_to_disclose_are_not_counted_in_all_texts(spark, monkeypatch):
    """All pairs as by brute force, and only terms that scanned documents leave possible are counted in all texts."""
    rng = random.Random(17)
    people = [f"user{i}@site{i % 4}.org" for i in range(12)]
    rows = [(i, f"{words(rng, 6)} secret{i % 12} shared{i % 4} common {people[i % 12]} own{i}") for i in range(120)]
    rows += [(1000 + i, f"{words(rng, 5)} common plain{i % 40}" + f" secret{i % 12}" * (i % 9 == 0)) for i in range(800)]
    counted, frequencies = {}, pii.term_frequencies

    def spy(docs, candidates, *column):
        counted[(column or ("text",))[0]] = {r["term"] for r in candidates.collect()}
        return frequencies(docs, candidates, *column)

    monkeypatch.setattr(pii, "term_frequencies", spy)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    texts = {i: set(pii.quick_hashes(t.encode()).tolist()) for i, t in rows}
    inside, held = {}, {}
    for i, t in rows:
        spans = pii.base_spans(t)
        inside[i] = set(pii.terms_outside(t, spans)[0].tolist())
        for kind, a, b in spans:
            for e in (t[a:b].lower(), pii.shared_part(kind, t[a:b])):
                held.setdefault(pii._hash(e), set()).add(i)
    for alpha in (0.5, 0.8, 0.95):
        got = {(r["entity"], r["term"]) for r in pii.disclosures(frame, pii.scan(frame), alpha).collect()}
        want, n_term = set(), lambda t: sum(t in own for own in texts.values())
        for e, ids in held.items():
            for t in set().union(*(inside[i] for i in ids)):
                n = sum(t in inside[i] for i in ids)
                if n >= 3 and np.log(n) + np.log(len(rows)) - np.log(n_term(t)) - np.log(len(ids)) >= -alpha * np.log(len(ids) / len(rows)):
                    want.add((e, t))
        assert got == want and want
        assert {t for _, t in want} <= counted["text"] and (pii.quick_hashes(b"common")[0] in counted["text"]) == (alpha < 0.8)
