"""LM scoring by a nested hierarchical Pitman-Yor model, beside a unigram score.

The restaurant of a preceding word (or of the start of a text) has the words that follow it as dishes; its parent is the
restaurant of all words, whose parent is a model of spellings: each byte given the three before it within the word, the
empty spelling being the end of a text. Every byte context is a Chinese restaurant whose parent is the context without
its earliest byte. At every level a new table is a customer of the parent. Seatings are sampled by blocked
Gibbs sweeps, all dishes of a level at a time given the parent's predictive probabilities and the restaurant's tables of the
sweep before (customers one by one up to 64 of a dish, then by Poisson steps), and predictive probabilities are averaged
over the sweeps after burn-in. Levels follow one another: pairs are first seated under the shares of words in their own range, their
tables seat the words, whose tables seat the spellings; then probabilities come down again and each level is sampled anew under them.

The corpus is read once, in chunks of some megabytes, each kept as the places of its tokens among its distinct words. Numbers of ranges grow
with the corpus. Pairs are dealt by a hash of the preceding word; those of a preceding word with over half a range's share of the tokens by a
hash of both words, its totals being added up in the driver sweep by sweep (at most two words for each range). The restaurant of all words
is dealt by words in the same way. Byte restaurants of two and three bytes live where their last two bytes are dealt to; those of one byte
and the root (at most 65,536 dishes) live in the driver, which gets the sampled tables of their children. A chunk asks each range of words
once for each distinct word and each range of pairs once for each distinct pair, a range of pairs asks each range of words once for
each distinct word, a range of words asks each range of contexts once for each distinct 4-gram, and answers come back in the order of the
questions. So no key, however frequent, is asked for more than once by a chunk, and nothing the size of the corpus is broadcast. Questions
and answers are exchanged as byte planes under zstd; log probabilities are rounded to 2^-16.

Edge cases: null and empty texts are one end symbol; a null id counts as held out; repeated rows count as often as they stand;
without training rows spellings are uniform; an empty table gives an empty result.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, fold, id_and_text, materialise, mix, packed, read_table, release, rising, risen, unpacked, word_hashes

END = 10
CHUNK_BYTES, RANGE_BYTES = 8 << 20, 16 << 20
LEAST_RANGES, MOST_CONTEXT_RANGES = 32, 256
SWEEPS, BURN_IN, EXACT_SEATS = 6, 2, 64
KEPT = SWEEPS - BURN_IN
THETA = 1.0


def grams(spelled: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(packed 4-grams of all bytes of the words and of their ends, number of them in each word). The pack is last, second,
    first of the context, then the predicted byte, so that restaurants of one suffix are neighbours in order."""
    pad, end = bytes([END]) * 3, bytes([END])
    joined = np.frombuffer(b"".join(pad + s + end for s in spelled), np.uint8).astype(np.uint32)
    sizes = np.array([len(s) + 1 for s in spelled], np.int64)
    starts = np.cumsum(sizes + 3) - sizes
    at = np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return joined[at - 1] << 24 | joined[at - 2] << 16 | joined[at - 3] << 8 | joined[at], sizes


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Which of some ranges of 64-bit hashes: rising with the hash."""
    return ((hashes >> U(32)) * U(ranges) >> U(32)).astype(np.int64)


def context_range(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Which range holds the restaurants of a gram: a hash of the last two bytes of its context."""
    return range_of((keys >> np.uint32(16)).astype(np.uint64) * U(0x9E3779B97F4A7C15), ranges)


def seats(count: np.ndarray, base: np.ndarray, strength: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Sampled numbers of tables of dishes with so many customers. ``base``: the parent's probability; ``strength``: theta + d * tables."""
    t = np.minimum(count, 1).astype(float)
    pull = strength * base
    most = int(count.max()) if len(count) else 0
    for n in range(1, min(most, EXACT_SEATS)):
        on = np.flatnonzero(count > n)
        new = rng.random(len(on)) * (n - discount * t[on] + pull[on]) < pull[on]
        t[on] += new
    n = EXACT_SEATS
    while n < most:
        on = np.flatnonzero(count > n)
        step = np.minimum(count[on], 2 * n) - n
        middle = n + step / 2
        t[on] = np.minimum(t[on] + rng.poisson(step * pull[on] / (middle - discount * t[on] + pull[on])), count[on])
        n *= 2
    return t


def discount_of(count: np.ndarray) -> float:
    one, two = (count == 1).sum(), (count == 2).sum()
    return float(np.clip((one + 0.5) / (one + 2 * two + 1), 0.05, 0.95))


class Level:
    """Restaurants of one depth: dishes with customers, grouped by restaurant; sampled tables; predictive probabilities."""

    theta = 1.0

    def __init__(self, restaurant: np.ndarray, size: int) -> None:
        self.restaurant, self.size = restaurant, size
        self.tables = np.zeros(len(restaurant))
        self.total_tables = np.zeros(size)

    def sample(self, count: np.ndarray, base: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        self.count, self.discount = count, discount_of(count[count > 0])
        strength = self.theta + self.discount * self.total_tables[self.restaurant]
        self.tables = seats(count.astype(np.int64), base, strength, self.discount, rng)
        self.total_tables = np.bincount(self.restaurant, weights=self.tables, minlength=self.size)
        self.customers = np.bincount(self.restaurant, weights=count, minlength=self.size)
        return self.tables

    def predict(self, restaurant: np.ndarray, dish: np.ndarray, base: np.ndarray) -> np.ndarray:
        """restaurant, dish: -1 where there is none."""
        known = restaurant >= 0
        r, d = np.maximum(restaurant, 0), np.maximum(dish, 0)
        if not self.size:
            return base
        own = np.where(dish >= 0, self.count[d] - self.discount * self.tables[d], 0.0) if len(self.count) else 0.0
        p = (own + (self.theta + self.discount * self.total_tables[r]) * base) / (self.theta + self.customers[r])
        return np.where(known & (self.customers[r] > 0), p, base)


def top_model(customers: np.ndarray, seed: int) -> np.ndarray:
    """p(byte | last byte), 256 x 256, from the customers that two-byte restaurants send: one-byte restaurants and the root."""
    rng = np.random.default_rng(seed)
    c, w = np.nonzero(customers)
    count = customers[c, w]
    one, root = Level(c, 256), Level(np.zeros(256, np.int64), 1)
    uniform = np.full(256, 1 / 256)
    p0, mean = uniform, np.zeros((256, 256))
    place = np.full((256, 256), -1)
    place[c, w] = np.arange(len(c))
    for sweep in range(SWEEPS):
        t = one.sample(count, p0[w], rng)
        root.sample(np.bincount(w, weights=t, minlength=256), uniform, rng)
        p0 = root.predict(np.zeros(256, np.int64), np.arange(256), uniform)
        if sweep >= BURN_IN:
            mean += one.predict(np.repeat(np.arange(256), 256), place.ravel(), np.tile(p0, 256)).reshape(256, 256)
    return mean / (SWEEPS - BURN_IN)


def lookup(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key, or -1."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def lower_model(keys: np.ndarray, count: np.ndarray, asked: np.ndarray, p1: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three- and two-byte restaurants of one range: log10 probabilities of the asked grams, and (suffix byte << 8 | dish, tables)
    that go to the one-byte restaurants, averaged."""
    rng = np.random.default_rng(seed)
    seen = count > 0
    keys, count = keys[seen], count[seen].astype(np.int64)
    r3, in3 = np.unique(keys >> np.uint32(8), return_inverse=True)
    k2 = (keys >> np.uint32(16)) << np.uint32(8) | (keys & np.uint32(255))
    u2, in2 = np.unique(k2, return_inverse=True)
    r2, of2 = np.unique(u2 >> np.uint32(8), return_inverse=True)
    three, two = Level(in3, len(r3)), Level(of2, len(r2))
    last, dish = lambda k: (k >> np.uint32(16)).astype(np.int64), lambda k: (k & np.uint32(255)).astype(np.int64)
    base2 = p1[last(u2), dish(u2)]
    a2 = (asked >> np.uint32(16)) << np.uint32(8) | (asked & np.uint32(255))
    at3, dish3, at2, dish2 = lookup(r3, asked >> np.uint32(8)), lookup(keys, asked), lookup(r2, a2 >> np.uint32(8)), lookup(u2, a2)
    base_asked = p1[last(a2), dish(a2)]
    p2, mean, sent = base2, np.zeros(len(asked)), np.zeros(len(u2))
    for sweep in range(SWEEPS):
        t3 = three.sample(count, p2[in2], rng)
        t2 = two.sample(np.bincount(in2, weights=t3, minlength=len(u2)), base2, rng)
        p2 = two.predict(of2, np.arange(len(u2)), base2)
        if sweep >= BURN_IN:
            sent += t2
            mean += three.predict(at3, dish3, two.predict(at2, dish2, base_asked))
    up = (last(u2) << 8) | dish(u2)
    return np.log10(np.maximum(mean / (SWEEPS - BURN_IN), 1e-300)), up, sent / (SWEEPS - BURN_IN)


_ASK = pa.schema([("range", pa.int32()), ("chunk", pa.int64()), ("tokens", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("sizes", pa.binary()), ("spelled", pa.binary())])
_ASK_DDL = "range int, chunk long, tokens long, keys binary, counts binary, sizes binary, spelled binary"
_TOLD = pa.schema([("range", pa.int32()), ("chunk", pa.int64()), ("counts", pa.binary()), ("told", pa.binary())])
_TOLD_DDL = "range int, chunk long, counts binary, told binary"
_LOW = U(0xFFFFFFFF)


def _cuts(ranges: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the stretches of equal values."""
    start = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1]])) if len(ranges) else np.zeros(0, np.int64)
    return list(zip(start.tolist(), np.append(start, len(ranges))[1:].tolist(), strict=True))


def _fixed(log: np.ndarray) -> bytes:
    """Log probabilities with 16 binary places."""
    return packed(np.round(log * 65536).astype(np.int32))


def _logs(blob: bytes) -> np.ndarray:
    return unpacked(blob, np.int32) / 65536


def _words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct word hashes of a chunk, the place of each word in them, words in each text, where each first occurs."""
    words = [word_hashes(t) for t in texts]
    w, first, at = np.unique(np.concatenate(words) if words else np.zeros(0, U), return_index=True, return_inverse=True)
    return w, at, np.array([len(x) for x in words], np.int64), first


def read_chunks(ranges: int):
    """For each chunk of (doc_id, text, train) rows: one row of range -1 with its documents and tokens, and what it asks the ranges of words."""

    def asked(chunk: int, docs: list, texts: list[bytes], train: list[bool]) -> pa.RecordBatch:
        w, at, n, first = _words_of(texts)
        teach = np.array(train, bool)
        count = np.bincount(at[np.repeat(teach, n)], minlength=len(w)).astype(np.uint32)
        every = [x for t in texts for x in t.split()]
        spelled = [every[i] for i in first.tolist()]
        of = range_of(w, ranges)
        known = np.array([d is not None for d in docs], np.uint8)
        rows = [{"range": -1, "chunk": chunk, "tokens": int(n[teach].sum()), "keys": packed(np.array([d or 0 for d in docs], np.int64)), "counts": packed(known << 1 | teach), "sizes": packed(n.astype(np.uint32)), "spelled": packed(at.astype(np.uint32))}]
        rows += [{"range": int(of[a]), "chunk": chunk, "keys": rising(w[a:b]), "counts": packed(count[a:b]), "sizes": packed(np.array([len(x) for x in spelled[a:b]], np.uint32)), "spelled": packed(np.frombuffer(b"".join(spelled[a:b]), np.uint8))} for a, b in _cuts(of)]
        return pa.RecordBatch.from_pylist(rows, schema=_ASK)

    def read(batches):
        # a task that is run again gives its chunks the same numbers
        chunk, size, held = TaskContext.get().partitionId() << 32, 0, ([], [], [])
        for batch in batches:
            for row in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("train").to_pylist(), strict=True):
                text = row[1].encode().lower()
                for column, v in zip(held, (row[0], text, row[2]), strict=True):
                    column.append(v)
                size += len(text) + 64
                if size >= CHUNK_BYTES:
                    yield asked(chunk, *held)
                    chunk, size, held = chunk + 1, 0, ([], [], [])
        if held[0]:
            yield asked(chunk, *held)

    return read


class Chunk:
    """A chunk's row: ids of its documents, which teach, words in each, and the place of each token among its distinct words."""

    def __init__(self, row: dict) -> None:
        flags = unpacked(row["counts"], np.uint8)
        self.ids = [int(d) if f & 2 else None for d, f in zip(unpacked(row["keys"], np.int64), flags, strict=True)]
        self.train, self.n, self.at = (flags & 1).astype(bool), unpacked(row["sizes"], np.uint32).astype(np.int64), unpacked(row["spelled"], np.uint32)


def _gathered(table: pa.Table, kind: type) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Keys as asked, sorted distinct keys, their summed counts, where each first stands among all."""
    keys = [risen(b, kind) for b in table["keys"].to_pylist()]
    counts = [unpacked(b, np.uint32) for b in table["counts"].to_pylist()]
    unique, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    return keys, unique, np.bincount(at, weights=np.concatenate(counts), minlength=len(unique)).astype(np.int64), first


def _spellings(table: pa.Table, first: np.ndarray) -> list[bytes]:
    sizes = np.concatenate([unpacked(b, np.uint32) for b in table["sizes"].to_pylist()]).astype(np.int64)
    joined, ends = b"".join(unpacked(b, np.uint8).tobytes() for b in table["spelled"].to_pylist()), np.cumsum(sizes)
    return [joined[e - n : e] for e, n in zip(ends[first].tolist(), sizes[first].tolist(), strict=True)]


def _range_grams(table: pa.Table, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a range of words: distinct grams in order of (context range, key), the place
    of each gram of each word in them, grams in each word. The empty spelling comes last."""
    if table.num_rows:
        _, _, _, first = _gathered(table, U)
    each, sizes = grams([*(_spellings(table, first) if table.num_rows else []), b""])
    g, at = np.unique(each, return_inverse=True)
    order = np.argsort(context_range(g, ranges), kind="stable")
    place = np.empty(len(g), np.int64)
    place[order] = np.arange(len(g))
    return g[order], place[at], sizes


def _halves(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """What chunks of texts ask a range of words, and what ranges of pairs ask it (their chunks are below 0)."""
    mine = np.array(table["chunk"].to_pylist(), np.int64) >= 0
    return table.filter(pa.array(mine)), table.filter(pa.array(~mine))


def _customers(asked: pa.Table, offset: int, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The places in a range of words that each range of pairs asks for, and the customers of every word: tables of pairs."""
    places = [risen(b, np.uint32).astype(np.int64) - offset for b in asked["keys"].to_pylist()]
    total = np.zeros(size, np.int64)
    for at, b in zip(places, asked["counts"].to_pylist(), strict=True):
        total[at] += unpacked(b, np.uint32)
    return places, total


def seatings(count: np.ndarray, base: np.ndarray, restaurant: np.ndarray, size: int, discount: float, seed: list[int], fixed: np.ndarray | None = None):
    """Sampled tables of every dish in each sweep after burn-in. ``fixed``: total tables of restaurants that are spread over ranges."""
    rng = np.random.default_rng(seed)
    total = np.bincount(restaurant, minlength=size).astype(float) if fixed is None else fixed
    for sweep in range(SWEEPS):
        t = seats(count, base, THETA + discount * total[restaurant], discount, rng)
        if fixed is None:
            total = np.bincount(restaurant, weights=t, minlength=size)
        if sweep >= BURN_IN:
            yield t


def pair_range(key: np.ndarray, hot: np.ndarray, ranges: int) -> np.ndarray:
    """Which range holds a pair (preceding word << 32 | word); ``hot``: sorted preceding words whose followers are spread."""
    before = key >> U(32)
    spread = lookup(hot, before) >= 0
    return range_of(mix(np.where(spread, key, before) + U(1)), ranges)


def _pairs_of(chunk: Chunk, ids: np.ndarray, end: int, hot: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of a chunk in order of (range, pair), their ranges, the place of each token's pair in them, the text of each token.
    ``ids``: of the chunk's distinct words; ``end`` and ``end + 1`` are the end and start of a text."""
    n, at = chunk.n, chunk.at
    stop = np.cumsum(n + 1) - 1
    inner = np.ones(int((n + 1).sum()), bool)
    inner[stop] = False
    word = np.full(len(inner), end, U)
    word[inner] = ids.astype(U)[at]
    before = np.empty(len(inner), U)
    before[1:] = word[:-1]
    before[stop - n] = end + 1
    key, place = np.unique(before << U(32) | word, return_inverse=True)
    of = pair_range(key, hot, ranges)
    order = np.argsort(of, kind="stable")
    back = np.empty(len(key), np.int64)
    back[order] = np.arange(len(key))
    return key[order], of[order], back[place], np.repeat(np.arange(len(n)), n + 1)


def _gathered_pairs(table: pa.Table, only: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Pairs as asked, sorted distinct pairs, their summed counts. ``only``: preceding words to keep."""
    keys, counts = [], []
    for before, word, count in zip(table["keys"].to_pylist(), table["sizes"].to_pylist(), table["counts"].to_pylist(), strict=True):
        key = risen(before, np.uint32).astype(U) << U(32) | unpacked(word, np.uint32).astype(U)
        n = unpacked(count, np.uint32)
        keep = slice(None) if only is None else lookup(only, key >> U(32)) >= 0
        keys.append(key[keep])
        counts.append(n[keep])
    unique, at = np.unique(np.concatenate(keys), return_inverse=True)
    return keys, unique, np.bincount(at, weights=np.concatenate(counts), minlength=len(unique)).astype(np.int64)


def seat_pairs(key: np.ndarray, count: np.ndarray, hot: np.ndarray, ranges: int, seed: int) -> np.ndarray:
    """First seating of one range of pairs: the parent is the share of each word among the range's tables."""
    seen = np.flatnonzero(count > 0)
    tables = np.zeros(len(key), np.int64)
    if len(seen):
        r, of = np.unique(key[seen] >> U(32), return_inverse=True)
        _, dish = np.unique(key[seen] & _LOW, return_inverse=True)
        spread = np.where(lookup(hot, r) >= 0, ranges, 1)
        t, discount, rng = np.ones(len(seen)), discount_of(count[seen]), np.random.default_rng([seed, 3])
        for _ in range(SWEEPS):
            total = np.bincount(of, weights=t) * spread
            share = np.bincount(dish, weights=t) / t.sum()
            t = seats(count[seen], share[dish], THETA + discount * total[of], discount, rng)
        tables[seen] = t
    return tables


class PairRange:
    """Restaurants of the preceding words of one range, sampled given the probabilities of the words.

    ``hot``: sorted preceding words that are spread over ranges, with their customers and their tables at the first seating.
    """

    def __init__(self, key: np.ndarray, count: np.ndarray, base: np.ndarray, discount: float, seed: int, hot: np.ndarray, hot_customers: np.ndarray, hot_tables: np.ndarray) -> None:
        self.key, self.count, self.base, self.discount, self.seed = key, count, base, discount, seed
        self.hot, self.hot_customers, self.hot_tables = hot, hot_customers, hot_tables
        self.spread = lookup(hot, key >> U(32))

    def hot_totals(self) -> np.ndarray:
        """Tables here of each spread restaurant in each kept sweep."""
        on = np.flatnonzero((self.spread >= 0) & (self.count > 0))
        return np.array([np.bincount(self.spread[on], weights=t, minlength=len(self.hot)) for t in self._hot_seatings(on)])

    def _hot_seatings(self, on: np.ndarray):
        return seatings(self.count[on], self.base[on], self.spread[on], len(self.hot), self.discount, [self.seed, 4], self.hot_tables)

    def predict(self, totals: np.ndarray) -> np.ndarray:
        """Probabilities of all pairs, averaged. ``totals``: tables everywhere of each spread restaurant in each kept sweep."""
        mean = np.zeros(len(self.key))
        on = np.flatnonzero((self.spread >= 0) & (self.count > 0))
        every = np.flatnonzero(self.spread >= 0)
        for t, total in zip(self._hot_seatings(on), totals, strict=True):
            own = self.count.astype(float)
            own[on] -= self.discount * t
            at = self.spread[every]
            mean[every] += (own[every] + (THETA + self.discount * total[at]) * self.base[every]) / (THETA + self.hot_customers[at])
        every = np.flatnonzero(self.spread < 0)
        r, of_every = np.unique(self.key[every] >> U(32), return_inverse=True)
        seen = self.count[every] > 0
        on, of = every[seen], of_every[seen]
        customers = np.bincount(of, weights=self.count[on], minlength=len(r))
        for t in seatings(self.count[on], self.base[on], of, len(r), self.discount, [self.seed, 5]):
            own = self.count.astype(float)
            own[on] -= self.discount * t
            strength = THETA + self.discount * np.bincount(of, weights=t, minlength=len(r))
            mean[every] += (own[every] + strength[of_every] * self.base[every]) / (THETA + customers)[of_every]
        return mean / KEPT


def drop_shuffles(docs: DataFrame) -> None:
    """Lets Spark delete the shuffle files of what has been collected."""
    gc.collect()
    docs.sparkSession.sparkContext._jvm.System.gc()


def score(docs: DataFrame, train_when) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score for every text; rows where ``train_when`` holds teach."""
    rows = id_and_text(docs).withColumn("train", train_when)
    size = rows.agg(F.sum(F.octet_length("text")).alias("b"), F.sum(F.col("train").cast("long")).alias("docs")).collect()[0]
    train_docs = size["docs"] or 0
    ranges = max(LEAST_RANGES, -(-(size["b"] or 0) // RANGE_BYTES))
    context_ranges = min(ranges, MOST_CONTEXT_RANGES)
    read = materialise(rows.mapInArrow(read_chunks(ranges), _ASK_DDL), "pitman-yor-read")
    chunks = materialise(read.where("range = -1"), "pitman-yor-chunks")
    words = materialise(read.where("range >= 0"), "pitman-yor-words")
    release(read)
    n = (chunks.agg(F.sum("tokens").alias("n")).collect()[0]["n"] or 0) + train_docs
    often = n / (2 * ranges)

    def word_totals(table: pa.Table) -> pa.Table:
        _, _, total, _ = _gathered(table, U)
        at = np.flatnonzero(total > often)
        return pa.table({"range": table["range"][:1], "size": pa.array([len(total)]), "v": pa.array([int((total > 0).sum())]), "once": pa.array([int((total == 1).sum())]), "twice": pa.array([int((total == 2).sum())]), "at": pa.array([at.tobytes()], pa.binary()), "counts": pa.array([total[at].tobytes()], pa.binary())})

    # a row from each range, and at most two frequent words for each
    by_range = words.select("range", "keys", "counts").groupBy("range").applyInArrow(word_totals, "range int, size long, v long, once long, twice long, at binary, counts binary").collect()
    sums = {c: sum(r[c] for r in by_range) for c in ("v", "once", "twice")}
    v = sums["v"] + (train_docs > 0)
    discount = float(np.clip((sums["once"] + 0.5) / (sums["once"] + 2 * sums["twice"] + 1), 0.05, 0.95))
    sizes_of = np.zeros(ranges, np.int64)
    for r in by_range:
        sizes_of[r["range"]] = r["size"]
    #: Words are numbered by range and hash; the end of a text is the last word of the last range.
    offsets = np.cumsum(sizes_of) - sizes_of
    end = int(sizes_of.sum())
    if end >= (1 << 32) - 2:
        raise ValueError("over 2^32 distinct words")

    def number(table: pa.Table) -> pa.Table:
        keys, unique, count, _ = _gathered(table, U)
        first = offsets[table["range"][0].as_py()]
        place = [np.searchsorted(unique, k) for k in keys]
        return pa.Table.from_arrays([table["range"], table["chunk"], pa.array([packed(count[i].astype(np.uint32)) for i in place], pa.binary()), pa.array([rising((i + first).astype(np.uint32)) for i in place], pa.binary())], schema=_TOLD)

    numbered = materialise(words.select("range", "chunk", "keys", "counts").groupBy("range").applyInArrow(number, _TOLD_DDL), "pitman-yor-numbers")
    found = sorted((int(i + offsets[r["range"]]), int(c)) for r in by_range for i, c in zip(np.frombuffer(r["at"], np.int64), np.frombuffer(r["counts"], np.int64), strict=True))
    hot = np.array([*(i for i, _ in found), end + 1], U)
    hot_customers = np.array([*(c for _, c in found), train_docs], float)

    def ids_of(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of a chunk's distinct words."""
        by = sorted(zip(answers["range"].to_pylist(), answers["counts"].to_pylist(), answers["told"].to_pylist(), strict=True))
        ids = np.concatenate([np.zeros(0, np.uint32), *(risen(b, np.uint32) for _, _, b in by)])
        return ids, np.concatenate([np.zeros(0, np.int64), *(unpacked(b, np.uint32).astype(np.int64) for _, b, _ in by)])

    def ask_pairs(mine: pa.Table, answers: pa.Table) -> pa.Table:
        if not mine.num_rows:
            return pa.Table.from_pylist([], schema=_ASK)
        chunk = Chunk(mine.to_pylist()[0])
        key, of, place, text = _pairs_of(chunk, ids_of(answers)[0], end, hot, ranges)
        count = np.bincount(place[chunk.train[text]], minlength=len(key)).astype(np.uint32)
        before, word = (key >> U(32)).astype(np.uint32), (key & _LOW).astype(np.uint32)
        rows = [{"range": int(of[a]), "chunk": mine["chunk"][0].as_py(), "keys": rising(before[a:b]), "counts": packed(count[a:b]), "sizes": packed(word[a:b])} for a, b in _cuts(of)]
        return pa.Table.from_pylist(rows, schema=_ASK)

    pairs = materialise(chunks.groupBy("chunk").cogroup(numbered.groupBy("chunk")).applyInArrow(ask_pairs, _ASK_DDL).drop("spelled", "tokens"), "pitman-yor-pairs")

    def first_seating(table: pa.Table) -> pa.Table:
        mine = table["range"][0].as_py()
        _, key, count = _gathered_pairs(table)
        tables = seat_pairs(key, count, hot, ranges, mine)
        word, at = np.unique(key & _LOW, return_inverse=True)
        up = np.bincount(at, weights=tables, minlength=len(word)).astype(np.uint32)
        spread = lookup(hot, key >> U(32))
        hot_tables = np.bincount(spread[spread >= 0], weights=tables[spread >= 0], minlength=len(hot))
        of = np.searchsorted(offsets, word.astype(np.int64), side="right") - 1
        rows = [{"range": int(of[a]), "chunk": -1 - mine, "keys": rising(word[a:b].astype(np.uint32)), "counts": packed(up[a:b])} for a, b in _cuts(of)]
        stats = np.array([(count == 1).sum(), (count == 2).sum(), tables.sum()], np.int64)
        return pa.Table.from_pylist([*rows, {"range": -1, "chunk": -1 - mine, "keys": stats.tobytes(), "counts": hot_tables.tobytes()}], schema=_ASK)

    seated = materialise(pairs.groupBy("range").applyInArrow(first_seating, _ASK_DDL), "pitman-yor-seated")
    # a row from each range
    told = seated.where("range = -1").select("keys", "counts").collect()
    once, twice, word_customers = np.sum([np.frombuffer(r["keys"], np.int64) for r in told], axis=0) if told else (0, 0, 0)
    pair_discount = float(np.clip((once + 0.5) / (once + 2 * twice + 1), 0.05, 0.95))
    hot_tables = np.sum([np.frombuffer(r["counts"], float) for r in told], axis=0) if told else np.zeros(len(hot))
    asked = words.unionByName(seated.where("range >= 0"))

    def ask_grams(table: pa.Table) -> pa.Table:
        """Customers of the spelling model: the tables of words, first seated under the range's own shares of bytes."""
        mine, others = _halves(table)
        g, at, sizes = _range_grams(mine, context_ranges)
        _, count = _customers(others, int(offsets[table["range"][0].as_py()]), len(sizes))
        of, seen = np.repeat(np.arange(len(sizes)), sizes), count > 0
        byte = (g[at] & np.uint32(255)).astype(np.int64)
        share = np.log(np.bincount(byte, minlength=256) + 1.0) - np.log(len(byte) + 256.0)
        base = np.exp(np.bincount(of, weights=share[byte], minlength=len(sizes)))
        tables = np.zeros(len(sizes))
        for tables[seen] in seatings(count[seen], base[seen], np.zeros(int(seen.sum()), np.int64), 1, discount, [table["range"][0].as_py(), 6], np.array([float(v)])):
            pass
        customers = np.bincount(at, weights=tables[of], minlength=len(g)).astype(np.uint32)
        to = context_range(g, context_ranges)
        rows = [{"range": int(to[a]), "chunk": table["range"][0].as_py(), "keys": rising(g[a:b]), "counts": packed(customers[a:b])} for a, b in _cuts(to)]
        # one more row: the tables themselves
        return pa.Table.from_pylist([*rows, {"range": -1, "chunk": int(tables.sum()), "keys": b"", "counts": b""}], schema=_ASK)

    grams_asked = materialise(asked.groupBy("range").applyInArrow(ask_grams, _ASK_DDL).drop("sizes", "spelled", "tokens"), "pitman-yor-grams")
    contexts = grams_asked.where("range >= 0")
    word_tables = np.array([float(grams_asked.where("range = -1").agg(F.sum("chunk").alias("t")).collect()[0]["t"] or 0)])

    def first_tables(table: pa.Table) -> pa.Table:
        _, unique, count, _ = _gathered(table, np.uint32)
        k2 = np.unique((unique[count > 0] >> np.uint32(16)) << np.uint32(8) | (unique[count > 0] & np.uint32(255)))
        key, tables = np.unique(((k2 >> np.uint32(16)) << np.uint32(8)) | (k2 & np.uint32(255)), return_counts=True)
        return pa.table({"key": pa.array(key.astype(np.int64)), "tables": pa.array(tables.astype(float))})

    def customers(frame: DataFrame) -> np.ndarray:
        out = np.zeros((256, 256))
        for r in frame.groupBy("key").agg(F.sum("tables").alias("t")).collect():  # at most 65,536 rows
            out[r["key"] >> 8, r["key"] & 255] = round(r["t"])
        return out

    p1 = top_model(customers(contexts.groupBy("range").applyInArrow(first_tables, "key long, tables double")), 1)

    def sampled_tables(table: pa.Table) -> pa.Table:
        _, unique, count, _ = _gathered(table, np.uint32)
        _, up, sent = lower_model(unique, count, unique[:0], p1, table["range"][0].as_py())
        return pa.table({"key": pa.array(up.astype(np.int64)), "tables": pa.array(sent)})

    p1_final = top_model(customers(contexts.groupBy("range").applyInArrow(sampled_tables, "key long, tables double")), 2)

    def tell_grams(table: pa.Table) -> pa.Table:
        keys, unique, count, _ = _gathered(table, np.uint32)
        p, _, _ = lower_model(unique, count, unique, p1_final, table["range"][0].as_py())
        told = [_fixed(p[np.searchsorted(unique, k)]) for k in keys]
        return pa.table({"word_range": table["chunk"].cast(pa.int32()), "range": table["range"], "told": pa.array(told, pa.binary())})

    drop_shuffles(docs)
    spelled = materialise(contexts.groupBy("range").applyInArrow(tell_grams, "word_range int, range int, told binary"), "pitman-yor-spelled")

    def spellings(table: pa.Table, answers: pa.Table) -> tuple[int, pa.Table, list[np.ndarray], np.ndarray, np.ndarray]:
        """The range, what ranges of pairs ask it, at which places, customers and log10 probabilities of the spellings of its words."""
        at_range = table["range"][0].as_py()
        mine, others = _halves(table)
        g, at, sizes = _range_grams(mine, context_ranges)
        logp = np.concatenate([_logs(b) for _, b in sorted(zip(answers["range"].to_pylist(), answers["told"].to_pylist(), strict=True))])
        assert len(logp) == len(g)
        places, count = _customers(others, int(offsets[at_range]), len(sizes))
        return at_range, others, places, count, np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=logp[at], minlength=len(sizes))

    def word_seatings(at_range: int, count: np.ndarray, spelling: np.ndarray):
        return seatings(count, 10.0**spelling, np.zeros(len(count), np.int64), 1, discount, [at_range, 7], word_tables)

    def tables_of_words(table: pa.Table, answers: pa.Table) -> pa.Table:
        at_range, _, _, count, spelling = spellings(table, answers)
        seen = count > 0
        return pa.table({"sweep": pa.array(range(KEPT), pa.int32()), "t": pa.array([float(t.sum()) for t in word_seatings(at_range, count[seen], spelling[seen])])})

    both = asked.groupBy("range").cogroup(spelled.groupBy("word_range"))
    kept = {r["sweep"]: r["t"] for r in both.applyInArrow(tables_of_words, "sweep int, t double").groupBy("sweep").agg(F.sum("t").alias("t")).collect()}
    word_totals_kept = [kept.get(k, 0.0) for k in range(KEPT)]

    def tell_words(table: pa.Table, answers: pa.Table) -> pa.Table:
        """log10 probabilities of words, to the ranges of pairs."""
        at_range, others, places, count, spelling = spellings(table, answers)
        seen, mean, base = count > 0, np.zeros(len(count)), 10.0**spelling
        for t, total in zip(word_seatings(at_range, count[seen], spelling[seen]), word_totals_kept, strict=True):
            own = count.astype(float)
            own[seen] -= discount * t
            mean += (own + (THETA + discount * total) * base) / (THETA + word_customers)
        # beyond the range of doubles the spelling alone counts
        back = np.log10((THETA + discount * np.mean(word_totals_kept)) / (THETA + word_customers))
        log = np.where(mean > 0, np.log10(np.maximum(mean / KEPT, 1e-300)), spelling + back)
        return pa.Table.from_arrays([others["range"], pa.array([-1 - c for c in others["chunk"].to_pylist()], pa.int64()), pa.array([b""] * others.num_rows, pa.binary()), pa.array([_fixed(log[i]) for i in places], pa.binary())], schema=_TOLD)

    drop_shuffles(docs)
    told_words = materialise(both.applyInArrow(tell_words, _TOLD_DDL), "pitman-yor-told")
    release(words, seated, grams_asked, spelled)

    def pairs_given(table: pa.Table, answers: pa.Table, only: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray, PairRange]:
        """Pairs as asked, log10 probabilities of the words of all distinct pairs, and the pairs' restaurants."""
        keys, key, count = _gathered_pairs(table, only)
        logp = np.concatenate([_logs(b) for _, b in sorted(zip(answers["range"].to_pylist(), answers["told"].to_pylist(), strict=True))])
        word = np.unique(np.concatenate([unpacked(b, np.uint32) for b in table["sizes"].to_pylist()]))
        assert len(word) == len(logp)
        log = logp[np.searchsorted(word, (key & _LOW).astype(np.uint32))]
        return keys, log, PairRange(key, count, 10.0**log, pair_discount, table["range"][0].as_py(), hot, hot_customers, hot_tables)

    def tables_of_hot(table: pa.Table, answers: pa.Table) -> pa.Table:
        return pa.table({"t": pa.array([pairs_given(table, answers, hot)[2].hot_totals().tobytes()], pa.binary())})

    both_pairs = pairs.withColumnRenamed("chunk", "asker").groupBy("range").cogroup(told_words.groupBy(F.col("chunk").cast("int")))
    # 4 numbers for each hot word (at most two for each range) from each range, added up as they come
    hot_kept = np.zeros((KEPT, len(hot)))
    for r in both_pairs.applyInArrow(tables_of_hot, "t binary").toLocalIterator():
        hot_kept += np.frombuffer(r["t"], float).reshape(KEPT, len(hot))

    drop_shuffles(docs)

    def tell_pairs(table: pa.Table, answers: pa.Table) -> pa.Table:
        keys, log, restaurants = pairs_given(table, answers, None)
        p = restaurants.predict(hot_kept)
        # beyond the range of doubles the parent alone counts
        out = np.where(p > 0, np.log10(np.maximum(p, 1e-300)), log)
        told = [_fixed(out[np.searchsorted(restaurants.key, k)]) for k in keys]
        return pa.Table.from_arrays([pa.array([ranges + r for r in table["range"].to_pylist()], pa.int32()), table["asker"], pa.array([b""] * table.num_rows, pa.binary()), pa.array(told, pa.binary())], schema=_TOLD)

    told_pairs = materialise(both_pairs.applyInArrow(tell_pairs, _TOLD_DDL), "pitman-yor-told-pairs")
    release(pairs, told_words)
    out = pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    rest = np.log10(n + 0.1 * (v + 1))

    def add_up(mine: pa.Table, answers: pa.Table) -> pa.Table:
        if not mine.num_rows:
            return pa.Table.from_pylist([], schema=out)
        from_words = np.array(answers["range"].to_pylist(), np.int64) < ranges
        chunk = Chunk(mine.to_pylist()[0])
        ids, count = ids_of(answers.filter(pa.array(from_words)))
        key, _, place, text = _pairs_of(chunk, ids, end, hot, ranges)
        of_pairs = answers.filter(pa.array(~from_words))
        logp = np.concatenate([_logs(b) for _, b in sorted(zip(of_pairs["range"].to_pylist(), of_pairs["told"].to_pylist(), strict=True))])
        assert len(logp) == len(key)
        n_w, docs_here = chunk.n, len(chunk.n)
        doc = np.repeat(np.arange(docs_here), n_w)
        base = np.bincount(doc, weights=np.log10(count[chunk.at] + 0.1), minlength=docs_here) + np.log10(train_docs + 0.1) - (n_w + 1) * rest
        known = np.bincount(doc, weights=count[chunk.at] > 0, minlength=docs_here).astype(np.int64) + (train_docs > 0)
        return pa.Table.from_arrays([pa.array(chunk.ids, pa.int64()), pa.array(chunk.train), pa.array(n_w + 1), pa.array(known), pa.array(np.full(docs_here, n)), pa.array(base), pa.array(np.bincount(text, weights=logp[place], minlength=docs_here))], schema=out)

    return chunks.groupBy("chunk").cogroup(numbered.unionByName(told_pairs).groupBy("chunk")).applyInArrow(add_up, "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op9_pitman_yor(spark, sf_dir: str) -> DataFrame:
    """Log probabilities of all ``documents`` under a unigram of words and under the hierarchical Pitman-Yor model."""
    d = score(read_table(spark, sf_dir, "documents"), fold("doc_id", 10) != 0)
    return d.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
