"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts are compared as words joined by one space, with A-Z lowered. Windows of an item's size are laid at any byte: every run of ``GRAM``
bytes of the document is looked up among the rarer half of each item's runs (rare among items; an index need not hold every
run), and a window is laid where enough of them stand within the diagonals that ``max_edit`` can reach; how many are enough is
set from the trials below (items under ``SHORT`` bytes: all runs, and one is enough, so short that some copy of it outlives any edits). The CGK random walk reads a string with a
pointer that moves on or stays by a random bit for each step and symbol; strings at a small edit distance then agree in most
places. Each of several tables samples some places; a window stays if it agrees with the item in all places of ``AGREE`` tables.
The numbers of runs and of tables are set from trials, item texts with random edits at the threshold inside other text, so that a passage
passes the whole search with ``recall`` at least; tables that must agree go down from ``AGREE`` where 400 are not enough. What stays is verified: the least edit distance of the item to any substring around the window
(bit-parallel, exact) must be at most ``max_edit`` of the item's length.

Benchmark items come in blocks of bounded size, each broadcast and held against all documents. Edge cases: null, empty and
whitespace texts and items match nothing; a document shorter than the item may still match within the edit bound; a null
doc_id or item_id is left out; repeated rows give equal results; empty tables give an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, pieces, read_table, record

GRAM, SHORT = 6, 60
#: Texts are searched in stretches of so many bytes, with overlaps that hold any window.
STRETCH = 1 << 13
#: Length of the embedding in lengths of the string: about as many steps as the pointer needs, as what follows its end agrees
#: in all texts and tells nothing.
STEPS = 2
#: Tables that must agree: one agrees by chance too often, and each needless verification costs more than some tables.
AGREE = 3
BLOCK_BYTES = 8 << 20
#: Items up to so many bytes are verified many at a time.
TOGETHER = 2048


def normal(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def least_distance(item: bytes, text: bytes) -> tuple[int, int]:
    """(least edit distance of the item to any substring of the text, where that substring ends): Myers' bit vectors."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[int, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    up, down, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = where.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = (down | ~(xh | up)) & full, up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        up, down = (mh | ~(xv | ph)) & full, ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def least_distances(items: list[bytes], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``least_distance`` of each pair, a column of all their tables at a time."""
    height, width = max(map(len, items)), max(map(len, texts))
    item, text = np.zeros((len(items), height), np.uint8), np.zeros((len(items), width), np.uint8)
    for k, (i, t) in enumerate(zip(items, texts, strict=True)):
        item[k, : len(i)] = np.frombuffer(i, np.uint8)
        text[k, : len(t)] = np.frombuffer(t, np.uint8)
    down = np.arange(height + 1, dtype=np.int16)
    row, last, size = np.arange(len(items)), np.array([len(i) for i in items]), np.array([len(t) for t in texts])
    column = np.broadcast_to(down, (len(items), height + 1)).copy()
    best, end = last.astype(np.int16), np.zeros(len(items), np.int64)
    for j in range(width):
        new = np.zeros_like(column)
        np.minimum(column[:, :-1] + (item != text[:, j, None]), column[:, 1:] + np.int16(1), out=new[:, 1:])
        # steps down add one each: a running minimum of what is left after taking them off
        new -= down
        np.minimum.accumulate(new, axis=1, out=new)
        new += down
        column, now = new, new[row, last]
        less = (now < best) & (j < size)
        best[less], end[less] = now[less], j + 1
    return best.astype(np.int64), end


class Walks:
    """Random walks over bytes: for each walk, step and symbol whether the pointer moves on."""

    def __init__(self, walks: int, steps: int, seed: int = 11) -> None:
        self.moves = np.random.default_rng(seed).integers(0, 2, (walks, steps, 256), dtype=np.uint8)

    def embed(self, texts: list[bytes], walk: int, steps: int) -> np.ndarray:
        """Row s holds the symbol that each text shows at step s; 0 beyond its end."""
        width = max(map(len, texts)) + 1
        grid = np.zeros((len(texts), width), np.uint8)
        for i, t in enumerate(texts):
            grid[i, : len(t)] = np.frombuffer(t, np.uint8)
        flat, base = grid.ravel(), np.arange(len(texts)) * width
        last = base + width - 1
        at = base.copy()
        out = np.empty((steps, len(texts)), np.uint8)
        for s in range(steps):
            c = flat[at]
            out[s] = c
            at += self.moves[walk, s, c]
            np.minimum(at, last, out=at)
        return out


def packed(text: bytes, q: int) -> np.ndarray:
    """All runs of q <= 8 bytes as numbers."""
    n = len(text) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    have, out, at = {1: np.frombuffer(text, np.uint8).astype(np.uint64)}, np.zeros(n, np.uint64), 0
    for k in (1, 2, 4):
        have[2 * k] = have[k][:-k] << np.uint64(8 * k) | have[k][k:] if len(have[k]) > k else have[k][:0]
    for k in (8, 4, 2, 1):
        if q & k:
            out = out << np.uint64(8 * k) | have[k][at : at + n]
            at += k
    return out


class Seeds:
    """Runs of q bytes of some items: where each stands. ``rarer``: only the half of each item's runs that is rarest among items."""

    BITS = 20

    def __init__(self, texts: list[bytes], members: list[int], q: int, rarer: bool = False) -> None:
        self.q = q
        grams = [packed(texts[j], q) for j in members]
        every, sizes = np.concatenate(grams), np.array([len(g) for g in grams])
        item, offset = np.repeat(np.array(members), sizes), np.concatenate([np.arange(n) for n in sizes])
        if rarer:
            _, at, count = np.unique(every, return_inverse=True, return_counts=True)
            rank = np.lexsort((every * np.uint64(0x9E3779B97F4A7C15), count[at], item))
            first = np.repeat(np.cumsum(sizes) - sizes, sizes)
            kept = np.sort(rank[np.arange(len(rank)) - first < np.repeat((sizes + 1) // 2, sizes)])
            every, item, offset = every[kept], item[kept], offset[kept]
        order = np.argsort(every, kind="stable")
        self.item, self.offset = item[order], offset[order]
        self.runs = np.bincount(item, minlength=len(texts))
        self.grams, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.present = np.zeros(1 << self.BITS, bool)
        self.present[self._slot(self.grams)] = True

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return (grams * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def hits(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """item, its offset, byte of the text of every shared run."""
        g = packed(text, self.q)
        pos = np.flatnonzero(self.present[self._slot(g)])
        at = np.minimum(np.searchsorted(self.grams, g[pos]), len(self.grams) - 1)
        same = self.grams[at] == g[pos]
        pos, at = pos[same], at[same]
        n = self.count[at]
        index = np.arange(int(n.sum())) + np.repeat(self.first[at] - (np.cumsum(n) - n), n)
        return self.item[index], self.offset[index], np.repeat(pos, n)


@dataclass
class Items:
    """A block of benchmark items prepared for matching."""

    ids: np.ndarray
    texts: list[bytes]
    bounds: np.ndarray
    seeds: list[Seeds]
    need: np.ndarray
    reach: np.ndarray
    walks: Walks
    places: list[tuple[int, np.ndarray]]
    signatures: list[np.ndarray]
    agree: int = AGREE

    def votes(self, item: np.ndarray, windows: list[bytes]) -> np.ndarray:
        """In how many tables windows agree with their items in all sampled places."""
        votes = np.zeros(len(windows), np.int32)
        for i in range(0, len(windows), 4096):
            part, own = windows[i : i + 4096], item[i : i + 4096]
            steps = max(STEPS * len(self.texts[j]) for j in np.unique(own))
            for walk in range(len(self.walks.moves)):
                seen = self.walks.embed(part, walk, steps)
                for (w, share), mine in zip(self.places, self.signatures, strict=True):
                    if w == walk:
                        at = (share[:, None] * (STEPS * self.bounds[own])[None, :]).astype(np.int64)
                        votes[i : i + 4096] += (seen[at, np.arange(len(part))[None, :]] == mine[:, own]).all(axis=0)
        return votes

    def filter(self, item: np.ndarray, windows: list[bytes]) -> np.ndarray:
        return self.votes(item, windows) >= self.agree

    def distances(self, windows: list[tuple[int, int, int]], texts: list[bytes], max_edit: float):
        """document, item, least edit distance around the window, where that ends; of windows (document, item, byte)."""
        windows = sorted(windows, key=lambda w: len(self.texts[w[1]]))
        for part in pieces([max(1, len(self.texts[i]) // 8) for _, i, _ in windows], 8192):
            mine, around, low = [], [], []
            for d, i, s in windows[part]:
                most = int(max_edit * len(self.texts[i]))
                low.append(max(0, s - 2 * most))
                mine.append(self.texts[i])
                around.append(texts[d][low[-1] : s + len(self.texts[i]) + 2 * most])
            if len(mine[-1]) > TOGETHER:
                found = [least_distance(i, t) for i, t in zip(mine, around, strict=True)]
            else:
                found = list(zip(*(x.tolist() for x in least_distances(mine, around)), strict=True))
            for (d, i, _), (distance, end), start in zip(windows[part], found, low, strict=True):
                yield d, i, distance, start + end


def edited(text: bytes, edits: int, rng: np.random.Generator) -> bytes:
    """The text after so many random insertions, deletions and substitutions."""
    out = list(text)
    for _ in range(edits):
        kind, at = int(rng.integers(3)), int(rng.integers(max(1, len(out))))
        symbol = int(rng.integers(97, 123))
        if kind == 0 or not out:
            out.insert(at, symbol)
        elif kind == 1:
            out.pop(at)
        else:
            out[at] = symbol
    return bytes(out)


def prepare(rows: list[tuple[int, str]], max_edit: float, recall: float, walks: int = 4, places: int = 3, trials: int = 400) -> Items | None:
    """Seeds and tables for a block of items; how many must agree follows from how often they survive edits at the threshold."""
    kept = [(i, t) for i, t in ((i, normal((t or "").encode())) for i, t in rows) if i is not None and t]
    if not kept:
        return None
    ids, texts = np.array([i for i, _ in kept], np.int64), [t for _, t in kept]
    bounds = np.array([len(t) for t in texts])
    longest = int(bounds.max())
    most = (max_edit * bounds).astype(np.int64)
    # of k + 1 equal pieces, k edits leave one whole
    grams = np.where(bounds >= SHORT, GRAM, np.minimum(GRAM, np.maximum(1, bounds // (most + 1))))
    kinds = sorted({(int(q), bool(n >= SHORT)) for q, n in zip(grams, bounds, strict=True)})
    seeds = [Seeds(texts, np.flatnonzero((grams == q) & ((bounds >= SHORT) == long)).tolist(), q, long) for q, long in kinds]
    random = Walks(walks, STEPS * longest)
    items = Items(ids, texts, bounds, seeds, np.ones(len(texts), np.int64), np.maximum(most, 1), random, [], [])
    rng = np.random.default_rng(5)
    chosen = rng.integers(0, len(texts), trials)
    around = [texts[i] for i in rng.integers(0, len(texts), 2 * trials)]
    tried = [b" ".join((around[2 * i], edited(texts[j], int(most[j]), rng), around[2 * i + 1])) for i, j in enumerate(chosen)]
    # shared runs of random edits: their share, less what all but an eighth of the allowed misses stay above
    share, spread = (1 - max_edit) ** GRAM, np.sqrt(np.maximum(sum(x.runs for x in seeds), 1))
    seen = np.array([max((n for i, _, n in laid(items, t) if i == j), default=0) for j, t in zip(chosen, tried, strict=True)])
    long = bounds[chosen] >= SHORT
    if long.any():
        runs = spread[chosen] ** 2
        low = np.quantile(((seen - share * runs) / spread[chosen])[long], (1 - recall) / 8, method="lower")
        items.need = np.where(bounds >= SHORT, np.maximum(1, np.floor(share * spread**2 + low * spread)), 1).astype(np.int64)
    found = [(k, s) for k, (j, t) in enumerate(zip(chosen, tried, strict=True)) for i, s, _ in laid(items, t) if i == j]
    of, own = np.array([k for k, _ in found], np.int64), chosen[[k for k, _ in found]]
    windows = [tried[k][s : s + int(bounds[chosen[k]])] for k, s in found]
    shown = [random.embed(texts, w, STEPS * longest) for w in range(walks)]
    width = np.arange(len(windows))[None, :]
    agreement = [random.embed(windows, w, STEPS * longest) == shown[w][:, own] for w in range(walks)] if windows else []
    votes = np.zeros(len(windows), np.int32)
    for k in range(400 if windows else 0):
        w, part = k % walks, rng.random(places)
        at = (part[:, None] * (STEPS * bounds)[None, :]).astype(np.int64)
        items.places.append((w, part))
        items.signatures.append(shown[w][at, np.arange(len(texts))[None, :]])
        votes += agreement[w][at[:, own], width].all(axis=0)
        best = np.zeros(trials, np.int32)
        np.maximum.at(best, of, votes)
        if k >= 7 and (best < AGREE).mean() <= (1 - recall) / 2:  # half, as trials vary
            break
    best = np.zeros(trials, np.int32)
    np.maximum.at(best, of, votes)
    items.agree = next((a for a in range(AGREE, 0, -1) if (best < a).mean() <= (1 - recall) / 2), 0)
    return items


def laid(items: Items, text: bytes) -> list[tuple[int, int, int]]:
    """(item, byte offset, shared runs) of the windows that shared runs suggest. A window's runs lie in two neighbouring bands of diagonals,
    each as wide as the edits allow, so no alignment within the bound falls between; it starts where its earliest run puts the item."""
    overlap = 2 * int(items.bounds.max()) + 2 * int(items.reach.max())
    out: dict[tuple[int, int], int] = {}
    for start in range(0, max(1, len(text) - overlap), STRETCH):
        stretch = text[start : start + STRETCH + overlap]
        for seeds in items.seeds:
            item, offset, pos = seeds.hits(stretch)
            # items with too few runs in the whole stretch have too few in any window of it
            many = (np.bincount(item, minlength=len(items.texts)) >= items.need)[item]
            item, offset, pos = item[many], offset[many], pos[many]
            if not len(item):
                continue
            bands = pos - offset + 2 * overlap
            bands //= items.reach[item]
            key = item << 40 | bands
            ordered = np.sort(key)
            first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            u, n = ordered[first], np.diff(np.append(first, len(ordered)))
            both = n.copy()
            both[:-1] += np.where(u[1:] == u[:-1] + 1, n[1:], 0)
            good = both >= items.need[u >> 40]
            # of overlapping windows the one with more runs
            before = np.concatenate([[False], (u[1:] == u[:-1] + 1) & (both[:-1] >= both[1:])])
            after = np.concatenate([(u[1:] == u[:-1] + 1) & (both[1:] > both[:-1]), [False]])
            good &= ~(before | after)
            u, both = u[good], both[good]
            if not len(u):
                continue
            at = np.searchsorted(u, key, side="right") - 1
            mine = np.flatnonzero((at >= 0) & (key - u[np.maximum(at, 0)] <= 1))
            mine = mine[np.lexsort((offset[mine], at[mine]))]
            lead = mine[np.concatenate([[True], at[mine][1:] != at[mine][:-1]])]
            for j, s, c in zip(item[lead].tolist(), np.maximum(pos[lead] - offset[lead], 0).tolist(), both.tolist(), strict=True):
                out[j, start + s] = max(c, out.get((j, start + s), 0))
    return [(j, s, c) for (j, s), c in sorted(out.items())]


_MATCH = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edit_distance", pa.int64()), ("item_bytes", pa.int64()), ("end_byte", pa.int64())])


def matches(docs: DataFrame, benchmark: DataFrame, max_edit: float = 0.2, recall: float = 0.98) -> DataFrame:
    """doc_id, item_id, edit_distance, item_bytes, end_byte (in the joined words): the best place of each item found in a document."""
    spark = docs.sparkSession
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).collect()[0]
    blocks = max(1, -(-(size["b"] or 0) // BLOCK_BYTES), -(-size["n"] // 50_000))
    out = None
    for k in range(blocks):
        rows = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()]
        block = prepare(rows, max_edit, recall)
        if block is None:
            continue
        shared = spark.sparkContext.broadcast(block)

        def find(batches, shared=shared):
            block = shared.value
            for batch in batches:
                ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                for part in pieces([len(t) for t in texts], 1 << 21):
                    own = [normal(t.encode()) for t in texts[part]]
                    windows = [(d, i, s) for d, t in enumerate(own) for i, s, _ in laid(block, t)]
                    ok = block.filter(np.array([i for _, i, _ in windows], np.int64), [own[d][s : s + len(block.texts[i])] for d, i, s in windows])
                    best: dict[tuple[int, int], tuple[int, int]] = {}
                    for d, i, distance, end in block.distances([windows[k] for k in np.flatnonzero(ok)], own, max_edit):
                        if (distance, end) < best.get((d, i), (int(max_edit * len(block.texts[i])) + 1, 0)):
                            best[d, i] = (distance, end)
                    keys = sorted(best)
                    yield record({"doc_id": [ids[part][d] for d, _ in keys], "item_id": [int(block.ids[i]) for _, i in keys], "edit_distance": [best[k][0] for k in keys], "item_bytes": [len(block.texts[i]) for _, i in keys], "end_byte": [best[k][1] for k in keys]}, _MATCH)

        found = id_and_text(docs).where(F.col("doc_id").isNotNull()).mapInArrow(find, "doc_id long, item_id long, edit_distance long, item_bytes long, end_byte long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return id_and_text(docs).limit(0).select("doc_id", *(F.lit(0).cast("long").alias(c) for c in ("item_id", "edit_distance", "item_bytes", "end_byte")))
    return out


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, exactly or nearly, with the item."""
    found = matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.withColumn("similarity", 1 - F.col("edit_distance") / F.col("item_bytes"))
