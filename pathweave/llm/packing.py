"""Best-fit packing by patterns.

Documents become pieces of at most ``capacity`` tokens. The histogram of piece lengths (at most ``capacity`` numbers, however
large the corpus) goes to the driver, where few-document patterns that fill a sequence exactly are enumerated, repeat counts
are fitted to the histogram by non-negative least squares and rounded down, and what is left over is packed by best fit,
pattern by pattern. The plan is a short list of runs: pieces of length l with ranks from r on go to sequences from s on, at one
offset. A piece's rank among its length is a count within its task plus the counts of the tasks before, so no group is ever
collected or sorted in one place.

Edge cases: a null or empty text is one piece holding id 0; repeated rows, and rows with a null id, are separate documents; an
empty table has no pieces.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import crc, id_and_text, materialise, pieces, read_table, record, trim_memory

CAPACITY = 2048
END_ID = 0
#: Entries of the cache of word encodings in one worker: some 100 MB.
CACHE = 600_000
_UNSAFE = re.compile(r" \s")


#: Fixed value: the pre-token pattern of byte-level BPE, as published with the vocabulary files.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def rank_encoder(path: str):
    """The tokenizer file's own vocabulary as ranks for tiktoken, which encodes single words several times faster.

    Only where that must give the same ids: byte-level BPE without normaliser or prefix space whose ids rise with the merges.
    Returns the encoder and the added tokens' strings, or None.
    """
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    plain = model.get("type") == "BPE" and not spec["normalizer"] and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    if not plain or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    vocab, added = model["vocab"], [a["content"] for a in spec["added_tokens"]]
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(x >= y for x, y in zip(merged[:-1], merged[1:], strict=True)):
        return None
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(visible)]
    byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in added}
    if len(ranks) + len(set(added) & set(vocab)) != len(vocab) or any(bytes([b]) not in ranks for b in range(256)):
        return None
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={}), added


class Encoder:
    """Token ids as little-endian 32-bit bytes, cached by space-separated part.

    A space before a character that is not white space always begins a pre-token of a byte-level BPE, so parts split there are
    encoded apart with the same result. Texts with a space before white space are encoded whole, and whatever holds the
    string of an added token is left to the tokenizer itself.
    """

    def __init__(self, path: str, ranks: bool = True) -> None:
        self.path = path
        self.ranks, self.added = (ranks and rank_encoder(path)) or (None, [])
        self.cache: dict[str, bytes] = {}

    @cached_property
    def tokenizer(self):
        """The tokenizer itself, which few texts need where there are ranks."""
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _slowly(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _encode(self, parts: list[str]) -> dict[str, bytes]:
        if self.ranks is None:
            return dict(zip(parts, self._slowly(parts), strict=True))
        encode = self.ranks.encode_ordinary
        slow = [p for p in parts if any(a in p for a in self.added)]
        out = {p: array("I", encode(p)).tobytes() for p in parts}
        return out | dict(zip(slow, self._slowly(slow), strict=True)) if slow else out

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > CACHE:
            self.cache.clear()
        split, cache = [], self.cache
        for t in texts:
            if _UNSAFE.search(t):
                split.append([t])
            else:
                first, *rest = t.split(" ")
                split.append([first, *map(" ".__add__, rest)] if rest else [first])
        own = self._encode(list(set(chain.from_iterable(split)).difference(cache)))
        cache.update((k, v) for k, v in own.items() if len(k) < 64)
        own = {k: v for k, v in own.items() if len(k) >= 64}
        get = cache.get
        return [b"".join([get(p) if len(p) < 64 else own[p] for p in parts]) for parts in split]


_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()), ("chunk", pa.int64()), ("rank_in_chunk", pa.int64())])
_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, chunk long, rank_in_chunk long"


def cut(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of every document, numbered by length within their task (``chunk``, ``rank_in_chunk``). Only documents over the
    capacity are cut; their first piece takes what does not fill a whole one."""

    def pieces_of(batches):
        chunk, seen, own = TaskContext.get().partitionId(), defaultdict(int), None
        try:
            for batch in batches:
                own = own or Encoder(tokenizer_path)
                ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                for part in pieces([len(t) for t in texts], 1 << 20):
                    out = {f.name: [] for f in _PIECE}
                    for doc, raw in zip(ids[part], own.encode(texts[part]), strict=True):
                        raw += END_ID.to_bytes(4, "little")
                        n = len(raw) // 4
                        at, length = 0, n % capacity or min(n, capacity)
                        k = 0
                        while at < n:
                            cut_ids = raw[4 * at : 4 * (at + length)]
                            for name, v in (("doc_id", doc), ("piece", k), ("start", at), ("length", length), ("ids_crc32", crc(cut_ids)), ("ids", cut_ids if keep_ids else None), ("chunk", chunk), ("rank_in_chunk", seen[length])):
                                out[name].append(v)
                            seen[length] += 1
                            at, k, length = at + length, k + 1, capacity
                    yield record(out, _PIECE)
        finally:
            # tasks take the workers in turn, those of earlier stages too: what waits for its next task holds no encoder
            own = None
            trim_memory()

    return id_and_text(docs).mapInArrow(pieces_of, _DDL)


def exact_patterns(counts: np.ndarray, capacity: int, per_length: int = 6) -> list[tuple[int, ...]]:
    """Lengths, falling, that fill a sequence exactly: one, two, or three documents, the frequent ones first for threes."""
    present = np.flatnonzero(counts)
    out = [(capacity,)] if counts[capacity] else []
    out += [(int(a), int(capacity - a)) for a in present if a * 2 >= capacity and a < capacity and counts[capacity - a]]
    common = sorted(present.tolist(), key=lambda a: (-counts[a], a))[:64]
    for a in present.tolist():
        took = 0
        for b in common:
            c = capacity - a - b
            if c >= 1 and counts[c] and a >= b >= c:
                out.append((a, b, c))
                took += 1
                if took == per_length:
                    break
    return out


def fit_repeats(patterns: list[tuple[int, ...]], counts: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Non-negative least squares of pattern repeats against the histogram, by cyclic coordinate descent."""
    x = np.zeros(len(patterns))
    rest = counts.astype(float).tolist()
    columns = []
    for p in patterns:
        use: dict[int, int] = {}
        for a in p:
            use[a] = use.get(a, 0) + 1
        columns.append((tuple(use.items()), float(sum(m * m for m in use.values()))))
    for _ in range(sweeps):
        moved = 0.0
        for j, (use, norm) in enumerate(columns):
            step = sum(m * rest[a] for a, m in use) / norm
            step = max(step, -x[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for a, m in use:
                    rest[a] -= m * step
        if moved < 0.05:
            break
    return x


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use every piece of the histogram exactly once. Its length is bounded by the capacity, not by the corpus."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    patterns = exact_patterns(left, capacity)
    fitted = fit_repeats(patterns, left)
    for j in np.argsort(-fitted, kind="stable"):
        times = int(fitted[j] + 1e-9)
        for a in set(patterns[j]):
            times = min(times, int(left[a]) // patterns[j].count(a))
        if times > 0:
            out.append((patterns[j], times))
            for a in patterns[j]:
                left[a] -= times
    # best fit for the rest: the longest piece, then whatever leaves the least room, as often as the counts allow
    while left.any():
        present = np.flatnonzero(left)
        use: dict[int, int] = {}
        room, pattern = capacity, []
        while True:
            fits = present[(present <= room)]
            fits = [a for a in fits[::-1][:8].tolist() if left[a] > use.get(a, 0)] or [a for a in fits[::-1].tolist() if left[a] > use.get(a, 0)][:1]
            if not fits:
                break
            a = fits[0]
            if pattern and a < room:
                # a pair that fills the room exactly is better than the longest single piece
                have = set(present.tolist())
                for b in fits:
                    c = room - b
                    if c in have and left[c] > use.get(c, 0) + (c == b) and c >= 1:
                        a = b
                        break
            pattern.append(a)
            use[a] = use.get(a, 0) + 1
            room -= a
            if not room:
                break
        times = min(int(left[a]) // m for a, m in use.items())
        out.append((tuple(pattern), times))
        for a, m in use.items():
            left[a] -= m * times
    return out


def runs(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """The plan as sorted runs: key = length << 40 | first rank, with the first sequence and the offset."""
    rank: dict[int, int] = defaultdict(int)
    keys, sequences, offsets, base = [], [], [], 0
    for pattern, times in patterns:
        at = 0
        for a in pattern:
            keys.append((a << 40) + rank[a])
            sequences.append(base)
            offsets.append(at)
            rank[a] += times
            at += a
        base += times
    order = np.argsort(np.array(keys, np.int64))
    return {k: np.array(v, np.int64)[order] for k, v in (("key", keys), ("sequence", sequences), ("offset", offsets))}


def place(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to materialised pieces."""
    per_chunk = cut_pieces.groupBy("chunk", "length").agg(F.count("*").alias("n"))
    per_chunk = materialise(per_chunk, "packing-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for r in per_chunk.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r["length"]] = r["n"]
    table = runs(plan(counts, capacity))
    before = per_chunk.select("chunk", "length", (F.sum("n").over(W.partitionBy("length").orderBy("chunk")) - F.col("n")).alias("before"))
    ranked = cut_pieces.join(before, ["chunk", "length"]).withColumn("rank", F.col("before") + F.col("rank_in_chunk")).drop("before", "rank_in_chunk", "chunk")
    out = pa.schema([(f, t) for f, t in (("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()))])

    def assign(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            i = np.searchsorted(table["key"], (length << 40) + rank, side="right") - 1
            own = table["key"][i] - (length << 40)
            cols = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            yield pa.RecordBatch.from_arrays([*(cols[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(table["sequence"][i] + rank - own), pa.array(table["offset"][i]), cols["ids"]], schema=out)

    return ranked.mapInArrow(assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids binary")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and the ids themselves, if asked for) of every piece."""
    return place(materialise(cut(docs, tokenizer_path, capacity, keep_ids), "packing-pieces"), capacity)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """All ``documents`` packed into sequences of 2048 tokens."""
    return pack(read_table(spark, sf_dir, "documents"), tokenizer_path or default_tokenizer()).drop("ids")
